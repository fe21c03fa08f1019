from . import ingest, registry  # noqa: F401  both register queries
