"""Stored answers of models as a data source: ``spark.read.format("logged_answers")``, and ``readStream`` too.

``log_answers`` keeps answers as JSON lines in a folder a model. The source lists the folders of the models that a filter on ``model`` leaves (``=`` and ``in``
are taken over, other filters stay with Spark), cuts large files into ranges of RANGE bytes, and each partition reads the lines that begin in its range.
As a stream it goes by the files' times and names: a file is read once, when it has come.

It reads through pyarrow's file systems, on executors: any store that these open. Lines that are no JSON object are skipped, as in the run log; fields that are missing
are null; a model's name is that of its folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .generation import USAGE

SCHEMA = f"model string, task_id string, raw string, usage {USAGE}"
COUNTS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
NAME, RANGE, ROWS, NO_MODEL = "logged_answers", 64 << 20, 1000, "__HIVE_DEFAULT_PARTITION__"


def log_answers(answers: DataFrame, path: str) -> None:
    """Add answers (SCHEMA) to a log."""
    answers.select("model", "task_id", "raw", "usage").write.mode("append").partitionBy("model").json(path)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, models: set | None = None) -> list[tuple[str, str | None, int, int]]:
    """(file, model, bytes, time in nanoseconds) of a log's files; of these models only, whose folders alone are looked into."""
    from pyarrow import fs

    store, top = _opened(path)
    out = []
    for folder in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        name = unquote(folder.base_name.removeprefix("model="))
        model = None if name == NO_MODEL else name
        if folder.base_name.startswith("model=") and (models is None or model in models):
            out += [(f.path, model, f.size, f.mtime_ns) for f in store.get_file_info(fs.FileSelector(folder.path)) if f.is_file and f.base_name[0] not in "._"]
    return sorted(out, key=lambda x: x[0])


@dataclass
class Range(InputPartition):
    file: str
    model: str | None
    start: int
    end: int


def _ranges(files) -> list[Range]:
    return [Range(f, m, at, min(at + RANGE, size)) for f, m, size, _ in files for at in range(0, size, RANGE)]


def lines_of(path: str, part: Range) -> Iterator[bytes]:
    """The lines that begin in the range; the last of them is read to its end."""
    store, _ = _opened(path)
    with store.open_input_file(part.file) as f:
        f.seek(max(0, part.start - 1))
        at, held = f.tell(), b""
        skip = part.start > 0
        while True:
            chunk = f.read(1 << 20)
            held += chunk
            *whole, held = held.split(b"\n") if chunk else [held, b""]
            for line in whole:
                if not skip and at < part.end and line:
                    yield line
                skip = False
                at += len(line) + 1
                if at >= part.end:
                    return
            if not chunk:
                return


def _rows(path: str, part: Range):
    import pyarrow as pa

    text = pa.string()
    schema = pa.schema([("model", text), ("task_id", text), ("raw", text), ("usage", pa.struct([(c, pa.int64()) for c in COUNTS]))])
    held = []
    for line in lines_of(path, part):
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            row = {k: found[k] for k in ("task_id", "raw") if isinstance(found.get(k), str)}
            usage = found["usage"] if isinstance(found.get("usage"), dict) else None
            counts = usage and {c: usage[c] if isinstance(usage.get(c), int) else None for c in COUNTS}
            held.append({"model": part.model, "usage": counts} | row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.models = path, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("model",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.models = own if self.models is None else self.models & own
            else:
                yield f

    def partitions(self):
        return _ranges(listed(self.path, self.models)) or [Range("", None, 0, 0)]

    def read(self, partition):
        if partition.file:
            yield from _rows(self.path, partition)


class Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"time": -1, "file": ""}

    def latestOffset(self):
        last = max(((t, f) for f, _, _, t in listed(self.path)), default=(-1, ""))
        return {"time": last[0], "file": last[1]}

    def partitions(self, start, end):
        low, high = (start["time"], start["file"]), (end["time"], end["file"])
        return _ranges(x for x in listed(self.path) if low < (x[3], x[0]) <= high)

    def read(self, partition):
        yield from _rows(self.path, partition)

    def commit(self, end):
        pass


class LoggedAnswers(DataSource):
    """Option path: the log's folder."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])

    def streamReader(self, schema):
        return Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters over."""
    spark.dataSource.register(LoggedAnswers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
