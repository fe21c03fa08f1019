"""The record store as a stream: files of attempts in, the latest record of each key out.

The stream holds nothing but its place in the files: each batch's own records are combined and committed to the store, which settles what is latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LOG
from .store import RecordStore


def attempts(spark: SparkSession, path: str, schema=LOG, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def start_store(stream: DataFrame, store: RecordStore, checkpoint: str, writer: str = "stream", **trigger):
    """Commit every batch of the stream to the store, once each; ``store.current()`` reads it."""
    query = stream.writeStream.foreachBatch(store.sink(writer)).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
