"""The append-only run log: JSON lines of attempts, of which the last of each key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOG, USUAL_METRICS


def read_log(spark: SparkSession, path: str, metrics: str | None = None) -> DataFrame:
    """Attempts; lines that are blank, cut off or without a task_id are skipped. metrics: the type of that column, where there are
    more measures than the usual one."""
    schema = LOG.replace(USUAL_METRICS, metrics) if metrics else LOG
    text = spark.read.text(path)
    parsed = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*").filter(F.col("task_id").isNotNull())


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def truncate_log(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LOG).write.mode("overwrite").json(path)


def last_write_wins(attempts: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row a key, of greatest ``order``. An aggregate, not a window: it combines before the shuffle."""
    rest = [c for c in attempts.columns if c not in keys]
    latest = attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return latest.select(*keys, "_last.*").select(*attempts.columns)


def todo(problems: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Problems without a record, or whose last one is an API failure."""
    done = records.filter(F.col("category") != "APIError").select(*keys)
    return problems.join(done, keys, "left_anti")
