"""Reference-shaped views of the supplied star-schema tables, so that every report can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .run_log import last_write_wins

KEYS = ["model", "benchmark", "task_id"]
ARCHITECTURE = {"m0": "LLM", "m1": "MoE", "m2": "SLM"}
PRICE = {"m0": (5.0, 25.0), "m1": (0.435, 0.87), "m2": (0.15, 0.15)}
MODELS, BENCHES = ("m0", "m1", "m2"), ("b0", "b1", "b2", "b3", "b4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_TABLE = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table of SMALL_TABLE bytes at most, in fewer files than there are cores, dealt to all cores for work that is long for its bytes:
    each file may be one row group, which only one task can read. Larger tables stay where they are."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL_TABLE and len(df.inputFiles()) < cores else df


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("b"), (F.col("k") % 5).cast("string")).alias("benchmark"),
        F.concat(F.lit("t/"), ((F.col("user_id") - F.col("user_id") % 3) / 3).cast("long").cast("string")).alias("task_id"),
        F.when(kind.isin("click", "view"), "Passed").when(kind == "purchase", "AssertionError").when(kind == "signup", "APIError").otherwise("SyntaxError").alias("category"),
        F.when(F.col("k") % 5 != 4, F.col("value") / 700).alias("score"),
        F.when(kind != "signup", F.floor("value").cast("long")).alias("input_tokens"),
        F.when(kind != "signup", F.col("k") * 10).alias("output_tokens"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_write_wins(attempts(spark, sf_dir), KEYS).withColumn("solved", F.col("category") == "Passed")


def dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, m, ARCHITECTURE[m], *PRICE[m]) for i, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "rank int, model string, architecture string, price_in double, price_out double")
