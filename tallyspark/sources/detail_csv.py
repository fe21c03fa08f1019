"""Detail tables as CSV: read with their model and benchmark, and written with a byte-order mark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_detail(spark: SparkSession, path: str, model: str, benchmark: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df.withColumns({"model": F.lit(model), "benchmark": F.lit(benchmark), "solved": strip("`pass@1`") == "passed"})


def read_all(spark: SparkSession, root: str, models: list[str], benchmarks: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(all detail tables there are, by column names; the paths that are missing)."""
    found, missing = [], []
    for model in models:
        for bench in benchmarks:
            path = f"{root}/{model}/{bench}/detail.csv"
            found.append(read_detail(spark, path, model, bench)) if path_exists(spark, path) else missing.append(path)
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None), missing


def write_detail(df: DataFrame, path: str) -> None:
    """Partitioned CSV files; each has its header. The first column's name begins with a byte-order mark."""
    marked = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    marked.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
