"""Problem sets as typed DataFrames: declared schemas, pruned and filtered scans, no inference."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import LANGUAGES, LIBRARIES
from ..functions.code import strip_docstrings
from ..schemas import PROBLEMS
from . import shared_files


def first_rows(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def humaneval(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parquet with an ``ordinal``; codice_completo is the prompt and the solution without docstrings."""
    df = spark.read.parquet(path)
    if "ordinal" not in df.columns:
        df = df.withColumn("ordinal", F.regexp_extract("task_id", r"(\d+)$", 1).try_cast("long"))
    whole = strip_docstrings(F.concat("prompt", "canonical_solution"))
    return first_rows(df, limit, "ordinal", "task_id").withColumn("codice_completo", whole)


def mbpp(splits: list[DataFrame], limit: int | None = None) -> DataFrame:
    """All splits together, tasks 11 to 510."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits)
    return first_rows(df.filter(F.col("task_id").between(11, 510)), limit, "task_id")


def canonical_library(name: str) -> str:
    """The library's own spelling; an unknown one is an error."""
    for known in LIBRARIES:
        if known.lower() == name.lower():
            return known
    raise ValueError(f"unknown library {name!r}; known: {', '.join(LIBRARIES)}")


def ds1000(spark: SparkSession, path: str, limit: int | None = None, libraries: list[str] | None = None) -> DataFrame:
    """JSON lines; libraries that don't occur match nothing."""
    df = spark.read.schema(PROBLEMS["ds1000"]).json(path).withColumn("task_id", F.col("metadata.problem_id"))
    if libraries:
        df = df.filter(F.lower("metadata.library").isin([x.lower() for x in libraries]))
    return first_rows(df, limit, "task_id")


def plot2code(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Parquet ingested with its positions as task_id; missing texts are empty."""
    df = spark.read.parquet(path)
    texts = {c: F.coalesce(c, F.lit("")) for c in ("instruction", "code", "url") if c in df.columns}
    df = df.withColumns(texts)
    return df if limit is None else df.filter(F.col("task_id") < limit)


def ingest_positions(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Number the rows of a set once, from 0 and without gaps, in their order or in that of the named columns, and write them: positions must not be made at
    query time.

    Rows are written with their place in their partition first, so that the partitions' counts and the rows are of one and the same run; sums of
    the counts, a row a partition, make positions of places. Nothing leaves the JVM and no rows go to one task.
    """
    spark, draft, low = df.sparkSession, f"{path}-draft-{uuid.uuid4().hex}", 33  # monotonically_increasing_id: the partition, then 33 bits of place
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(draft)
    placed = spark.read.schema(placed.schema).parquet(draft).withColumn("_part", F.shiftright("_at", low))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))
    numbered = placed.join(F.broadcast(bases), "_part").withColumn("task_id", F.col("_base") + F.col("_at").bitwiseAND((1 << low) - 1))
    numbered.select(*df.columns, "task_id").write.mode("overwrite").parquet(path)
    shared_files.delete(spark, draft)


def multipl_e(spark: SparkSession, path: str, limit: int | None = None, languages: list[str] | None = None) -> DataFrame:
    """Parquet in language= folders; unknown languages are dropped; the limit holds for each language."""
    wanted = [x for x in LANGUAGES if languages is None or x in languages]
    df = spark.read.parquet(path).filter(F.col("language").isin(wanted))
    df = df.withColumn("task_id", F.concat_ws("/", "language", "name"))
    return first_per_group(df, "language", "name", limit) if limit is not None else df


def _library_set(spark, path, limit, only):
    names = [canonical_library(x) for x in only or ()]
    return ds1000(spark, path, limit, names or None).withColumns({"library": F.col("metadata.library"), "perturbation_type": F.col("metadata.perturbation_type")})


#: benchmark: (spark, path, limit, libraries or languages) -> its problems. Add a set by adding an entry.
LOADERS = {
    "humaneval": lambda spark, path, limit, only: humaneval(spark, path, limit),
    "mbpp": lambda spark, path, limit, only: mbpp([spark.read.parquet(path)], limit),
    "ds1000": _library_set,
    "plot2code": lambda spark, path, limit, only: plot2code(spark, path, limit),
    "multipl-e": lambda spark, path, limit, only: multipl_e(spark, path, limit, only or None),
}


def first_per_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.filter(F.col("_n") <= limit).drop("_n")


def detect_benchmark(columns: list[str]) -> str:
    """Which benchmark foreign rows are from, by the columns they have."""
    from ..fixed_values import MARKERS

    return next((bench for column, bench in MARKERS.items() if column in columns), "humaneval")
