"""Shared plumbing of the training-data operators: durable intermediate tables and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None

#: ``[^\x20\x09-\x0D]+`` is the word of every contract; this is its complement, in Java's syntax.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where it is unset, a local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    global _LOCAL_DIR
    if _LOCAL_DIR is None or not os.path.isdir(_LOCAL_DIR):
        _LOCAL_DIR = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return _LOCAL_DIR


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, fixes ids, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._table = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._table)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set session options (``__`` stands for a dot) while eager jobs run, then restore them."""
    before = {}
    for key, value in settings.items():
        name = key.replace("__", ".")
        before[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


BROADCAST_BYTES, SALTS = 32 << 20, 16


def bytes_of(df: DataFrame) -> int:
    """About how many bytes a written table's rows take in memory: 16 for each number, what they are for texts and arrays."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    lists = [(f.name, 8 if f.dataType.elementType.simpleString() in ("int", "bigint", "double") else 40) for f in df.schema.fields if f.dataType.simpleString().startswith("array")]
    extra = [F.sum(F.coalesce(F.octet_length(c), F.lit(0))) for c in texts] + [F.sum(F.greatest(F.size(c), F.lit(0)) * w) for c, w in lists]
    counted = df.agg(F.count("*"), *extra).first()
    return counted[0] * 16 * (len(df.columns) + 1) + sum(x or 0 for x in counted[1:])


def small_or_plain(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if its bytes are within BROADCAST_BYTES, else with one against it."""
    return F.broadcast(df) if bytes_of(df) <= BROADCAST_BYTES else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that its join must not broadcast: Spark goes by the bytes of its files, which say little of those of its rows, and
    nothing of what an explode makes of them."""
    return df.hint("merge")


def attached(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` rows a key joined with a written table of one row a key: broadcast if its bytes are few, else on the key and one of
    SALTS numbers, so that a frequent key is no task of its own."""
    if bytes_of(few) <= BROADCAST_BYTES:
        return many.join(F.broadcast(few), key, how)
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)))
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(shuffled(each), [key, "_salt"], how).drop("_salt")


BATCH_ROWS, READ_ROWS = "1000", "512"


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts are read READ_ROWS at a time and go to Python BATCH_ROWS at a time: of the defaults, 4096 and
    10,000, so many may not fit beside each other."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def parallelism(spark: SparkSession) -> int:
    """Partitions for small tables whose rows carry much work: a few for each core."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


SMALL_TABLE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of SMALL_TABLE bytes at most, in fewer files than there are cores, dealt to all cores, as each file may be one row group, which
    only one task can read. Other tables aren't moved."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL_TABLE and len(df.inputFiles()) < cores else df


def held_out(column="doc_id"):
    """``crc32(doc_id as text) mod 4 is 2``: the rows that no model may learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def spelled(column="doc_id"):
    """A whole-number column as text, which pandas keeps as it is: numbers beside nulls would become doubles."""
    return F.col(column).cast("long").cast("string").alias(column)


def numbers(texts) -> list:
    """The whole numbers, or None, of ``spelled`` texts."""
    return [int(x) if isinstance(x, str) else None for x in texts]


M_MMAP_THRESHOLD = -3  # its number in the C library's malloc.h


def tidied(run):
    """A function for mapInPandas that leaves no memory behind in its worker, which goes on to other tasks."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)  # large arrays go back to the system as soon as they are freed
        trim = getattr(libc, "malloc_trim", None)
        try:
            for out in run(batches):
                yield out
        finally:
            gc.collect()
            if trim:
                trim(0)

    return wrapped


def slices(texts: list, most: int = 250_000):
    """Runs (from, to) of ``texts`` of about ``most`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def first_by_hash(rows: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """Of each group the ``most`` distinct ids that come first in the order of a hash: (id_col, group).

    Groups are counted first; only ids whose hash is below a bound that lets about four times as many through are
    ranked. So what is ranked depends on ``most`` and the number of groups, not on the number of rows.
    """
    share = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_group")
    near = rows.select(id_col, group).join(F.broadcast(counts), F.col(group) == F.col("_group")).filter(share * F.col("_n") < 4 * most + 100)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(id_col, F.lit(5)), id_col))
    return near.select(id_col, group).distinct().withColumn("_r", rank).filter(F.col("_r") <= most).select(id_col, group)
