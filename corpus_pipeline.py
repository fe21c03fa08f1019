"""A corpus from raw documents to packed training sequences, in five stages that each write a Parquet table.

1 quality classifier: documents that it rejects go. 2 MinHash near-dedup: one document of each group stays (five-word
shingles, similarity 0.8). 3 PII: spans are replaced by their kind. 4 mixing: the words of each source that the target
weights call for, texts of which are taken repeatedly standing there repeatedly. 5 best-fit packing: pieces of at most
2048 tokens in sequences. All but the last return the columns of documents. Null and empty texts, repeated rows and empty
tables go through as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize, shared_dir, small_or_plain
from tallyspark.llm.mixing import mix
from tallyspark.llm.neardup import near_duplicates
from tallyspark.llm.packing import pack
from tallyspark.llm.pii import redact
from tallyspark.llm.quality_classifier import keep_good

DEDUP_WORDS, DEDUP_SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that stands for its group. Rows that repeat a doc_id are texts of their own: of those that agree in the text too
    one stays, others are compared as any two texts. Rows without a doc_id stay."""
    again = materialize(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "dedup-again")
    repeats = again.limit(1).count() > 0
    own = F.col("doc_id").cast("long")
    rows = docs.withColumns({"__row": own, "__twice": F.lit(False)})
    if repeats:  # a number of its own for each text of a repeated id
        twice = small_or_plain(again.withColumn("__twice", F.lit(True)))
        of_text = -F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 1) - 1
        rows = docs.join(twice, "doc_id", "left").withColumn("__twice", F.coalesce("__twice", F.lit(False)))
        rows = rows.withColumn("__row", F.when(F.col("__twice"), of_text).otherwise(own))
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), DEDUP_WORDS, DEDUP_SIMILARITY)
    gone = materialize(found.filter("not kept").select(F.col("doc_id").alias("__row")).distinct(), "dedup-gone")
    left = rows.join(small_or_plain(gone), "__row", "left_anti")
    if repeats:
        alike = left.filter("__twice").select("__row", F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("h"))
        once = alike.groupBy("__row").agg(F.min_by("row", "h").alias("row")).select("row.*")
        return left.filter("not __twice").select(*docs.columns).unionByName(once)
    return left.select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars is made new."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, cached_words=100_000)  # beside what earlier stages have left in use of an executor


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", dedup),
    ("PII", private_data),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't express the learned and the random stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
