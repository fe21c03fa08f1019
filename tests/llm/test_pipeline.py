"""The pipeline's stages: columns, effects, and the whole run on the smallest tables."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
        if k == 0:
            bad = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0")
            good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1")
            assert docs.join(bad, "doc_id").count() == 0
            assert docs.join(good, "doc_id").count() >= 0.95 * before.join(good, "doc_id").count()
        if k == 1:
            assert docs.groupBy("text").count().filter("count > 1").count() == 0
        if k == 2:
            assert docs.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
        if k == 3:
            words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()]
            assert min(words) > 0
    fill = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n > 2048 or n <> end").count() == 0
    total = docs.agg(F.sum("length")).first()[0]
    assert fill.count() <= -(-total // 2048) + 1


def test_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 300, "en", "a", 1500), (3, "word " * 300, "en", "a", 1500), (None, "some words here", None, "b", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.dedup(spark, docs, sf).count() == 4
    for given in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            stage(spark, given, sf).collect()
