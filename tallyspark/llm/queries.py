"""The registered queries of the training-data operators: thin forms over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, mixing, neardup, packing, periodic, pii, quality_classifier, quality_rules, secret_scan, spelling, topk, warc
from .common import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _count(spans: str, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all other vectors, by integer inner product, for every vector whose id 50 divides."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans by kind, their digest, and all spans."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and the component of its near copies."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans by kind, their digest, and all spans."""
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [_count("spans", k).alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, whether it fails the base rules, and whether it is kept."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words of it that the mix takes."""
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from archives written and read back."""
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs: their number, the longest one, and digests of all and of the collapsed text."""
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), change=True)
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = found.withColumn("best", F.array_min(order)).withColumn("length", -F.col("best.l"))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        "length",
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its form and its root."""
    return spelling.variants(_table(spark, sf_dir, "documents"), change=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py in a row."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_exact_top_k,
        op3_pii,
        op4_near_duplicates,
        op5_quality_classifier,
        op6_language_id,
        op7_html_extraction,
        op8_secret_scan,
        op9_quality_rules,
        op10_mixing,
        op11_warc,
        op12_periodic_runs,
        op13_spelling_variants,
        pipeline,
    )
}

# DuckDB has no crc32: 256 steps of eight bits, then a byte at a time. ``bytes`` is a list of the text's bytes.
_CRC_TABLE = """crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)
    ) s
)"""
_CRC = "xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
_BYTES = "list_transform(range(CAST(octet_length(encode({0})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"

ORACLE_SQL = {
    "op2_exact_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op4_near_duplicates": r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s
    FROM worded
), items AS (
    SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), each_way AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reached r JOIN each_way e ON e.a = r.other
), low AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low USING (doc_id)
""",
    "op11_warc": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), fives AS (
    SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT)) AS v, max(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM fives
""",
    "op12_periodic_runs": rf"""
WITH {_CRC_TABLE}, worded AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_BYTES.format("CAST(doc_id AS VARCHAR)")} AS bytes FROM documents
), hashed AS (
    SELECT doc_id, w, len(w) AS n, {_CRC} AS h FROM worded, crc_table
), placed AS (
    SELECT doc_id, w, n, h, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed
), changed AS (
    SELECT doc_id, n, CASE WHEN a = n THEN w
        ELSE list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END AS BIGINT)]) END AS w
    FROM placed
), spots AS (
    SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM changed
), twins AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM twins
), stretches AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12
), runs AS (
    SELECT doc_id, s, length, min(q) AS q FROM stretches GROUP BY doc_id, s, length
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs
), collapsed AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM spots ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), per AS (
    SELECT doc_id, count(*) AS n_runs, min([-length, s, q]) AS best, string_agg(concat(s, ',', length, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
       CAST(1000 * (-best[1]) // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM changed LEFT JOIN per USING (doc_id) LEFT JOIN collapsed USING (doc_id)
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE}, found AS (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) d
), counted AS (
    SELECT doc_id, run, count(*) AS c, {_BYTES.format("concat(doc_id, ':', run)")} AS bytes FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
    SELECT run, c, {_CRC} AS h FROM counted, crc_table
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, c FROM hashed
), vocabulary AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), shorter AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary) v
), pairs AS (
    SELECT x.word, y.word AS near, y.n AS near_n FROM shorter x JOIN shorter y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM shorter x JOIN vocabulary y ON x.rest = y.word
    UNION SELECT y.word, x.word, x.n FROM shorter x JOIN vocabulary y ON x.rest = y.word
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
), formed AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
    FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1
), led(word, lead_to) AS (
    SELECT word, word FROM formed UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.lead_to WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.lead_to AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN led l USING (word) JOIN formed e ON e.word = l.lead_to WHERE e.form IS NULL
""",
}
