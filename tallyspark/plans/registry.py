"""All registered queries of the analytics library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bags, grid, images, lines, outcome
from ..functions import code as code_functions
from ..functions import text as X
from ..operators import detail as detail_tables
from ..operators import execution, ledger
from ..sources import answers, capabilities, generation, nested, problem_sets, run_log
from ..sources import synthetic as S
from . import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ATTEMPTS = """attempts AS (
    SELECT event_id AS seq, concat('m', user_id % 3) AS model, concat('b', k % 5) AS benchmark,
           concat('t/', CAST((user_id - user_id % 3) // 3 AS BIGINT)) AS task_id,
           CASE event_type WHEN 'click' THEN 'Passed' WHEN 'view' THEN 'Passed' WHEN 'purchase' THEN 'AssertionError' WHEN 'signup' THEN 'APIError' ELSE 'SyntaxError' END AS category,
           CASE WHEN k % 5 = 4 THEN NULL ELSE value / 700 END AS score,
           CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS input_tokens,
           CASE WHEN event_type = 'signup' THEN NULL ELSE k * 10 END AS output_tokens
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
)"""
RECORDS = (
    ATTEMPTS
    + """, records AS (
    SELECT * EXCLUDE rn, category = 'Passed' AS solved
    FROM (SELECT *, row_number() OVER (PARTITION BY model, benchmark, task_id ORDER BY seq DESC) AS rn FROM attempts) t WHERE rn = 1
)"""
)
DIM = "dim(rank, model, architecture, price_in, price_out) AS (VALUES (0, 'm0', 'LLM', 5.0e0, 25.0e0), (1, 'm1', 'MoE', 0.435e0, 0.87e0), (2, 'm2', 'SLM', 0.15e0, 0.15e0))"
RATES = """rates AS (
    SELECT model, benchmark, count(*) AS n, count(*) FILTER (WHERE solved) AS solved, round(100e0 * count(*) FILTER (WHERE solved) / count(*), 1) AS pass_pct
    FROM records GROUP BY model, benchmark
)"""
MATRIX = """matrix AS (
    SELECT benchmark, task_id, bool_or(solved) FILTER (WHERE model = 'm0') AS m0, bool_or(solved) FILTER (WHERE model = 'm1') AS m1,
           bool_or(solved) FILTER (WHERE model = 'm2') AS m2
    FROM records GROUP BY benchmark, task_id
)"""


def _mean(digits: int, of: str = "score") -> str:
    """The mean score, summed up in whole units and rounded once."""
    unit = 10 ** (R.DIGITS - digits)
    total = f"CAST(sum(CAST({of} AS DECIMAL({R.DIGITS + 8}, {R.DIGITS}))) * {10**R.DIGITS} AS HUGEINT)"
    return f"CASE WHEN count({of}) > 0 THEN CAST((2 * {total} + count({of}) * {unit}) // (2 * count({of}) * {unit}) AS DOUBLE) / 1e{digits} END"


RANGE = 65536  # keys summed up as one in running counts


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the checkpoint folder, or else the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


# ---------------------------------------------------------------- record store


@query(f"WITH {RECORDS} SELECT model, benchmark, task_id, seq, category, score, input_tokens, output_tokens FROM records")
def latest_attempts(spark, sf):
    return S.records(spark, sf).select("model", "benchmark", "task_id", "seq", "category", "score", "input_tokens", "output_tokens")


@query(f"WITH {RECORDS} SELECT DISTINCT a.model, a.benchmark, a.task_id FROM attempts a JOIN records r USING (model, benchmark, task_id) WHERE r.category = 'APIError'")
def todo_tasks(spark, sf):
    tries = S.attempts(spark, sf)
    return run_log.todo(tries.select(*S.KEYS).distinct(), S.records(spark, sf), S.KEYS)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) t WHERE rn = 1"""
)
def last_write_wins_lineitem(spark, sf):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", order.alias("seq"))
    return run_log.last_write_wins(rows, ["l_orderkey", "l_linenumber"]).drop("seq")


@query(f"WITH {ATTEMPTS} SELECT seq, model, CAST(sum(CASE WHEN category = 'Passed' THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY seq) AS BIGINT) AS passed_so_far FROM attempts")
def running_passed(spark, sf):
    rows = S.attempts(spark, sf).select("seq", "model", "category")
    return R.running_counts(rows, "model", "seq", F.col("category") == "Passed", "passed_so_far", RANGE).drop("category")


@query(
    f"WITH {RECORDS}, problems AS (SELECT CAST(o_orderkey AS BIGINT) AS ordinal, concat('t/', o_orderkey) AS task_id FROM orders)"
    " SELECT ordinal, task_id, model, benchmark, category FROM problems JOIN records USING (task_id) ORDER BY ordinal, model, benchmark"
)
def ordered_results(spark, sf):
    problems = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("t/"), F.col("o_orderkey").cast("string")).alias("task_id"))
    joined = problems.join(S.records(spark, sf), "task_id").select("ordinal", "task_id", "model", "benchmark", "category")
    return joined.orderBy("ordinal", "model", "benchmark")


@query(
    f"WITH {ATTEMPTS} SELECT seq, model, benchmark, task_id, category, score FROM attempts"
)
def json_roundtrip(spark, sf):
    """Attempts written as JSON text and read back by schema."""
    rows = S.attempts(spark, sf).select("seq", "model", "benchmark", "task_id", "category", "score")
    return rows.select(F.from_json(F.to_json(F.struct("*")), rows.schema).alias("r")).select("r.*")


def _log_files(spark, sf, columns=None):
    """A new folder with the attempts as files of JSON lines in ``in``, and their schema."""
    import uuid

    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = S.attempts(spark, sf)
    rows = rows.select(*columns) if columns else rows
    rows.repartitionByRange(6, "seq").write.json(f"{top}/in")
    return top, rows.schema


@query(f"WITH {RECORDS} SELECT model, benchmark, task_id, seq, category, score, input_tokens, output_tokens FROM records")
def stream_latest(spark, sf):
    """The batch report's records, gathered by a stream of many batches in the committed store, and read while some of its deltas are open."""
    from ..streaming import records as stream
    from ..streaming.store import RecordStore

    top, schema = _log_files(spark, sf)
    store = RecordStore(spark, f"{top}/store", S.KEYS, many=4)
    stream.start_store(stream.attempts(spark, f"{top}/in", schema, files_per_trigger=1), store, f"{top}/state").awaitTermination()
    return store.current().select(*S.KEYS, "seq", "category", "score", "input_tokens", "output_tokens")


@query(f"WITH {RECORDS} SELECT model, benchmark, task_id FROM records WHERE category = 'APIError'")
def stream_todo(spark, sf):
    """The tasks to be run again, by a stream whose state forgets the tasks that are done."""
    from ..streaming import records as stream
    from ..streaming import retry
    from ..streaming.store import RecordStore

    top, schema = _log_files(spark, sf, [*S.KEYS, "seq", "category"])
    store = RecordStore(spark, f"{top}/store", S.KEYS, order="order")
    attempts = stream.attempts(spark, f"{top}/in", schema, files_per_trigger=2)
    retry.start_retries(spark, attempts, S.KEYS, store, f"{top}/state", keep_ms=1).awaitTermination()
    return retry.pending(store)


@query(
    """SELECT concat('m', p.conv_id % 3) AS model, concat(p.conv_id, '/', p.turn) AS task_id, a.text AS raw, len(string_split(a.text, ' ')) AS output_tokens,
 CASE WHEN a.text IS NULL THEN 'no stored answer' END AS failure
FROM conversations p LEFT JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.role = 'assistant' WHERE p.role = 'user' AND p.conv_id % 3 <> 0"""
)
def replayed_answers(spark, sf):
    """Two models' prompts with their stored answers, read from the answers' log by its own data source."""
    import uuid

    model, task = F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")), lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))
    rows = S.table(spark, sf, "conversations")
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    counts = F.struct(F.lit(0).cast("long").alias("input_tokens"), F.size(F.split("text", " ", -1)).cast("long").alias("output_tokens"))
    answers.log_answers(rows.filter("role = 'assistant'").select(model.alias("model"), task(F.col("turn") - 1).alias("task_id"), F.col("text").alias("raw"), counts.alias("usage")), path)
    answers.register(spark)
    stored = spark.read.format(answers.NAME).option("path", path).load().filter(F.col("model").isin("m1", "m2"))
    prompts = rows.filter("role = 'user' and conv_id % 3 <> 0").select(model.alias("model"), task(F.col("turn")).alias("task_id"))
    return generation.replay(prompts, stored, ["model", "task_id"]).select("model", "task_id", "raw", F.col("usage.output_tokens").alias("output_tokens"), "failure")


# ---------------------------------------------------------------- reports


@query(f"WITH {RECORDS}, {RATES} SELECT * FROM rates")
def pass_rate_by_model_benchmark(spark, sf):
    return R.pass_rates(S.records(spark, sf))


@query(
    f"WITH {RECORDS}, {RATES} SELECT model, {', '.join(f"max(pass_pct) FILTER (WHERE benchmark = '{b}') AS {b}" for b in S.BENCHES)},"
    " round(sum(pass_pct) / count(pass_pct), 1) AS mean_pct FROM rates GROUP BY model"
)
def pass_rate_pivot(spark, sf):
    return R.pass_rate_pivot(S.records(spark, sf), S.BENCHES)


_SUMMARY = f"""summary AS (
    SELECT model, dim.architecture, count(*) AS total, count(*) FILTER (WHERE solved) AS passed, round(1e0 * count(*) FILTER (WHERE solved) / count(*), 6) AS pass_at_1,
           {_mean(6)} AS mean_score, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
           round(sum(coalesce(input_tokens, 0)) / 1e6 * coalesce(max(price_in), 0) + sum(coalesce(output_tokens, 0)) / 1e6 * coalesce(max(price_out), 0), 4) AS cost_usd
    FROM records LEFT JOIN dim USING (model) GROUP BY model, dim.architecture
)"""


@query(f"WITH {RECORDS}, {DIM}, {_SUMMARY} SELECT * FROM summary")
def per_model_summary(spark, sf):
    return R.model_summary(S.records(spark, sf), S.dimension(spark))


@query(
    f"WITH {RECORDS}, {DIM}, {_SUMMARY} SELECT model, total, passed, input_tokens, output_tokens, cost_usd FROM summary UNION ALL"
    " SELECT 'TOTAL', CAST(sum(total) AS BIGINT), CAST(sum(passed) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT), round(sum(cost_usd), 4) FROM summary HAVING count(*) > 1"
)
def cost_totals(spark, sf):
    return R.cost_totals(R.model_summary(S.records(spark, sf), S.dimension(spark)))


@query(f"WITH {RECORDS}, {DIM} SELECT coalesce(architecture, '?') AS architecture, category, count(*) AS n FROM records LEFT JOIN dim USING (model) WHERE NOT solved GROUP BY ALL")
def errors_by_architecture(spark, sf):
    return R.errors_by_architecture(S.records(spark, sf), S.dimension(spark))


@query(f"WITH {RECORDS} SELECT model, string_agg(concat(category, '=', n), ',' ORDER BY category) AS errors FROM (SELECT model, category, count(*) AS n FROM records WHERE NOT solved GROUP BY ALL) t GROUP BY model")
def errors_by_model_map(spark, sf):
    listed = F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return R.error_map(S.records(spark, sf)).select("model", F.array_join(listed, ",").alias("errors"))


@query(f"WITH {RECORDS} SELECT model, {', '.join(f"{_mean(3, f"CASE WHEN benchmark = '{b}' THEN score END")} AS {b}" for b in S.BENCHES[:4])} FROM records WHERE benchmark <> 'b4' GROUP BY model")
def score_mean_pivot(spark, sf):
    return R.score_pivot(S.records(spark, sf), S.BENCHES[:4])


@query(
    f"WITH {RECORDS}, {RATES}, scores AS (SELECT model, benchmark, {_mean(3)} AS mean_score FROM records WHERE score IS NOT NULL GROUP BY ALL)"
    " SELECT model, benchmark, concat(solved, ' / ', n) AS solved_of, pass_pct, coalesce(format('{:.3f}', mean_score), 'n/d') AS score_text FROM rates LEFT JOIN scores USING (model, benchmark)"
)
def summary_with_score(spark, sf):
    return R.summary_with_score(S.records(spark, sf))


def _labelled(spark, sf):
    docs, labels = S.table(spark, sf, "documents").select("doc_id", "lang"), S.table(spark, sf, "labels")
    model = F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))
    return docs.join(labels, "doc_id").select(F.col("lang").alias("language"), model.alias("model"), (F.col("quality") == 1).alias("solved"))


_LABELLED = "rows AS (SELECT lang AS language, concat('m', doc_id % 3) AS model, quality = 1 AS solved FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_LABELLED}, per AS (SELECT language, model, count(*) AS n FROM rows WHERE solved GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY language) AS BIGINT) AS language_total FROM per")
def solved_by_language(spark, sf):
    return R.solved_by_language(_labelled(spark, sf))


@query(f"WITH {_LABELLED} SELECT language, {', '.join(f"count(*) FILTER (WHERE model = '{m}') AS {m}" for m in S.MODELS)} FROM rows WHERE solved GROUP BY language")
def solved_by_language_pivot(spark, sf):
    return R.solved_by_language_pivot(_labelled(spark, sf), S.MODELS)


@query(f"WITH {RECORDS}, {MATRIX} SELECT * FROM matrix")
def outcome_matrix(spark, sf):
    return R.outcome_matrix(S.records(spark, sf), S.MODELS)


_PAIRS = """pairs AS (
    SELECT a.model AS strong, b.model AS weak, x.benchmark, (
        SELECT count(*) FROM records s JOIN records w ON s.benchmark = w.benchmark AND s.task_id = w.task_id
        WHERE s.model = a.model AND w.model = b.model AND s.benchmark = x.benchmark AND NOT s.solved AND w.solved) AS n
    FROM dim a JOIN dim b ON a.rank < b.rank CROSS JOIN (SELECT unnest(['b0', 'b1', 'b2', 'b3', 'b4']) AS benchmark) x
)"""


@query(f"WITH {RECORDS}, {DIM}, {_PAIRS} SELECT * FROM pairs")
def cross_model_pairs(spark, sf):
    return R.cross_model_pairs(R.outcome_matrix(S.records(spark, sf), S.MODELS), S.MODELS, S.BENCHES)


@query(
    f"WITH {RECORDS}, {DIM}, {_PAIRS} SELECT concat(strong, ' - ', weak) AS pair, {', '.join(f"CAST(sum(n) FILTER (WHERE benchmark = '{b}') AS BIGINT) AS {b}" for b in S.BENCHES)},"
    " CAST(sum(n) AS BIGINT) AS total FROM pairs GROUP BY ALL"
)
def cross_model_pairs_pivot(spark, sf):
    return R.cross_model_pivot(cross_model_pairs(spark, sf), S.BENCHES)


@query(
    f"WITH {RECORDS}, {MATRIX} SELECT coalesce(benchmark, 'TOTAL') AS benchmark, count(*) AS failures, count(*) FILTER (WHERE m1) AS by_m1, count(*) FILTER (WHERE m2) AS by_m2,"
    " count(*) FILTER (WHERE coalesce(m1, false) OR coalesce(m2, false)) AS by_any FROM matrix WHERE NOT m0 GROUP BY ROLLUP (benchmark)"
)
def best_model_focus(spark, sf):
    return R.best_model_focus(R.outcome_matrix(S.records(spark, sf), S.MODELS), "m0", ("m1", "m2"))


@query(
    f"WITH {RECORDS}, {MATRIX} SELECT benchmark, task_id, coalesce(m1, false) AS solved_m1, coalesce(m2, false) AS solved_m2 FROM matrix"
    " WHERE NOT m0 AND (coalesce(m1, false) OR coalesce(m2, false))"
)
def recovered_cases(spark, sf):
    return R.recovered_cases(R.outcome_matrix(S.records(spark, sf), S.MODELS), "m0", ("m1", "m2"))


@query(
    f"WITH {RECORDS} SELECT m.model, b.benchmark, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in R.ERRORS)}, count(category) AS total"
    " FROM (SELECT unnest(['m0', 'm1', 'm2']) AS model) m CROSS JOIN (SELECT unnest(['b0', 'b1', 'b2', 'b3', 'b4']) AS benchmark) b"
    " LEFT JOIN records r ON r.model = m.model AND r.benchmark = b.benchmark AND NOT r.solved GROUP BY ALL"
)
def error_crosstab(spark, sf):
    return R.error_crosstab(S.records(spark, sf), S.MODELS, S.BENCHES)


@query(f"WITH {RECORDS}, per AS (SELECT category, count(*) AS n FROM records WHERE NOT solved GROUP BY ALL) SELECT category, n, round(100e0 * n / sum(n) OVER (), 1) AS share_pct FROM per")
def error_share(spark, sf):
    return R.error_share(S.records(spark, sf))


@query(
    f"WITH {RECORDS}, per AS (SELECT model, benchmark, category, count(*) AS n FROM records WHERE NOT solved GROUP BY ALL)"
    " SELECT model, benchmark, concat(category, ' (', n, ')') AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY model, benchmark ORDER BY n DESC, category) AS r FROM per) t WHERE r = 1"
)
def dominant_error(spark, sf):
    return R.dominant_error(S.records(spark, sf))


@query(
    f"WITH {RECORDS} SELECT model, round(avg(score) FILTER (WHERE solved), 3) AS ssim, round(avg(CAST(output_tokens AS DOUBLE)) FILTER (WHERE solved), 3) AS color_sim,"
    " concat(count(*) FILTER (WHERE solved), ' / ', count(*)) AS rendered_of FROM records WHERE benchmark = 'b3' GROUP BY model"
)
def render_metrics(spark, sf):
    rows = S.records(spark, sf).filter("benchmark = 'b3'").select("model", F.col("solved").alias("rendered"), F.col("score").alias("ssim"), F.col("output_tokens").cast("double").alias("color_sim"))
    return R.render_metrics(rows, ("ssim", "color_sim"))


@query(
    f"WITH {RECORDS} SELECT model, count(*) AS n, round(covar_pop(score, CAST(input_tokens AS DOUBLE)) / (stddev_pop(score) * stddev_pop(CAST(input_tokens AS DOUBLE))), 6) AS r"
    " FROM records WHERE score IS NOT NULL AND input_tokens IS NOT NULL GROUP BY model"
)
def score_correlation(spark, sf):
    return R.correlation(S.records(spark, sf).withColumn("tokens", F.col("input_tokens").cast("double")), "model", "score", "tokens")


# ---------------------------------------------------------------- plans, unions, windows


_CAPABLE = [("en", True), ("de", True), ("fr", False)]


def _capable(spark):
    return spark.createDataFrame(_CAPABLE, "capability string, available boolean")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de')")
def runnable_plan(spark, sf):
    return capabilities.split_runnable(S.table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", _capable(spark))[0]


@query("SELECT lang, count(*) AS skipped FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang")
def missing_report(spark, sf):
    return capabilities.split_runnable(S.table(spark, sf, "documents").select("doc_id", "lang"), "lang", _capable(spark))[1]


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def problems_per_library(spark, sf):
    return S.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) t WHERE r <= 7")
def limit_per_group(spark, sf):
    return problem_sets.first_per_group(S.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 7)


@query("SELECT o_orderkey AS task_id, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 11 AND 510")
def union_splits_range(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    return problem_sets.mbpp([orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]).orderBy("task_id")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS ordinal FROM customer")
def fallback_ordinal(spark, sf):
    rows = S.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return R.running_counts(rows, "c_mktsegment", "c_custkey", F.lit(True), "_n", RANGE).select("c_custkey", "c_mktsegment", (F.col("_n") - 1).alias("ordinal"))


@query(r"SELECT s_suppkey, try_cast(nullif(regexp_extract(s_name, '(\d+)$', 1), '') AS DOUBLE) AS trailing FROM supplier")
def trailing_id(spark, sf):
    return S.table(spark, sf, "supplier").select("s_suppkey", X.trailing_number("s_name").alias("trailing"))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'n/d' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events")
def tolerant_numeric(spark, sf):
    k = F.when(F.col("event_id") % 4 == 0, "n/d").otherwise(F.get_json_object("props", "$.k"))
    return S.table(spark, sf, "events").select("event_id", X.number(k).alias("k"))


# ---------------------------------------------------------------- text functions


def _docs(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", "text")


def _sorted_lines(x: str) -> str:
    return f"regexp_split_to_array({x}, '\\n')"


@query(
    r"""WITH raw AS (SELECT conv_id, turn, concat('Sure:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'end') AS raw FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_extract(raw, '(?s)```[^\n`]*\n(.*?)```', 1), '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g') AS code FROM raw"""
)
def extract_code(spark, sf):
    turns = S.table(spark, sf, "conversations")
    raw = F.concat(F.lit("Sure:\n```python\n"), F.col("text"), F.lit("\n```\nend"))
    return turns.select("conv_id", "turn", X.extract_code(raw).alias("code"))


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped, right(text, 2000) AS tail FROM documents")
def trim_edges(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip("text").alias("stripped"), X.tail("text", 2000).alias("tail"))


@query(
    """SELECT doc_id, array_to_string(list_filter(string_split(concat('import a', chr(10), text, chr(10), 'from b import c', chr(10), '  import d'), chr(10)),
    lambda s: starts_with(s, 'import ') OR starts_with(s, 'from ')), chr(10)) AS header FROM documents"""
)
def import_header(spark, sf):
    program = F.concat(F.lit("import a\n"), F.col("text"), F.lit("\nfrom b import c\n  import d"))
    return _docs(spark, sf).select("doc_id", X.import_header(program).alias("header"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS first_lines FROM documents")
def first_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", X.join_lines(F.slice(F.split("text", "\n"), 1, 3)).alias("first_lines"))


_EDGE_SQL = ", ".join(f"'{w}'" for w in X.EDGE_WORDS)


@query(rf"SELECT conv_id, turn, array_to_string(list_filter([{_EDGE_SQL}], lambda w: regexp_matches(lower(concat('an Empty list, even or odd: ', role, ' case ', coalesce(text, ''))), concat('\b', w, '\b'))), ', ') AS edges FROM conversations")
def edge_keywords(spark, sf):
    """Edge-case words in whole turns, behind some words that hold a few."""
    text = F.concat(F.lit("an Empty list, even or odd: "), F.col("role"), F.lit(" case "), F.coalesce("text", F.lit("")))
    return S.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.edge_words(text), ", ").alias("edges"))


@query(
    """WITH split AS (SELECT doc_id, list_transform(string_split(concat(chr(10), '   ', chr(10), '    x ', chr(10), text, '  ', chr(10), ' ', chr(10)), chr(10)), lambda s: regexp_replace(s, '\\s+$', '')) AS l FROM documents)
SELECT doc_id, array_to_string(l[list_position(list_transform(l, lambda s: s <> ''), true) : len(l) + 1 - list_position(list_transform(list_reverse(l), lambda s: s <> ''), true)], chr(10)) AS trimmed FROM split"""
)
def trim_blank_edges(spark, sf):
    """Whole texts between blank lines, without them and without white space at line ends; the first line's indent stays."""
    text = F.concat(F.lit("\n   \n    x \n"), F.col("text"), F.lit("  \n \n"))
    return _docs(spark, sf).select("doc_id", X.trim_blank_edges(text).alias("trimmed"))


@query("SELECT p_partkey, concat('f', p_size) AS called FROM part")
def called_identifier(spark, sf):
    test = F.concat(F.lit("assert set(f"), F.col("p_size").cast("string"), F.lit("([1, 2])) == set(g(3))"))
    return S.table(spark, sf, "part").select("p_partkey", X.called_name(F.array(F.lit("x = 1"), test)).alias("called"))


@query(
    """SELECT p_partkey, concat('def f', p_size, '(a: int, b: int) -> int:') AS signature, 'int' AS returns, concat('>>> f', p_size, '(1, 2)') AS examples,
    CASE WHEN p_size % 2 = 0 THEN concat('name', p_size) END AS task_function FROM part"""
)
def prompt_parts(spark, sf):
    n = F.col("p_size").cast("string")
    prompt = F.concat(F.lit("import x\n\ndef f"), n, F.lit("(a: int,\n      b: int) -> int:\n    '''Adds.\n    >>> f"), n, F.lit("(1, 2)\n    3\n    '''\n"))
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("HumanEval_7_name"), n)).otherwise("other")
    return S.table(spark, sf, "part").select(
        "p_partkey", X.signature(prompt).alias("signature"), X.return_type(prompt).alias("returns"), F.array_join(X.doctests(prompt), "\n").alias("examples"), X.task_function(name).alias("task_function")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'function-body' ELSE 'module' END AS form, CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 END AS indent FROM part"""
)
def insertion_form(spark, sf):
    size = F.col("p_size") % 3
    context = F.when(size == 0, "x = 1\ndef f(df):\n[insert]\n").when(size == 1, "x = 1\nfor i in y:\n[insert]\n").otherwise("x = 1\n[insert]\n")
    return S.table(spark, sf, "part").select("p_partkey", X.solution_form(context).alias("form"), X.insert_indent(context).alias("indent"))


_PYTHON_STDERR = (
    ("Traceback:\n  File x\nZeroDivisionError: division by zero", "RuntimeError"),
    ("Traceback:\nModuleNotFoundError: No module named 'q'", "ImportError"),
    ("Traceback:\nAssertionError", "AssertionError"),
    ("Traceback:\njson.decoder.KeyError: 'a'\n\n", "KeyError"),
    ("nothing that looks so!", "RuntimeError"),
)


@query(f"SELECT event_id, ([{', '.join(f"'{kind}'" for _, kind in _PYTHON_STDERR)}])[event_id % {len(_PYTHON_STDERR)} + 1] AS category FROM events")
def classify_stderr(spark, sf):
    stderr = F.get(F.array(*[F.lit(t) for t, _ in _PYTHON_STDERR]), (F.col("event_id") % len(_PYTHON_STDERR)).cast("int"))
    return S.table(spark, sf, "events").select("event_id", outcome.python_category(stderr).alias("category"))


_OTHER_OUTPUT = (
    ("  \n ", "AssertionError"),
    ("thread 'main' panicked at x", "AssertionError"),
    ("sh: syntax error near unexpected token", "SyntaxError"),
    ("Can't locate Foo.pm", "ImportError"),
    ("bc: command not found", "NameError"),
    ("x is not a function", "TypeError"),
    ("index out of bounds", "IndexError"),
    ("Division by zero", "ValueError"),
    ("something else", "RuntimeError"),
)


@query(f"SELECT event_id, ([{', '.join(f"'{kind}'" for _, kind in _OTHER_OUTPUT)}])[event_id % {len(_OTHER_OUTPUT)} + 1] AS category FROM events")
def classify_multilang(spark, sf):
    output = F.get(F.array(*[F.lit(t) for t, _ in _OTHER_OUTPUT]), (F.col("event_id") % len(_OTHER_OUTPUT)).cast("int"))
    return S.table(spark, sf, "events").select("event_id", outcome.other_category(output).alias("category"))


@query(r"SELECT page_id, regexp_replace(concat(chr(1), html, chr(31)), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS html FROM pages")
def xml_safe(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.xml_safe(F.concat(F.lit("\x01"), F.col("html"), F.lit("\x1f"))).alias("html"))


@query(
    """WITH p AS (SELECT conv_id, turn, regexp_replace(text, '\\s+$', '') AS base, role FROM conversations)
SELECT conv_id, turn, concat('Complete the ', CASE role WHEN 'user' THEN 'Rust' ELSE 'Bash' END, ' program below. Answer with the continuation only.', chr(10), chr(10),
 '# Program to complete', chr(10), base, chr(10), chr(10), '# Hints', chr(10), '- Implement the function `go`.') AS prompt FROM p"""
)
def prompt_assembly(spark, sf):
    from ..functions.prompts import prompt

    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit(">>>"), F.lit("")).alias("prompt"), F.when(F.col("role") == "user", "rs").otherwise("sh").alias("language"), F.lit("HumanEval_1_go").alias("name"))
    return rows.select("conv_id", "turn", prompt("multipl-e").alias("prompt"))


# ---------------------------------------------------------------- bags and vectors


@query(
    r"""WITH bags AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) t GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS s FROM bags GROUP BY ALL),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
common AS (SELECT p.a, p.b, sum(least(x.n, y.n)) AS c FROM pairs p JOIN bags x ON x.doc_id = p.a JOIN bags y ON y.doc_id = p.b AND y.token = x.token GROUP BY ALL)
SELECT a, b, CAST(coalesce(c, 0) AS BIGINT) AS common, round(CASE WHEN coalesce(x.s, 0) = 0 AND coalesce(y.s, 0) = 0 THEN 1e0 ELSE 2e0 * coalesce(c, 0) / (coalesce(x.s, 0) + coalesce(y.s, 0)) END, 6) AS f1
FROM pairs LEFT JOIN common USING (a, b) LEFT JOIN sizes x ON x.doc_id = a LEFT JOIN sizes y ON y.doc_id = b"""
)
def bag_f1_documents(spark, sf):
    """Each document's bag of words against the next one's."""
    docs = S.dealt(_docs(spark, sf))
    held = docs.select("doc_id", F.sort_array(X.word_tokens("text")).alias("tokens"))
    pairs = docs.select(F.col("doc_id").alias("a")).join(docs.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b")), "a")
    return bags.pair_f1(pairs, held.withColumnRenamed("doc_id", "a"), held.withColumnRenamed("doc_id", "b"), "a", "b")


@query(
    r"""WITH d AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) t GROUP BY ALL),
b AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark) t GROUP BY ALL),
per AS (SELECT item_id, doc_id, sum(least(b.n, d.n)) AS n FROM b JOIN d USING (token) GROUP BY item_id, doc_id)
SELECT item_id, count(per.n) AS docs, CAST(coalesce(sum(per.n), 0) AS BIGINT) AS shared FROM (SELECT DISTINCT item_id FROM benchmark) i LEFT JOIN per USING (item_id) GROUP BY item_id"""
)
def contamination_overlap(spark, sf):
    """Of each benchmark item, the documents that share words with it, and the words shared: the sum over documents of
    the multiset intersections of both bags."""
    items = S.table(spark, sf, "benchmark").select("item_id", "text")
    return bags.overlap(items, S.dealt(_docs(spark, sf)), "item_id", "doc_id", X.word_tokens("text"))


@query(
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 1000 END AS t, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 2000 END AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 3000 END AS c FROM events)
SELECT event_id, round((coalesce(t * 0.4e0, 0) + coalesce(s * 0.4e0, 0) + coalesce(c * 0.2e0, 0)) / nullif(CASE WHEN t IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN s IS NULL THEN 0e0 ELSE 0.4e0 END + CASE WHEN c IS NULL THEN 0e0 ELSE 0.2e0 END, 0), 10) AS composite FROM p"""
)
def composite_weighted(spark, sf):
    part = lambda n, by: F.when(F.col("event_id") % n != 0, F.col("value") / by)
    parts = {"text_match": part(3, 1000), "ssim": part(5, 2000), "color_sim": part(7, 3000)}
    return S.table(spark, sf, "events").select("event_id", F.round(images.composite(parts), 10).alias("composite"))


def _vector_pairs(spark, sf):
    v = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")), "a")


_HIST = "list_transform(range(0, 8), lambda b: 1e0 * len(list_filter({0}, lambda v: least(greatest(floor((CAST(v AS DOUBLE) + 1) / 2 * 8), 0), 7) = b)) / len({0}))"


@query(
    f"WITH h AS (SELECT vec_id, {_HIST.format('embedding')} AS h FROM embeddings) SELECT a.vec_id AS a, round(list_sum(list_transform(range(1, 9), lambda i: least(a.h[i], b.h[i]))), 6) AS shared FROM h a JOIN h b ON b.vec_id = a.vec_id + 1"
)
def histogram_intersection(spark, sf):
    hist = lambda c: bags.histogram(F.col(c), -1.0, 1.0, 8)
    return _vector_pairs(spark, sf).select("a", F.round(bags.intersection(hist("x"), hist("y")), 6).alias("shared"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), p AS (
 SELECT a.vec_id AS a, list_avg(a.x) AS m1, list_avg(b.x) AS m2, list_inner_product(a.x, a.x) / len(a.x) AS xx, list_inner_product(b.x, b.x) / len(b.x) AS yy, list_inner_product(a.x, b.x) / len(a.x) AS xy
 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT a, round((2 * m1 * m2 + 0.0001e0) * (2 * (xy - m1 * m2) + 0.0009e0) / ((m1 * m1 + m2 * m2 + 0.0001e0) * (xx - m1 * m1 + yy - m2 * m2 + 0.0009e0)), 6) AS ssim FROM p"""
)
def global_ssim_1d(spark, sf):
    return _vector_pairs(spark, sf).select("a", F.round(bags.global_ssim(F.col("x"), F.col("y")), 6).alias("ssim"))


# pictures: the lines of every two that follow each other, ``one`` and ``two``, null where one has no such line
def _ssim_sql(pictures: str) -> str:
    from ..functions.grid import kernel

    weights = kernel()
    listed = ", ".join(f"({k - len(weights) // 2}, {w!r}e0)" for k, w in enumerate(weights))
    place = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
    sums = lambda c: ", ".join(f"sum(w * {x}) AS {y}" for x, y in c.items())
    maps = {m: m for m in ("m1", "m2", "aa", "bb", "ab")}
    return f"""WITH w(k, w) AS (VALUES {listed}), px AS ({pictures}), sizes AS (SELECT p, max(y) + 1 AS h, max(x) + 1 AS n FROM px GROUP BY p), pairs AS (
    SELECT a.p, a.y, a.x, s.h, s.n, a.v AS a, b.v AS b FROM px a JOIN px b ON b.p = a.p + 1 AND b.y = a.y AND b.x = a.x JOIN sizes s ON s.p = a.p JOIN sizes t ON t.p = b.p WHERE s.h = t.h
), along AS (
    SELECT b.p, b.y, b.x, b.h, {sums({"s.a": "m1", "s.b": "m2", "s.a * s.a": "aa", "s.b * s.b": "bb", "s.a * s.b": "ab"})}
    FROM pairs b CROSS JOIN w JOIN pairs s ON s.p = b.p AND s.y = b.y AND s.x = {place("b.x + k", "b.n")} GROUP BY b.p, b.y, b.x, b.h
), done AS (
    SELECT b.p, b.y, b.x, {sums({f"s.{m}": m for m in maps})} FROM along b CROSS JOIN w JOIN along s ON s.p = b.p AND s.x = b.x AND s.y = {place("b.y + k", "b.h")} GROUP BY b.p, b.y, b.x
), scored AS (
    SELECT p, avg((2 * m1 * m2 + 6.5025e0) * (2 * (ab - m1 * m2) + 58.5225e0) / ((m1 * m1 + m2 * m2 + 6.5025e0) * (aa - m1 * m1 + bb - m2 * m2 + 58.5225e0))) AS ssim FROM done GROUP BY p
)
SELECT s.p AS picture, CASE WHEN ssim IS NOT NULL THEN round(least(greatest(ssim, 0e0), 1e0), 6) END AS ssim FROM sizes s JOIN sizes t ON t.p = s.p + 1 LEFT JOIN scored c ON c.p = s.p"""


def _lines_of_pairs(lines: DataFrame) -> DataFrame:
    """picture, y, one, two: every line of a picture beside that of the next one; lines are (p, y, line)."""
    first = lines.select(F.col("p").alias("picture"), "y", F.col("line").alias("one"))
    second = lines.select((F.col("p") - 1).alias("picture"), "y", F.col("line").alias("two"))
    there = lines.select("p").distinct()
    pairs = there.select(F.col("p").alias("picture")).join(there.select((F.col("p") - 1).alias("picture")), "picture")
    return pairs.join(first.join(second, ["picture", "y"], "full"), "picture")


def _grey(x):
    return (x.cast("double") + 1) * 127.5


@query(_ssim_sql("SELECT vec_id AS p, i // 8 AS y, i % 8 AS x, (CAST(v AS DOUBLE) + 1) * 127.5e0 AS v FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings) t"))
def ssim_tiles(spark, sf):
    """Each vector as a picture of 8 by 8 pixels, against the next one."""
    line = lambda y: F.transform(F.slice("embedding", y * 8 + 1, 8), _grey)
    tiles = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("p"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), line)).alias("y", "line"))
    return grid.similarity(_lines_of_pairs(tiles), ["picture"]).select("picture", F.round("ssim", 6).alias("ssim"))


@query(_ssim_sql("SELECT vec_id // 64 AS p, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, (CAST(unnest(embedding) AS DOUBLE) + 1) * 127.5e0 AS v FROM embeddings"))
def ssim_pictures(spark, sf):
    """Every 64 vectors as a picture of as many lines, against the next one; null where the last has fewer lines."""
    lines = S.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("p"), (F.col("vec_id") % 64).cast("int").alias("y"), F.transform("embedding", _grey).alias("line"))
    return grid.similarity(_lines_of_pairs(lines), ["picture"]).select("picture", F.round("ssim", 6).alias("ssim"))


# ---------------------------------------------------------------- detail tables


def _records_of(spark, sf, benchmark):
    """Wide records made from attempts, for the projections."""
    r = S.records(spark, sf)
    text = lambda name: F.concat(F.lit(f"{name} "), F.col("task_id")).alias(name)
    names = ("entry_point", "prompt", "canonical_solution", "codice_completo", "test", "text", "code_reference", "test_setup_code", "library", "perturbation_type", "instruction", "url", "ref_image", "render_path", "name", "language", "tests", "code")
    parts = F.struct(F.lit(None).cast("double").alias("text_match"), F.col("score").alias("ssim"), F.col("score").alias("color_sim"), F.col("score").alias("composite"))
    return r.select(
        "task_id", F.col("model").alias("model_id"), F.lit("LLM").alias("architecture"), F.lit(benchmark).alias("benchmark"), F.col("solved").alias("passed"), "category",
        F.struct(F.col("score").alias("codebleu")).alias("metrics"), F.array(F.lit("assert a"), F.lit("assert b")).alias("test_list"), parts.alias("image_similarity"), *map(text, names),
    )


def _detail_sql(benchmark: str) -> str:
    made = {
        "model_id": "model", "architecture": "'LLM'", "task_id": "task_id", "Codice Completo": "concat('codice_completo ', task_id)", "test_list": "concat('assert a', chr(10), 'assert b')",
        "pass@1": "CASE WHEN solved THEN 'passed' ELSE category END", "codebleu": "round_even(score, 4)", "img_text": "CAST(NULL AS DOUBLE)", "img_ssim": "round_even(score, 4)",
        "img_color": "round_even(score, 4)", "img_visual": "round_even(score, 4)",
    }
    from ..fixed_values import DETAIL

    columns = [f'{made.get(c, f"concat('{c} ', task_id)")} AS "{c}"' for c in DETAIL[benchmark]]
    return f"WITH {RECORDS} SELECT {', '.join(columns)} FROM records"


def _detail(benchmark: str):
    def run(spark, sf):
        return detail_tables.detail(_records_of(spark, sf, benchmark), benchmark)

    run.__name__ = "detail_" + benchmark.replace("-", "_")
    return run


for _benchmark in ("humaneval", "mbpp", "ds1000", "plot2code", "multipl-e"):
    query(_detail_sql(_benchmark))(_detail(_benchmark))


# ---------------------------------------------------------------- braces, lines, documents without a schema

_BLANKS = " || ".join(f"chr({ord(b)})" for b in X.BLANKS)


@query(
    f"""WITH b AS (SELECT doc_id, translate(text, 'ea', '{{}}') AS body FROM documents),
p AS (SELECT doc_id, body, string_split(body, '}}') AS parts, CAST(length(replace(body, '{{', '')) - length(replace(body, '}}', '')) AS BIGINT) AS surplus FROM b)
SELECT doc_id, greatest(surplus, 0) AS dropped,
    md5(rtrim(CASE WHEN surplus > 0 THEN concat(array_to_string(parts[1:len(parts) - surplus], '}}'), array_to_string(parts[len(parts) - surplus + 1:], '')) ELSE body END, {_BLANKS})) AS code_md5 FROM p"""
)
def brace_balance_documents(spark, sf):
    """Every text with braces in the place of two letters, brought into balance."""
    body = _docs(spark, sf).select("doc_id", F.translate("text", "ea", "{}").alias("body"))
    made = body.select("doc_id", "body", X.balance_braces("body").alias("code"))
    count = lambda x: F.length(F.regexp_replace(x, "[^}]", "")).cast("long")
    return made.select("doc_id", (count("body") - count("code")).alias("dropped"), F.md5("code").alias("code_md5"))


_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"


@query(
    rf"""WITH d AS (SELECT doc_id, replace(translate(text, 'qxz', chr(11) || chr(133) || chr(8232)), 'k', chr(13) || chr(10)) AS text FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+'), 1) - 1 AS line_no FROM d)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY line_no) - length(piece) AS BIGINT) AS start, md5(regexp_replace(piece, '(\r\n|[{_ENDS}])$', '')) AS line_md5 FROM p"""
)
def document_lines(spark, sf):
    """The lines of every text, with line ends of several kinds in the place of some letters."""
    text = F.replace(F.translate("text", "qxz", "\x0b\x85\u2028"), F.lit("k"), F.lit("\r\n"))
    found = lines.text_lines(_docs(spark, sf).select("doc_id", text.alias("text")), "text", "doc_id")
    return found.select("doc_id", "line_no", "start", F.md5("line").alias("line_md5"))


_EVENT_JSON = """j AS (
    SELECT event_id, CASE WHEN json_valid(x) THEN x END AS j FROM (
        SELECT event_id, CASE WHEN event_id % 7 = 0 THEN rtrim(props, '}') WHEN event_id % 5 = 0 THEN concat('{"who": {"id": "n/d"}, "props": ', props, '}')
            ELSE concat('{"props": ', props, ', "who": {"id": ', user_id, '}, "tags": ["', event_type, '", ', CAST(floor(value) AS BIGINT), ', null]}') END AS x FROM events) t
)"""


def _event_documents(spark, sf):
    """event_id, document: of each event; some are broken, some have no tags and no number of a user."""
    whole = F.concat(F.lit('{"props": '), "props", F.lit(', "who": {"id": '), "user_id", F.lit('}, "tags": ["'), "event_type", F.lit('", '), F.floor("value").cast("long").cast("string"), F.lit(", null]}"))
    odd = F.concat(F.lit('{"who": {"id": "n/d"}, "props": '), "props", F.lit("}"))
    text = F.when(F.col("event_id") % 7 == 0, F.rtrim("props", F.lit("}"))).when(F.col("event_id") % 5 == 0, odd).otherwise(whole)
    return S.table(spark, sf, "events").select("event_id", nested.parsed(text).alias("document"))


@query(f"WITH {_EVENT_JSON} SELECT event_id, j IS NOT NULL AS valid, CAST(json_extract_string(j, '$.props.k') AS BIGINT) AS k, try_cast(json_extract_string(j, '$.who.id') AS BIGINT) AS who FROM j")
def event_fields(spark, sf):
    """Fields of documents without a schema, as typed columns."""
    typed = nested.shredded(_event_documents(spark, sf), "document", {"k": ("$.props.k", "bigint"), "who": ("$.who.id", "bigint")})
    return typed.select("event_id", F.col("document").isNotNull().alias("valid"), "k", "who")


@query(
    f"WITH {_EVENT_JSON}, t AS (SELECT event_id, j, unnest(range(CAST(json_array_length(j, '$.tags') AS BIGINT))) AS tag_no FROM j)"
    " SELECT event_id, tag_no, tag FROM j LEFT JOIN (SELECT event_id, tag_no, json_extract_string(j, concat('$.tags[', tag_no, ']')) AS tag FROM t) u USING (event_id)"
)
def event_tags(spark, sf):
    """Each tag of each document, in its order; documents without tags have one row."""
    tags = nested.members(_event_documents(spark, sf), nested.field("document", "$.tags", "variant"), "tag_no", "_key", "_tag", keep_empty=True)
    return tags.select("event_id", F.col("tag_no").cast("long").alias("tag_no"), nested.field("_tag", "$").alias("tag"))


# ---------------------------------------------------------------- what SQL can't say


@query()
def strip_docstrings(spark, sf):
    program = F.concat(F.lit("def f(x):\n    '''"), F.col("p_name"), F.lit("'''\n    return x\n"))
    return S.table(spark, sf, "part").select("p_partkey", code_functions.strip_docstrings(program).alias("code"))


@query("SELECT p_partkey, 'if (x) { y(); }' AS code FROM part")
def brace_balance(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", X.balance_braces(F.concat(F.lit("if (x) { y(); }"), F.repeat(F.lit("}"), F.col("p_size") % 3))).alias("code"))


@query()
def codebleu_udf(spark, sf):
    ref = F.concat(F.lit("def f(a):\n    b = a + "), F.col("p_size").cast("string"), F.lit("\n    return b\n"))
    got = F.concat(F.lit("def f(x):\n    y = x + 1\n    return y"), F.when(F.col("p_size") % 5 == 0, "(").otherwise("\n"))
    return S.table(spark, sf, "part").select("p_partkey", F.round(code_functions.codebleu(ref, got), 6).alias("score"))


_BODIES = ("return len(s)", "return len(s) + 1", "return s.count('e')", "return {}[s]", None, "return undefined", "raise ValueError(s)", "return (")
_OUTCOMES = "CASE p_partkey % 8 WHEN 0 THEN 'Passed' WHEN 1 THEN 'AssertionError' WHEN 2 THEN CASE WHEN length(replace(p_name, 'e', '')) = 0 THEN 'Passed' ELSE 'AssertionError' END WHEN 3 THEN 'KeyError' WHEN 4 THEN 'EmptyOutput' WHEN 5 THEN 'NameError' WHEN 6 THEN 'ValueError' ELSE 'SyntaxError' END"


@query(f"SELECT p_partkey AS task_id, {_OUTCOMES} AS category FROM part")
def execute_candidates(spark, sf):
    """A candidate for each part, which is to say how long the part's name is: run through a ledger, and classified."""
    import uuid

    name = code_functions.python_literal(F.col("p_name"))
    body = F.get(F.array(*[F.lit(b) for b in _BODIES]), (F.col("p_partkey") % len(_BODIES)).cast("int"))
    code = F.coalesce(F.concat(F.lit("def f(s):\n    "), body), F.lit(""))
    test = F.concat(F.lit("assert f("), name, F.lit(") == "), F.length("p_name").cast("string"))
    problems = S.dealt(S.table(spark, sf, "part")).select(F.col("p_partkey").alias("task_id"), F.lit("").alias("test_setup_code"), F.array(test).alias("test_list"), code.alias("code"))
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    raw = ledger.execute_table(problems, "mbpp", "task_id", folder, 20.0, seconds=F.length("code") / 100, bins=2 * spark.sparkContext.defaultParallelism, allow=True, once=True)
    return execution.classified(raw, "mbpp").select("task_id", "category")


@query()
def image_compare(spark, sf):
    """Drawn pictures against each other: the first with itself, with a moved one, with noise that isn't a picture."""
    import struct
    import zlib

    def png(shift):
        line = bytes(255 if (x + shift) % 16 < 8 else 0 for x in range(64))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        head = struct.pack(">IIBBBBB", 64, 48, 8, 0, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress((b"\0" + line) * 48)) + chunk(b"IEND", b"")

    rows = spark.createDataFrame([(0, png(0), png(0)), (1, png(0), png(5)), (2, png(0), b"noise")], "pair int, ref binary, got binary")
    return rows.select("pair", images.image_similarity("ref", "got").alias("s")).select("pair", *[F.round(f"s.{p}", 6).alias(p) for p in ("text_match", "ssim", "color_sim", "composite")])
