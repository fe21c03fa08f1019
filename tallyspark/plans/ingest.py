"""Queries on the way from problem sets to records: sets written in their own shapes and read by the loaders, programs, assembled records,
and reports whose order is a column. Problems are made from the sample tables, all rows of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import outcome
from ..functions import text as X
from ..operators import execution
from ..operators.detail import assemble, detail
from ..sources import detail_csv, problem_sets
from ..sources import synthetic as S
from . import reports as R
from .registry import DIM, RATES, RECORDS, _LABELLED, _PAIRS, _labelled, query, shared_folder


def _written(df):
    """The path of the frame's rows as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/set-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


# ---------------------------------------------------------------- problem sets through their loaders


@query("SELECT concat('HumanEval/', p_partkey) AS task_id, p_partkey AS ordinal, concat('def f', p_size, '(x):', chr(10), '    return x + ', p_size) AS codice_completo FROM part")
def load_humaneval(spark, sf):
    size = F.col("p_size").cast("string")
    head = F.concat(F.lit("def f"), size, F.lit("(x):\n    '''"), F.col("p_name"), F.lit("'''\n"))
    rows = S.table(spark, sf, "part").select(F.concat(F.lit("HumanEval/"), F.col("p_partkey").cast("string")).alias("task_id"), head.alias("prompt"), F.concat(F.lit("    return x + "), size, F.lit("\n")).alias("canonical_solution"))
    return problem_sets.humaneval(spark, _written(rows)).select("task_id", "ordinal", "codice_completo")


@query("SELECT p_partkey AS task_id, p_name AS text, concat('f', p_size) AS called FROM part WHERE p_partkey BETWEEN 11 AND 510")
def load_mbpp(spark, sf):
    """Two splits of unlike columns, together; the range of task ids is the set's own."""
    test = F.array(F.concat(F.lit("assert f"), F.col("p_size").cast("string"), F.lit("(1) == 2")))
    rows = S.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("text"), test.alias("test_list"), "p_size")
    splits = [spark.read.parquet(_written(rows.filter("p_size % 2 = 0").drop("p_size"))), spark.read.parquet(_written(rows.filter("p_size % 2 <> 0")))]
    return problem_sets.mbpp(splits).select("task_id", "text", X.called_name(F.col("test_list")).alias("called"))


@query("SELECT p_partkey AS task_id, CASE p_size % 3 WHEN 0 THEN 'Pandas' ELSE 'Numpy' END AS library, p_name AS prompt FROM part WHERE p_size % 3 < 2")
def load_ds1000(spark, sf):
    """JSON lines of three libraries, of which two are asked for, however they are spelt."""
    library = F.when(F.col("p_size") % 3 == 0, "Pandas").when(F.col("p_size") % 3 == 1, "Numpy").otherwise("Scipy")
    rows = S.table(spark, sf, "part").select(F.col("p_name").alias("prompt"), F.struct(F.col("p_partkey").alias("problem_id"), library.alias("library")).alias("metadata"))
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    rows.write.json(path)
    return problem_sets.LOADERS["ds1000"](spark, path, None, ["pandas", "NUMPY"]).select("task_id", "library", "prompt")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS task_id, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS instruction, '' AS url FROM part")
def load_plot2code(spark, sf):
    """Rows numbered once when they are taken in; missing texts are empty."""
    rows = S.table(spark, sf, "part").orderBy("p_partkey").select(F.when(F.col("p_size") % 2 != 0, F.col("p_name")).alias("instruction"), F.lit(None).cast("string").alias("url"))
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    problem_sets.ingest_positions(rows, path)
    return problem_sets.plot2code(spark, path).select("task_id", "instruction", "url")


_MULTIPL_E = "SELECT (['java', 'sh', 'zz', 'lua'])[p_size % 4 + 1] AS language, concat('HumanEval_', p_partkey, '_f', p_size) AS name, p_size FROM part"


@query(f"SELECT concat(language, '/', name) AS task_id, concat('f', p_size) AS called FROM ({_MULTIPL_E}) t WHERE language <> 'zz'")
def load_multipl_e(spark, sf):
    """Folders by language; those of no known language are left out."""
    part = S.table(spark, sf, "part")
    language = F.get(F.array(*map(F.lit, ("java", "sh", "zz", "lua"))), (F.col("p_size") % 4).cast("int"))
    name = F.concat(F.lit("HumanEval_"), F.col("p_partkey").cast("string"), F.lit("_f"), F.col("p_size").cast("string"))
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    part.select(language.alias("language"), name.alias("name")).write.partitionBy("language").parquet(path)
    return problem_sets.multipl_e(spark, path).select("task_id", X.task_function("name").alias("called"))


# ---------------------------------------------------------------- programs and records


@query("SELECT p_partkey, concat('import re', chr(10), p_name, chr(10), 'assert f(', p_size, ')', chr(10), 'assert g()') AS mbpp, concat('# ', p_name, chr(10), 'import matplotlib', chr(10), 'import matplotlib') AS headed FROM part")
def program_text(spark, sf):
    """The text that runs for an MBPP candidate; import lines of a prompt with others."""
    size = F.col("p_size").cast("string")
    rows = S.table(spark, sf, "part").select("p_partkey", "p_name", F.lit("import re").alias("test_setup_code"), F.col("p_name").alias("code"), F.array(F.concat(F.lit("assert f("), size, F.lit(")")), F.lit("assert g()")).alias("test_list"))
    lines = X.import_header(F.concat(F.lit("import matplotlib\nx\n  import y\n"), F.col("p_name"), F.lit("\nimport matplotlib")))
    return rows.select("p_partkey", execution.program("mbpp").alias("mbpp"), F.concat(F.lit("# "), F.col("p_name"), F.lit("\n"), lines).alias("headed"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN concat('  return ', p_size) ELSE concat('return ', p_size) END AS code FROM part")
def echo_stripped(spark, sf):
    """Answers that repeat the prompt's last line (differently spaced), and others as they are."""
    size = F.col("p_size").cast("string")
    given = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("words\nint  f( int x )  {\n  return "), size)).otherwise(F.concat(F.lit("return "), size))
    return S.table(spark, sf, "part").select("p_partkey", X.strip_echo(F.concat(F.col("p_name"), F.lit("\nint f(int x) {\n\n")), given).alias("code"))


_GO = (("# x [build failed]", "SyntaxError"), ("x [setup failed]", "SyntaxError"), ("--- FAIL: TestX", "AssertionError"), ("panic: x", "RuntimeError"))
_CS = ((1, "x.cs: error CS1002", "SyntaxError"), (0, "fine", "Passed"), (0, "Assertion failed", "AssertionError"), (134, "abort", "AssertionError"), (1, "MSB1: error", "SyntaxError"))


def _chosen(values, key="event_id"):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


@query(
    f"SELECT event_id, ([{', '.join(f"'{k}'" for _, k in _GO)}])[event_id % {len(_GO)} + 1] AS go, ([{', '.join(f"'{k}'" for _, _, k in _CS)}])[event_id % {len(_CS)} + 1] AS cs,"
    " (['Passed', 'NoFigure', 'EmptyOutput', 'TimeoutError', 'RuntimeMissing', 'SyntaxError'])[event_id % 6 + 1] AS figure FROM events"
)
def classify_compiled(spark, sf):
    """Go and C# outcomes, and the outcomes of figures by exit code, time, tools and the size of what was drawn."""
    on = lambda k: F.col("event_id") % 6 == k
    figure = outcome.category(F.lit("plot2code"), F.lit("python"), F.when(on(2), " ").otherwise("x"), F.lit(0), on(3), F.lit(""), F.lit(""), F.when(on(1), 0).otherwise(9), on(4), on(5))
    return S.table(spark, sf, "events").select(
        "event_id",
        outcome.go_category(_chosen([t for t, _ in _GO])).alias("go"),
        outcome.cs_category(_chosen([r for r, _, _ in _CS]), _chosen([t for _, t, _ in _CS])).alias("cs"),
        figure.alias("figure"),
    )


def _runs(spark, sf):
    """Runs of MultiPL-E candidates, a row an attempt that counts."""
    r = S.records(spark, sf)
    usage = F.struct(*[F.col(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens")], F.lit(0).cast("long").alias("cache_read_input_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens"))
    return r.select("task_id", "model", F.concat(F.col("model"), F.lit("-id")).alias("model_id"), F.lit("LLM").alias("architecture"), F.col("benchmark").alias("name"), F.lit("lua").alias("language"), F.lit(None).cast("string").alias("prompt"), F.concat(F.lit("code "), F.col("task_id")).alias("code"), F.lit("tests").alias("tests"), "category", usage.alias("usage"), F.lit("").alias("stderr"))


@query(f"WITH {RECORDS} SELECT task_id, concat(model, '-id') AS model_id, 'LLM' AS architecture, benchmark AS name, 'lua' AS language, '' AS prompt, concat('code ', task_id) AS code, CASE WHEN solved THEN 'passed' ELSE category END AS \"pass@1\", 'tests' AS tests FROM records")
def assembled_detail(spark, sf):
    """Runs to records to the detail layout."""
    return detail(assemble(_runs(spark, sf), "multipl-e"), "multipl-e")


@query("SELECT conv_id, turn, text, \"pass@1\" = 'passed' AS solved, 'm' AS model, 'b' AS benchmark FROM (SELECT conv_id, turn, nullif(regexp_replace(concat('a,', chr(34), 'b', chr(34), chr(10), coalesce(text, '')), '\\r', '', 'g'), '') AS text, CASE turn % 2 WHEN 0 THEN 'passed' ELSE 'KeyError' END AS \"pass@1\" FROM conversations) t")
def detail_csv_roundtrip(spark, sf):
    """Whole turns behind quotes, commas and line ends, to CSV files and back."""
    text = F.concat(F.lit('a,"b"\n'), F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""))
    rows = S.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"), F.when(F.col("turn") % 2 == 0, "passed").otherwise("KeyError").alias("pass@1"))
    path = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    detail_csv.write_detail(rows, path)
    return detail_csv.read_detail(spark, path, "m", "b", rows.schema).drop("pass@1")


# ---------------------------------------------------------------- reports in an order that is a column


_RANKS = "ranks AS (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS place FROM records WHERE NOT solved GROUP BY category)"
_GRID = "(SELECT unnest(['m0', 'm1', 'm2']) AS model, unnest([0, 1, 2]) AS model_no) m CROSS JOIN (SELECT unnest(['b0', 'b1', 'b2', 'b3', 'b4']) AS benchmark, unnest([0, 1, 2, 3, 4]) AS bench_no) b"


@query(f"WITH {RECORDS}, {_RANKS} SELECT * FROM ranks")
def error_ranks(spark, sf):
    return R.error_ranks(S.records(spark, sf))


@query(
    f"WITH {RECORDS}, {_RANKS}, cells AS (SELECT m.model, m.model_no, b.benchmark, b.bench_no, r.category, r.place FROM {_GRID} CROSS JOIN ranks r),"
    " counts AS (SELECT model, benchmark, category, count(*) AS n FROM records WHERE NOT solved GROUP BY ALL)"
    " SELECT model_no, model, bench_no, benchmark, category, place, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY model, benchmark) AS BIGINT) AS total FROM cells LEFT JOIN counts USING (model, benchmark, category)"
)
def error_crosstab_ranked(spark, sf):
    return R.error_crosstab_ranked(S.records(spark, sf), S.MODELS, S.BENCHES)


@query(f"WITH {RECORDS}, {RATES} SELECT *, CAST(substr(model, 2) AS INTEGER) + 1 AS model_no, CAST(substr(benchmark, 2) AS INTEGER) + 1 AS bench_no FROM rates")
def rates_in_order(spark, sf):
    return R.ordered_results(S.records(spark, sf), S.MODELS, S.BENCHES)


@query(
    f"WITH {_LABELLED}, per AS (SELECT language, model, count(*) AS n FROM rows WHERE solved GROUP BY ALL), whole AS (SELECT *, CAST(sum(n) OVER (PARTITION BY language) AS BIGINT) AS language_total FROM per)"
    " SELECT *, dense_rank() OVER (ORDER BY language_total DESC, language) AS place FROM whole"
)
def languages_by_total(spark, sf):
    return R.languages_by_total(R.solved_by_language(_labelled(spark, sf)))


@query(f"WITH {RECORDS}, {DIM}, {_PAIRS} SELECT strong, weak, benchmark, n FROM pairs WHERE n > 0")
def pairs_to_draw(spark, sf):
    matrix = R.outcome_matrix(S.records(spark, sf), S.MODELS)
    return R.nonzero(R.cross_model_pairs(matrix, S.MODELS, S.BENCHES))


@query(
    f"WITH {RECORDS}, c AS (SELECT model, round(max(CASE WHEN model = 'm1' THEN 0 ELSE score END), 4) AS composite FROM records GROUP BY model)"
    " SELECT model, composite, row_number() OVER (ORDER BY CASE WHEN composite > 0 THEN composite ELSE -1 END DESC, model) - 1 AS place FROM c"
)
def models_by_composite(spark, sf):
    """Best composite first, 0 and missing last alike; the place is that of the sorted rows."""
    per = S.records(spark, sf).groupBy("model").agg(F.round(F.max(F.when(F.col("model") == "m1", 0e0).otherwise(F.col("score"))), 4).alias("composite"))
    return R.by_composite(per, "composite").coalesce(1).withColumn("place", F.monotonically_increasing_id())  # a row a model


@query(
    f"WITH {RECORDS} SELECT model, benchmark, task_id, CASE WHEN solved THEN 'risolto' ELSE 'non risolto' END AS label, concat(model, '') AS short,"
    " CASE model WHEN 'm0' THEN 'LLM' WHEN 'm1' THEN 'MoE' ELSE 'other' END AS architecture FROM records"
)
def labels_for_charts(spark, sf):
    """Labels of outcomes, models (before the first hyphen) and architectures (before the brackets; others as they are)."""
    kind = F.when(F.col("model") == "m0", "LLM").when(F.col("model") == "m1", "MoE").otherwise("other (kind)")
    return S.records(spark, sf).select(
        "model", "benchmark", "task_id", X.solved_label("solved").alias("label"), X.short_name(F.concat(F.col("model"), F.lit("-x-1"))).alias("short"), X.architecture_label(kind).alias("architecture")
    )


@query(f"WITH {RECORDS} SELECT model, benchmark, task_id, seq FROM records ORDER BY seq DESC LIMIT 15")
def preview_latest(spark, sf):
    """The 15 latest records: a preview, so the limit is the feature."""
    return R.preview(S.records(spark, sf), 15, F.desc("seq")).select("model", "benchmark", "task_id", "seq")


@query(
    r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),"
    r" firsts AS (SELECT doc_id, word, min(place) AS place FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w) t GROUP BY ALL)"
    r" SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY place), '') AS vocabulary FROM w LEFT JOIN firsts USING (doc_id) GROUP BY doc_id"
)
def vocabulary_in_order(spark, sf):
    """Each document's words, each once, in the order in which they first stand."""
    words = X.distinct_in_order(X.word_tokens(F.coalesce("text", F.lit(""))))
    return S.table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("vocabulary"))
