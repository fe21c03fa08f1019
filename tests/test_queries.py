"""Every registered query of the analytics library against its SQL twin, and sources, sinks and resuming."""

import duckdb
import pandas as pd
import pytest

from tallyspark.operators import evaluation, sinks
from tallyspark.plans import registry
from tallyspark.sources import detail_csv, problem_sets, run_log
from tallyspark.sources.generation import Stub

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_run_log_skips_broken_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "task_id": "a", "category": "APIError"}\n\n{"seq": 2, "task_id": "a", "category": "Passed"}\n{"seq": 3}\n{"seq": 4, "task_id": "b", "categ')
    log = run_log.read_log(spark, str(tmp_path))
    assert [(r.task_id, r.category) for r in run_log.last_write_wins(log, ["task_id"]).collect()] == [("a", "Passed")]


def test_evaluation_resumes(spark, tmp_path):
    problems = spark.createDataFrame([("1", "t", "c", "", ["assert f() == 1"]), ("2", "t", "c", "", ["assert f() == 2"])], "task_id string, text string, code string, test_setup_code string, test_list array<string>")
    calls = spark.sparkContext.accumulator(0)

    class Counting(Stub):
        def __call__(self, model_id, prompt):
            calls.add(1)
            return super().__call__(model_id, prompt)

    model = ("m", "m-1", "none", "LLM")
    step = lambda: evaluation.evaluate(problems, model, "mbpp", str(tmp_path / "log"), Counting("```python\ndef f():\n    return 1\n```"), 5.0, allow=True)
    assert {r.task_id: r.category for r in step().collect()} == {"1": "Passed", "2": "AssertionError"}
    first = calls.value
    assert {r.task_id: r.category for r in step().collect()} == {"1": "Passed", "2": "AssertionError"}
    assert calls.value == first


def test_detail_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'say "x"\nand y', "passed"), ("2", "a,b", "KeyError")], "task_id string, code string, `pass@1` string")
    detail_csv.write_detail(rows, str(tmp_path / "m/b/detail.csv"))
    got, missing = detail_csv.read_all(spark, str(tmp_path), ["m"], ["b", "c"])
    assert len(missing) == 1
    assert {(r.task_id, r.code, r.solved, r.benchmark) for r in got.collect()} == {("1", 'say "x"\nand y', True, "b"), ("2", "a,b", False, "b")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\x01<b>")], "n int, t string")
    assert sinks.write_xlsx(df, str(tmp_path / "x.xlsx"))
    assert not sinks.write_xlsx(df, str(tmp_path / "none/x.xlsx"))
    sinks.write_summary_json(df, str(tmp_path / "x.json"))


def test_problem_sets():
    assert problem_sets.canonical_library("pandas") == "Pandas"
    with pytest.raises(ValueError, match="unknown library"):
        problem_sets.canonical_library("nope")
    assert problem_sets.detect_benchmark(["test_list", "stop_tokens"]) == "multipl-e" and problem_sets.detect_benchmark(["x"]) == "humaneval"
