"""Candidates of a table: outcomes as those of plain subprocesses, nothing run twice, bins of equal seconds."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.code import python_literal
from tallyspark.operators import execution, ledger

PROBLEMS = "task_id long, test_setup_code string, test_list array<string>, code string, raw string"
CODES = {
    "def f():\n    return 1": "Passed", "def f():\n    return 2": "AssertionError", "def f(:": "SyntaxError", "def f():\n    return {}['a']": "KeyError", "": "EmptyOutput", None: "EmptyOutput",
    "import sys\nsys.exit(3)": "RuntimeError", "import sys\nsys.exit('no')": "RuntimeError", "def f():\n    while True: pass": "TimeoutError", "import os\nos._exit(0)": "Passed",
    "def f():\n    return f()": "RecursionError", "import os, signal\nos.kill(os.getpid(), signal.SIGKILL)": "RuntimeError", "print('é' * 100000)\ndef f():\n    return 1": "Passed",
    "import os\nos.kill(os.getppid(), 9)\nimport time\ntime.sleep(9)": "RuntimeError", "import subprocess\nsubprocess.Popen(['sleep', '60'])\ndef f():\n    return 1": "Passed",
}


def problems(spark, codes):
    return spark.createDataFrame([(i, "", ["assert f() == 1"], c, "x") for i, c in enumerate(codes)], PROBLEMS)


def test_outcomes(spark, tmp_path):
    df = problems(spark, CODES)
    raw = ledger.execute_table(df, "mbpp", "task_id", str(tmp_path / "l"), 3.0, bins=3, allow=True)
    got = {r.code: r.category for r in execution.classified(raw, "mbpp").collect()}
    assert got == CODES
    with pytest.raises(PermissionError, match="untrusted"):
        ledger.execute_table(df, "mbpp", "task_id", str(tmp_path / "l"), 3.0)
    assert ledger.execute_table(df.limit(0), "mbpp", "task_id", str(tmp_path / "e"), 3.0, bins=2, allow=True).count() == 0


def test_a_lost_task_runs_only_what_is_not_logged(spark, tmp_path):
    """Candidates leave a mark each time they run. The task fails in the middle, once; then the whole call is repeated."""
    marks = tmp_path / "marks"
    marks.mkdir()
    code = lambda i: f"import os\nopen(os.path.join({str(marks)!r}, '{i}'), 'a').write('x')\ndef f():\n    return {i % 2}"
    df = problems(spark, [code(i) for i in range(40)])
    folder = str(tmp_path / "l")
    run = lambda: ledger.execute_table(df, "mbpp", "task_id", folder, 20.0, bins=2, allow=True, flush=0.0)
    first = run()
    failing = first.select("task_id", "rc", F.when((F.col("task_id") == 31) & (F.rand() >= 0), F.raise_error(F.lit("lost"))).alias("x"))
    with pytest.raises(Exception, match="lost"):
        failing.collect()
    before = {p.name: p.read_text() for p in marks.iterdir()}
    assert before
    assert {r.task_id: r.rc for r in run().collect()} == {i: int(i % 2 == 0) for i in range(40)}
    assert {p.name: p.read_text() for p in marks.iterdir()} == {str(i): "x" for i in range(40)}
    logged = ledger.finished(spark, folder)
    assert logged.count() == 40 and logged.select("name").distinct().count() == 40
    assert all(name in {p.name for p in marks.iterdir()} for name in before)


def test_another_program_of_the_same_key_is_run(spark, tmp_path):
    folder = str(tmp_path / "l")
    run = lambda code: [r.rc for r in ledger.execute_table(problems(spark, [code]), "mbpp", "task_id", folder, 9.0, bins=1, allow=True).collect()]
    assert run("def f():\n    return 1") == [0] and run("def f():\n    return 2") == [1] and run("def f():\n    return 1") == [0]
    twice = problems(spark, ["def f():\n    return 1"]).unionAll(problems(spark, ["def f():\n    return 1"]))
    assert ledger.execute_table(twice, "mbpp", "task_id", folder, 9.0, bins=1, allow=True).count() == 2


def test_bins_hold_equal_seconds_the_longest_first(spark):
    seconds = [600.0] * 20 + [60.0] * 300 + [1.0] * 20_000 + [0.0, -5.0]
    rows = spark.createDataFrame(list(enumerate([*seconds, None])), "id long, s double")
    bins = ledger.dealt(rows, F.col("s"), F.col("id"), 20).groupBy("_bin").agg(F.sum("s").alias("sum"), F.max("s").alias("longest"), F.min("s").alias("least")).orderBy("_bin").collect()
    assert [r._bin for r in bins] == list(range(20))
    mean = sum(seconds) / 20
    assert max(r["sum"] for r in bins) < mean + 3 * 600 and bins[0].least == 600 and bins[-1].longest == 1
    assert ledger.dealt(rows, F.col("s"), F.col("id")).agg(F.max("_bin")).first()[0] + 1 == -(-int(sum(seconds) + 7) // 30)
    # the same rows have the same bins, however they lie
    one, two = (dict(ledger.dealt(r, F.col("s"), F.col("id"), 7).select("id", "_bin").collect()) for r in (rows, rows.repartition(5)))
    assert one == two


def test_a_torn_log_is_not_read(spark, tmp_path):
    own = ledger.Ledger(str(tmp_path), 3)
    own.add("a:1", (0, False, "", "", 0, False, False), 1e9)
    assert own.finished() == {}
    own.write()
    (tmp_path / "bin=3" / ".draft").write_text('["b:2", 0')
    assert list(ledger.Ledger(f"file://{tmp_path}", 3).finished()) == ["a:1"]
    assert json.loads((next((tmp_path / "bin=3").glob("*.jsonl"))).read_text())[0] == "a:1" and os.listdir(tmp_path) == ["bin=3"]


def test_names_in_programs(spark):
    names = ["it's", 'a "b"', "back\\slash", "é\n"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [eval(r.x) for r in df.select(python_literal(F.col("n")).alias("x")).collect()] == names  # noqa: S307


def test_equal_programs_are_run_once(spark, tmp_path):
    """Each run leaves a mark: as many as there are programs, while every row, of every key, has its outcome."""
    code = lambda i: f"import os\nwith open({str(tmp_path / 'marks')!r}, 'a') as f:\n    f.write('{i}')\ndef f():\n    return {i}"
    df = problems(spark, [code(i % 3) for i in range(60)] + ["", None, " "])
    raw = ledger.execute_table(df, "mbpp", "task_id", str(tmp_path / "l"), 9.0, bins=4, allow=True, once=True)
    assert set(raw.columns) == {*df.columns, *ledger.NAMES}
    got = {r.task_id: r.rc for r in raw.collect()}
    assert got == {i: int(i % 3 != 1) for i in range(60)} | {60: None, 61: None, 62: None}
    assert sorted((tmp_path / "marks").read_text()) == ["0", "1", "2"]
    # by itself each row is still run where that is not asked for
    assert ledger.execute_table(df, "mbpp", "task_id", str(tmp_path / "each"), 9.0, bins=4, allow=True).count() == 63
    assert len((tmp_path / "marks").read_text()) == 63
