"""The command line: arguments, and a run over a small set with its log, detail tables and summary."""

import pytest

from tallyspark import cli
from tallyspark.sources import detail_csv
from tallyspark.sources.generation import Stub


def test_arguments():
    given = cli.parser().parse_args("run -b mbpp -n 3 -m a b --problems p --log l --out o --generator m:x".split())
    assert (given.benchmark, given.limit, given.models, given.allow, given.fresh) == ("mbpp", 3, ["a", "b"], False, False)
    for wrong in ("run -b nope --problems p --log l --out o --generator m:x", "run -b mbpp -n 0 --problems p --log l --out o --generator m:x", ""):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(wrong.split())


def test_run(spark, tmp_path, capsys):
    rows = [(11, "t", "c", "", ["assert f() == 1"]), (12, "t", "c", "", ["assert f() == 2"]), (900, "t", "c", "", ["assert f() == 1"])]
    spark.createDataFrame(rows, "task_id long, text string, code string, test_setup_code string, test_list array<string>").write.parquet(f"{tmp_path}/set")
    key = cli.capabilities.MODELS[0][0]
    args = cli.parser().parse_args(f"run -b mbpp -m {key} -t 5 --allow --problems {tmp_path}/set --log {tmp_path}/log --out {tmp_path}/out --generator m:x".split())
    got = cli.run(spark, args, Stub("```python\ndef f():\n    return 1\n```")).collect()
    assert [(r.model, r.total, r.passed) for r in got] == [(key, 2, 1)]
    found, missing = detail_csv.read_all(spark, f"{tmp_path}/out", [key], ["mbpp"])
    assert not missing and {(r.task_id, r.solved) for r in found.collect()} == {("11", True), ("12", False)}
    shown = capsys.readouterr().out
    assert "pass_at_1" in shown and "AssertionError" in shown
    assert [(r.model, r.total) for r in cli.show_reports(spark, f"{tmp_path}/log").collect()] == [(key, 2)]
