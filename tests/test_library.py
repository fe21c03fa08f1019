"""Registries, tools of candidates, files that the driver writes, balances and lots."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tallyspark import cli
from tallyspark.operators import detail, evaluation, execution, sinks
from tallyspark.plans import reports
from tallyspark.sources import balances, capabilities, files, problem_sets, run_log
from tallyspark.sources.generation import Stub


def test_tools_beside_the_path(tmp_path, monkeypatch):
    for v in ("1.9", "1.10", "1.2"):
        (tmp_path / f"tool-{v}").mkdir()
        (tmp_path / f"tool-{v}" / "sometool").touch()
    monkeypatch.setitem(capabilities.FALLBACKS, "sometool", (str(tmp_path / "none*"), f"{tmp_path}/tool-*/sometool"))
    assert capabilities.tool("sometool") == f"{tmp_path}/tool-1.10/sometool"
    assert capabilities.tool("no such tool") is None
    monkeypatch.setitem(capabilities.FALLBACKS, "sh", (f"{tmp_path}/tool-1.2/sometool",))
    assert capabilities.tool("sh") != capabilities.tool("sh", fallbacks_first=True) == f"{tmp_path}/tool-1.2/sometool"


def test_surroundings(tmp_path):
    assert execution.surroundings("lua", "/usr/bin/lua", str(tmp_path)) == {}
    for v in ("5.3", "5.4"):
        (tmp_path / ".luarocks/share/lua" / v).mkdir(parents=True)
    env = execution.surroundings("lua", "/usr/bin/lua", str(tmp_path))
    assert env["LUA_PATH"].startswith(f"{tmp_path}/.luarocks/share/lua/5.4/?.lua;") and env["LUA_CPATH"] == f"{tmp_path}/.luarocks/lib/lua/5.4/?.so;;"
    assert execution.surroundings("sh", "/opt/x/bash")["PATH"].startswith("/opt/x:")
    assert execution.surroundings("rb", "/usr/bin/ruby") == {}


def test_jars_on_the_class_path(tmp_path, monkeypatch):
    (tmp_path / "jars").mkdir()
    for name in ("b.jar", "a.jar", "note.txt"):
        (tmp_path / "jars" / name).touch()
    monkeypatch.setattr(execution, "which", lambda name: f"/opt/{name}")
    steps, _ = execution._steps("java", "class Problem {}", str(tmp_path), str(tmp_path / "jars"))
    path = f".:{tmp_path}/jars/a.jar:{tmp_path}/jars/b.jar"
    assert [s for s, _ in steps] == [["/opt/javac", "-cp", path, "Problem.java"], ["/opt/java", "-ea", "-cp", path, "Problem"]]


def test_balances():
    asked = []

    def fetch(provider):
        asked.append(provider)
        if provider == "broken":
            raise OSError("no network")
        return {"rich": {"is_available": True, "balance_infos": [{"total_balance": "2.5", "currency": "EUR"}]}, "odd": {"is_available": True, "balance_infos": [{"total_balance": "x"}]}, "bare": {}}.get(provider)

    of = balances.Balances(fetch)
    assert of("rich") == of("rich") == {"available": True, "amount": 2.5, "currency": "EUR"}
    assert of("broken") is None and of("broken") is None and of("none") is None and of("odd") is None
    assert of("bare") == {"available": False, "amount": 0.0, "currency": "USD"}
    assert asked == ["rich", "broken", "none", "odd", "bare"]


def test_models_without_credential(capsys):
    class Live:
        pass

    models = [{"model": "a", "provider": "x", "has_key": False}, {"model": "b", "provider": "y", "has_key": True}]
    assert [m["model"] for m in cli.runnable(models, Live())] == ["b"]
    assert "a, no credential of x" in capsys.readouterr().err
    assert cli.runnable(models, Stub()) == models
    cli.warn_balances(models, {"x": {"available": True, "amount": 0.0}, "y": None}.get)
    assert capsys.readouterr().err == "no balance left at x\n"


def test_stop():
    stop = cli.Stop()
    stop(2, None)
    assert stop.asked
    with pytest.raises(KeyboardInterrupt):
        stop(2, None)


def test_run_that_is_asked_to_stop_goes_on_later(spark, tmp_path):
    rows = [(i, "t", "c", "", ["assert f() == 1"]) for i in range(11, 31)]
    spark.createDataFrame(rows, "task_id long, text string, code string, test_setup_code string, test_list array<string>").write.parquet(f"{tmp_path}/set")
    key = capabilities.MODELS[0][0]
    args = cli.parser().parse_args(f"run -b mbpp -m {key} -t 5 --lot 8 --allow --problems {tmp_path}/set --log {tmp_path}/log --out {tmp_path}/out --generator m:x".split())

    class AfterOne(cli.Stop):  # asked while the first lot runs
        looks = 0

        @property
        def asked(self):
            self.looks += 1
            return self.looks > 1

    answer = Stub("```python\ndef f():\n    return 1\n```")
    first = cli.run(spark, args, answer, AfterOne()).first()
    assert 0 < first.total < 20
    assert cli.run(spark, args, answer).first().total == 20
    whole = json.loads((tmp_path / "out" / key / "mbpp" / "records.json").read_text())
    assert sorted(r["task_id"] for r in whole) == [str(i) for i in range(11, 31)] and whole[0]["metrics"].keys() == {"codebleu"}
    assert sorted(r.seq for r in run_log.read_log(spark, f"{tmp_path}/log").collect()) == sorted({r.seq for r in run_log.read_log(spark, f"{tmp_path}/log").collect()})


def test_lots_hold_every_problem_once(spark):
    problems = spark.range(100).select(F.col("id").alias("task_id"))
    dealt = [r.task_id for lot in evaluation.lots(problems, 30) for r in lot.collect()]
    assert sorted(dealt) == list(range(100)) and len(evaluation.lots(problems, 30)) == 4 and evaluation.lots(problems, None) == [problems]
    assert len(evaluation.lots(problems.limit(0), 5)) == 1


def test_new_metric_and_new_set(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(detail.METRICS, "shorter", lambda ref, got: (F.length(got) < F.length(ref)).cast("double"))
    runs = spark.createDataFrame([("1", "m", "m-1", "LLM", "x", "Passed", "longer")], "task_id string, model string, model_id string, architecture string, code string, category string, reference string")
    runs = runs.withColumns({c: F.lit(None).cast("string") for c in ("text", "test_setup_code")}).withColumn("test_list", F.array(F.lit("a")))
    made = detail.assemble(runs, "mbpp")
    assert made.first().metrics.shorter == 1
    run_log.append_log(made.withColumn("seq", F.lit(0)), f"{tmp_path}/log")
    assert run_log.read_log(spark, f"{tmp_path}/log", detail.metrics_type()).first().metrics.shorter == 1
    assert run_log.read_log(spark, f"{tmp_path}/log").first().metrics.asDict().keys() == {"codebleu"}
    monkeypatch.setitem(problem_sets.LOADERS, "own", lambda spark, path, limit, only: spark.range(limit))
    assert cli.load_problems(spark, "own", "", 3, None).count() == 3


def test_one_csv_and_pretty_json(spark, tmp_path):
    df = spark.createDataFrame([("b", 'x,"y"\nz', True), ("a", "é", None)], "benchmark string, task_id string, solved boolean")
    sinks.write_one_csv(df, f"{tmp_path}/one.csv")
    with open(f"{tmp_path}/one.csv", newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["benchmark", "task_id", "solved"], ["b", 'x,"y"\nz', "True"], ["a", "é", ""]]
    sinks.write_pretty_json(df, f"{tmp_path}/all.json")
    assert [r["task_id"] for r in json.loads((tmp_path / "all.json").read_text())] == ['x,"y"\nz', "é"]
    sinks.write_pretty_json(df.limit(0), f"{tmp_path}/all.json")
    assert json.loads((tmp_path / "all.json").read_text()) == []


def test_charts_under_their_names(spark, tmp_path):
    import base64

    cell = lambda source, data: {"source": [source], "outputs": [{"data": {"image/png": base64.b64encode(data).decode()}}]}
    book = {"cells": [cell("p_pass.show()", b"one"), cell('scatter_for_model("m-1")', b"two"), cell("other()", b"three")]}
    (tmp_path / "book.ipynb").write_text(json.dumps(book))
    names = {r.name for r in files.export_charts(spark, f"{tmp_path}/book.ipynb", f"{tmp_path}/charts").collect()}
    assert {p.stem: p.read_bytes() for p in (tmp_path / "charts").iterdir()} == dict(zip(sorted(names), (b"one", b"two"), strict=True))
    assert names == {"01_pass1_per_benchmark_e_modello", "02_scatter_codebleu_m-1"}


def test_crosstab_columns_by_frequency(spark):
    rows = [("m", "b", c, False) for c in ["KeyError"] * 3 + ["TypeError"] * 3 + ["NameError"] * 4] + [("m", "b", "Passed", True)]
    records = spark.createDataFrame(rows, "model string, benchmark string, category string, solved boolean")
    order = reports.error_order(records)
    assert order == ["NameError", "KeyError", "TypeError"] and reports.error_order(records.filter("solved")) == []
    wide = reports.error_crosstab(records, ["m", "n"], ["b"], order)
    assert wide.columns == ["model", "benchmark", *order, "total"] and sorted(map(tuple, wide.collect())) == [("m", "b", 4, 3, 3, 10), ("n", "b", 0, 0, 0, 0)]
