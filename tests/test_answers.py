"""The answers' data source, replay, and dense positions, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import answers, generation, problem_sets

ROWS = [("m1", "a", "é\nx", (1, 2)), ("m1", "b", None, None), ("m2", "a", "y" * 5000, (3, None)), ("m/3: x", "c", "", (0, 0)), (None, "d", "z", None)]
SCHEMA = "model string, task_id string, raw string, usage struct<input_tokens:long,output_tokens:long>"


@pytest.fixture
def log(spark, tmp_path):
    answers.register(spark)
    path = str(tmp_path / "log")
    answers.log_answers(spark.createDataFrame(ROWS, SCHEMA), path)
    return path


def stored(spark, path):
    return spark.read.format("logged_answers").option("path", path).load()


def flat(df):
    return sorted(((r.model, r.task_id, r.raw, r.usage and (r.usage.input_tokens, r.usage.output_tokens)) for r in df.collect()), key=str)


def test_scan_and_pruning(spark, log):
    assert flat(stored(spark, log)) == sorted(ROWS, key=str)
    for condition, names in (("model = 'm1'", {"m1"}), ("model in ('m2', 'm/3: x')", {"m2", "m/3: x"}), ("model in ('m1', 'm2') and model = 'm2'", {"m2"}), ("model = 'none'", set()), ("model = 'm1' and task_id = 'b'", {"m1"})):
        df = stored(spark, log).filter(condition)
        assert flat(df) == sorted((r for r in ROWS if r[0] in names and ("task_id" not in condition or r[1] == "b")), key=str)
        assert df.rdd.getNumPartitions() == max(1, len({f for f, m, _, _ in answers.listed(log) if m in names}))
    assert stored(spark, log).filter("model is null").count() == 1 and stored(spark, f"{log}/none").count() == 0


def test_broken_lines(spark, log):
    with open(f"{log}/model=m2/more.json", "w") as f:
        f.write('{"task_id": 3, "raw": "r", "usage": {"input_tokens": "x"}}\n\nnot json\n[1]\n{"task_id": "last"}\n{"task_id": "cut')
    got = [r for r in flat(stored(spark, log).filter("model = 'm2'")) if r[1] != "a"]
    assert got == sorted([("m2", None, "r", (None, None)), ("m2", "last", None, None)], key=str)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_every_line_is_of_one_range(tmp_path, size):
    rng = random.Random(size)
    lines = [json.dumps({"i": i, "t": "é" * rng.randrange(40)}) for i in range(100)]
    for end in ("", "\n"):
        data = ("\n".join(lines) + end).encode()
        (tmp_path / "f").write_bytes(data)
        parts = [answers.Range(str(tmp_path / "f"), None, at, min(at + size, len(data))) for at in range(0, len(data), size)]
        assert [x.decode() for p in parts for x in answers.lines_of(str(tmp_path), p)] == lines


def test_stream_reads_each_file_once(spark, log, tmp_path):
    def run():
        source = spark.readStream.format("logged_answers").option("path", log).load()
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == len(ROWS)
    answers.log_answers(spark.createDataFrame([("m9", "n", "new", None)], SCHEMA), log)
    assert run() == len(ROWS) + 1 and run() == len(ROWS) + 1


def test_replay(spark, log):
    prompts = spark.createDataFrame([("m1", "a", "p"), ("m1", "zz", "q"), ("m2", "a", "r")], "model string, task_id string, prompt string")
    got = {(r.model, r.task_id): (r.raw, r.failure) for r in generation.replay(prompts, stored(spark, log), ["model", "task_id"]).collect()}
    assert got == {("m1", "a"): ("é\nx", None), ("m1", "zz"): (None, "no stored answer"), ("m2", "a"): ("y" * 5000, None)}


def test_positions(spark, tmp_path):
    rng = random.Random(3)
    values = [rng.randrange(10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v, str(v)) for v in values], "v long, t string")
    problem_sets.ingest_positions(df, str(tmp_path / "a"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "a")).orderBy("task_id").collect()] == values
    problem_sets.ingest_positions(df.repartition(7), str(tmp_path / "b"), order=["v", "t"])
    got = spark.read.parquet(str(tmp_path / "b")).orderBy("task_id")
    assert [(r.task_id, r.v) for r in got.collect()] == list(enumerate(sorted(values)))
    problem_sets.ingest_positions(df.filter(F.lit(False)), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]
