"""The committed store, streams into it, retries with bounded state, and similarity of pictures, against plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import grid, images
from tallyspark.plans import reports
from tallyspark.sources import shared_files
from tallyspark.streaming import records, retry
from tallyspark.streaming.store import RecordStore

SCHEMA = "k string, j int, seq long, v string"


def batches(n, seed=1, keys=40, size=30):
    rng = random.Random(seed)
    return [[(rng.choice([None, *(f"k{i}" for i in range(keys))]), rng.randrange(2), rng.randrange(1000), f"{b}.{i}") for i in range(size if b % 5 else 0)] for b in range(n)]


def latest(all_batches):
    """The record of greatest seq of each key; of equal ones that of the later batch, within a batch any."""
    best = {}
    for b in all_batches:
        own = {}
        for k, j, seq, v in b:
            if (k, j) not in own or seq > own[k, j][0]:
                own[k, j] = (seq, {v})
            elif seq == own[k, j][0]:
                own[k, j][1].add(v)
        for key, (seq, v) in own.items():
            if key not in best or seq >= best[key][0]:
                best[key] = (seq, v)
    return best


def same(store, all_batches):
    got = store.current().collect()
    want = latest(all_batches)
    assert len(got) == len(want)
    for r in got:
        seq, v = want[r.k, r.j]
        assert r.seq == seq and r.v in v


def test_commits_compaction_and_replay(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), ["k", "j"], buckets=4, many=3)
    with pytest.raises(ValueError, match="committed"):
        store.current()
    done = []
    for n, b in enumerate(batches(11)):
        df = spark.createDataFrame(b, SCHEMA)
        assert store.commit(df, "w", n)
        done.append(b)
        assert not store.commit(df, "w", n)  # a replayed batch changes nothing
        assert not store.commit(spark.createDataFrame([("k1", 0, 10**6, "old")], SCHEMA), "w", max(0, n - 1))
    same(store, done)
    assert len(store.manifest().deltas) < 3
    # another writer counts for itself
    assert store.commit(spark.createDataFrame([("k1", 0, 5000, "other")], SCHEMA), "other", 0)
    done.append([("k1", 0, 5000, "other")])
    assert not store.manifest().deltas and not store.compact()
    done.append([("k2", 1, 6000, "more"), (None, 0, -5, "less")])
    assert store.commit(spark.createDataFrame(done[-1], SCHEMA), "other", 1)
    same(store, done)
    before = store.current().collect()
    version = store.versions()[-1]
    assert store.compact() and not store.compact()
    assert sorted(map(str, store.current().collect())) == sorted(map(str, before)) == sorted(map(str, store.current(version).collect()))
    store.vacuum(1)
    same(store, done)
    folders = [x for top in ("base", "deltas") for x in shared_files.names(spark, f"{store.path}/{top}")]
    assert len(folders) == len(store.manifest().folders()) <= 4
    assert shared_files.size(spark, f"{store.path}/base")[1] <= 4 * (4 + 2)  # files of four buckets, with their markers and checksums


def test_files_stay_bounded(spark, tmp_path):
    store, seen = RecordStore(spark, str(tmp_path / "s"), ["k", "j"], buckets=2, many=2), []
    for n, b in enumerate(batches(8, seed=2, size=12)):
        store.commit(spark.createDataFrame(b, SCHEMA).coalesce(1), "w", n)
        store.vacuum(1)
        seen.append(shared_files.size(spark, store.path)[1])
    assert max(seen[4:]) <= max(seen[:4]) + 2


def test_only_one_writer_makes_a_version(spark, tmp_path):
    path = str(tmp_path / "x" / "000000000001")
    assert shared_files.create(spark, path, "é one") and not shared_files.create(spark, path, "two")
    assert shared_files.read_text(spark, path) == "é one" and shared_files.names(spark, str(tmp_path / "x")) == ["000000000001"]


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    """Another writer commits while a batch is being written: both count."""
    one, two = (RecordStore(spark, str(tmp_path / "s"), ["k", "j"], many=9) for _ in range(2))
    publish, raced = one._publish, []

    def late(after):
        if not raced:
            raced.append(two.commit(spark.createDataFrame([("b", 0, 2, "two")], SCHEMA), "two", 7))
        return publish(after)

    one._publish = late
    assert one.commit(spark.createDataFrame([("a", 0, 1, "one")], SCHEMA), "one", 3) and raced == [True]
    assert {(r.k, r.v) for r in one.current().collect()} == {("a", "one"), ("b", "two")}
    assert one.manifest().writers == {"one": 3, "two": 7}


def test_a_stream_that_fails_and_starts_again(spark, tmp_path):
    """The batch that failed after its commit is replayed and counts once."""
    done = batches(6, seed=3)
    schema = spark.createDataFrame([], SCHEMA).schema
    for n, b in enumerate(done):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
    store = RecordStore(spark, str(tmp_path / "s"), ["k", "j"], many=3)
    commit, failed = store.commit, []

    def failing(batch, writer, number):
        out = commit(batch, writer, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost after its commit")
        return out

    store.commit = failing
    start = lambda: records.start_store(records.attempts(spark, str(tmp_path / "in" / "*"), schema, files_per_trigger=1), store, str(tmp_path / "state"))
    with pytest.raises(Exception, match="lost after its commit"):
        start().awaitTermination()
    versions = len(store.versions())
    start().awaitTermination()
    assert failed == [2] and len(store.versions()) > versions
    best = {}
    for b in done:  # files come in any order: only the greatest seq of a key counts
        for k, j, seq, _ in b:
            best[k, j] = max(seq, best.get((k, j), -1))
    assert {(r.k, r.j): r.seq for r in store.current().collect()} == best


def test_retries_with_bounded_state(spark, tmp_path):
    """Done keys leave the state, those that failed stay and are asked for; late attempts change nothing."""
    folder = tmp_path / "in"
    schema = spark.createDataFrame([], "task string, seq long, category string").schema
    store = RecordStore(spark, str(tmp_path / "s"), ["task"], order="order")
    kept, seq, last = [], 0, {}
    for n in range(5):
        rows = []
        for i in range(12):
            seq += 1
            task = f"t{n}.{i}" if i > 1 else "wait" if i else f"t{max(0, n - 1)}.5"
            rows.append((task, seq, "APIError" if task == "wait" or (n < 4 and i == 7) else "Passed"))
            last[task] = (seq, rows[-1][2])
        rows.append(("wait", 1, "Passed"))  # late
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(folder / f"{n}"))
        attempts = records.attempts(spark, str(folder / "*"), schema, files_per_trigger=1)
        query = retry.start_retries(spark, attempts, ["task"], store, str(tmp_path / "state"), keep_ms=1, first_ms=1)
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(0.05)
    want = {t for t, (_, c) in last.items() if c == "APIError"}
    assert {r.task for r in retry.pending(store).collect()} == want and "wait" in want
    asked = {r.task for r in store.current().filter("asked").collect()}
    assert asked <= want and "t0.7" in asked
    # a batch's keys, those that wait, and their timers; not all keys ever seen
    assert max(kept[2:]) <= 4 * (12 + len(want)) < 4 * len(last)


def test_retries_of_many_keys_in_few_buckets(spark, tmp_path):
    """A bucket's keys are handled together, with one timer; whole-number keys, null ones among them, keep their digits."""
    rng, schema, last, seq = random.Random(3), spark.createDataFrame([], "task long, model string, seq long, category string").schema, {}, 0
    tasks = [None, 2**60 + 1, 2**60 + 2, *range(150)]
    store = RecordStore(spark, str(tmp_path / "s"), ["task", "model"], order="order")
    for n in range(2):
        rows = []
        for _ in range(400):
            seq += 1
            row = (rng.choice(tasks), rng.choice([None, "m"]), seq, rng.choice(["APIError", "Passed", None]))
            rows.append(row)
            last[row[:2]] = row[3]
        spark.createDataFrame(rng.sample(rows, 400), schema).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
        attempts = records.attempts(spark, str(tmp_path / "in" / "*"), schema, files_per_trigger=1)
        query = retry.start_retries(spark, attempts, ["task", "model"], store, str(tmp_path / "state"), buckets=4)
        query.awaitTermination()
    assert {(r.task, r.model) for r in retry.pending(store).collect()} == {k for k, c in last.items() if c == "APIError"}
    assert store.current().count() == len(last)
    # no timers of their own for each key
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= len(last) + 3 * 4


@pytest.mark.parametrize(("height", "width"), [(8, 8), (3, 2), (1, 1), (13, 30)])
def test_similarity_of_pictures(spark, height, width):
    rng = np.random.default_rng(height)
    pairs = [(p, rng.integers(0, 256, (height, width)).astype(float)) for p in range(4)]
    pairs = [(p, a, np.clip(a + rng.normal(0, 10.0 * p, a.shape), 0, 255)) for p, a in pairs]
    rows = [(p, y, a[y].tolist(), b[y].tolist()) for p, a, b in pairs for y in range(height)]
    rows += [(9, 0, [1.0], None), (10, 0, [1.0, 2.0], [1.0]), (11, 1, [1.0], [1.0]), (12, 0, [None], [1.0])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "pair int, y int, one array<double>, two array<double>")
    got = {r.pair: r.ssim for r in grid.similarity(df, ["pair"]).collect()}
    assert {p for p, s in got.items() if s is None} == {9, 10, 11, 12}
    for p, a, b in pairs:
        assert got[p] == pytest.approx(images.ssim(a, b), abs=1e-9)
    assert got[0] == pytest.approx(1)
    assert "Python" not in grid.similarity(df, ["pair"])._jdf.queryExecution().toString()


def test_means_of_whole_precision(spark):
    scores = [0.123456789, 0.1234567891, 0.5, 1 / 3, None]
    rows = [("m", "b", i % 2 == 0, s, 1, 1) for i, s in enumerate(scores)] + [("n", "b", True, x, 1, 1) for x in (0.0000005, 0.0000015)]
    df = spark.createDataFrame(rows, "model string, benchmark string, solved boolean, score double, input_tokens long, output_tokens long")
    dim = spark.createDataFrame([("m", "LLM", 1.0, 1.0)], "model string, architecture string, price_in double, price_out double")
    got = {r.model: r.mean_score for r in reports.model_summary(df, dim).collect()}
    assert got == {"m": round(sum(scores[:4]) / 4, 6), "n": 0.000001}
    assert {r.model: r.b for r in reports.score_pivot(df, ["b"]).collect()} == {"m": round(sum(scores[:4]) / 4, 3), "n": 0.0}
    assert reports.summary_with_score(df).filter("model = 'm'").first().score_text == "0.270"
    assert df.filter(F.lit(False)).transform(lambda d: reports.model_summary(d, dim)).count() == 0
