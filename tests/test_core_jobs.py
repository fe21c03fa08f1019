"""Queries whose SQL twin once had the same cut as they: against brute force in Python, and the twin too."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import bags
from tallyspark.plans import registry


def tables(spark, folder, **rows):
    """Parquet tables (schema, rows) by name; the folder and a DuckDB connection that has them as views."""
    con = duckdb.connect()
    for name, (schema, given) in rows.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return str(folder), con


def both(spark, sf, con, name):
    """Rows of the query and of its twin, columns in the query's order."""
    got = registry.QUERIES[name](spark, sf)
    order = ", ".join(got.columns)
    return [tuple(r) for r in got.collect()], con.sql(f"SELECT {order} FROM ({registry.ORACLE_SQL[name]}) t").fetchall()


def test_contamination_overlap(spark, tmp_path):
    items = [(i, f"w{i} w{i} und {'the' if i % 2 else 'was'}") for i in range(130)] + [(200, "Für für a 7"), (201, "nothing-shared"), (202, ""), (203, None)]
    docs = [(1, "the für was FÜR für a"), (2, "w0 w0 w0 w129 the the"), (3, "w62 w63 und w64 7"), (4, ""), (5, None), (6, "other words only")]
    bag = lambda t: Counter(re.findall(r"[^\W_]+", (t or "").lower()))
    want = []
    for i, t in items:
        per = [sum((bag(t) & bag(d)).values()) for _, d in docs]
        want.append((i, sum(n > 0 for n in per), sum(per)))
    sf, con = tables(spark, tmp_path, benchmark=("item_id long, text string", items), documents=("doc_id long, text string", docs))
    got, twin = both(spark, sf, con, "contamination_overlap")
    assert sorted(got) == sorted(want)
    assert sorted(twin) == sorted(want)


def test_ordered_results(spark, tmp_path):
    events = [(i, 3 * t, kind, 1.5, '{"k": 1}') for i, (t, kind) in enumerate([(500, "click"), (1, "view"), (200, "signup"), (201, "click"), (201, "purchase"), (7, "view")])]
    orders = [(500,), (201,), (200,), (1,), (8,)]
    schema = "event_id long, user_id long, event_type string, value double, props string"
    sf, con = tables(spark, tmp_path, events=(schema, events), orders=("o_orderkey long", orders))
    want = [(n, f"t/{n}", "m0", "b1", c) for n, c in [(1, "Passed"), (200, "APIError"), (201, "AssertionError"), (500, "Passed")]]
    got, twin = both(spark, sf, con, "ordered_results")
    assert got == want
    assert sorted(twin) == want


@pytest.mark.parametrize("budget", [0, bags.BROADCAST_BYTES])
def test_bags_against_counters(spark, monkeypatch, budget):
    monkeypatch.setattr(bags, "BROADCAST_BYTES", budget)
    monkeypatch.setattr(bags, "BUCKET", 40)
    draw = random.Random(5)
    texts = {i: [draw.choice("abcdefghij") for _ in range(draw.choice((0, 1, 7, 40)))] for i in range(60)} | {60: ["a"] * 5000 + ["b"], 61: ["b"] * 3000 + ["a"] * 2}
    items = {i: [draw.choice("abcdefghijxyz") for _ in range(draw.choice((0, 2, 6)))] for i in range(130)}
    frame = lambda rows, name: spark.createDataFrame(sorted(rows.items()), f"{name} long, tokens array<string>")
    got = {r.item: (r.docs, r.shared) for r in bags.overlap(frame(items, "item"), frame(texts, "doc"), "item", "doc", F.col("tokens")).collect()}
    sizes = {i: [sum((Counter(x) & Counter(t)).values()) for t in texts.values()] for i, x in items.items()}
    assert got == {i: (sum(n > 0 for n in per), sum(per)) for i, per in sizes.items()}
    if budget:
        held = frame(texts, "a").select("a", F.sort_array("tokens").alias("tokens"))
        pairs = spark.createDataFrame([(a, b) for a in range(62) for b in (a, (a * 7) % 62, 61, 99)], "a long, b long").distinct()
        for r in bags.pair_f1(pairs, held, held.withColumnRenamed("a", "b"), "a", "b").collect():
            one, two = Counter(texts[r.a]), Counter(texts.get(r.b, []))
            common, size = sum((one & two).values()), one.total() + two.total()
            assert (r.common, r.f1) == (common, round(2 * common / size, 6) if size else 1.0), (r.a, r.b)
