"""Documents without a schema, lines as rows and braces in balance: against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import lines
from tallyspark.functions import text as X
from tallyspark.sources import files, nested


def balanced(body):
    if body is None:
        return None
    surplus = body.count("}") - body.count("{")
    return "".join(body.rsplit("}", surplus) if surplus > 0 else [body]).rstrip()


def test_braces_against_python(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("{}}a \n \x1f ", k=n)) for n in range(60)] + ["", "}", "}}}{", None, "a { b } } }\n", "{" * 9, "}" * 100_000 + " " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.b for r in rows.select("i", X.balance_braces("t").alias("b")).orderBy("i").collect()] == [balanced(t) for t in texts]


def test_lines_against_python(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choices("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85  \x1f", k=n)) for n in range(40)] + ["", None, "no end", "\r\n", "\r\n\r", "x\n" * 60_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {}
    for r in lines.text_lines(rows, "t", "i").orderBy("i", "line_no").collect():
        held = got.setdefault(r.i, [])
        assert r.line_no == len(held) and texts[r.i][r.start :].startswith(r.line)
        held.append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t}
    assert lines.text_lines(rows.limit(0), "t", "i").count() == 0


@pytest.fixture
def books(tmp_path):
    shown = {"output_type": "display_data", "data": {"image/png": "QUJD\n", "text/plain": ["p", "q"], "application/json": {"a": [1]}}}
    cells = [
        {"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"output_type": "stream", "text": ["x\n", "y"]}, shown, {"output_type": "error", "ename": "E", "evalue": "v"}, 7, None, {}]},
        {"source": "whole", "outputs": None},
        {"cell_type": "markdown"},
        5,
        {"source": [], "outputs": {"output_type": "stream"}},
    ]
    (tmp_path / "one.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "broken.ipynb").write_text('{"cells": [')
    (tmp_path / "none.ipynb").write_text('{"metadata": {}}')
    return f"{tmp_path}/*.ipynb"


def test_notebooks_with_missing_and_odd_outputs(spark, books):
    cells = nested.notebook_cells(spark, books)
    assert [(r.cell, r.kind, r.source) for r in cells.orderBy("cell").collect()] == [(0, "code", "a\nb"), (1, None, "whole"), (2, "markdown", None), (3, None, None), (4, None, "")]
    got = {(r.cell, r.output, r.kind, r.mime, r.content) for r in nested.notebook_outputs(cells).collect()}
    assert got == {
        (0, 0, "stream", "text/plain", "x\ny"),
        (0, 1, "display_data", "image/png", "QUJD\n"),
        (0, 1, "display_data", "text/plain", "pq"),
        (0, 1, "display_data", "application/json", '{"a":[1]}'),
        (0, 2, "error", "text/plain", "E: v"),
    }
    assert files.notebook_images(spark, books).count() == 0  # no cell of a known chart


def test_shredded_columns_prune_and_filter(spark, tmp_path):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a": 1, "b": {"c": "x"}}', '{"a": "2"}', '{"a": []}', "{", None, "[]", "3"])], "i long, t string")
    typed = nested.shredded(rows.select("i", nested.parsed("t").alias("d")), "d", {"a": ("$.a", "bigint"), "c": ("$.b.c", "string")})
    typed.write.parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert sorted((r.i, r.a, r.c) for r in back.select("i", "a", "c").collect()) == [(0, 1, "x"), (1, 2, None), (2, None, None), (3, None, None), (4, None, None), (5, None, None), (6, None, None)]
    plan = back.filter("a = 2").select("i")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,2)" in plan and "variant" not in plan
    assert [r.x for r in back.filter("i = 0").select(nested.field("d", "$.b.c").alias("x")).collect()] == ["x"]
    with pytest.raises(ValueError, match="there already"):
        nested.shredded(rows, "t", {"i": ("$", "string")})
    placed = nested.members(back, F.col("d"), "place", "key", "value", keep_empty=True).filter("i = 5 or key is not null").orderBy("i", "place").collect()
    assert [(r.i, r.key) for r in placed] == [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (5, None)]
