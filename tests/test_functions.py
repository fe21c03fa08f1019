"""Text, code, classification, image and execution functions on the cases that went wrong once."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import code, images, outcome, prompts
from tallyspark.functions import text as X
from tallyspark.operators import execution


def value(spark, make, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
    return df.select(make(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Sure:\n```python\nx = 1\n```\nbye", "x = 1"),
        ("```javascript\nlet a\n```", "let a"),
        ("```py\n```", ""),
        ("Here it is:\nimport os\nx = 1", "import os\nx = 1"),
        ("no code at all", "no code at all"),
        ("```\nBEGIN SOLUTION\n    return df  \nEND SOLUTION\n```", "    return df"),
        (None, ""),
        ("", ""),
    ],
)
def test_extract_code(spark, raw, want):
    assert value(spark, X.extract_code, raw) == want


def test_lines_and_edges(spark):
    for text in ("a\nb\n", "", "\n", "a\r\nb\rc", "x\x0by\u2028z"):
        assert value(spark, X.lines, text) == text.splitlines()
    assert value(spark, X.trim_blank_edges, "\n  \n    x \n\ny\t\n\n") == "    x\n\ny"
    assert value(spark, X.import_header, "import a\n  from b import c\nfrom d import e") == "import a\nfrom d import e"


def test_prompt_parts(spark):
    prompt = "def f(a: int,\n      b) -> int:\n    '''an Empty list, or sorted\n    >>> f(1, 2)\n    3\n    >>> a\n    >>> b\n    >>> c'''"
    assert value(spark, X.signature, prompt) == "def f(a: int, b) -> int:"
    assert value(spark, X.return_type, prompt) == "int" and value(spark, X.return_type, "def f():") is None
    assert value(spark, X.doctests, prompt) == [">>> f(1, 2)", ">>> a", ">>> b"]
    assert value(spark, X.edge_words, prompt) == ["empty", "sorted"]
    assert value(spark, lambda t: X.called_name(F.array(F.lit("x"), t)), "assert set(area(1)) == abs(2)") == "area"
    assert value(spark, X.task_function, "MBPP_12_go_on") == "go_on"
    assert value(spark, X.solution_form, "def f(x):\n[insert]") == "function-body" and value(spark, X.solution_form, "a\n[insert]") == "module"
    assert value(spark, X.insert_indent, "  for a in b:\n[insert]") == 6


def test_echo(spark):
    echo = lambda a, b: value(spark, X.strip_echo, a, b)
    assert echo("// doc\nfn f(a: i32) {\n", "fn f(a:i32) {\n  a\n}") == "  a\n}"
    assert echo("fn f() {\n", "  a\n}") == "  a\n}"
    assert echo("fn f() {", "fn f() {") == ""


def test_code_functions():
    assert code.without_docstrings("def f():\n    '''d'''\n    return 1") == "def f():\n    return 1"
    assert code.without_docstrings("def f():\n    '''only'''") == "def f():\n    '''only'''"
    assert code.without_docstrings("def f(:") == "def f(:"
    assert code.reindented("  x\n    y", 4) == "    x\n      y"
    ref = "def f(a):\n    b = a + 1\n    return b\n"
    assert code.code_similarity(ref, ref) == pytest.approx(1.0)
    assert code.code_similarity(ref, "") is None and code.code_similarity("def (", ref) is None
    assert code.code_similarity(ref, "print(0)") < 0.5


def test_classification(spark):
    python = lambda t: value(spark, outcome.python_category, t)
    assert python("Traceback\n  x\nfoo.bar.KeyError: 'a'\n") == "KeyError"
    assert python("ModuleNotFoundError: no") == "ImportError" and python("ZeroDivisionError") == "RuntimeError" and python("") == "RuntimeError"
    other = lambda t: value(spark, outcome.other_category, t)
    assert other("\n") == "AssertionError" and other("bc: command not found") == "NameError" and other("x\nnot ok 3") == "AssertionError"
    assert value(spark, outcome.go_category, "--- FAIL: TestX expected 3") == "AssertionError" and value(spark, outcome.go_category, "[build failed]") == "SyntaxError"
    assert value(spark, lambda t: outcome.cs_category(F.lit(0), t), "Assertion failed") == "AssertionError"
    assert value(spark, lambda t: outcome.cs_category(F.lit(0), t), "msb3644 warning") == "Passed"


def test_prompts(spark):
    row = spark.createDataFrame([("add", "def add(a) -> int:\n    '''zero\n    >>> add(1)\n'''")], "entry_point string, prompt string")
    text = row.select(prompts.prompt("humaneval").alias("p")).first().p
    assert "`add`" in text and "def add(a) -> int:" in text and "    >>> add(1)" in text and "zero" in text
    bare = spark.createDataFrame([(None, "x")], "entry_point string, prompt string").select(prompts.hints("humaneval").alias("h")).first().h
    assert bare == ""


def png(width, height, rgb):
    rows = b"".join(b"\0" + bytes(rgb[y].astype(np.uint8).ravel()) for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark):
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 255, (20, 30, 3)), rng.integers(0, 255, (20, 30, 3))
    assert (images.read_png(png(30, 20, one)) == one).all()
    same = images.compare(png(30, 20, one), png(30, 20, one))
    assert same["ssim"] == pytest.approx(1) and same["color_sim"] == pytest.approx(1) and same["composite"] == pytest.approx(1) and same["text_match"] is None
    assert images.compare(png(30, 20, one), png(30, 20, two))["ssim"] < 0.7
    assert images.compare(b"x", b"y") is None and images.compare(None, b"") is None
    assert images.bag_f1([], []) == 1 and images.bag_f1(["a"], []) == 0 and images.bag_f1(["a", "a"], ["a"]) == pytest.approx(2 / 3)
    none = spark.range(1).select(images.composite({"ssim": F.lit(None).cast("double")}).alias("c")).first().c
    assert none is None


def test_execution(spark):
    cases = [
        ("def f(): return 1", "assert f() == 1", "Passed"),
        ("def f(): return 1", "assert f() == 2", "AssertionError"),
        ("def f(:", "f()", "SyntaxError"),
        ("  \n", "f()", "EmptyOutput"),
        ("import time", "time.sleep(60)", "TimeoutError"),
        ("import subprocess", "subprocess.Popen(['sleep', '60'])", "TimeoutError"),
        ("import sys", "sys.exit(3)", "RuntimeError"),
    ]
    rows = spark.createDataFrame([(i, None, [t], c, w) for i, (c, t, w) in enumerate(cases)], "task_id long, test_setup_code string, test_list array<string>, code string, want string")
    got = execution.classified(execution.execute(rows, "mbpp", 3.0, allow=True), "mbpp").collect()
    assert [(r.task_id, r.category) for r in got] == [(r.task_id, r.want) for r in got] and len(got) == len(cases)
    with pytest.raises(PermissionError):
        execution.execute(rows, "mbpp", 3.0)
    shell = spark.createDataFrame([("1", "sh", "f() {\n", "  echo 1\n}\n}", "}\n[[ $(f) = 1 ]]"), ("2", "zz", "", "x", "")], "task_id string, language string, prompt string, code string, tests string")
    out = {r.task_id: r.category for r in execution.classified(execution.execute(shell, "multipl-e", 5.0, allow=True), "multipl-e").collect()}
    assert out["2"] == "RuntimeMissing" and out["1"] in ("Passed", "SyntaxError")
