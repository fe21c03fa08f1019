"""Functions on program text that need Python's own parser or an unbounded loop: Arrow UDFs over whole batches."""

from __future__ import annotations

import ast
import math
import textwrap
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWNERS = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def without_docstrings(code: str | None) -> str | None:
    """Docstring lines dropped where something else is left in the body; text that doesn't parse stays as it is."""
    if not code:
        return code
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return code
    drop: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, _OWNERS) and len(node.body) > 1 and ast.get_docstring(node, clean=False) is not None:
            first = node.body[0]
            drop.update(range(first.lineno, first.end_lineno + 1))
    return "\n".join(x for i, x in enumerate(code.splitlines(), 1) if i not in drop) if drop else code


def reindented(code: str | None, indent: int | None) -> str | None:
    if code is None or indent is None or not code.strip():
        return code
    return textwrap.indent(textwrap.dedent(code), " " * int(indent))


def _each(fn, *columns):
    return pd.Series([fn(*[None if x is pd.NA or (isinstance(x, float) and math.isnan(x)) else x for x in row]) for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def strip_docstrings(code: pd.Series) -> pd.Series:
    return _each(without_docstrings, code)


@F.pandas_udf(T.StringType())
def reindent(code: pd.Series, indent: pd.Series) -> pd.Series:
    return _each(reindented, code, indent)


@F.pandas_udf(T.StringType())
def python_literal(code: pd.Series) -> pd.Series:
    return _each(lambda s: None if s is None else repr(s), code)


# ---------------------------------------------------------------- code similarity


def _tokens(code: str) -> list[str]:
    import re

    return re.findall(r"\w+|[^\w\s]", code)


def _ngram_score(ref: list[str], got: list[str], weight=lambda gram: 1.0) -> float:
    """Modified n-gram precision up to 4, geometric mean with add-one smoothing above 1, times the brevity penalty."""
    if not ref or not got:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        r, g = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (ref, got))
        hit = sum(min(k, r[gram]) * (weight(gram) if n == 1 else 1.0) for gram, k in g.items())
        all_ = sum(k * (weight(gram) if n == 1 else 1.0) for gram, k in g.items())
        hit, all_ = (hit, all_) if n == 1 else (hit + 1, all_ + 1)
        if not hit:
            return 0.0
        logs += math.log(hit / all_)
    return math.exp(logs / 4) * min(1.0, math.exp(1 - len(ref) / len(got)))


def _subtrees(tree: ast.AST) -> Counter:
    """Shapes of all subtrees with children: names and constants count by their kind only."""
    found: Counter = Counter()

    def shape(node):
        kids = [shape(k) for k in ast.iter_child_nodes(node)]
        text = f"({type(node).__name__}{' '.join(kids)})"
        if kids:
            found[text] += 1
        return text

    shape(tree)
    return found


def _flows(tree: ast.AST) -> Counter:
    """(target, sources) of assignments, variables numbered in the order of their first appearance."""
    order: dict[str, str] = {}
    name = lambda n: order.setdefault(n, f"v{len(order)}")
    edges: Counter = Counter()
    for node in ast.walk(tree):
        value = getattr(node, "value", None)
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AugAssign | ast.AnnAssign | ast.For | ast.NamedExpr) else []
        value = node.iter if isinstance(node, ast.For) else value
        if targets and value is not None:
            sources = tuple(name(n.id) for n in ast.walk(value) if isinstance(n, ast.Name))
            for t in targets:
                edges.update((name(n.id), sources) for n in ast.walk(t) if isinstance(n, ast.Name))
    return edges


def _share(ref: Counter, got: Counter) -> float:
    total = sum(ref.values())
    return sum(min(k, got[x]) for x, k in ref.items()) / total if total else 1.0


def code_similarity(ref: str | None, got: str | None) -> float | None:
    """The mean of n-gram, keyword-weighted n-gram, syntax-tree and data-flow agreement, without docstrings. Null
    where a side is empty or the reference doesn't parse; a candidate that doesn't parse gets 0 for both tree parts.
    A reference without data flow counts as matched."""
    import keyword

    if not ref or not got or not ref.strip() or not got.strip():
        return None
    try:
        ref, got = without_docstrings(ref), without_docstrings(got)
        ref_tree = ast.parse(ref)
        a, b = _tokens(ref), _tokens(got)
        weighted = _ngram_score(a, b, lambda gram: 5.0 if keyword.iskeyword(gram[0]) else 1.0)
        try:
            tree = ast.parse(got)
            parts = _share(_subtrees(ref_tree), _subtrees(tree)), _share(_flows(ref_tree), _flows(tree))
        except (SyntaxError, ValueError):
            parts = 0.0, 0.0
        return (_ngram_score(a, b) + weighted + sum(parts)) / 4
    except Exception:  # any failure of the measure is a missing measure
        return None


@F.pandas_udf(T.DoubleType())
def codebleu(ref: pd.Series, got: pd.Series) -> pd.Series:
    return _each(code_similarity, ref, got).astype("float64")
