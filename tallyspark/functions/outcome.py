"""What became of a run: native classification of exit code, output and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import PYTHON_ERRORS, SIGNATURES
from .text import c, lines, or_null, strip

# ---- fixed values: pattern
EXCEPTION_LINE = r"^([A-Za-z_][A-Za-z0-9_.]*)(?::.*)?$"


def _any(low: Column, keys) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])


def python_category(stderr) -> Column:
    """From the last line that looks like an exception."""
    shown = F.filter(F.reverse(lines(F.coalesce(c(stderr), F.lit("")))), lambda s: F.regexp_replace(s, r"\s+$", "").rlike(EXCEPTION_LINE))
    name = F.substring_index(F.regexp_extract(F.regexp_replace(F.get(shown, F.lit(0)), r"\s+$", ""), EXCEPTION_LINE, 1), ".", -1)
    return F.when(name == "ModuleNotFoundError", "ImportError").when(name.isin(*PYTHON_ERRORS), name).otherwise("RuntimeError")


def other_category(output) -> Column:
    low = F.lower(F.coalesce(c(output), F.lit("")))
    start = F.when(strip(low) == "", F.lit("AssertionError"))
    return reduce(lambda chain, kind: chain.when(_any(low, SIGNATURES[kind]), F.lit(kind)), SIGNATURES, start).otherwise("RuntimeError")


def go_category(output) -> Column:
    low = F.lower(c(output))
    return F.when(_any(low, ("build failed", "setup failed")), "SyntaxError").when(F.contains(low, F.lit("--- fail")), "AssertionError").otherwise("RuntimeError")


def cs_category(rc, output) -> Column:
    low = F.lower(c(output))
    build = _any(low, ("error cs", "build failed")) | (F.contains(low, F.lit("msb")) & F.contains(low, F.lit("error")))
    failed = F.contains(low, F.lit("assert")) & F.contains(low, F.lit("fail"))
    return F.when(build, "SyntaxError").when((c(rc) == 0) & ~failed, "Passed").otherwise("AssertionError")


def category(benchmark, language, code, rc, timed_out, out, err, artifact_bytes=None, missing=None, compile_failed=None) -> Column:
    """Category of a raw execution: see operators.execution for its columns."""
    rc, out, err = c(rc), F.coalesce(c(out), F.lit("")), F.coalesce(c(err), F.lit(""))
    off = lambda x: F.coalesce(c(x), F.lit(False)) if x is not None else F.lit(False)
    first_out, first_err = F.concat(out, F.lit("\n"), err), F.concat(err, F.lit("\n"), out)
    multi = c(benchmark) == "multipl-e"
    by_language = F.when(c(language) == "cs", cs_category(rc, first_out)).when(rc == 0, "Passed").when(c(language) == "go", go_category(first_out)).otherwise(other_category(first_err))
    figure = (c(benchmark) == "plot2code") & (rc == 0) & (F.coalesce(c(artifact_bytes) if artifact_bytes is not None else F.lit(0), F.lit(0)) == 0)
    return (
        F.when(or_null(strip(F.coalesce(c(code), F.lit("")))).isNull(), "EmptyOutput")
        .when(off(missing), "RuntimeMissing")
        .when(off(timed_out), "TimeoutError")
        .when(off(compile_failed), "SyntaxError")
        .when(multi, by_language)
        .when(figure, "NoFigure")
        .when(rc == 0, "Passed")
        .otherwise(python_category(err))
    )
