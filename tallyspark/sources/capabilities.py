"""What this environment can run: libraries, language runtimes and credentials, as small DataFrames."""

from __future__ import annotations

import glob
import importlib.util
import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import INTERPRETERS, LIBRARIES, MODELS, PRICES, PROVIDER_KEYS

COMPILERS = {"java": ("javac", "java"), "cpp": ("g++", "clang++", "c++"), "rs": ("rustc",), "dart": ("dart",), "go": ("go",), "cs": ("dotnet",)}


#: where a tool may be beside the PATH, as glob patterns by its name; the user's own
FALLBACKS: dict[str, tuple[str, ...]] = {}


def version(path: str) -> tuple:
    """A key by which 1.10 comes after 1.9."""
    return tuple((int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", path))


def newest(patterns) -> str | None:
    """The match of greatest version of the first pattern that has any."""
    return next((max(found, key=version) for found in map(glob.glob, patterns) if found), None)


def tool(name: str, fallbacks_first: bool = False) -> str | None:
    """Path of an executable, from the PATH or from its fallbacks; null if it is nowhere."""
    ways = [lambda: shutil.which(name), lambda: newest(FALLBACKS.get(name, ()))]
    return next(filter(None, (way() for way in (reversed(ways) if fallbacks_first else ways))), None)


def libraries(spark: SparkSession) -> DataFrame:
    rows = [(name, importlib.util.find_spec(module) is not None) for name, module in LIBRARIES.items()]
    return spark.createDataFrame(rows, "capability string, available boolean")


def runtimes(spark: SparkSession) -> DataFrame:
    found = {lang: tool(program) is not None for lang, (_, program, _) in INTERPRETERS.items()}
    for lang, tools in COMPILERS.items():
        there = [tool(t) is not None for t in tools]
        found[lang] = all(there) if lang == "java" else any(there)
    return spark.createDataFrame(list(found.items()), "capability string, available boolean")


def has_key(provider: str, env=os.environ) -> bool:
    return bool(env.get(PROVIDER_KEYS[provider]))


def models(spark: SparkSession, keys: list[str] | None = None) -> DataFrame:
    """The model dimension with its prices; unknown keys select nothing, none select all."""
    rows = [(i, key, model_id, provider, arch, *PRICES.get(model_id, (0.0, 0.0)), has_key(provider)) for i, (key, model_id, provider, arch) in enumerate(MODELS)]
    df = spark.createDataFrame(rows, "rank int, model string, model_id string, provider string, architecture string, price_in double, price_out double, has_key boolean")
    return df.filter(F.col("model").isin(keys)) if keys else df


def split_runnable(problems: DataFrame, key: str, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems that can run; key and number of those that can't)."""
    there = F.broadcast(capabilities.filter("available").select(F.col("capability").alias(key)))  # a row for each library or language
    return problems.join(there, key, "left_semi"), problems.join(there, key, "left_anti").groupBy(key).agg(F.count("*").alias("skipped"))
