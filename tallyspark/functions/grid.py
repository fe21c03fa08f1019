"""Structural similarity of pictures as tables of pixel rows, natively: no Python worker, and no picture in one row.

A picture is a row for each of its lines. The Gaussian is separable: along a line it is a sliding window over the array, across lines a framed window over the
picture's rows. Beyond the edges a picture is mirrored, its edge line being repeated; the lines that a window needs beyond the first and the last are made
as copies first, so that every frame is whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGMA, TRUNCATE = 1.5, 3.5


def kernel(sigma: float = SIGMA, truncate: float = TRUNCATE) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def mirrored(i: Column, n: Column) -> Column:
    """The place in 0 .. n - 1 that place i beyond the edges stands for."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def blurred(line: Column, weights: list[float]) -> Column:
    """A line of pixels, each the weighted sum of those around it."""
    radius, n = len(weights) // 2, F.size(line)
    at = lambda i: F.get(line, mirrored(i, n))
    return F.transform(line, lambda _, i: reduce(lambda a, b: a + b, [F.lit(w) * at(i + (k - radius)) for k, w in enumerate(weights)]))


def across(lines: DataFrame, picture: list[str], place: str, height: str, columns: list[str], weights: list[float]) -> DataFrame:
    """The same down the lines: each array of ``columns`` becomes the weighted sum of those of the lines around it."""
    radius = len(weights) // 2
    y, h = F.col(place), F.col(height)
    # the places in -radius .. height - 1 + radius that this line stands for
    turns = F.sequence(-F.ceil(F.lit(radius) / (2 * h)).cast("int") - 1, F.ceil(F.lit(radius) / (2 * h)).cast("int") + 1)
    places = F.flatten(F.transform(turns, lambda k: F.array(y + 2 * h * k, 2 * h * k - 1 - y)))
    places = F.filter(places, lambda p: (p >= -radius) & (p < h + radius))
    every = lines.withColumn("_at", F.explode(places))
    around = Window.partitionBy(*picture).orderBy("_at").rowsBetween(-radius, radius)
    framed = every.withColumn("_around", F.collect_list(F.struct(*columns)).over(around)).filter(F.col("_at") == y)

    def summed(c):
        start = F.transform(F.col(c), lambda _: F.lit(0e0))
        steps = F.zip_with(F.col("_around"), F.array(*map(F.lit, weights)), lambda r, w: F.struct(r[c].alias("line"), w.alias("w")))
        return F.aggregate(steps, start, lambda acc, s: F.zip_with(acc, s["line"], lambda a, x: a + s["w"] * x))

    return framed.select(*[c for c in lines.columns if c not in columns], *[summed(c).alias(c) for c in columns])


def similarity(lines: DataFrame, pair: list[str], place: str = "y", one: str = "one", two: str = "two", span: float = 255.0, weights: list[float] | None = None) -> DataFrame:
    """The pair's columns and ssim: the mean of the map of structural similarity, cut to 0..1.

    lines: a row for each line of a pair of pictures of one size, with the line's place from 0 and both its arrays of pixels. Pairs with a line that is missing, null or of
    another length in the other picture have a null ssim.
    """
    weights = weights or kernel()
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    double = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    product = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    whole = Window.partitionBy(*pair)
    fits = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b")) & ~F.exists(F.zip_with("_a", "_b", lambda x, y: x + y), lambda x: x.isNull())
    rows = lines.select(*pair, F.col(place).cast("int").alias("_y"), double(one).alias("_a"), double(two).alias("_b")).withColumn("_fits", fits)
    rows = rows.withColumns({"_h": F.count("*").over(whole), "_good": F.min("_fits").over(whole), "_top": F.max("_y").over(whole)})
    bad = rows.filter(~F.col("_good") | (F.col("_top") + 1 != F.col("_h"))).select(*pair).distinct().withColumn("ssim", F.lit(None).cast("double"))
    good = rows.filter(F.col("_good") & (F.col("_top") + 1 == F.col("_h"))).withColumn("_h", F.col("_h").cast("int"))
    maps = {"_m1": F.col("_a"), "_m2": F.col("_b"), "_aa": product("_a", "_a"), "_bb": product("_b", "_b"), "_ab": product("_a", "_b")}
    made = good.select(*pair, "_y", "_h", *[v.alias(k) for k, v in maps.items()])  # once a line, not once for each use of it
    wide = made.select(*pair, "_y", "_h", *[blurred(F.col(k), weights).alias(k) for k in maps])
    done = across(wide, pair, "_y", "_h", list(maps), weights)
    cells = F.arrays_zip(*maps)

    def of(c):
        m1, m2 = c["_m1"], c["_m2"]
        return (2 * m1 * m2 + c1) * (2 * (c["_ab"] - m1 * m2) + c2) / ((m1 * m1 + m2 * m2 + c1) * (c["_aa"] - m1 * m1 + c["_bb"] - m2 * m2 + c2))

    line = F.aggregate(F.transform(cells, of), F.lit(0e0), lambda a, x: a + x)
    per = done.select(*pair, "_h", line.alias("_sum"), F.size("_m1").alias("_w")).groupBy(*pair).agg(F.sum("_sum").alias("_sum"), F.sum("_w").alias("_n"))
    return per.select(*pair, F.least(F.greatest(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("ssim")).unionByName(bad)
