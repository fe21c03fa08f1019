"""Bags of words and vectors, natively: multiset intersections, histograms, global similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BROADCAST_BYTES, SALTS, BUCKET = 32 << 20, 16, 4096


def counted(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, token, n."""
    return rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def common_size(one: Column, two: Column) -> Column:
    """Size of the multiset intersection of two arrays of texts without nulls, each in order: both are laid into one order,
    then one pass counts how often the token at hand stands in each."""
    token, n1, n2, total = "token", "n1", "n2", "total"
    tagged = lambda side, tag: F.transform(side, lambda x: F.struct(x.alias(token), F.lit(tag).alias("second")))
    state = lambda t, a, b, c: F.struct(t.alias(token), a.alias(n1), b.alias(n2), c.alias(total))
    closed = lambda s: s[total] + F.least(s[n1], s[n2])
    one_more = lambda x, tag: (x["second"] == tag).cast("long")

    def step(s, x):
        same = s[token] == x[token]
        more = lambda n, tag: F.when(same, s[n]).otherwise(F.lit(0).cast("long")) + one_more(x, tag)
        return state(x[token], more(n1, 0), more(n2, 1), F.when(same, s[total]).otherwise(closed(s)))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(F.concat(tagged(one, 0), tagged(two, 1))), state(F.lit(""), zero, zero, zero), step, closed)


def pair_f1(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """F1 of the bags of each listed pair (a, b); left has (a, tokens), right (b, tokens), one row a key, the tokens in order.

    A bag travels as one row, and no row is made of a token. A key without a bag, or with a null one, counts as empty.
    """
    empty = F.array().cast("array<string>")
    both = pairs.join(left.select(a, F.col("tokens").alias("_one")), a, "left").join(right.select(b, F.col("tokens").alias("_two")), b, "left")
    both = both.select(a, b, F.coalesce("_one", empty).alias("_one"), F.coalesce("_two", empty).alias("_two"))
    whole = both.select(a, b, common_size(F.col("_one"), F.col("_two")).alias("common"), (F.size("_one") + F.size("_two")).cast("long").alias("_size"))
    f1 = F.when(F.col("_size") == 0, F.lit(1.0)).otherwise(F.try_divide(2e0 * F.col("common"), F.col("_size")))
    return whole.select(a, b, "common", F.round(f1, 6).alias("f1"))


def _few(df: DataFrame) -> bool:
    """Whether rows of a token and three numbers, counted, are within BROADCAST_BYTES."""
    rows, texts = df.agg(F.count("*"), F.sum(F.octet_length("token"))).first()
    return 64 * rows + (texts or 0) <= BROADCAST_BYTES


def overlap(items: DataFrame, docs: DataFrame, item: str, doc: str, tokens: Column) -> DataFrame:
    """Of each item, docs: how many documents share a token with its bag; shared: the sum of the multiset intersections.

    No pair of an item and a document is made. The intersections are summed from how many documents have a token so
    many times; documents are counted from 63 items at a time as the bits of a number, or-ed over a document's tokens.
    Items get their bits within buckets of about BUCKET items. What the items know of their tokens is broadcast if its
    counted bytes are few; else it is joined on the token and a salt, so that a frequent token is no task of its own.
    """
    mine = counted(items, item, tokens)
    known = items.select(item).distinct()
    buckets = max(1, -(-known.count() // BUCKET))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(item)) - 1
    numbered = known.withColumn("_bucket", F.pmod(F.xxhash64(item), F.lit(buckets))).withColumn("_at", place)
    numbered = numbered.select(item, (F.col("_bucket") * (BUCKET * 4) + F.floor(F.col("_at") / 63)).alias("_word"), (F.col("_at") % 63).cast("int").alias("_bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    masks = mine.join(numbered, item).groupBy("token", "_word").agg(F.bit_or(one).alias("_mask"))
    words = masks.select("token").distinct()
    in_docs = docs.select(doc, F.explode(tokens).alias("token"))
    counts = F.col("n") > 0  # always; with it both uses of a document's words need n, and so share one shuffle
    if _few(masks):
        theirs = in_docs.join(F.broadcast(words), "token", "left_semi").groupBy(doc, "token").agg(F.count("*").alias("n")).filter(counts)
        held = F.struct("_word", "_mask").alias("_held")
        marked = theirs.join(F.broadcast(masks.groupBy("token").agg(F.collect_list(held).alias("_held"))), "token")
    else:
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt")
        salted = in_docs.groupBy(doc, "token").agg(F.count("*").alias("n")).filter(counts).withColumn("_salt", F.pmod(F.xxhash64(doc), F.lit(SALTS)))
        theirs = salted.join(words.select("token", salt), ["token", "_salt"], "left_semi")
        marked = theirs.join(masks.select("token", F.array(F.struct("_word", "_mask")).alias("_held"), salt), ["token", "_salt"])
    times = theirs.groupBy("token", "n").agg(F.count("*").alias("times")).withColumnRenamed("n", "n2")
    shared = mine.join(times, "token").groupBy(item).agg(F.sum(F.least("n", "n2") * F.col("times")).alias("shared"))
    sets = marked.select(doc, F.explode("_held").alias("_held")).groupBy(doc, "_held._word").agg(F.bit_or("_held._mask").alias("_mask"))
    sets = sets.groupBy("_word", "_mask").agg(F.count("*").alias("times"))
    hits = sets.select("_word", "times", F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("getbit", F.col("_mask"), i) == 1)).alias("_bit"))
    found = hits.groupBy("_word", "_bit").agg(F.sum("times").alias("docs")).join(numbered, ["_word", "_bit"])
    whole = numbered.select(item).join(found.select(item, "docs"), item, "left").join(shared, item, "left")
    return whole.na.fill(0, ["docs", "shared"]).select(item, "docs", "shared")


def histogram(values: Column, low: float, high: float, bins: int) -> Column:
    """Shares of an array's values in equal bins; the upper edge belongs to the last bin."""
    cell = F.transform(values, lambda x: F.least(F.greatest(F.floor((x.cast("double") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)))
    n = F.nullif(F.size(values), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(cell, lambda x: x == b)) / n)


def intersection(one: Column, two: Column) -> Column:
    return F.aggregate(F.zip_with(one, two, lambda a, b: F.least(a, b)), F.lit(0e0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0e0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(values), F.lit(0))


def global_ssim(one: Column, two: Column, span: float = 1.0) -> Column:
    """Structural similarity of two arrays as wholes, without blurring."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    product = lambda a, b: mean(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    m1, m2 = mean(one), mean(two)
    v1, v2, cov = product(one, one) - m1 * m1, product(two, two) - m2 * m2, product(one, two) - m1 * m2
    return (2 * m1 * m2 + c1) * (2 * cov + c2) / ((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2))
