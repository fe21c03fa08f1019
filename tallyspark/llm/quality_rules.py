"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each text gets a few shares (of symbols, marks, repeated lines and repeated words), in steps of 1 / STEPS. Labelled rows that the
base rules keep and that aren't held out (``common.held_out``) are split by a hash: LEARN of them say how much more frequent bad rows
are than good ones at or beyond each step of each rule and stratum (the language); the others calibrate. A row's score is the highest such ratio of
its rules, so that each level of the score is one cutoff on every rule, and laxer levels contain stricter ones.

In each stratum the levels are gone through from the strictest on. A level is accepted while an exact binomial test on the
calibration rows rejects that a good text reaches it with probability RISK or more; the first that isn't accepted ends
the sequence, so nothing is lost along it. Strata are corrected for by Bonferroni's rule: every test of a stratum is made at DELTA / strata. (A share that one stratum
has used for its first level can't be passed on to others while it is still used for its later ones.) Of the accepted levels the one is taken that rejects
most bad rows less PENALTY times the good ones. So with probability 1 - DELTA or more, in every stratum the rules reject at most RISK of
the good texts that the base rules keep. Strata with fewer good calibration rows than a test without any rejected one needs
(``least_rows``) are one stratum together, for which the same holds as a whole; if that is too small too, it gets no cutoff.

Nulls: a null text has no words; a null language is a stratum of its own, apart from the empty one; labels that are null are no labels; a doc_id with
several labels counts as bad if one is 0. Repeated rows give a row each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, held_out, materialize, small_or_plain
from .pii import let

WINDOW, RISK, DELTA, PENALTY, STEPS, LEARN, FLOOR = 5, 0.02, 0.05, 20, 100, 0.3, 0.002
SYMBOLS = "#*$%&|<>"

def shares() -> dict[str, Column]:
    """The rules: shares between 0 and 1, a text being worse the larger they are."""
    over = lambda a, b: F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))
    return {"symbols": over("n_symbols", "word_chars"), "marks": over("n_marks", "n_words"), "lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words")}


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more: windows are the hashes of all windows, in order."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p):
        twin = lambda k, h: F.coalesce(F.get(p, k)["h"] == h, F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda x, k: twin(k - 1, x["h"]) | twin(k + 1, x["h"])), lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    total = F.aggregate(let(by_hash, repeated), start, step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)


def measured(docs: DataFrame) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words; the text is dropped."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    times = lambda chars: sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")

    def hashed(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    repeats = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) >= WINDOW, let(hashed(w), _covered)).otherwise(F.lit(0).cast("long")))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    given = docs.select("doc_id", "lang", of_words.alias("w"), of_lines.alias("l"), times(SYMBOLS).alias("n_symbols"), times("!").alias("n_marks"), repeats.alias("n_repeat_words"))
    return given.select("doc_id", "lang", "w.*", "l.*", "n_symbols", "n_marks", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """ln n!: exactly up to 20, beyond by Stirling's series (to 1e-13 of it)."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k); 1 where k is n * p or more (the test can't reject there).

    The terms from k downwards, each as a multiple of the first: below the mean they fall faster than a bell's, so that
    what comes after 10 standard deviations of them is below a double's precision.
    """
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    many = F.least(k, F.ceil(10 * F.sqrt(n * p)) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, i):  # the i-th term below the first
        term = acc["term"] * ((k - i + 1) * (1 - p) / ((n - k + i) * p))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), many.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.exp(first) * F.aggregate(steps, start, add, lambda acc: acc["total"]), F.lit(1.0)))


def least_rows(strata: int, risk: float = RISK, delta: float = DELTA) -> int:
    """Good rows without which no test can reject, at the level that each of so many strata is tested at."""
    return math.ceil(math.log(delta / max(1, strata)) / math.log1p(-risk))


def _worth(steps: DataFrame, both: DataFrame) -> DataFrame:
    """stratum, rule, step, worth: by how much bad rows at or beyond the step outnumber good ones, not falling as steps rise.

    steps: (stratum, rule, step, good, bad) of learning rows; both: (stratum, goods, bads).
    """
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))
    below = Window.partitionBy("stratum", "rule").orderBy("step")
    tails = steps.select("stratum", "rule", "step", F.sum("good").over(above).alias("g"), F.sum("bad").over(above).alias("b")).join(F.broadcast(both), "stratum")
    ratio = (F.col("b") / F.greatest("bads", F.lit(1))) / (F.col("g") / F.greatest("goods", F.lit(1)) + FLOOR)
    return tails.filter("step > 0").withColumn("ratio", ratio).select("stratum", "rule", "step", F.max("ratio").over(below).alias("worth"))


def _by_step(worth: DataFrame) -> DataFrame:
    """stratum, and for each rule an array: the worth of its steps from 0 to STEPS. As large as strata x rules x STEPS."""
    listed = worth.groupBy("stratum").pivot("rule", list(shares())).agg(F.collect_list(F.struct("step", "worth")))
    upto = lambda c, i: F.array_max(F.transform(F.filter(c, lambda x: x["step"] <= i), lambda x: x["worth"]))
    dense = lambda r: F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.coalesce(upto(F.col(r), i), F.lit(0.0)))
    return listed.select("stratum", *[dense(r).alias(f"w_{r}") for r in shares()])


def accepted(tested: DataFrame, alpha: Column) -> DataFrame:
    """The rows (stratum, level, p, ...) of each stratum's levels, from the strictest on, before the first whose p is above alpha."""
    stricter = Window.partitionBy("stratum").orderBy(F.desc("level"))
    return tested.withColumn("fails", F.max((F.col("p") > alpha).cast("int")).over(stricter)).filter("fails = 0").drop("fails")


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum (a struct of lang, so that a null one is one), and the least step of each rule that is rejected, null if none.

    rows: as ``measured`` gives them. What is counted is as large as strata x rules x STEPS, whatever the number of rows.
    """
    rules = shares()
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    learns = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1000)) < int(1000 * LEARN)
    steps = [F.floor(c * STEPS).cast("int").alias(r) for r, c in rules.items()]
    used = rows.filter(~held_out()).filter(~base_failed()).join(known, "doc_id").select(F.struct("lang").alias("own"), "good", learns.alias("learns"), *steps)
    counted = used.groupBy("own", "learns", *rules).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    counted = materialize(counted, "rules-counted")  # distinct combinations of steps
    goods = materialize(counted.groupBy("own").agg(F.sum(F.when(~F.col("learns"), F.col("good")).otherwise(0)).alias("goods")), "rules-strata")
    need = least_rows(goods.count(), risk, delta)
    # small strata are one together
    pooled = goods.select("own", F.when(F.col("goods") >= need, F.col("own.lang")).alias("lang"), (F.col("goods") < need).alias("pooled"))
    pooled = pooled.select("own", F.struct("lang", "pooled").alias("stratum"))
    counted = materialize(counted.join(F.broadcast(pooled), "own").groupBy("stratum", "learns", *rules).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "rules-strata-counted")
    learning, rest = counted.filter("learns"), counted.filter(~F.col("learns"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in rules])).alias("x")
    by_step = learning.select("stratum", "good", "bad", each).groupBy("stratum", "x.rule", "x.step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    both = learning.groupBy("stratum").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    worths = materialize(_by_step(materialize(_worth(by_step, both), "rules-worth")), "rules-worths")
    score = F.greatest(*[F.get(F.col(f"w_{r}"), F.col(r)) for r in rules])
    scored = rest.join(F.broadcast(worths), "stratum").withColumn("level", score).groupBy("stratum", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    stricter = Window.partitionBy("stratum").orderBy(F.desc("level"))
    sums = {"k": F.sum("good").over(stricter), "caught": F.sum("bad").over(stricter), "n": F.sum("good").over(Window.partitionBy("stratum"))}
    tried = materialize(scored.withColumns(sums).filter("level > 0").withColumn("p", at_most(F.col("k"), F.col("n"), risk)), "rules-tested")
    strata = max(1, counted.select("stratum").distinct().count())
    gone = accepted(tried, F.lit(delta / strata))
    gain = F.col("caught") - PENALTY * F.col("k")
    best = gone.withColumn("gain", gain).filter("gain > 0").groupBy("stratum").agg(F.max_by("level", F.struct("gain", "level")).alias("level"))
    lowest = lambda r: F.get(F.filter(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.get(F.col(f"w_{r}"), i) >= F.col("level")), F.lit(0))
    best = best.join(worths, "stratum").select("stratum", *[lowest(r).alias(r) for r in rules])
    return materialize(pooled.join(F.broadcast(best), "stratum").select(F.col("own").alias("stratum"), *rules), "rules-cutoffs")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, and kept: neither that nor at or beyond a cutoff of its stratum."""
    rows = materialize(measured(docs), "rules-measured")
    chosen = cutoffs(rows, labels).select("stratum", *[F.col(r).alias(f"cut_{r}") for r in shares()])
    joined = rows.join(small_or_plain(chosen), F.struct(rows["lang"]).eqNullSafe(chosen["stratum"]), "left")
    beyond = [F.coalesce(F.floor(share * STEPS) >= F.col(f"cut_{r}"), F.lit(False)) for r, share in shares().items()]
    rejected = reduce(lambda x, y: x | y, beyond)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", *[f"cut_{r}" for r in shares()])
