"""Reports on records (model, benchmark, task_id, category, solved, score, input_tokens, output_tokens): DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CATEGORIES

ERRORS = tuple(c for c in CATEGORIES if c != "Passed")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100e0 * F.try_divide(part, whole), digits)


#: scores are summed up in whole units of 10 ** -DIGITS
DIGITS = 12
SCORE_SUM = f"sum(CAST(CAST(score AS DECIMAL({DIGITS + 8}, {DIGITS})) * {10**DIGITS} AS DECIMAL({DIGITS + 8}, 0)))"


def exact_mean(total: str, n: str, digits: int) -> Column:
    """total / n of a sum of units as ``SCORE_SUM`` makes it, that isn't negative, rounded once, half up: in whole numbers, so that neither the order of
    a sum nor a tie in rounding matters. Null where n is 0."""
    unit = 10 ** (DIGITS - digits)
    many = f"CAST({n} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {n} > 0 THEN ((2 * {total} + {many} * {unit}) DIV (2 * {many} * {unit})) / 1e{digits}D END")


def running_counts(rows: DataFrame, group: str, order: str, counted: Column, name: str, span: int) -> DataFrame:
    """rows with ``name``: how many of the group's rows up to this one in ``order``, a whole number, satisfy ``counted``.

    Sums over ranges of ``span`` values of ``order`` come first, then those within a range: no task holds a whole group's rows.
    """
    ranged = rows.withColumns({"_range": F.floor(F.col(order) / span), "_one": F.coalesce(counted, F.lit(False)).cast("long")})
    sums = ranged.groupBy(group, "_range").agg(F.sum("_one").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_one").over(Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("_inside", inside).join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_one", "_inside", "_g", "_r", "_before")


def solved_count() -> Column:
    return F.count_if("solved")


def pass_rates(records: DataFrame) -> DataFrame:
    return records.groupBy("model", "benchmark").agg(F.count("*").alias("n"), solved_count().alias("solved"), percent(solved_count(), F.count("*")).alias("pass_pct"))


def pass_rate_pivot(records: DataFrame, benchmarks) -> DataFrame:
    """A column a benchmark, and the mean of the row's rounded percentages."""
    wide = pass_rates(records).groupBy("model").pivot("benchmark", list(benchmarks)).agg(F.first("pass_pct"))
    there = F.array_compact(F.array(*benchmarks))
    mean = F.aggregate(there, F.lit(0e0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    return wide.withColumn("mean_pct", F.round(mean, 1))


def model_summary(records: DataFrame, dimension: DataFrame) -> DataFrame:
    """Totals, pass rate, mean score, tokens and estimated cost of each model; a model without a price costs 0."""
    tokens = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    per = records.groupBy("model").agg(
        F.count("*").alias("total"),
        solved_count().alias("passed"),
        F.expr(SCORE_SUM).alias("score_sum"),
        F.count("score").alias("scored"),
        tokens("input_tokens").alias("input_tokens"),
        tokens("output_tokens").alias("output_tokens"),
    )
    priced = per.join(dimension.select("model", "architecture", "price_in", "price_out"), "model", "left")
    cost = F.col("input_tokens") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("output_tokens") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    rate = F.round(F.col("passed") / F.col("total"), 6)
    return priced.select("model", "architecture", "total", "passed", rate.alias("pass_at_1"), exact_mean("score_sum", "scored", 6).alias("mean_score"), "input_tokens", "output_tokens", F.round(cost, 4).alias("cost_usd"))


def cost_totals(summary: DataFrame) -> DataFrame:
    """The models and, if they are several, a TOTAL row: the sum of the rounded costs."""
    columns = ["model", "total", "passed", "input_tokens", "output_tokens", "cost_usd"]
    total = summary.agg(F.lit("TOTAL").alias("model"), *[F.sum(c).alias(c) for c in columns[1:-1]], F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.count("*").alias("_n"))
    return summary.select(*columns).unionByName(total.filter("_n > 1").drop("_n"))


def errors_by(records: DataFrame, *keys: str) -> DataFrame:
    return records.filter(~F.col("solved")).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def errors_by_architecture(records: DataFrame, dimension: DataFrame) -> DataFrame:
    per = errors_by(records, "model").join(dimension.select("model", "architecture"), "model", "left")
    return per.groupBy(F.coalesce("architecture", F.lit("?")).alias("architecture"), "category").agg(F.sum("n").alias("n"))


def error_map(records: DataFrame) -> DataFrame:
    pairs = errors_by(records, "model").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("pairs"))
    return pairs.select("model", F.map_from_entries("pairs").alias("errors"))


def score_pivot(records: DataFrame, benchmarks) -> DataFrame:
    wide = records.filter(F.col("benchmark").isin(*benchmarks)).groupBy("model").pivot("benchmark", list(benchmarks)).agg(exact_mean(SCORE_SUM, "count(score)", 3))
    return wide


def summary_with_score(records: DataFrame) -> DataFrame:
    """Pass counts as text, and the mean score where there is one."""
    scores = records.filter("score is not null").groupBy("model", "benchmark").agg(exact_mean(SCORE_SUM, "count(score)", 3).alias("mean_score"))
    joined = pass_rates(records).join(scores, ["model", "benchmark"], "left")
    shown = F.coalesce(F.format_number("mean_score", 3), F.lit("n/d"))
    return joined.select("model", "benchmark", F.concat_ws(" / ", F.col("solved").cast("string"), F.col("n").cast("string")).alias("solved_of"), "pass_pct", shown.alias("score_text"))


def ordered_results(records: DataFrame, models, benchmarks) -> DataFrame:
    """In the order of the model and benchmark lists."""
    place = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    return pass_rates(records).withColumns({"model_no": place(models, "model"), "bench_no": place(benchmarks, "benchmark")}).orderBy("model_no", "bench_no")


def solved_by_language(rows: DataFrame) -> DataFrame:
    """rows: language, model, solved. Solved counts with the language's total, for ordering."""
    per = rows.filter("solved").groupBy("language", "model").agg(F.count("*").alias("n"))
    return per.withColumn("language_total", F.sum("n").over(Window.partitionBy("language")))


def solved_by_language_pivot(rows: DataFrame, models) -> DataFrame:
    wide = rows.filter("solved").groupBy("language").pivot("model", list(models)).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def outcome_matrix(records: DataFrame, models) -> DataFrame:
    """A row a task, a nullable flag a model."""
    return records.groupBy("benchmark", "task_id").pivot("model", list(models)).agg(F.bool_or("solved"))


def cross_model_pairs(matrix: DataFrame, models, benchmarks) -> DataFrame:
    """For each stronger and weaker model how many tasks the weaker solves and the stronger, having tried, doesn't."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    counts = [F.count_if(~F.col(a) & F.col(b)).alias(f"{a}>{b}") for a, b in pairs]
    wide = matrix.groupBy("benchmark").agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("strong"), F.lit(b).alias("weak"), F.col(f"`{a}>{b}`").alias("n")) for a, b in pairs])).alias("p")
    grid = matrix.sparkSession.createDataFrame([(a, b, x) for a, b in pairs for x in benchmarks], "strong string, weak string, benchmark string")
    return grid.join(wide.select("benchmark", rows).select("benchmark", "p.*"), ["strong", "weak", "benchmark"], "left").na.fill(0)


def cross_model_pivot(pairs: DataFrame, benchmarks) -> DataFrame:
    wide = pairs.groupBy(F.concat_ws(" - ", "strong", "weak").alias("pair")).pivot("benchmark", list(benchmarks)).agg(F.sum("n")).na.fill(0)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(x) for x in benchmarks]))


def best_model_focus(matrix: DataFrame, best: str, others) -> DataFrame:
    """The best model's failures and how many each other, and any other, recovers; TOTAL by rollup."""
    flag = lambda m: F.coalesce(F.col(m), F.lit(False))
    missed = matrix.filter(~F.col(best))
    anyone = reduce(lambda a, b: a | b, [flag(m) for m in others])
    counts = [F.count_if(flag(m)).alias(f"by_{m}") for m in others]
    out = missed.rollup("benchmark").agg(F.count("*").alias("failures"), *counts, F.count_if(anyone).alias("by_any"))
    return out.withColumn("benchmark", F.coalesce("benchmark", F.lit("TOTAL")))


def recovered_cases(matrix: DataFrame, best: str, others) -> DataFrame:
    """Tasks that the best model fails and another solves; numbers in task ids sort as numbers."""
    flag = lambda m: F.coalesce(F.col(m), F.lit(False))
    anyone = reduce(lambda a, b: a | b, [flag(m) for m in others])
    rows = matrix.filter(~F.col(best) & anyone).select("benchmark", "task_id", *[flag(m).alias(f"solved_{m}") for m in others])
    return rows.orderBy("benchmark", F.col("task_id").try_cast("long").asc_nulls_last(), "task_id")


def error_crosstab(records: DataFrame, models, benchmarks, categories=ERRORS) -> DataFrame:
    """Every model and benchmark by category, 0 where none, with a row total. The categories are the fixed list: a static plan."""
    spark = records.sparkSession
    grid = spark.createDataFrame([(m, b) for m in models for b in benchmarks], "model string, benchmark string")
    counts = [F.count_if(F.col("category") == c).alias(c) for c in categories]
    per = records.filter(~F.col("solved")).groupBy("model", "benchmark").agg(*counts, F.count("*").alias("total"))
    return grid.join(per, ["model", "benchmark"], "left").na.fill(0)


def error_order(records: DataFrame) -> list[str]:
    """The categories of unsolved records, the commonest first, ties by name: as many names as there are categories."""
    return [r["category"] for r in errors_by(records).orderBy(F.desc("n"), "category").collect()]


def error_ranks(records: DataFrame) -> DataFrame:
    """Categories of unsolved records with their place by frequency, from 1, ties by name. Ranked after counting."""
    return errors_by(records).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


def error_crosstab_ranked(records: DataFrame, models, benchmarks) -> DataFrame:
    """The crosstab as rows in reading order: models and benchmarks as listed, categories by global frequency, 0 where none."""
    spark = records.sparkSession
    grid = spark.createDataFrame([(i, m, j, b) for i, m in enumerate(models) for j, b in enumerate(benchmarks)], "model_no int, model string, bench_no int, benchmark string")
    cells = grid.crossJoin(error_ranks(records).select("category", "place"))  # models by benchmarks by categories: names, not records
    joined = cells.join(errors_by(records, "model", "benchmark"), ["model", "benchmark", "category"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("model", "benchmark"))
    return joined.withColumn("total", total).orderBy("model_no", "bench_no", "place")


def languages_by_total(per: DataFrame) -> DataFrame:
    """solved_by_language with each language's place: most solved first, ties by name."""
    return per.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("language_total"), "language"))).orderBy("place", "model")


def nonzero(rows: DataFrame, column: str = "n") -> DataFrame:
    """Rows worth drawing."""
    return rows.filter(F.col(column) > 0)


def preview(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in an order: a top-n, not a sort of all."""
    return rows.orderBy(*order).limit(n)


def error_share(records: DataFrame) -> DataFrame:
    per = errors_by(records).withColumn("whole", F.sum("n").over(Window.partitionBy()))
    return per.select("category", "n", percent(F.col("n"), F.col("whole")).alias("share_pct"))


def dominant_error(records: DataFrame) -> DataFrame:
    """The commonest category of each model and benchmark, ties by name."""
    top = F.row_number().over(Window.partitionBy("model", "benchmark").orderBy(F.desc("n"), "category"))
    best = errors_by(records, "model", "benchmark").withColumn("r", top).filter("r = 1")
    return best.select("model", "benchmark", F.format_string("%s (%d)", "category", "n").alias("dominant"))


def render_metrics(rows: DataFrame, parts) -> DataFrame:
    """Means of image parts over rendered rows, 3 digits, and how many were rendered of all."""
    means = [F.round(F.avg(F.when(F.col("rendered"), F.col(p))), 3).alias(p) for p in parts]
    done = F.concat_ws(" / ", F.count_if("rendered").cast("string"), F.count("*").cast("string"))
    return rows.groupBy("model").agg(*means, done.alias("rendered_of"))


def correlation(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Pearson's r of each group, null where a side doesn't vary: corr() would raise there."""
    both = rows.dropna(subset=[x, y])
    per = both.groupBy(group).agg(F.covar_pop(x, y).alias("cov"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.count("*").alias("n"))
    return per.select(group, "n", F.round(F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")), 6).alias("r"))


def by_composite(rows: DataFrame, column: str) -> DataFrame:
    """Best first; 0 and missing stand last alike."""
    return rows.orderBy(F.when(F.col(column) > 0, F.col(column)).otherwise(-1e0).desc(), "model")
