"""Command line: what can run here, a resumable run over several models, and the reports on a run log.

``python -m tallyspark.cli list``
``python -m tallyspark.cli run -b mbpp --problems PATH --log PATH --out PATH --generator module:object --allow``
``python -m tallyspark.cli report --log PATH``

Nothing asks for input. A job that is interrupted leaves its log whole: the next run does only what is left. The first Ctrl+C lets
the current lot of problems end, the second stops at once.
"""

from __future__ import annotations

import argparse
import importlib
import signal
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import BENCHMARKS
from .operators import sinks
from .operators.detail import detail
from .operators.evaluation import evaluate, lots
from .functions.text import architecture_label
from .plans import reports
from .session import session
from .sources import balances, capabilities, detail_csv, problem_sets, run_log

GROUPED = {"ds1000": ("library", capabilities.libraries), "multipl-e": ("language", capabilities.runtimes)}


def positive(text: str) -> int:
    """A whole number of 1 or more, or argparse's error."""
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tallyspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--master", help="only for local runs, such as local[8]")
    does = top.add_subparsers(dest="command", required=True)
    does.add_parser("list", help="models, libraries and runtimes, and which of them are there")
    run = does.add_parser("run", help="prompt, run, score and log what is still to do, then report")
    run.add_argument("-b", "--benchmark", required=True, choices=list(BENCHMARKS))
    run.add_argument("-n", "--limit", type=positive)
    run.add_argument("-m", "--models", nargs="*", help="keys; all if there are none")
    run.add_argument("--only", nargs="*", help="libraries or languages")
    run.add_argument("-t", "--timeout", type=float, default=30.0, help="seconds a candidate")
    run.add_argument("--lot", type=positive, help="about as many problems at a time; all if not given")
    run.add_argument("--jars", help="a folder of jars for Java's class path")
    run.add_argument("--fresh", action="store_true", help="empty the log first")
    run.add_argument("--allow", action="store_true", help="let candidates run")
    run.add_argument("--generator", required=True, help="module:object that answers prompts")
    for name in ("problems", "log", "out"):
        run.add_argument(f"--{name}", required=True)
    report = does.add_parser("report", help="tables on a run log")
    report.add_argument("--log", required=True)
    return top


def load_problems(spark: SparkSession, benchmark: str, path: str, limit: int | None, only: list[str] | None) -> DataFrame:
    """The problems of a set. An unknown library is an error here; unknown languages are dropped."""
    return problem_sets.LOADERS[benchmark](spark, path, limit, only)


def scored(log: DataFrame) -> DataFrame:
    """The records that reports take: the last attempt of each key."""
    last = run_log.last_write_wins(log, ["model", "benchmark", "task_id"])
    return last.select("model", "benchmark", "task_id", "category", F.col("passed").alias("solved"), F.col("metrics.codebleu").alias("score"), "usage.input_tokens", "usage.output_tokens", "architecture")


def show_reports(spark: SparkSession, log_path: str) -> DataFrame:
    """Prints the tables; returns the summary by model, best first."""
    records = scored(run_log.read_log(spark, log_path)).cache()
    summary = reports.model_summary(records.drop("architecture"), capabilities.models(spark)).orderBy(F.desc("pass_at_1"), "model")
    summary.show(truncate=False)
    reports.pass_rates(records).orderBy("model", "benchmark").show(100, truncate=False)
    shown = reports.errors_by(records, "architecture").withColumn("architecture", architecture_label("architecture"))
    shown.orderBy("architecture", F.desc("n"), "category").show(100, truncate=False)
    order = reports.error_order(records)
    if order:
        seen = [[r[c] for r in records.select(c).distinct().orderBy(c).collect()] for c in ("model", "benchmark")]  # names
        reports.error_crosstab(records, *seen, order).orderBy("model", "benchmark").show(100, truncate=False)
    reports.cost_totals(summary).show(truncate=False)
    records.unpersist()
    return summary


class Stop:
    """The first interruption asks for an end after the current lot, the second makes it."""

    asked = False

    def __call__(self, *_):
        if self.asked:
            raise KeyboardInterrupt
        self.asked = True
        print("stopping after the current lot; once more to stop at once", file=sys.stderr)


def runnable(models: list, generator) -> list:
    """The models with a credential; others are named and skipped. A generator that is ``offline`` needs none."""
    offline = getattr(generator, "offline", False)
    for m in models:
        if not (offline or m["has_key"]):
            print(f"skipped: {m['model']}, no credential of {m['provider']}", file=sys.stderr)
    return [m for m in models if offline or m["has_key"]]


def warn_balances(models: list, balances) -> None:
    """Names the providers that have nothing left, where ``balances`` knows; it asks each once."""
    for provider in dict.fromkeys(m["provider"] for m in models):
        left = balances(provider)
        if left is not None and (not left["available"] or left["amount"] <= 0):
            print(f"no balance left at {provider}", file=sys.stderr)


def run(spark: SparkSession, args: argparse.Namespace, generator, stop=None) -> DataFrame | None:
    """Plan, evaluate each model, write its records and detail table, and report; null if no model can run. A run that is asked to
    stop reports what is done."""
    stop = stop or Stop()
    chosen = runnable(capabilities.models(spark, args.models or None).orderBy("rank").collect(), generator)
    if not chosen:
        print("no model can run", file=sys.stderr)
        return None
    if hasattr(generator, "balance"):
        warn_balances(chosen, balances.Balances(generator.balance))
    problems = load_problems(spark, args.benchmark, args.problems, args.limit, args.only)
    if args.benchmark in GROUPED:
        key, there = GROUPED[args.benchmark]
        problems, skipped = capabilities.split_runnable(problems, key, there(spark))
        for r in skipped.orderBy(key).collect():  # a row a library or language
            print(f"skipped: {r['skipped']} problems of {r[key]}, which can't run here", file=sys.stderr)
    if args.fresh:
        run_log.truncate_log(spark, args.log)
    for m in chosen:
        done = None
        for lot in lots(problems, args.lot):
            if stop.asked:
                break
            step = evaluate(lot, (m["model"], m["model_id"], m["provider"], m["architecture"]), args.benchmark, args.log, generator, args.timeout, args.allow, jars=args.jars)
            done = step if done is None else done.unionByName(step)
        if done is not None:
            detail_csv.write_detail(detail(done, args.benchmark), f"{args.out}/{m['model']}/{args.benchmark}/detail.csv")
            sinks.write_pretty_json(done, f"{args.out}/{m['model']}/{args.benchmark}/records.json")
    summary = show_reports(spark, args.log)
    sinks.write_records_json(summary, f"{args.out}/summary_{args.benchmark}")
    return summary


def main(given: list[str] | None = None) -> int:
    args = parser().parse_args(given)
    spark = session(args.master)
    if args.command == "list":
        capabilities.models(spark).orderBy("rank").drop("rank").show(100, truncate=False)
        for of in (capabilities.libraries, capabilities.runtimes):
            of(spark).orderBy("capability").show(100, truncate=False)
    elif args.command == "report":
        show_reports(spark, args.log)
    else:
        module, _, name = args.generator.partition(":")
        try:
            stop = Stop()
            signal.signal(signal.SIGINT, stop)
            if run(spark, args, getattr(importlib.import_module(module), name), stop) is None:
                return 1
            return 130 if stop.asked else 0
        except KeyboardInterrupt:
            spark.sparkContext.cancelAllJobs()
            print("interrupted; what was logged stays, the next run goes on from there", file=sys.stderr)
            return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
