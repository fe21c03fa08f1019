"""One resumable evaluation step: problems still to do are prompted, answered, run, scored and appended to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import WORDING, prompt
from ..functions.text import extract_code
from ..sources import run_log
from ..sources.generation import generate
from .detail import assemble, metrics_type
from .execution import classified, execute


def lots(problems: DataFrame, size: int | None) -> list[DataFrame]:
    """The problems dealt by hash of their ids to lots of about ``size``, between which a run may stop; one lot without a size."""
    if size is None:
        return [problems]
    n = max(1, -(-problems.count() // size))
    place = F.pmod(F.xxhash64(F.col("task_id").cast("string")), F.lit(n))
    return [problems.filter(place == k) for k in range(n)]


def evaluate(problems: DataFrame, model: tuple, benchmark: str, log_path: str, generator, timeout: float, allow: bool = False, wording=WORDING, jars: str | None = None) -> DataFrame:
    """Records of the problems after this step. model: key, id, provider, architecture. A second call does only what is left."""
    spark = problems.sparkSession
    key, model_id, _, architecture = model
    task = F.col("task_id").cast("string")
    try:
        log = run_log.read_log(spark, log_path, metrics_type())
        latest = run_log.last_write_wins(log, ["model", "benchmark", "task_id"])
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        log, latest = None, None
    left = problems.withColumn("task_id", task)
    begun = 0
    if latest is not None:
        mine = latest.filter((F.col("model") == key) & (F.col("benchmark") == benchmark))
        left = run_log.todo(left, mine, ["task_id"])
        begun = (log.agg(F.max("seq")).first()[0] or -1) + 1
    if benchmark in ("mbpp", "plot2code"):
        left = left.withColumnRenamed("code", "reference")
    asked = left.withColumns({"model": F.lit(key), "model_id": F.lit(model_id), "architecture": F.lit(architecture), "prompt_sent": prompt(benchmark, wording)})
    own_prompt = "prompt" in asked.columns
    asked = asked.withColumnRenamed("prompt", "task_prompt") if own_prompt else asked
    answered = generate(asked.withColumnRenamed("prompt_sent", "prompt"), generator).drop("prompt")
    answered = answered.withColumnRenamed("task_prompt", "prompt") if own_prompt else answered
    runs = classified(execute(answered.withColumn("code", extract_code("raw")), benchmark, timeout, allow, jars=jars), benchmark)
    failed = F.col("failure").isNotNull()
    runs = runs.withColumns({"category": F.when(failed, "APIError").otherwise(F.col("category")), "stderr": F.when(failed, F.col("failure")).otherwise(F.col("stderr"))})
    records = assemble(runs, benchmark)
    numbered = records.withColumn("seq", F.lit(begun) + F.monotonically_increasing_id())
    run_log.append_log(numbered, log_path)
    done = run_log.last_write_wins(run_log.read_log(spark, log_path, metrics_type()), ["model", "benchmark", "task_id"])
    return done.filter((F.col("model") == key) & (F.col("benchmark") == benchmark)).join(problems.select(task.alias("task_id")), "task_id", "left_semi")
