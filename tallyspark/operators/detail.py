"""Records from runs, and the five detail layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..fixed_values import DETAIL
from ..functions.code import codebleu
from ..functions.images import image_similarity
from ..functions.text import joined, or_null
from ..schemas import RECORD

#: metric: (reference, candidate) -> its column. Add a measure by adding an entry, and its name to the record's metrics by metrics_type
METRICS = {"codebleu": codebleu}


def metrics_type() -> str:
    return f"struct<{','.join(f'{name}:double' for name in METRICS)}>"


def metrics(benchmark: str) -> Column:
    """All measures of a candidate against its gold code; null for a set that has none."""
    none = F.lit(None).cast("double")
    return F.struct(*[(none if benchmark == "multipl-e" else of(reference_code(benchmark), F.col("code"))).alias(name) for name, of in METRICS.items()])


#: record column: problem column, where they differ
_OWN = {
    "humaneval": {"entry_point": "entry_point", "prompt": "prompt", "canonical_solution": "canonical_solution", "test": "test"},
    "mbpp": {"text": "text", "code_reference": "reference", "test_setup_code": "test_setup_code", "test_list": "test_list"},
    "ds1000": {"library": "metadata.library", "perturbation_type": "metadata.perturbation_type", "prompt": "prompt", "code_reference": "reference_code"},
    "plot2code": {"instruction": "instruction", "code_reference": "reference", "url": "url", "ref_image": "ref_image"},
    "multipl-e": {"name": "name", "language": "language", "prompt": "prompt", "tests": "tests"},
}


def reference_code(benchmark: str) -> Column:
    """The gold code that a candidate is held against. A set's own ``code`` is called ``reference`` in rows with answers."""
    if benchmark in ("mbpp", "plot2code"):
        return F.col("reference")
    if benchmark == "ds1000":
        return F.col("reference_code")
    if benchmark == "multipl-e":
        return F.lit("")
    return F.coalesce(or_null(F.col("codice_completo")), F.col("canonical_solution"))


def assemble(runs: DataFrame, benchmark: str) -> DataFrame:
    """Records of one benchmark: runs are problems with model, model_id, architecture, code, category, usage and stderr."""
    made = {
        "task_id": F.col("task_id").cast("string"),
        "benchmark": F.lit(benchmark),
        "passed": F.col("category") == "Passed",
        "metrics": metrics(benchmark),
        **{name: F.col(source) for name, source in _OWN[benchmark].items()},
    }
    if benchmark == "humaneval":
        made["codice_completo"] = reference_code(benchmark)
    if benchmark == "plot2code":
        made["render_path"] = F.when(F.col("category") == "Passed", F.coalesce("render_path", F.lit(""))).otherwise("")
        if "ref_content" in runs.columns:
            made["image_similarity"] = F.when(F.col("ref_content").isNotNull() & F.col("render_content").isNotNull(), image_similarity("ref_content", "render_content"))
    given = {"model", "model_id", "architecture", "code", "category", "usage", "stderr"} & set(runs.columns)
    columns = [(made[f.name] if f.name in made else F.col(f.name) if f.name in given else F.lit(None)).cast(metrics_type() if f.name == "metrics" else f.dataType).alias(f.name) for f in StructType.fromDDL(RECORD).fields]
    return runs.select(*columns)


def outcome() -> Column:
    return F.when(F.col("passed"), "passed").otherwise(F.coalesce("category", F.lit("")))


def detail(records: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark's rows of records in its layout; scores rounded to 4 digits, missing ones null (empty in CSV)."""
    picture = {"img_text": "text_match", "img_ssim": "ssim", "img_color": "color_sim", "img_visual": "composite"}
    made = {"Codice Completo": F.col("codice_completo"), "pass@1": outcome(), "codebleu": F.bround("metrics.codebleu", 4), "test_list": joined("test_list")}
    made |= {name: F.bround(f"image_similarity.{part}", 4) for name, part in picture.items()}
    of = records.filter(F.col("benchmark") == benchmark)
    return of.select(*[(made[c] if c in made else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in DETAIL[benchmark]])
