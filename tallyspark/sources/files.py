"""Pictures and notebooks as DataFrames, and pictures written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chart_name
from . import nested


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each picture."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path).select("path", "content")


def attach_images(records: DataFrame, pictures: DataFrame) -> DataFrame:
    """Records with the contents at ref_image and render_path."""
    ref = pictures.select(F.col("path").alias("ref_image"), F.col("content").alias("ref_content"))
    got = pictures.select(F.col("path").alias("render_path"), F.col("content").alias("render_content"))
    return records.join(ref, "ref_image", "left").join(got, "render_path", "left")


def write_images(df: DataFrame, folder: str) -> None:
    """(task_id, image) rows as <folder>/<task_id>.png; files that are there stay. folder: shared by all executors."""
    import os

    def put(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            path = f"{folder}/{r['task_id']}.png"
            if not os.path.exists(path):
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(r["image"])
                os.replace(f.name, path)

    df.select("task_id", "image").foreachPartition(put)


def export_charts(spark: SparkSession, notebook: str, folder: str) -> DataFrame:
    """Writes a notebook's charts under the names of their cells; returns the names."""
    shown = notebook_images(spark, notebook)
    write_images(shown.select(F.col("name").alias("task_id"), F.col("content").alias("image")), folder)
    return shown.select("name")


def notebook_images(spark: SparkSession, path: str) -> DataFrame:
    """name, content of each picture that a notebook's tracked cells show."""
    shown = nested.notebook_outputs(nested.notebook_cells(spark, path)).filter("mime = 'image/png'")
    return shown.select(chart_name("source").alias("name"), F.unbase64(F.regexp_replace("content", r"\s", "")).alias("content")).filter("name is not null and content is not null")
