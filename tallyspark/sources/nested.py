"""JSON documents without a schema as VARIANT: fields by path, arrays and objects as rows, notebooks as tables.

What isn't valid JSON, a path that isn't there and a value of another type are null, never an error. A document is parsed once;
paths then read its binary form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(text) -> Column:
    """The document of a JSON text; null where it isn't valid. What follows the first whole value isn't read."""
    return F.try_parse_json(text)


def field(document, path: str, kind: str = "string") -> Column:
    """What stands at ``path`` ($.a.b[0]), as a type of Spark SQL; null if it isn't there or can't be one."""
    return F.try_variant_get(document, path, kind)


def shredded(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a typed column for each name: (path, type) beside the document, for tables to be written: readers then
    prune and filter these columns in the files and open the document only for what isn't among them."""
    taken = set(fields) & set(rows.columns)
    if taken:
        raise ValueError(f"columns are there already: {sorted(taken)}")
    return rows.withColumns({name: field(column, path, kind) for name, (path, kind) in fields.items()})


def members(rows: DataFrame, document: Column, place: str, key: str, value: str, keep_empty: bool = False) -> DataFrame:
    """A row for each element of an array or field of an object: its place from 0, its key (null in arrays), its value as a document.
    Rows without any are dropped, unless ``keep_empty``."""
    held = rows.withColumn("_document", document).alias("_rows")
    table = rows.sparkSession.tvf
    made = (table.variant_explode_outer if keep_empty else table.variant_explode)(F.col("_rows._document").outer())
    return held.lateralJoin(made.toDF(place, key, value)).drop("_document")


def text_of(document) -> Column:
    """A text that may be kept whole or as a list of its pieces."""
    return F.coalesce(F.array_join(field(document, "$", "array<string>"), ""), field(document, "$"))


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, cell (its number from 0), kind, source, outputs (a document) of each cell of the notebooks at ``path``."""
    books = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), parsed("value").alias("book"))
    cells = members(books, field("book", "$.cells", "variant"), "cell", "_key", "_cell")
    return cells.select("path", "cell", field("_cell", "$.cell_type").alias("kind"), text_of(field("_cell", "$.source", "variant")).alias("source"), field("_cell", "$.outputs", "variant").alias("outputs"))


def notebook_outputs(cells: DataFrame) -> DataFrame:
    """Of ``notebook_cells``: path, cell, source, output (its number from 0), kind, mime, content. What was printed has no mime of its own
    and counts as text/plain; so does an error's message."""
    shown = members(cells.drop("kind"), F.col("outputs"), "output", "_key", "_output")
    shown = shown.select("path", "cell", "source", "output", field("_output", "$.output_type").alias("kind"), "_output")
    data = members(shown, field("_output", "$.data", "variant"), "_place", "mime", "_value").select("path", "cell", "source", "output", "kind", "mime", text_of("_value").alias("content"))
    error = F.concat_ws(": ", field("_output", "$.ename"), field("_output", "$.evalue"))
    said = F.coalesce(text_of(field("_output", "$.text", "variant")), F.when(F.col("kind") == "error", error))
    printed = shown.select("path", "cell", "source", "output", "kind", F.lit("text/plain").alias("mime"), said.alias("content")).filter("content is not null")
    return data.unionByName(printed)
