"""A text's lines as rows, by a table function: for texts of any length, as no array of lines is made."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LINE_BREAK

_BREAK = re.compile(LINE_BREAK)


@F.udtf(returnType="line_no bigint, start bigint, line string")
class TextLines:
    """Lines of one text, with any usual line end, without it: number from 0, place of the first character, text. No line for a null or
    empty text, none behind a last line end. A line is made when it is asked for."""

    def eval(self, text: str):
        if not text:
            return
        start = number = 0
        for end in _BREAK.finditer(text):
            yield number, start, text[start : end.start()]
            start, number = end.end(), number + 1
        if start < len(text):
            yield number, start, text[start:]


def text_lines(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and line_no, start, line of each line of column ``text``; each task reads the lines of its own rows."""
    held = rows.select(*keep, F.col(text).alias("_text")).alias("_rows")
    return held.lateralJoin(TextLines(F.col("_rows._text").outer())).drop("_text")
