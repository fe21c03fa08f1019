"""String functions on code and prompts, as column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ARCHITECTURES, CHART_MODEL, CHARTS, EDGE_WORDS, SOLVED_LABELS, WRAPPERS

# ---- fixed values: patterns
FENCE = r"(?s)```[^\n`]*\n(.*?)```"
MARKER_LINE = r"(?im)^[ \t]*(?:</?code>|BEGIN\s+SOLUTION|END\s+SOLUTION|#\s*SOLUTION\s+(?:START|END))[ \t]*$"
CODE_LINE = r"^\s*(?:import\s|from\s|def\s|class\s|@|#)"
SIGNATURE = r"(?ms)^\s*def\s+\w+\s*\(.*?\)\s*(->\s*[^:]+)?:"
RETURNS = r"->\s*([^:]+):"
DOCTEST = r"(?m)^\s*>>>.*$"
CALL = r"\b([A-Za-z_]\w*)\s*\("
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
NOT_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_null(text: Column) -> Column:
    """Null for the empty string, which regexp_extract gives where nothing matches."""
    return F.nullif(text, F.lit(""))


def strip(x) -> Column:
    """All white space off both ends, not only blanks."""
    return F.regexp_replace(c(x), r"^\s+|\s+$", "")


def rstrip(x) -> Column:
    return F.regexp_replace(c(x), r"\s+$", "")


def lines(x) -> Column:
    """Lines without their ends; no line for the empty text, none behind a last line end."""
    parts = F.split(c(x), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def join_lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _first(parts: Column, test) -> Column:
    """Number, from 1, of the first element that passes; 0 if none does."""
    return F.array_position(F.transform(parts, test), True)


def trim_blank_edges(x) -> Column:
    """No blank first and last lines, no white space at line ends; the first line's indent stays."""
    parts = F.transform(lines(x), rstrip)
    filled = lambda s: s != ""
    first, last = _first(parts, filled), _first(F.reverse(parts), filled)
    kept = F.slice(parts, first.cast("int"), (F.size(parts) - last - first + 2).cast("int"))
    return F.when(first == 0, F.lit("")).otherwise(join_lines(kept))


def strip_markers(x) -> Column:
    return F.regexp_replace(c(x), MARKER_LINE, "")


def strip_leading_prose(x) -> Column:
    """From the first line that looks like code; everything if none does."""
    parts = lines(x)
    at = _first(parts, lambda s: s.rlike(CODE_LINE))
    return trim_blank_edges(F.when(at > 0, join_lines(F.slice(parts, at.cast("int"), F.size(parts)))).otherwise(c(x)))


def extract_code(x) -> Column:
    """The code in an answer: the first fenced block, though it be empty, or else what follows leading prose."""
    raw = F.coalesce(c(x), F.lit(""))
    body = F.when(raw.rlike(FENCE), trim_blank_edges(F.regexp_extract(raw, FENCE, 1))).otherwise(strip_leading_prose(raw))
    return trim_blank_edges(strip_markers(body))


def import_header(x) -> Column:
    """Import lines that begin at the first column."""
    return join_lines(F.filter(lines(x), lambda s: s.startswith("import ") | s.startswith("from ")))


def signature(x) -> Column:
    return strip(F.regexp_replace(or_null(F.regexp_extract(c(x), SIGNATURE, 0)), r"\s+", " "))


def return_type(x) -> Column:
    return or_null(strip(F.regexp_extract(c(x), RETURNS, 1)))


def doctests(x, most: int = 3) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(c(x), F.lit(DOCTEST), F.lit(0)), strip), 1, most)


def edge_words(x) -> Column:
    """Edge-case words that a text has, in the vocabulary's order."""
    low = F.lower(c(x))
    return F.filter(F.array(*map(F.lit, EDGE_WORDS)), lambda w: F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b"))))


def called_name(tests: Column) -> Column:
    """The first function that the assertions call, but for wrappers."""
    names = F.flatten(F.transform(tests, lambda t: F.regexp_extract_all(t, F.lit(CALL), F.lit(1))))
    return F.get(F.filter(names, lambda n: ~n.isin(*WRAPPERS)), F.lit(0))


def task_function(x) -> Column:
    return or_null(F.regexp_extract(c(x), r"^(?:HumanEval|MBPP)_\d+_(.+)$", 1))


def _line_before_insert(x) -> tuple[Column, Column]:
    has = F.contains(c(x), F.lit("[insert]"))
    before = lines(F.substring_index(c(x), "[insert]", 1))
    return has, F.coalesce(F.get(before, F.size(before) - 1), F.lit(""))


def solution_form(x) -> Column:
    """Whether a solution goes into a function's body or stands by itself."""
    has, last = _line_before_insert(x)
    inside = strip(last).startswith("def ") & strip(last).endswith(":")
    return F.when(has & inside, F.lit("function-body")).otherwise(F.lit("module"))


def insert_indent(x) -> Column:
    """Blanks before an inserted body, if it stands behind a line that opens a block; else null."""
    has, last = _line_before_insert(x)
    return F.when(has & strip(last).endswith(":"), F.length(F.regexp_extract(last, r"^\s*", 0)) + 4)


def strip_echo(prompt, code) -> Column:
    """Drops a repetition of the prompt's last line, and what stands before it."""
    bare = lambda s: F.regexp_replace(s, r"\s+", "")
    filled = F.filter(lines(prompt), lambda s: strip(s) != "")
    last = bare(F.coalesce(F.get(filled, F.size(filled) - 1), F.lit("")))
    parts = lines(code)
    back = _first(F.reverse(parts), lambda s: F.contains(bare(s), last))
    rest = F.when(back > 1, join_lines(F.slice(F.reverse(F.slice(F.reverse(parts), 1, F.greatest(back - 1, F.lit(1)).cast("int"))), 1, F.size(parts)))).otherwise(F.lit(""))
    return F.when((last == "") | (strip(code) == "") | (back == 0), c(code)).otherwise(rest)


def tail(x, most: int) -> Column:
    return F.right(c(x), F.lit(most))


def xml_safe(x) -> Column:
    return F.regexp_replace(c(x), NOT_XML, "")


def trailing_number(x) -> Column:
    return or_null(F.regexp_extract(c(x), r"(\d+)$", 1)).try_cast("double")


def number(x) -> Column:
    return c(x).try_cast("double")


def word_tokens(x) -> Column:
    return F.regexp_extract_all(F.lower(c(x)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def joined(x) -> Column:
    return F.array_join(c(x), "\n")


#: All characters that Python takes for white space.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def balance_braces(x) -> Column:
    """Closing braces beyond the opening ones are dropped from the end, and white space at the end."""
    count = lambda brace: F.length(c(x)) - F.length(F.replace(c(x), F.lit(brace)))
    surplus, parts = F.greatest(count("}") - count("{"), F.lit(0)), F.split(c(x), "[}]")
    kept = F.size(parts) - surplus
    whole = F.concat(F.array_join(F.slice(parts, F.lit(1), kept), "}"), F.array_join(F.slice(parts, kept + 1, surplus), ""))
    return F.rtrim(whole, F.lit(BLANKS))


def package_base(x) -> Column:
    return F.regexp_replace(F.regexp_extract(c(x), r"(?m)^package\s+(\w+)", 1), "_test$", "")


def chart_name(source) -> Column:
    """File name of the chart that a notebook cell makes; null for other cells."""
    s = c(source)
    model = or_null(F.regexp_extract(s, CHART_MODEL, 1))
    held = [(reduce(lambda a, b: a & b, map(s.contains, marks)), F.replace(F.lit(name), F.lit("{model}"), model) if "{model}" in name else F.lit(name)) for marks, name in CHARTS]
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(held), F.lit(None).cast("string"))


def short_name(x) -> Column:
    """A model's label: what stands before its first hyphen."""
    return F.substring_index(c(x), "-", 1)


def architecture_label(x) -> Column:
    """What stands before the brackets of a known architecture's name; another passes through."""
    names = F.create_map(*[F.lit(v) for kv in ARCHITECTURES.items() for v in kv])
    return F.substring_index(F.coalesce(F.try_element_at(names, c(x)), c(x)), " (", 1)


def solved_label(x) -> Column:
    return F.when(c(x), SOLVED_LABELS[True]).when(~c(x), SOLVED_LABELS[False])


def distinct_in_order(values) -> Column:
    """Each value once, where it first stands."""
    return F.array_distinct(c(values))
