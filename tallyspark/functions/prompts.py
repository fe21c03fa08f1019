"""Prompts: a task and hints drawn from it. The wording is a parameter; these are the defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LANGUAGES
from . import text as X

WORDING = {
    "instruction": {
        "humaneval": "Write the whole Python function with its imports. Answer with code only.",
        "mbpp": "Write a Python function that passes the tests below. Answer with code only.",
        "ds1000": "Write only the code that belongs in the marked place. Answer with code only.",
        "plot2code": "Write a whole matplotlib script that draws the figure described. Answer with code only.",
        "multipl-e": "Complete the {language} program below. Answer with the continuation only.",
    },
    "task": {"humaneval": "# Task", "mbpp": "# Task", "ds1000": "# Task", "plot2code": "# Figure", "multipl-e": "# Program to complete"},
    "hints": "# Hints",
    "function": "- Implement the function `{}`.",
    "signature": "- Keep the signature {}",
    "returns": "- It returns {}",
    "examples": "- These must hold:",
    "edges": "- Mind: {}.",
    "library": "- Use {}.",
    "body": "- Write the body of the open function, from column 0, ending with a return.",
    "result": "- Assign the outcome to `result`, from the data that is already there.",
}


def _say(pattern: str, value: Column) -> Column:
    before, after = pattern.split("{}")
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(before), value, F.lit(after)))


def _examples(wording, examples: Column) -> Column:
    """A heading and the examples; null if there are none."""
    return F.when(F.size(examples) > 0, F.concat(F.lit(wording["examples"]), F.lit("\n"), F.array_join(F.transform(examples, lambda e: F.concat(F.lit("    "), e)), "\n")))


def _joined(parts: list[Column], by: str) -> Column:
    return F.concat_ws(by, *[X.or_null(p) for p in parts])


def hints(benchmark: str, wording=WORDING) -> Column:
    """The hint block of a problem row of the benchmark; the empty string without hints."""
    w = wording
    if benchmark == "humaneval":
        prompt = F.coalesce("prompt", F.lit(""))
        parts = [_say(w["function"], F.col("entry_point")), _say(w["signature"], X.signature(prompt)), _say(w["returns"], X.return_type(prompt))]
        parts += [_examples(w, X.doctests(prompt)), _say(w["edges"], F.array_join(X.edge_words(prompt), ", "))]
    elif benchmark == "mbpp":
        tests = F.coalesce("test_list", F.array().cast("array<string>"))
        parts = [_say(w["function"], X.called_name(tests)), _examples(w, tests), _say(w["edges"], F.array_join(X.edge_words(F.coalesce("text", F.lit(""))), ", "))]
    elif benchmark == "ds1000":
        form = X.solution_form(F.coalesce("code_context", F.lit("")))
        parts = [_say(w["library"], F.col("metadata.library")), F.when(form == "function-body", w["body"]).otherwise(w["result"])]
    elif benchmark == "multipl-e":
        shown = F.slice(F.transform(F.filter(X.lines(F.coalesce("prompt", F.lit(""))), lambda s: s.contains(">>>")), X.strip), 1, 3)
        parts = [_say(w["function"], X.task_function("name")), _examples(w, shown)]
    else:
        return F.lit("")
    return _joined(parts, "\n")


def prompt(benchmark: str, wording=WORDING) -> Column:
    """The whole prompt of a problem row."""
    source = {"mbpp": "text", "plot2code": "instruction"}.get(benchmark, "prompt")
    task = X.rstrip(F.coalesce(source, F.lit("")))
    instruction, head = F.lit(wording["instruction"][benchmark]), F.lit(wording["task"][benchmark])
    if benchmark == "multipl-e":
        names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
        label = F.coalesce(F.try_element_at(names, F.col("language")), X.or_null(F.col("language")), F.lit("given"))
        instruction = F.replace(instruction, F.lit("{language}"), label)
    block = hints(benchmark, wording)
    return F.concat_ws("\n\n", instruction, F.concat(head, F.lit("\n"), task), F.when(block != "", F.concat(F.lit(wording["hints"] + "\n"), block)))
