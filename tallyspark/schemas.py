"""Declared schemas of problem sets, run-log records and dimensions, as DDL: it can be read without a session."""

from __future__ import annotations

_s = lambda *names: ", ".join(f"`{n}` string" for n in names)

PROBLEMS = {
    "humaneval": (_s("task_id", "prompt", "entry_point", "canonical_solution", "test", "codice_completo")),
    "mbpp": (f"task_id long, {_s('text', 'code', 'test_setup_code')}, test_list array<string>"),
    "ds1000": (f"{_s('prompt', 'reference_code', 'code_context')}, metadata struct<problem_id:long,library:string,perturbation_type:string,test_case_cnt:long>"),
    "plot2code": (_s("instruction", "code", "url", "ref_image")),
    "multipl-e": (f"{_s('name', 'language', 'prompt', 'tests')}, stop_tokens array<string>"),
}
USUAL_METRICS = "struct<codebleu:double>"
COMMON = (
    f"{_s('task_id', 'model', 'model_id', 'architecture', 'benchmark', 'code')}, passed boolean, category string, metrics {USUAL_METRICS},"
    " usage struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>, stderr string"
)
OWN = (
    _s("entry_point", "prompt", "canonical_solution", "codice_completo", "test", "text", "code_reference", "test_setup_code", "library", "perturbation_type")
    + ", "
    + _s("instruction", "url", "ref_image", "render_path", "name", "language", "tests")
    + ", test_list array<string>, image_similarity struct<text_match:double,ssim:double,color_sim:double,composite:double>"
)
#: one wide record; columns that a benchmark hasn't are null
RECORD = (f"{COMMON}, {OWN}")
#: as the log has it: seq orders the attempts of a key
LOG = (f"seq long, {COMMON}, {OWN}")
