"""Names, lists and patterns that results depend on, as text in natural order."""

# ---- fixed values: outcome categories
CATEGORIES = (
    "Passed", "SyntaxError", "IndentationError", "NameError", "TypeError", "ValueError", "IndexError", "KeyError", "AttributeError",
    "AssertionError", "RecursionError", "ImportError", "TimeoutError", "RuntimeError", "EmptyOutput", "NoFigure", "RuntimeMissing", "APIError",
)
PYTHON_ERRORS = (
    "SyntaxError", "IndentationError", "NameError", "TypeError", "ValueError", "IndexError", "KeyError", "AttributeError",
    "AssertionError", "RecursionError", "ImportError",
)

# ---- fixed values: what a diagnostic of a program that isn't Python says, by category, tried in this order
SIGNATURES = {
    "AssertionError": ("assertionerror", "assertion failed", "test failed", "stopifnot", "panicked", "\nnot ok", "not ok "),
    "SyntaxError": (
        "syntaxerror", "syntax error", "parse error", "parseerror", "unexpected token", "unexpected symbol", "unexpected end",
        "near unexpected token", "malformed", "expected ", "unexpected '", "unterminated",
    ),
    "ImportError": ("can't locate", "cannot find module", "module not found", "there is no package", "no such module"),
    "NameError": (
        "is not defined", "referenceerror", "undefined variable", "nil value", "command not found", "could not find function", "object '",
        "use of undeclared", "undefined subroutine",
    ),
    "TypeError": ("typeerror", "is not a function", "cannot read propert", "non-numeric argument", "not callable"),
    "IndexError": ("index out of", "out of range", "subscript out of bounds", "indexerror"),
    "ValueError": ("valueerror", "division by zero", "divide by zero", "/ 0"),
}

# ---- fixed values: words in a task that point to edge cases
EDGE_WORDS = (
    "empty", "negative", "zero", "none", "null", "duplicate", "duplicates", "sorted", "unsorted", "case", "uppercase", "lowercase",
    "whitespace", "space", "even", "odd", "prime", "round", "rounding", "float", "integer", "overflow", "boundary", "edge", "single", "unique", "order",
)

# ---- fixed values: calls in an assertion that aren't the function under test
WRAPPERS = (
    "assert", "abs", "round", "len", "set", "sorted", "list", "tuple", "dict", "frozenset", "str", "int", "float", "bool", "isclose", "math",
    "all", "any", "sum", "max", "min",
)

# ---- fixed values: benchmarks (label, full size, time limit in seconds)
BENCHMARKS = {
    "humaneval": ("HumanEval", 164, 10),
    "mbpp": ("MBPP", 500, 10),
    "ds1000": ("DS-1000", 1000, 60),
    "plot2code": ("Plot2Code", 368, 60),
    "multipl-e": ("MultiPL-E", 3864, 30),
}
LIBRARIES = {
    "Pandas": "pandas", "Numpy": "numpy", "Matplotlib": "matplotlib", "Sklearn": "sklearn", "Scipy": "scipy", "Pytorch": "torch",
    "Tensorflow": "tensorflow",
}
LANGUAGES = {
    "cpp": "C++", "cs": "C#", "d": "D", "go": "Go", "java": "Java", "jl": "Julia", "js": "JavaScript", "lua": "Lua", "php": "PHP",
    "pl": "Perl", "r": "R", "rb": "Ruby", "rkt": "Racket", "rs": "Rust", "scala": "Scala", "sh": "Bash", "swift": "Swift",
    "ts": "TypeScript", "clj": "Clojure", "dart": "Dart", "elixir": "Elixir", "hs": "Haskell", "ml": "OCaml", "adb": "Ada",
}
BRACE_LANGUAGES = ("java", "rs", "cs", "dart", "cpp", "sh")
#: interpreted languages: file ending, interpreter, arguments before the file
INTERPRETERS = {
    "js": (".js", "node", ()), "ts": (".cts", "node", ("--experimental-strip-types",)), "php": (".php", "php", ()), "rb": (".rb", "ruby", ()),
    "pl": (".pl", "perl", ()), "lua": (".lua", "lua", ()), "jl": (".jl", "julia", ()), "sh": (".sh", "bash", ()), "r": (".r", "Rscript", ()),
}

# ---- fixed values: models (key, model id, provider, architecture) and USD per million tokens in and out
MODELS = (
    ("claude-opus-4.7", "claude-opus-4-7", "anthropic", "LLM"),
    ("deepseek-v4-pro", "deepseek-v4-pro", "deepseek", "MoE"),
    ("ministral-8b", "ministral-8b-latest", "mistral", "SLM"),
)
PRICES = {"claude-opus-4-7": (5.0, 25.0), "deepseek-v4-pro": (0.435, 0.87), "ministral-8b-latest": (0.15, 0.15)}
PROVIDER_KEYS = {"anthropic": "ANTHROPIC_API_KEY", "deepseek": "DEEPSEEK_API_KEY", "mistral": "MISTRAL_API_KEY"}
SOLVED_LABELS = {True: "risolto", False: "non risolto"}
ARCHITECTURES = {"LLM": "LLM (dense)", "SLM": "SLM (small)", "MoE": "MoE (mixture of experts)", "VLM": "VLM (vision)"}

# ---- fixed values: columns of the detail tables
DETAIL = {
    "humaneval": ("task_id", "model_id", "architecture", "entry_point", "prompt", "canonical_solution", "test", "Codice Completo", "code", "pass@1", "codebleu"),
    "mbpp": ("task_id", "model_id", "architecture", "text", "code_reference", "test_setup_code", "test_list", "code", "pass@1", "codebleu"),
    "ds1000": ("task_id", "model_id", "architecture", "library", "perturbation_type", "prompt", "code_reference", "code", "pass@1", "codebleu"),
    "plot2code": (
        "task_id", "model_id", "architecture", "url", "instruction", "code_reference", "code", "pass@1", "codebleu",
        "img_text", "img_ssim", "img_color", "img_visual", "ref_image", "render_path",
    ),
    "multipl-e": ("task_id", "model_id", "architecture", "name", "language", "prompt", "code", "pass@1", "tests"),
}
#: the column that shows which benchmark a foreign row is from, in order of precedence
MARKERS = {"stop_tokens": "multipl-e", "instruction": "plot2code", "code_context": "ds1000", "test_list": "mbpp"}

# ---- fixed values: pictures of a notebook (what a cell holds, all of it; the file's name), tried in this order
CHARTS = (
    (("p_pass",), "01_pass1_per_benchmark_e_modello"),
    (("scatter_for_model(",), "02_scatter_codebleu_{model}"),
    (("AnnotationBbox", "MODEL_COLORS"), "03_multipl-e_risolti_per_linguaggio_e_modello"),
    (("p_cross",), "04_cross_modello_recuperi"),
    (("p_p2c",), "05_plot2code_imgvisual_vs_codebleu"),
)
CHART_MODEL = r'scatter_for_model\("([^"]+)"\)'

# ---- fixed values: weights
IMAGE_WEIGHTS = {"text_match": 0.4, "ssim": 0.4, "color_sim": 0.2}
STDERR_TAIL = 2000
