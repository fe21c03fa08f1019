"""Running candidate programs from Spark's workers: raw outcomes first, native classification after.

Candidates are untrusted code. They run only if asked for (``allow=True``), each in a folder of its own that is removed, in a
session of its own whose whole process group is killed at the time limit, with bounded memory and file size. Running
is a side effect: the raw outcomes are written or persisted before they are used twice, keys make a second run harmless,
and speculation must be off.
"""

from __future__ import annotations

import contextlib
import glob
import os
import re
import signal
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BRACE_LANGUAGES, INTERPRETERS, STDERR_TAIL
from ..functions.code import python_literal, reindent
from ..functions.outcome import category
from ..functions.text import balance_braces, import_header, insert_indent, rstrip, strip, strip_echo, tail
from ..sources.capabilities import newest, tool as which

RAW = "rc int, timed_out boolean, out string, err string, artifact_bytes long, missing boolean, compile_failed boolean"
FIGURE = "figure.png"
SAVE_FIGURE = f"\nimport matplotlib.pyplot as _plt\nif _plt.get_fignums():\n    _plt.figure(_plt.get_fignums()[-1]).savefig({FIGURE!r}, dpi=100)\n"
MEMORY, FILES = 4 << 30, 64 << 20


def program(benchmark: str) -> Column:
    """The text of the program to run, from a problem with its candidate ``code``."""
    text = lambda x: F.coalesce(x, F.lit(""))
    code = text("code")
    if benchmark == "humaneval":
        return F.concat_ws("\n\n", import_header(text("prompt")), code, text("test"), F.concat(F.lit("check("), text("entry_point"), F.lit(")")))
    if benchmark == "mbpp":
        return F.concat_ws("\n", text("test_setup_code"), code, F.array_join("test_list", "\n"))
    if benchmark == "ds1000":
        body = F.when(strip(code) == "", code).otherwise(reindent(code, insert_indent(text("code_context"))))
        head = F.when(F.col("metadata.library") == "Matplotlib", "import matplotlib\nmatplotlib.use('Agg')\n\n").otherwise("")
        calls = F.when(F.contains("code_context", F.lit("def test_string")), "test_execution(solution)\ntest_string(solution)").otherwise("test_execution(solution)")
        return F.concat_ws("\n", F.concat(head, text("code_context")), F.lit(""), F.concat(F.lit("solution = "), python_literal(body)), calls)
    if benchmark == "plot2code":
        return F.concat(F.lit("import matplotlib\nmatplotlib.use('Agg')\n"), code, F.lit(SAVE_FIGURE))
    body = strip_echo(text("prompt"), code)
    body = F.when(F.col("language").isin(*BRACE_LANGUAGES), balance_braces(body)).otherwise(body)
    return F.concat(rstrip(text("prompt")), F.lit("\n"), body, F.lit("\n\n"), text("tests"), F.lit("\n"))


def _limits():
    import resource

    resource.setrlimit(resource.RLIMIT_AS, (MEMORY, MEMORY))
    resource.setrlimit(resource.RLIMIT_FSIZE, (FILES, FILES))


def guarded(command: list[str], timeout: float, folder: str, env=None, limited: bool = True) -> tuple[int | None, str, str]:
    """(exit code or None at the time limit, out, err); at the limit the whole process group is killed."""
    run = subprocess.Popen(command, cwd=folder, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True, preexec_fn=_limits if limited else None)  # noqa: PLW1509
    try:
        out, err = run.communicate(timeout=timeout)
        return run.returncode, out, err
    except subprocess.TimeoutExpired:
        return None, "", "timeout"
    finally:  # grandchildren that hold the pipes go as well
        with contextlib.suppress(ProcessLookupError, PermissionError):
            os.killpg(run.pid, signal.SIGKILL)
        with contextlib.suppress(subprocess.TimeoutExpired):
            run.communicate(timeout=5)


def surroundings(language: str, program: str, home: str | None = None) -> dict[str, str]:
    """Environment that an interpreter needs beside the usual: Lua finds the modules of the user's rocks tree, a shell the tools
    that lie in its own folder."""
    if language == "lua":
        shared = newest([os.path.join(home or os.path.expanduser("~"), ".luarocks", "share", "lua", "*")])
        if shared is None:
            return {}
        compiled = os.path.join(shared.rsplit(f"{os.sep}share{os.sep}", 1)[0], "lib", "lua", os.path.basename(shared))
        return {"LUA_PATH": f"{shared}/?.lua;{shared}/?/init.lua;;", "LUA_CPATH": f"{compiled}/?.so;;"}
    if language == "sh":
        return {"PATH": os.pathsep.join([os.path.dirname(program), os.environ.get("PATH", "")])}
    return {}


def _steps(language: str, text: str, folder: str, jars: str | None = None) -> tuple[list[tuple[list[str], bool]], dict] | None:
    """Commands (with whether it is a compilation) and more environment; writes the files. Null without the tools."""
    put = lambda name, body: open(os.path.join(folder, name), "w", encoding="utf-8").write(body)  # noqa: E731, SIM115
    if language in INTERPRETERS:
        ending, name, before = INTERPRETERS[language]
        if not (program := which(name)):
            return None
        put(f"program{ending}", text)
        return [([program, *before, f"program{ending}"], False)], surroundings(language, program)
    if language == "java" and which("javac") and which("java"):
        put("Problem.java", text)
        path = os.pathsep.join([".", *sorted(glob.glob(os.path.join(jars, "*.jar")))]) if jars else "."
        return [([which("javac"), "-cp", path, "Problem.java"], True), ([which("java"), "-ea", "-cp", path, "Problem"], False)], {}
    if language == "cpp" and (compiler := next(filter(None, map(which, ("g++", "clang++", "c++"))), None)):
        put("program.cpp", text)
        return [([compiler, "-std=c++17", "program.cpp", "-o", "program"], True), (["./program"], False)], {}
    if language == "rs" and which("rustc"):
        put("program.rs", text)
        return [([which("rustc"), "-A", "warnings", "program.rs", "-o", "program"], True), (["./program"], False)], {}
    if language == "dart" and which("dart"):
        put("program.dart", text)
        return [([which("dart"), "run", "program.dart"], False)], {}
    if language == "go" and which("go"):
        name = re.search(r"(?m)^package\s+(\w+)", text)
        put("go.mod", "module program\n\ngo 1.21\n")
        put("stub.go", f"package {(name[1] if name else 'main').removesuffix('_test')}\n")
        put("program_test.go", text)
        return [([which("go"), "test"], False)], {"GOTOOLCHAIN": "local", "GOFLAGS": "-mod=mod"}
    if language == "cs" and which("dotnet"):
        put("program.csproj", '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><OutputType>Exe</OutputType><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>')
        put("Program.cs", text)
        return [([which("dotnet"), "run", "-c", "Debug"], False)], {}
    return None


def run_program(language: str, text: str, timeout: float, jars: str | None = None) -> tuple:
    """The RAW columns of one program. Time limits hold for compilation and run apart. jars: a folder, on Java's class path."""
    with tempfile.TemporaryDirectory(prefix="candidate-", ignore_cleanup_errors=True) as folder:
        if language == "python":
            with open(os.path.join(folder, "program.py"), "w", encoding="utf-8", errors="replace") as f:
                f.write(text)
            steps, more = [([sys.executable, "program.py"], False)], {}
        else:
            found = _steps(language, text, folder, jars)
            if found is None:
                return None, False, "", "", 0, True, False
            steps, more = found
        env = {k: v for k, v in os.environ.items() if not re.search("KEY|TOKEN|SECRET|PASSWORD", k)} | more
        rc, out, err = 0, "", ""
        for command, compiles in steps:
            rc, out, err = guarded(command, timeout, folder, env, limited=language in ("python", *INTERPRETERS) and language not in ("js", "ts"))
            if rc is None:
                return None, True, "", "timeout", 0, False, False
            if compiles and rc:
                return rc, False, out, err, 0, False, True
        figure = os.path.join(folder, FIGURE)
        return rc, False, out, err, os.path.getsize(figure) if os.path.exists(figure) else 0, False, False


def execute(problems: DataFrame, benchmark: str, timeout: float, allow: bool = False, partitions: int | None = None, jars: str | None = None) -> DataFrame:
    """The rows with the RAW columns of their candidate's run. problems: rows of one benchmark with ``code``."""
    if not allow:
        raise PermissionError("running candidates runs untrusted code: pass allow=True")
    language = F.col("language") if benchmark == "multipl-e" else F.lit("python")
    given = problems.withColumns({"_language": language, "_program": program(benchmark)})
    given = given.repartition(partitions) if partitions else given
    schema = problems.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for frame in batches:
            blank = [not (c or "").strip() for c in frame["code"]]
            rows = [(None, False, "", "", 0, False, False) if b else run_program(x, p, timeout, jars) for x, p, b in zip(frame["_language"], frame["_program"], blank, strict=True)]
            raw = pd.DataFrame(rows, index=frame.index, columns=[x.split()[0] for x in RAW.split(", ")])
            raw["rc"] = raw["rc"].astype("Int32")
            yield pd.concat([frame.drop(columns=["_language", "_program"]), raw], axis=1)

    return given.mapInPandas(run, f"{schema}, {RAW}")


def classified(raw: DataFrame, benchmark: str) -> DataFrame:
    """Raw runs with category and the tail of the diagnostics; the whole text is classified before it is cut."""
    language = F.col("language") if benchmark == "multipl-e" else F.lit("python")
    kind = category(F.lit(benchmark), language, "code", "rc", "timed_out", "out", "err", "artifact_bytes", "missing", "compile_failed")
    text = F.when(kind == "Passed", F.lit("")).when(F.lit(benchmark == "multipl-e"), F.concat_ws("\n", "err", "out")).otherwise(F.col("err"))
    return raw.withColumns({"category": kind, "stderr": tail(text, STDERR_TAIL)}).drop(*[x.split()[0] for x in RAW.split(", ")])
