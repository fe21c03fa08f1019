"""Running the candidates of a whole table: dealt by expected seconds, forked from a warm interpreter, never run twice once finished.

Dealing. Rows are put into classes of expected seconds (steps of a factor of two). A class's rows lie, in the order of a hash, on its stretch of a line as long
as all seconds together, classes of long ones first; the line is cut into bins of equal length, a bin a task. So no rows are sorted or collected: only the classes,
a few dozen rows, are summed up. Tasks begin in the order of bins, so the longest candidates begin first, and bins hold about equal seconds.

Ledger. A task logs what has finished, FLUSH seconds at a time, in files of its bin in the shared folder. A task that runs again, after an executor was
lost, reads its bin's files and runs only what isn't there. So does a whole second call with the same folder: its bins are those of the rows, not of the session. A
file is written under another name and then moved, so it is there whole or not at all. What was running when the executor went, or had finished within the last
FLUSH seconds, runs again; with FLUSH 0 that is the one candidate that was running.

Interpreter. A worker starts one Python process that only forks: each candidate is a fork of its own, in a session and folder of its own, with the limits of
``execution``, its output in files, and none of the worker's pipes. That saves the start of an interpreter for each candidate; what a candidate can do is what it
can do there.

Candidates without a key (null) or with a key that repeats are all run and logged by key and program: two rows that agree in both are one candidate.
With ``once``, rows of different keys that have the same program are one candidate too: it is run once and all of them have its outcome. That is for programs
whose outcome follows from their text, as those of a benchmark should; where it hangs on chance, time or what others have left, leave it off.
"""

from __future__ import annotations

import contextlib
import json
import os
import signal
import subprocess
import sys
import tempfile
import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .execution import FIGURE, FILES, MEMORY, RAW, program, run_program

CLASSES, SECONDS_A_BIN, MOST_BINS, FLUSH = 40, 30.0, 100_000, 5.0
NAMES = [x.split()[0] for x in RAW.split(", ")]

# reads a line (folder, limit in seconds), answers a line (exit code or null)
_FORKS = f"""
import gc, json, linecache, os, resource, select, signal, sys, time, tokenize, traceback, types
try:
    raise ValueError
except ValueError:
    traceback.format_exc()  # what the first one loads is loaded here, not in each fork
keep = os.dup(1)
os.dup2(os.open(os.devnull, os.O_WRONLY), 1)
linecache.clearcache()
gc.collect()
gc.freeze()  # a fork's collections touch, and so copy, none of this
for line in sys.stdin:
    folder, limit = json.loads(line)
    child = os.fork()
    if child == 0:
        try:
            os.setsid()
            os.chdir(folder)
            os.close(keep)
            for number, name, how in ((0, os.devnull, os.O_RDONLY), (1, 'stdout', os.O_WRONLY | os.O_CREAT), (2, 'stderr', os.O_WRONLY | os.O_CREAT)):
                f = os.open(name, how, 0o600)
                os.dup2(f, number)
                os.close(f)
            os.closerange(3, 256)
            sys.stdin, sys.argv, sys.path[0] = open(0), ['program.py'], folder
            resource.setrlimit(resource.RLIMIT_AS, ({MEMORY}, {MEMORY}))
            resource.setrlimit(resource.RLIMIT_FSIZE, ({FILES}, {FILES}))
            code = 0
            main = sys.modules['__main__'] = types.ModuleType('__main__')
            main.__dict__.update(__file__='program.py', __builtins__=__builtins__, __cached__=None)
            try:
                with open('program.py', 'rb') as f:
                    text = f.read()
                exec(compile(text, 'program.py', 'exec', dont_inherit=True), main.__dict__)
            except SystemExit as e:
                code = e.code if isinstance(e.code, int) else 0 if e.code is None else 1
                if code == 1 and not isinstance(e.code, int):
                    print(e.code, file=sys.stderr)
            except BaseException:
                traceback.print_exc()
                code = 1
            sys.stdout.flush()
            sys.stderr.flush()
        except BaseException:
            code = 1
        os._exit(code & 255)
    code, ended = None, select.poll()
    seen = os.pidfd_open(child)
    ended.register(seen, select.POLLIN)
    in_time = ended.poll(1000 * limit)
    os.close(seen)
    try:
        os.killpg(child, signal.SIGKILL)  # not waited for yet: nobody else has its number
    except (ProcessLookupError, PermissionError):
        pass
    status = os.waitpid(child, 0)[1]
    if in_time:
        code = os.waitstatus_to_exitcode(status)
    os.write(keep, (json.dumps(code) + chr(10)).encode())
"""


class Forks:
    """A warm interpreter of which candidates are forks; a new one where it has died."""

    def __init__(self):
        self.server = None

    def _ready(self):
        if self.server is None or self.server.poll() is not None:
            env = {k: v for k, v in os.environ.items() if not any(x in k for x in ("KEY", "TOKEN", "SECRET", "PASSWORD"))}
            self.server = subprocess.Popen([sys.executable, "-c", _FORKS], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, text=True, start_new_session=True)
        return self.server

    def run(self, text: str, timeout: float) -> tuple:
        """The RAW columns of one Python program."""
        with tempfile.TemporaryDirectory(prefix="candidate-", ignore_cleanup_errors=True) as folder:
            with open(os.path.join(folder, "program.py"), "w", encoding="utf-8", errors="replace") as f:
                f.write(text)
            server = self._ready()
            try:
                server.stdin.write(json.dumps([folder, timeout]) + "\n")
                server.stdin.flush()
                answer = server.stdout.readline()
            except BrokenPipeError:
                answer = ""
            if not answer:  # the candidate has ended its server too
                self.close()
                return -9, False, "", "killed", 0, False, False
            code = json.loads(answer)
            if code is None:
                return None, True, "", "timeout", 0, False, False
            shown = []
            for name in ("stdout", "stderr"):
                with contextlib.suppress(OSError), open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    shown.append(f.read())
            out, err = [*shown, "", ""][:2]
            figure = os.path.join(folder, FIGURE)
            return code, False, out, err, os.path.getsize(figure) if os.path.exists(figure) else 0, False, False

    def close(self) -> None:
        if self.server is not None:
            with contextlib.suppress(ProcessLookupError, PermissionError):
                os.killpg(self.server.pid, signal.SIGKILL)
            self.server.wait()
            self.server.stdin.close()
            self.server.stdout.close()
            self.server = None


class Ledger:
    """The log of one bin, in a folder that all executors see, through pyarrow's file systems."""

    def __init__(self, folder: str, number: int):
        from pyarrow import fs

        self.fs, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.folder, self.name, self.held, self.nth = f"{top}/bin={number}", uuid.uuid4().hex, [], 0
        self.since = time.monotonic()
        self.fs.create_dir(self.folder, recursive=True)

    def finished(self) -> dict[str, list]:
        from pyarrow import fs

        out = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.endswith(".jsonl"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        key, *row = json.loads(line)
                        out[key] = row
        return out

    def add(self, key: str, row: tuple, flush: float) -> None:
        self.held.append(json.dumps([key, *row]))
        if time.monotonic() - self.since >= flush:
            self.write()

    def write(self) -> None:
        if self.held:
            draft = f"{self.folder}/.{self.name}-{self.nth}"
            with self.fs.open_output_stream(draft) as f:
                f.write("\n".join(self.held).encode())
            self.fs.move(draft, f"{self.folder}/{self.name}-{self.nth}.jsonl")
            self.held, self.nth = [], self.nth + 1
        self.since = time.monotonic()


def dealt(rows: DataFrame, seconds: Column, key: Column, bins: int | None = None) -> DataFrame:
    """The rows with ``_bin``: about equal sums of expected seconds, the longest in the first bins."""
    length = F.greatest(F.coalesce(seconds.cast("double"), F.lit(1.0)), F.lit(1e-3))
    place = F.least(F.greatest(F.floor(F.log2(length)) + CLASSES // 2, F.lit(0)), F.lit(CLASSES)).cast("int")
    classed = rows.withColumns({"_class": place, "_length": length})
    sums = classed.groupBy("_class").agg(F.sum("_length").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row a class
    sums = sums.withColumn("_before", before).withColumn("_all", F.sum("_sum").over(Window.partitionBy()))
    n = F.lit(bins) if bins else F.least(F.greatest(F.ceil(F.col("_all") / SECONDS_A_BIN), F.lit(1)), F.lit(MOST_BINS))
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    at = (F.col("_before") + F.col("_sum") * share) / F.col("_all")
    joined = classed.join(F.broadcast(sums), "_class").withColumn("_bin", F.least(F.floor(at * n), n - 1).cast("int"))
    return joined.drop("_class", "_length", "_sum", "_before", "_all")


def execute_table(problems: DataFrame, benchmark: str, key: str, folder: str, timeout: float, seconds: Column | None = None, bins: int = 64, allow: bool = False, flush: float = FLUSH, jars: str | None = None, once: bool = False) -> DataFrame:
    """The rows with the RAW columns of their candidate's run, as ``execution.execute`` gives them; folder: the ledger's, the same for a run and its repeats.

    seconds: the expected ones, a column (of a former ledger, or a length); all alike without it. bins: tasks. once: equal programs are run once.
    """
    if not allow:
        raise PermissionError("running candidates runs untrusted code: pass allow=True")
    language = F.col("language") if benchmark == "multipl-e" else F.lit("python")
    given = problems.withColumns({"_language": language, "_program": program(benchmark)})
    expected = seconds if seconds is not None else F.lit(1.0)
    if once:
        given = given.withColumn("_same", F.sha2(F.to_json(F.struct("_language", "_program", F.coalesce("code", F.lit("")))), 256))
        texts = [F.first(c).alias(c) for c in ("_language", "_program", "code")]  # the same in all of them
        rows, given = given.drop("_language", "_program"), given.withColumn("_expected", expected).groupBy("_same").agg(*texts, F.max("_expected").alias("_expected"))
        name, expected, schema = F.concat(F.lit(":"), F.col("_same")), F.col("_expected"), "_same string, code string, _expected " + dict(given.dtypes)["_expected"]
        given = given.select("_same", "code", "_expected", "_language", "_program")
    else:
        name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.sha2("_program", 256))
        schema = problems.schema.simpleString()[len("struct<") : -1]
    given = dealt(given.withColumn("_name", name), expected, F.col("_name"), bins)
    given = given.repartitionById(bins, F.col("_bin"))

    def run(batches):
        forks, ledgers, logged = Forks(), {}, {}
        try:
            for frame in batches:
                rows = []
                for number, own, kind, text, code in zip(frame["_bin"], frame["_name"], frame["_language"], frame["_program"], frame["code"], strict=True):
                    if not (code or "").strip():
                        rows.append((None, False, "", "", 0, False, False))
                        continue
                    if number not in ledgers:
                        ledgers[number] = Ledger(folder, int(number))
                        logged[number] = ledgers[number].finished()
                    if own not in logged[number]:
                        done = forks.run(text, timeout) if kind == "python" else run_program(kind, text, timeout, jars)
                        logged[number][own] = list(done)
                        ledgers[number].add(own, done, flush)
                    rows.append(tuple(logged[number][own]))
                raw = pd.DataFrame(rows, index=frame.index, columns=NAMES)
                raw["rc"] = raw["rc"].astype("Int32")
                yield pd.concat([frame.drop(columns=["_language", "_program", "_name", "_bin"]), raw], axis=1)
        finally:
            forks.close()
            for ledger in ledgers.values():
                ledger.write()

    ran = given.mapInPandas(run, f"{schema}, {RAW}")
    if not once:
        return ran
    joined = rows.join(ran.drop("code", "_expected").withColumn("_ran", F.lit(True)), "_same", "left")
    lost = F.raise_error(F.lit("a row was not there when the table was read for its programs"))
    return joined.withColumn("timed_out", F.when(F.col("_ran"), F.col("timed_out")).otherwise(lost)).drop("_same", "_ran")


def finished(spark, folder: str) -> DataFrame:
    """What a ledger holds: name (key:digest of the program) and the RAW columns."""
    rows = spark.read.text(f"{folder}/bin=*/*.jsonl").select(F.from_json("value", "array<string>").alias("r"))
    kinds = [x.split()[1] for x in RAW.split(", ")]
    return rows.select(F.get("r", F.lit(0)).alias("name"), *[F.get("r", F.lit(i + 1)).cast(k).alias(n) for i, (n, k) in enumerate(zip(NAMES, kinds, strict=True))])
