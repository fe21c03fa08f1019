"""Which tasks are to be run again, as a stream with bounded state.

A key's state is its last attempt: number, category and how many infrastructure failures came in a row. Keys are dealt to BUCKETS by their hash, and a bucket's
keys are read, changed and written together: a key costs a dictionary's entry, not calls to the state store. Timers in processing time end it: a key whose last
attempt has a result is forgotten KEEP after it, so state holds the keys of that time and those that wait. A key whose last attempt failed for
reasons of the infrastructure stays, and its timer, at FIRST and twice as long after each further failure, asks for the next attempt.

Rows out: the key, seq, category, pending (whether it is to be run again) and asked (whether this row comes from the timer). The last row of
each key by (seq, asked) says what holds; a ``RecordStore`` keeps just that. An attempt that comes after a later one changes nothing, also when that one is
forgotten already, as the store minds the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .store import RecordStore

INFRASTRUCTURE = "APIError"
BUCKETS, WHOLE = 4096, ("tinyint", "smallint", "int", "bigint")
KEEP_MS, FIRST_MS, LONGEST_MS = 3_600_000, 60_000, 6 * 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "seq long, category string, pending boolean, asked boolean"


class Retry(StatefulProcessor):
    """All keys of one bucket at a time: its state is a list of the keys that are open, its one timer the earliest of theirs."""

    def __init__(self, keys: list[str], kinds: dict[str, str], keep_ms: int, first_ms: int, longest_ms: int):
        self.keys, self.kinds, self.keep_ms, self.first_ms, self.longest_ms = keys, kinds, keep_ms, first_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ", ".join([*(f"{k} {self.kinds[k]}" for k in self.keys), "seq long, category string, failures int, due long"]))

    def _held(self) -> dict[tuple, tuple]:
        """key -> (seq, category, failures, due)."""
        n = len(self.keys)
        return {row[:n]: row[n:] for row in self.open.get()} if self.open.exists() else {}

    def _hold(self, held: dict[tuple, tuple], timer: int | None) -> None:
        """Write the open keys; timer: the one that is set."""
        self.open.put([key + of for key, of in held.items()]) if held else self.open.clear()
        due = min((of[3] for of in held.values() if of[3] >= 0), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def _out(self, rows: list[tuple], asked: bool) -> pd.DataFrame:
        """rows: key, seq, category."""
        out = pd.DataFrame(rows, columns=[*self.keys, "seq", "category"], dtype=object)
        out["seq"] = out["seq"].astype("int64")
        out["pending"], out["asked"] = [r[-1] == INFRASTRUCTURE for r in rows], asked
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentProcessingTimeInMs()
        timer = min((of[3] for of in held.values() if of[3] >= 0), default=None)
        plain = [_whole if self.kinds[k] in WHOLE else _plain for k in self.keys]
        # (seq, category), first to last, of each key
        tries: dict[tuple, list] = {}
        for frame in rows:
            for *own, seq, category in zip(*(frame[c].tolist() for c in [*self.keys, "seq", "category"]), strict=True):
                tries.setdefault(tuple(as_held(x) for as_held, x in zip(plain, own, strict=True)), []).append((int(seq), category))
        changed = []
        for own, given in tries.items():
            before = held.get(own)
            given = [t for t in given if t[0] > before[0]] if before else given
            if not given:
                continue
            given.sort(key=lambda t: t[0])
            failures = before[2] if before else 0
            for _, category in given:
                failures = failures + 1 if category == INFRASTRUCTURE else 0
            wait = min(self.first_ms * 2 ** min(failures - 1, 30), self.longest_ms) if failures else self.keep_ms
            held[own] = (*given[-1], failures, now + wait)
            changed.append((*own, *given[-1]))
        if changed:
            self._hold(held, timer)
            yield self._out(changed, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now, asked = self._held(), expiredTimerInfo.getExpiryTimeInMs(), []
        now = max(now, timerValues.getCurrentProcessingTimeInMs() - 1)  # all that are due
        for own, (seq, category, failures, due) in list(held.items()):
            if not 0 <= due <= now:
                continue
            if failures:
                held[own] = (seq, category, failures, -1)  # it waits for the attempt that is asked for now
                asked.append((*own, seq, category))
            else:
                del held[own]
        self._hold(held, None)  # the timer that has fired is gone
        if asked:
            yield self._out(asked, True)


def _plain(value):
    """A key's value as state holds it: null for what pandas makes of one."""
    return None if value is None or value != value else value


def _whole(value):
    return None if value is None else int(value)


def retries(attempts: DataFrame, keys: list[str], keep_ms: int = KEEP_MS, first_ms: int = FIRST_MS, longest_ms: int = LONGEST_MS, buckets: int = BUCKETS) -> DataFrame:
    """A stream of attempts (keys, seq, category) to the stream of rows out. buckets: fixed with the checkpoint."""
    kinds = dict(attempts.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), OUT])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    given = [F.col(k).cast("string") if kinds[k] in WHOLE else F.col(k) for k in keys]  # whole numbers beside nulls would become doubles
    rows = attempts.select(*[g.alias(k) for g, k in zip(given, keys, strict=True)], "seq", "category", bucket.alias("_bucket")).groupBy("_bucket")
    return rows.transformWithStateInPandas(Retry(keys, kinds, keep_ms, first_ms, longest_ms), schema, "Update", "ProcessingTime")


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    """Session options that a query takes over when it starts, set only while it does."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_retries(spark: SparkSession, attempts: DataFrame, keys: list[str], store: RecordStore, checkpoint: str, writer: str = "retry", **options):
    """Commit the stream's rows to a store over (seq, asked), in ``order``; options: of ``retries`` and the trigger.

    A run over what is there (``availableNow``, the default) ends with its last file, as timers alone would keep it going for ever; what is due then is asked for
    with the next run's files, or by a run with ``processingTime``.
    """
    trigger = {k: options.pop(k) for k in ("availableNow", "processingTime") if k in options} or {"availableNow": True}
    rows = retries(attempts, keys, **options).withColumn("order", F.struct("seq", "asked"))
    query = rows.writeStream.outputMode("update").foreachBatch(store.sink(writer)).option("checkpointLocation", checkpoint).trigger(**trigger)
    idle = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if "availableNow" in trigger else {}
    with _settings(spark, **{"spark.sql.streaming.stateStore.providerClass": PROVIDER}, **idle):
        return query.start()


def pending(store: RecordStore) -> DataFrame:
    """The keys to be run again."""
    return store.current().filter("pending").select(*store.keys)
