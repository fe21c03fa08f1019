"""A committed store of the latest record of each key: a manifest of batches, deltas merged when read, compaction into key buckets.

Layout under the store's path: ``deltas/<batch>`` and ``base/<compaction>/bucket=<b>`` hold Parquet, ``manifest/<version>`` one JSON document that names all
that counts. A version is written whole and only if it isn't there yet, so of two writers one starts again on what the other committed; files that no
version names are leftovers and never read.

A batch is committed once: the manifest keeps each writer's last batch number, and a batch that is replayed after a failure changes nothing. No state is kept
by the stream itself: a batch's own records are combined, written as a delta, and the rest is done when reading.

Reading takes the base and the open deltas. Only key buckets that a delta touches are merged with it; the others are read as they lie. When MANY deltas are open they are
merged into new base folders of the buckets they touch; others stay. So the number of files is bounded by buckets and open deltas, whatever the number
of batches. ``vacuum`` deletes what the last versions don't name; until then, readers that began earlier find their files.

A record with a lower ``order`` than the stored one changes nothing; of equal ones the last committed counts. Null keys are keys. Empty batches are
committed without a folder. All batches have the store's columns.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_files as files

BUCKETS, MANY, FILE_BYTES = 32, 8, 128 << 20


@dataclass
class Manifest:
    """What counts as of one version. base: bucket -> folder; deltas: in the order of their commits."""

    version: int = 0
    schema: str | None = None
    buckets: int = BUCKETS
    base: dict[str, str] = field(default_factory=dict)
    deltas: list[dict] = field(default_factory=list)
    writers: dict[str, int] = field(default_factory=dict)

    def touched(self) -> list[int]:
        return sorted({b for d in self.deltas for b in d["buckets"]})

    def folders(self) -> set[str]:
        return {f"base/{f}" for f in self.base.values()} | {f"deltas/{d['folder']}" for d in self.deltas if d["folder"]}


class RecordStore:
    """The latest records by ``keys``, as ``order`` says. buckets: fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str = "seq", buckets: int = BUCKETS, many: int = MANY):
        self.spark, self.path, self.keys, self.order, self.buckets, self.many = spark, path.rstrip("/"), list(keys), order, buckets, many

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(x) for x in files.names(self.spark, f"{self.path}/manifest")]

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest(buckets=self.buckets)
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/manifest/{version or known[-1]:012d}")))

    def _publish(self, after: Manifest) -> bool:
        return files.create(self.spark, f"{self.path}/manifest/{after.version:012d}", json.dumps(vars(after)))

    # ------------------------------------------------------------ writing

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))

    def _latest(self, rows: DataFrame, *newer: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.order, *newer)).alias("_last"))
        return last.select(*self.keys, "_last.*").select(*[c for c in rows.columns if c not in newer])

    def commit(self, batch: DataFrame, writer: str, number: int) -> bool:
        """Add a batch's records; False, and nothing is changed, if the writer has committed this batch or a later one."""
        before = self.manifest()
        if before.writers.get(writer, -1) >= number:
            return False
        name = f"{writer}-{number:012d}-{uuid.uuid4().hex}"
        where = f"{self.path}/deltas/{name}"
        own = self._latest(batch)
        own.write.parquet(where)
        written = self.spark.read.schema(own.schema).parquet(where)
        found = [r.bucket for r in self._bucketed(written.select(*self.keys), before.buckets).select("bucket").distinct().collect()]
        size = files.size(self.spark, where)[0]
        while True:
            schema = before.schema or own.schema.json()
            delta = {"folder": name if found else None, "writer": writer, "number": number, "buckets": sorted(found), "bytes": size}
            after = Manifest(before.version + 1, schema, before.buckets, before.base, [*before.deltas, *([delta] if found else [])], before.writers | {writer: number})
            if self._publish(after):
                break
            before = self.manifest()  # another writer was first
            if before.writers.get(writer, -1) >= number:
                return False
        if len(after.deltas) >= self.many:
            self.compact()
        return True

    def sink(self, writer: str = "stream"):
        """For ``foreachBatch``."""
        return lambda batch, number: self.commit(batch, writer, number) and None

    # ------------------------------------------------------------ reading

    def _read(self, m: Manifest, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        schema = self._schema(m)
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows if buckets is None else self._bucketed(rows, m.buckets).filter(F.col("bucket").isin(buckets)).drop("bucket")

    @staticmethod
    def _schema(m: Manifest):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(m.schema))

    def _merged(self, m: Manifest, buckets: list[int]) -> DataFrame:
        """Base and deltas of these buckets; each delta's place in the order of commits settles ties."""
        parts = [self._read(m, [f"base/{m.base[str(b)]}/bucket={b}" for b in buckets if str(b) in m.base]).withColumn("_nth", F.lit(-1))]
        for k, d in enumerate(m.deltas):
            if set(d["buckets"]) & set(buckets):
                parts.append(self._read(m, [f"deltas/{d['folder']}"], None if set(d["buckets"]) <= set(buckets) else buckets).withColumn("_nth", F.lit(k)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return self._latest(rows, "_nth")

    def current(self, version: int | None = None) -> DataFrame:
        """The latest records, as of a version if one is given (that ``vacuum`` has left)."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("nothing was committed yet")
        touched = m.touched()
        still = [f"base/{m.base[b]}/bucket={b}" for b in m.base if int(b) not in touched]
        if not touched:
            return self._read(m, still)
        merged = self._merged(m, touched)
        return merged.unionByName(self._read(m, still)) if still else merged

    # ------------------------------------------------------------ upkeep

    def compact(self) -> bool:
        """Merge the open deltas into the buckets they touch; False if there are none, or a writer was first (the deltas stay open then)."""
        m = self.manifest()
        touched = m.touched()
        if not touched:
            return False
        name = f"{m.version:012d}-{uuid.uuid4().hex}"
        size = sum(d["bytes"] for d in m.deltas) + sum(files.size(self.spark, f"{self.path}/base/{m.base[str(b)]}/bucket={b}")[0] for b in touched if str(b) in m.base)
        slots = max(1, -(-size // FILE_BYTES // len(touched)))  # files a bucket
        rows = self._bucketed(self._merged(m, touched), m.buckets).withColumn("_slot", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(slots)))
        rows.repartition(len(touched) * slots, "bucket", "_slot").drop("_slot").write.partitionBy("bucket").parquet(f"{self.path}/base/{name}")
        made = {int(x.removeprefix("bucket=")) for x in files.names(self.spark, f"{self.path}/base/{name}") if x.startswith("bucket=")}
        while True:
            now = self.manifest()
            if {k: v for k, v in now.base.items() if int(k) in touched} != {k: v for k, v in m.base.items() if int(k) in touched} or now.deltas[: len(m.deltas)] != m.deltas:
                return False  # another compaction was first
            base = now.base | {str(b): name for b in made}
            if self._publish(Manifest(now.version + 1, now.schema, now.buckets, base, now.deltas[len(m.deltas) :], now.writers)):
                return True

    def vacuum(self, versions: int = 2) -> int:
        """Delete old versions but the last few, and the folders that those don't name; the number of folders deleted. Not beside writers, whose
        uncommitted folders no version names yet."""
        known = self.versions()
        keep = known[-versions:]
        named = set().union(*[self.manifest(v).folders() for v in keep]) if keep else set()
        gone = [f"{top}/{x}" for top in ("base", "deltas") for x in files.names(self.spark, f"{self.path}/{top}") if f"{top}/{x}" not in named]
        for v in known[:-versions]:
            files.delete(self.spark, f"{self.path}/manifest/{v:012d}")
        for folder in gone:
            files.delete(self.spark, f"{self.path}/{folder}")
        return len(gone)
