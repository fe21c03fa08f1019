"""Mixing of sources to target weights: fixed-length blocks of words, multinomial draws, pseudorandom index permutations.

1. Each source's texts are laid end to end as one stream of words (in the order of a hash of doc_id and text, so
   that the mix doesn't depend on how files are split) and cut into blocks of
   BLOCK words. A word's place comes from running sums over many small chunks of a source, not over the source at once.
2. Targets: the sources share all words by weight; none gets more than LIMIT times its own size, the excess is
   reshared by weight among the others until none is above.
3. A source's target is a number of block slots. The output is made of shards of about SHARD_SLOTS slots each; a shard's
   numbers of slots by source are a multinomial draw with the slots still to be filled as weights, cut at what a
   source has left. So that no task goes through all shards, the draws go down a tree: all slots are drawn for PARTS parts of the shards,
   the slots of each part for PARTS parts of it, until a part is one shard. Each part's draw is seeded by the shards it is of.
4. A source's i-th slot takes, of its blocks, the one at place i modulo their number under a pseudorandom permutation (a keyed
   Feistel network with cycle walking) of that round: each block is taken once before any is taken again.
5. Slots and blocks are joined by (source, block index).

Only the sources' sizes, some numbers and a name for each, reach the driver; tables with a row a source are broadcast if their
bytes are counted and few. Nulls: a null text has size 0; a null source is a source of
its own, last in order; a null doc_id is carried. Repeated rows are separate texts. A source of size 0 has target 0.
Empty tables give empty results. ``mix`` carries all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, small_batches, small_or_plain, tidied

WEIGHTS, LIMIT, BLOCK, SHARD_SLOTS, PARTS, CHUNK_ROWS, SEED = (5.0, 2.0, 1.0), 3.0, 64, 16384, 64, 1024, 29
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Each source's share of sum(sizes) by weight, at most limit * its size, the excess reshared by weight."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > limit * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in over:
            targets[i] = limit * sizes[i]
        left -= sum(targets[i] for i in over)
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return targets


def permuted(index, n, key):
    """Places of ``index`` (0 .. n - 1) under a pseudorandom permutation of 0 .. n - 1, for arrays of index, n and key."""
    import numpy as np

    from .hashing import U, mix

    index, n, key = (np.asarray(x).astype(np.uint64) for x in (index, n, key))
    half = np.zeros(len(n), np.uint64)
    for bits in range(1, 32):  # half of the bits of an even number of bits that holds n
        half += ((n - U(1)) >> (U(2) * half) > 0).astype(np.uint64)
    half = np.maximum(half, U(1))
    mask = (U(1) << half) - U(1)
    out, walk = index.copy(), np.arange(len(index))
    while len(walk):
        left, right = out[walk] >> half[walk], out[walk] & mask[walk]
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(key[walk] + U(r * 0x9E3779B97F4A7C15 % 2**64))) & mask[walk])
        out[walk] = (left << half[walk]) | right
        walk = walk[out[walk] >= n[walk]]
    return out.astype(np.int64)


def draws(slots, shards: list[int], seed) -> list[list[int]]:
    """For each part (of so many ``shards``) the number of slots of each source; over all parts each source's add up to its slots."""
    import numpy as np

    rng = np.random.default_rng(seed)
    left, to_fill, out = np.array(slots, np.int64), sum(shards), []
    for n in shards:
        size = int(left.sum()) * n // to_fill
        to_fill -= n
        take = left.copy() if not to_fill else np.zeros(len(left), np.int64)
        while size > int(take.sum()):
            rest = left - take
            take += np.minimum(rng.multinomial(size - int(take.sum()), rest / rest.sum()), rest)
        left = left - take
        out.append(take.tolist())
    return out


def parts_of(low: int, high: int) -> list[tuple[int, int]]:
    """The shards low .. high - 1 in PARTS parts or fewer, even ones."""
    n = min(PARTS, high - low)
    edges = [low + (high - low) * k // n for k in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


NODE = "low long, high long, source_no array<int>, begin array<long>, n array<long>"


def _drawn(batches):
    """Each node of the tree, some shards and the sources' slots in them, as its parts."""
    import pandas as pd

    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            if r.high - r.low == 1:
                rows.append((r.low, r.high, r.source_no, r.begin, r.n))
                continue
            parts, begin = parts_of(int(r.low), int(r.high)), [int(b) for b in r.begin]
            for (low, high), taken in zip(parts, draws(r.n, [b - a for a, b in parts], [SEED, int(r.low), int(r.high)]), strict=True):
                some = [i for i, k in enumerate(taken) if k]
                rows.append((low, high, [int(r.source_no[i]) for i in some], [begin[i] for i in some], [taken[i] for i in some]))
                begin = [b + k for b, k in zip(begin, taken, strict=True)]
        yield pd.DataFrame(rows, columns=["low", "high", "source_no", "begin", "n"])


def shard_runs(spark, slots: list[int]) -> DataFrame:
    """source_no, shard, begin, n: which of its slots, n from ``begin`` on, each source has in each shard. A run is no longer than a shard."""
    some = [(i, n) for i, n in enumerate(slots) if n]
    n_shards = max(1, -(-sum(slots) // SHARD_SLOTS))
    root = [(0, n_shards, [i for i, _ in some], [0] * len(some), [n for _, n in some])]
    nodes, widest, n_nodes = spark.createDataFrame(root, NODE), n_shards, 1
    while widest > 1:
        nodes = materialize(nodes.repartition(min(n_nodes, parallelism(spark))).mapInPandas(tidied(_drawn), NODE), "mix-draws")
        widest, n_nodes = -(-widest // PARTS), min(n_shards, n_nodes * PARTS)
    each = nodes.select(F.col("low").alias("shard"), F.explode(F.arrays_zip("source_no", "begin", "n")).alias("z"))
    return each.select("z.source_no", "shard", "z.begin", "z.n")


def _streams(rows: DataFrame) -> DataFrame:
    """rows (uid, rank, source, size) with first: the place of the row's first word in its source's stream."""
    n = rows.count()
    chunk = F.pmod(F.xxhash64("rank"), F.lit(max(1, n // CHUNK_ROWS)))
    rows = rows.withColumn("chunk", chunk)
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("chunk_first"))
    inner = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("rank", "uid").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inner", F.coalesce(inner, F.lit(0)))
    joined = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["chunk"] == offsets["c"]))
    return joined.select(*[c for c in rows.columns if c != "chunk"], (F.col("chunk_first") + F.col("inner")).alias("first"))


def plan(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, block: int = BLOCK):
    """(rows: uid, doc_id, source, size, first; sources as a small DataFrame; pieces with the times they are taken).

    pieces: uid, block_no, words (of this text in that block), times.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    sized = docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), order.alias("rank"))
    rows = materialize(sized.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    rows = materialize(_streams(rows), "mix-streams")
    held = sorted(((r["source"], int(r["n"] or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in held]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(held))], limit)
    n_blocks = [-(-n // block) for n in sizes]
    slots = [min(round(t * b / n), int(limit * b)) if n else 0 for t, b, n in zip(targets, n_blocks, sizes, strict=True)]
    table = [(i, name, n, t, b) for i, ((name, n), t, b) in enumerate(zip(held, targets, n_blocks, strict=True))]
    sources = small_or_plain(spark.createDataFrame(table, "source_no int, source string, source_size long, target double, n_blocks long"))
    drawn = shard_runs(spark, slots).repartition(parallelism(spark))
    slot = drawn.join(sources.select("source_no", "n_blocks"), "source_no").select("source_no", "shard", "n_blocks", F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("slot"))

    @F.pandas_udf("long")
    def block_of(slot, n_blocks, source_no):
        import pandas as pd

        key = source_no.to_numpy() * 1_000_003 + slot.to_numpy() // n_blocks.to_numpy() + 7919 * SEED
        return pd.Series(permuted(slot.to_numpy() % n_blocks.to_numpy(), n_blocks.to_numpy(), key))

    taken = slot.select("source_no", "shard", "slot", block_of("slot", "n_blocks", "source_no").alias("block_no"))
    numbered = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("uid", "doc_id", "rank", rows["source"], "size", "first", "source_no", "source_size", "target")
    last = F.col("first") + F.col("size")
    low = F.floor(F.col("first") / block)
    cut = numbered.filter("size > 0").select("uid", "source_no", "first", last.alias("last"), F.explode(F.sequence(low, F.floor((last - 1) / block))).alias("block_no"))
    words = F.least("last", (F.col("block_no") + 1) * block) - F.greatest("first", F.col("block_no") * block)
    pieces = cut.select("uid", "source_no", "block_no", words.alias("words"), F.greatest(F.col("block_no") * block - F.col("first"), F.lit(0)).alias("from_word"))
    times = taken.groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
    return numbered, sources, pieces.join(times, ["source_no", "block_no"]), taken


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every row."""
    rows, _, pieces, _ = plan(docs, weights, limit, block)
    per = pieces.groupBy("uid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(per, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """The mixed corpus: for each text and each time that words of it are taken, a row with those words, in the columns of ``docs``.

    A text that is taken whole keeps its characters; of others the taken stretches are cut out and joined by a line
    end. n_chars, if there, is made new. Texts of which nothing is taken leave.
    """
    small_batches(docs.sparkSession)
    rows, _, pieces, _ = plan(docs, weights, limit, block)
    stretch = F.struct("from_word", "words", "times")
    per = rows.select("uid", "doc_id", "rank", "size").join(pieces.groupBy("uid").agg(F.sort_array(F.collect_list(stretch)).alias("stretches")), "uid")
    # texts that agree in doc_id, source and words are told apart by their number among their like
    like = Window.partitionBy("doc_id", "rank").orderBy("uid")
    per = per.withColumn("like", F.row_number().over(like)).drop("uid")
    order = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    given = docs.withColumn("__rank", order)
    repeated = per.filter("like > 1").limit(1).count() > 0
    if repeated:
        given = given.withColumn("__like", F.row_number().over(Window.partitionBy("doc_id", "__rank").orderBy(F.lit(0))))
    else:
        given = given.withColumn("__like", F.lit(1))
    per = per.select(F.col("doc_id").alias("__doc"), F.col("rank").alias("__r"), F.col("like").alias("__l"), F.col("size").alias("__size"), F.col("stretches").alias("__stretches"))
    per = per.hint("shuffle_hash")  # small rows: the texts on the other side then needn't be sorted
    joined = given.join(per, given["doc_id"].cast("long").eqNullSafe(per["__doc"]) & (given["__rank"] == per["__r"]) & (given["__like"] == per["__l"]))
    columns, schema = docs.columns, docs.schema

    def cut(batches):
        import re

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        word, out_schema = re.compile(r"[^\x20\x09-\x0D]+"), to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    stretches, spans = r["__stretches"], None
                    for time in range(1, max(s["times"] for s in stretches) + 1):
                        runs = []
                        for s in stretches:
                            if s["times"] >= time:
                                a, b = s["from_word"], s["from_word"] + s["words"]
                                if runs and runs[-1][1] == a:
                                    runs[-1][1] = b
                                else:
                                    runs.append([a, b])
                        if runs == [[0, r["__size"]]]:
                            text = r["text"]
                        else:
                            spans = spans or [m.span() for m in word.finditer(r["text"])]
                            text = "\n".join(r["text"][spans[a][0] : spans[b - 1][1]] for a, b in runs)
                        row = {c: r[c] for c in columns} | {"text": text}
                        if "n_chars" in row:
                            row["n_chars"] = len(text)
                        out.append(row)
                yield pa.RecordBatch.from_pylist(out, out_schema)

    return joined.select(*columns, "__size", "__stretches").mapInArrow(tidied(cut), schema)
