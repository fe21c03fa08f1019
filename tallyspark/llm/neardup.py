"""Near duplicates by MinHash bands and odd sketches, confirmed on whole shingle sets; connected components.

1. Texts with equal shingle sets form a class; its smallest doc_id stands for it. What follows works on the classes.
2. BANDS x ROWS MinHash samples. Classes that share a band meet. (At similarity 0.8 a pair shares none of the 40 bands
   of 7 samples with probability 8e-5, at 0.85 with 1e-7.)
3. In a band bucket every class is compared with one leader, not with all: the bucket's member of smallest (hash of
   doc_id, doc_id), which is mostly the same in all bands of a group. Odd sketches (the samples folded into a parity
   bitmap; the count of the bits in which two differ estimates the similarity) drop pairs that are far below the
   threshold; the others are confirmed on their whole sets. So a group of n close copies costs about n comparisons.
4. Components: every class takes its smallest leader, and only the leaders' graph, which is far smaller, is gone through by
   repeated minimum labels with shortcuts, in tables of the shared folder.
5. Buckets whose members aren't yet one component are gone through exactly: their members are cut by component into
   chunks of bounded size. Pairs of chunks that don't belong to one component meet as ids first, then by the odd sketches of their
   members; the members that are near to one of another component, and no others, are compared on whole sets. Only one
   link for each two components leaves a pair of chunks. So no link that could join two components is lost in any
   bucket, whatever its size, and no group is held by one task. Then the components are made again.

Nulls: a null text has no words; texts without words have the empty set, are linked with nothing and stay. A null doc_id
can't name a component: it is treated as a text of its own, linked with nothing. Rows that repeat a doc_id with
other texts keep a row each: links of any of them are links of the id. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, discard, materialize, parallelism, session_conf, small_batches, small_or_plain, spelled, tidied

WIDTH, THRESHOLD, BANDS, ROWS, BITS = 4, 80, 40, 7, 1024
HOT, CHUNK, NODE_SIZE = 10_000, 40_000, 20  # CHUNK: a chunk's shingles, each text counting as so many more


# ---------------------------------------------------------------- signatures


def signature(sets, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
    """MinHash band keys (int64, texts x bands) and odd sketches (int64, texts x bits / 64) of shingle sets."""
    import numpy as np

    from .hashing import U, mix, randoms

    k = bands * rows
    a, b = randoms(k, 11), randoms(k, 13)
    low = np.full((len(sets), k), np.uint64(2**64 - 1))
    for i, s in enumerate(sets):
        for at in range(0, len(s), 128):  # as much as stays in the processor's cache
            np.minimum(low[i], ((s[at : at + 128, None] ^ b) * a).min(axis=0), out=low[i])
    salted = mix(low ^ np.arange(k, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * U(3) + salted[:, r::rows])
    keys = keys ^ mix(np.arange(bands, dtype=np.uint64) + U(1))
    sketch = np.zeros((len(sets), bits), np.uint8)
    place = ((salted >> U(33)) % U(bits)).astype(np.int64)
    for j in range(k):
        sketch[np.arange(len(sets)), place[:, j]] ^= 1
    return keys.view(np.int64), np.packbits(sketch, axis=1).view(np.int64)


def most_differing(threshold: int = THRESHOLD, samples: int = BANDS * ROWS, bits: int = BITS) -> int:
    """Sketch bits in which a pair at the threshold can differ: 7 standard deviations of its samples, and of the folding."""
    s = threshold / 100
    samples_off = 2 * samples * (1 - s) + 14 * (samples * s * (1 - s)) ** 0.5
    return int(bits / 2 * (1 - math.exp(-2 * samples_off / bits)) + 20)


def _signed(width: int):
    def run(batches):
        import hashlib

        import pandas as pd

        from .common import numbers, slices
        from .hashing import Words, shingles

        for frame in batches:
            ids, texts = numbers(frame["doc_id"]), frame["text"].tolist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                sets = shingles(words.hashes(), words.doc, words.n_docs, width)
                keys, sketch = signature(sets)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out = pd.DataFrame({"doc_id": pd.array(ids[a:b], "Int64"), "n_shingles": [len(s) for s in sets], "digest": digest})
                out["bands"], out["sketch"] = list(keys), list(sketch)
                yield out

    return run


def _sets(width: int):
    def run(batches):
        import pandas as pd

        from .common import slices
        from .hashing import Words, shingles

        for frame in batches:
            ids, texts = frame["node"].tolist(), frame["text"].tolist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                sets = shingles(words.hashes(), words.doc, words.n_docs, width)
                yield pd.DataFrame({"node": ids[a:b], "shingles": [s.tobytes() for s in sets]})

    return run


def similar(one: bytes, two: bytes, threshold: int) -> tuple[bool, int, int]:
    """Whether 100 * intersection >= threshold * union of two sorted sets, and both sizes."""
    import numpy as np

    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
    union = len(a) + len(b) - both
    return union > 0 and 100 * both >= threshold * union, both, union


def _confirmed(threshold: int):
    def run(batches):
        for frame in batches:
            linked = [similar(x, y, threshold)[0] for x, y in zip(frame["s1"], frame["s2"], strict=True)]
            yield frame.loc[linked, ["a", "b"]]

    return run


def intersections(one: list, two: list):
    """The sizes of the intersections of sorted sets, each of ``one`` with each of ``two``: products of 0/1 blocks."""
    import numpy as np

    if len(one) * len(two) <= 48:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in two] for x in one], float)
    flat = np.concatenate([*one, *two])
    _, place = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(one), len(two)), np.float32)
    width = 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [at, at + width])
        cells = np.zeros((len(one) + len(two), width), np.float32)
        cells[row[a:b], place[a:b] - at] = 1
        out += cells[: len(one)] @ cells[len(one) :].T
    return out


def _near_across(most: int):
    """Of the members of each pair of chunks those that are near, by their sketches, to one of another component in the other chunk."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                one, two = (([m["node"] for m in side], np.array([m["component"] for m in side]), np.array([m["sketch"] for m in side], np.int64).view(np.uint64)) for side in (r.one, r.two))
                hit1, hit2 = np.zeros(len(one[0]), bool), np.zeros(len(two[0]), bool)
                for at in range(0, len(one[0]), 32):
                    bits = np.bitwise_count(one[2][at : at + 32, None, :] ^ two[2][None, :, :]).sum(axis=2, dtype=np.int64)
                    near = (bits <= most) & (one[1][at : at + 32, None] != two[1][None, :])
                    hit1[at : at + 32] = near.any(axis=1)
                    hit2 |= near.any(axis=0)
                for side, (nodes, parts, _), hit in ((1, one, hit1), (2, two, hit2)):
                    rows += [(r.pair, side, nodes[i], int(parts[i])) for i in np.flatnonzero(hit)]
            yield pd.DataFrame(rows, columns=["pair", "side", "node", "component"])

    return run


def _linked_across(threshold: int):
    """One confirmed link for each two components of a pair of chunks: held has the members of both."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            links = []
            for held in frame["held"]:
                one, two = ([(m["node"], m["component"], np.frombuffer(m["shingles"], np.uint64)) for m in held if m["side"] == side] for side in (1, 2))
                sizes1, sizes2 = (np.array([len(m[2]) for m in side], float) for side in (one, two))
                both = intersections([m[2] for m in one], [m[2] for m in two])
                close = 100 * both >= threshold * (sizes1[:, None] + sizes2[None, :] - both)
                apart = np.array([m[1] for m in one])[:, None] != np.array([m[1] for m in two])[None, :]
                found = {}
                for i, j in np.argwhere(close & apart):
                    found.setdefault((one[i][1], two[j][1]), (one[i][0], two[j][0]))
                links += found.values()
            yield pd.DataFrame(links, columns=["a", "b"])

    return run


# ---------------------------------------------------------------- components


def _propagated(edges: DataFrame, label: str) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b), by minimum labels and shortcuts."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    links = materialize(both.distinct(), f"{label}-links")
    low = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), label)
    changed = low.limit(1).count()
    while changed:
        # a node takes the smallest label among its neighbours', then that label's own label
        offer = links.join(low.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        better = low.join(offer, "node").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        better = materialize(better, label)
        up = better.select(F.col("node").alias("component"), F.col("component").alias("above"))
        short = better.join(up, "component", "left").select("node", "was", F.coalesce("above", "component").alias("component"))
        short = materialize(short, label)
        discard(low, better)
        changed, low = short.filter("was <> component").limit(1).count(), short
    discard(links)
    return low.select("node", "component")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b).

    Every b takes its smallest a as its head; what is left to go through are the edges between heads.
    """
    links = materialize(edges.filter("a <> b").select("a", "b").distinct(), f"{label}-edges")
    star = materialize(links.groupBy("b").agg(F.min("a").alias("head")), f"{label}-stars")
    heads = materialize(links.select("a").distinct(), f"{label}-heads")
    inner = links.join(star, "b").filter("a <> head").select(F.col("head").alias("a"), F.col("a").alias("b"))
    own = star.join(heads, F.col("b") == F.col("a"), "left_semi").select(F.col("b").alias("a"), F.col("head").alias("b"))
    between = materialize(inner.union(own).distinct(), f"{label}-between")
    nodes = star.select(F.col("b").alias("node"), "head").union(heads.select(F.col("a").alias("node"), F.col("a").alias("head"))).groupBy("node").agg(F.min("head").alias("head"))
    if between.limit(1).count():
        found = materialize(_propagated(between, label).select(F.col("node").alias("head"), F.col("component").alias("name")), f"{label}-named")
        nodes = attached(nodes, found, "head", "left").select("node", F.coalesce("name", "head").alias("head"))
    nodes = materialize(nodes, f"{label}-nodes")
    lowest = materialize(nodes.groupBy("head").agg(F.min("node").alias("component")), f"{label}-lowest")
    out = materialize(attached(nodes, lowest, "head").select("node", "component"), label)
    discard(links, star, heads, between, nodes, lowest)
    return out


# ---------------------------------------------------------------- the operator


def _whole_sets(nodes: DataFrame, docs: DataFrame, width: int, label: str) -> DataFrame:
    """node, shingles: the set of each node. Sets are made only of texts that have to be compared."""
    nodes = materialize(nodes.select("node").distinct(), f"{label}-nodes")
    texts = docs.join(small_or_plain(nodes), docs["doc_id"] == nodes["node"]).select("node", "text")
    return materialize(texts.mapInPandas(tidied(_sets(width)), "node long, shingles binary"), f"{label}-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs a, b that are linked, on the whole sets of both. An id with several texts is linked if one of them is."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = _whole_sets(nodes, docs, width, "neardup-led")
    first, second = (sets.select(F.col("node").alias(c), F.col("shingles").alias(s)) for c, s in (("a", "s1"), ("b", "s2")))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "s1", "s2")
    return materialize(joined.mapInPandas(tidied(_confirmed(threshold)), "a long, b long"), "neardup-led")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id is component_id), class_id
    (smallest doc_id with the same set)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialize(
        texts.select(spelled(), "text").mapInPandas(tidied(_signed(width)), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"), "neardup-signed"
    )
    usable = signed.filter("digest is not null and doc_id is not null")
    # all texts with one set: the smallest id stands for them
    reps = usable.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")
    )
    reps = materialize(reps, "neardup-classes")
    links, found = _links(reps, texts, width, threshold)
    rows, classes = signed.select("doc_id", "n_shingles", "digest"), reps.select("digest", F.col("node").alias("class_id"), "n")
    repeated = usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    if repeated.limit(1).count():  # ids with several texts tie their classes together
        same = _classed(usable.select("doc_id", "digest"), classes.select("digest", "class_id", "n"))
        twice = same.filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
        whole = components(links.union(twice))
        named = rows.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class_id", F.col("doc_id"))
    else:
        named = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("digest", "class_id", "component", "n")
        named = _classed(rows, named)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "class_id", "doc_id"))
    named = named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with what ``classes`` (a row a digest, of n texts) has of their digest. Classes of more than HOT texts, of which there are
    at most rows / HOT, are broadcast, so that none is a task of its own."""
    classes = materialize(classes, "neardup-named")
    hot = materialize(classes.filter(F.col("n") > HOT).drop("n"), "neardup-hot")
    classes = classes.drop("n")
    if not hot.limit(1).count():
        return rows.join(classes, "digest", "left")
    big = rows.join(F.broadcast(hot), "digest")
    return big.unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(classes, "digest", "left"))


def _members(reps: DataFrame) -> DataFrame:
    """key, node, leader, for band buckets of two members or more; of buckets with the same members, one."""
    banded = reps.select("node", F.explode("bands").alias("key"))
    rank = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))
    described = banded.groupBy("key").agg(
        F.min(rank)["node"].alias("leader"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x2")
    )
    described = materialize(described.filter("n > 1"), "neardup-buckets")
    single = materialize(described.groupBy("n", "x1", "x2").agg(F.min(F.struct("key", "leader")).alias("m")).select("m.key", "m.leader"), "neardup-single")
    members = materialize(banded.join(small_or_plain(single), "key").select("key", "node", "leader"), "neardup-members")
    discard(described, single)
    return members


def _links(reps: DataFrame, docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links a, b between classes, enough of them for the components of all links of all buckets, and these components."""
    members = _members(reps)
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    one, two = (reps.select(F.col("node").alias(c), F.col("sketch").alias(s)) for c, s in (("a", "k1"), ("b", "k2")))
    differing = F.aggregate(F.zip_with("k1", "k2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = materialize(pairs.join(one, "a").join(two, "b").filter(differing <= most_differing(threshold)).select("a", "b"), "neardup-near")
    led = _confirm(near, docs, width, threshold)
    discard(near)
    first = components(led, "neardup-first")
    across = _across(members, reps, first, docs, width, threshold)
    links = led.union(across)
    return links, components(links) if across.limit(1).count() else first


def _across(members: DataFrame, reps: DataFrame, first: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links between different components of a bucket."""
    spark = members.sparkSession
    size = (F.col("n_shingles") + NODE_SIZE).alias("size")
    known = members.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    known = materialize(known, "neardup-known")
    mixed = materialize(known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "neardup-mixed")
    known = materialize(known.join(small_or_plain(mixed), "key").join(reps.select("node", size), "node"), "neardup-open")
    by_part = known.groupBy("key", "component").agg(F.sum("size").alias("size"))
    by_part = materialize(by_part.withColumn("large", F.col("size") > CHUNK), "neardup-parts")
    small = by_part.groupBy("key").agg(F.sum(F.when(~F.col("large"), F.col("size"))).alias("small_size"))
    parts = by_part.join(small, "key")
    label = F.when(F.col("large"), F.col("component"))
    count = F.ceil(F.when(F.col("large"), F.col("size")).otherwise(F.col("small_size")) / CHUNK)
    chunked = known.join(small_or_plain(materialize(parts.select("key", "component", label.alias("owner"), count.alias("n")), "neardup-owners")), ["key", "component"])
    salt = F.pmod(F.xxhash64(F.when(F.col("owner").isNull(), F.col("component")).otherwise(F.col("node"))), F.col("n"))
    chunked = chunked.select("key", "node", "component", "owner", salt.alias("salt"))
    chunked = materialize(chunked.withColumn("chunk", F.xxhash64("key", "owner", "salt")), "neardup-chunked")
    # pairs of chunks, as ids
    chunks = chunked.select("key", "owner", "salt", "chunk").distinct()
    one, two = chunks.alias("one"), chunks.alias("two")
    order = lambda side: F.struct(F.col(f"{side}.owner").isNotNull(), F.col(f"{side}.owner"), F.col(f"{side}.salt"))
    apart = (F.col("one.key") == F.col("two.key")) & (order("one") <= order("two")) & ~F.coalesce(F.col("one.owner") == F.col("two.owner"), F.lit(False))
    pairs = one.join(two, apart).select(F.col("one.chunk").alias("c1"), F.col("two.chunk").alias("c2")).distinct()
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("c1", "c2")), "neardup-pairs")
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
        sketches = chunked.join(reps.select("node", "sketch"), "node").groupBy("chunk").agg(F.collect_list(F.struct("node", "component", "sketch")).alias("held"))
        sketches = materialize(sketches, "neardup-sketches")
        first_, second = sketches.select(F.col("chunk").alias("c1"), F.col("held").alias("one")), sketches.select(F.col("chunk").alias("c2"), F.col("held").alias("two"))
        both = pairs.join(first_, "c1").join(second, "c2").select("pair", "one", "two").repartition(parallelism(spark), "pair")
        near = materialize(both.mapInPandas(tidied(_near_across(most_differing(threshold))), "pair long, side int, node long, component long"), "neardup-across-near")
        sets = _whole_sets(near, docs, width, "neardup-across")
        held = near.join(sets, "node").groupBy("pair").agg(F.collect_list(F.struct("side", "node", "component", "shingles")).alias("held"))
        links = held.select("held").mapInPandas(tidied(_linked_across(threshold)), "a long, b long")
        links = materialize(links.distinct(), "neardup-across")
    discard(known, mixed, by_part, chunked, pairs, sketches, near, sets)
    return links
