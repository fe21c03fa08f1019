"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Every document becomes pieces of at most ``capacity`` tokens. A full piece is a sequence by itself. The others are
dealt at random to blocks of about BLOCK pieces. For each block, ISLANDS populations evolve apart in EPOCHS rounds:
a crossover injects whole well-filled bins of one parent into the other, removes the bins that hold a duplicate,
and best-fits the displaced pieces, longest first. After each round the islands of a block pass their elite to the
next one. Badly filled bins of a block are then dissolved, and MERGE blocks' worth of them make a new block, until one
block is left: so what is lost at the ends of blocks doesn't grow with the corpus. No task ever holds more than
about a block's pieces, and every random draw is seeded by block and island: a task that is run again gives the
same answer.

Nulls: a null text is an empty one (one piece, the end token alone); a null doc_id is carried as it is. Repeated rows
are packed as often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism, small_batches, spelled, tidied

CAPACITY, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, MERGE = 2048, 2048, 3, 2, 6, 4, 8
CACHED_WORDS = 400_000
#: a comma or a full stop at the end of a word, behind a letter of Latin-1
MARKS = re.compile(r"(?<=[A-Za-zªµºÀ-ÖØ-öø-ÿ])([,.])(?=[ \n]|\Z)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache:
    """ids of whole texts by the tokenizers library, put together from those of their blank-separated words, which this
    tokenizer's rules allow: its pattern never crosses white space, and its normaliser works on characters.

    Words are cut further where the rules cut them anyway: a comma or a full stop behind a letter is a piece by itself, and remembered once for all words. What
    is left is mostly one run of letters, that is one piece, which goes straight to the library's model (in lower case, its bytes
    spelled as the model spells them); every other word goes through the whole tokenizer. The cache is bounded; when
    full it keeps the words of the next texts alone.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {}, most
        self.model, spelled = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        #: how the model spells Latin letters, which need no other normalising than to lower case
        self.letters = {c: spelled.pre_tokenize_str(chr(c).lower())[0][0] for c in range(65, 256) if chr(c).isalpha()}

    def _learn(self, words) -> None:
        from array import array

        known, letters, spell, last = self.known, self.letters, self.model.tokenize, chr(255)
        others = []
        for word in words:
            if not word.isalpha():
                others.append(word)
            elif word.isascii():
                known[word] = array("I", [t.id for t in spell(word.lower())]).tobytes()
            elif max(word) <= last:
                known[word] = array("I", [t.id for t in spell(word.translate(letters))]).tobytes()
            else:
                others.append(word)
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, got, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [MARKS.sub(r" \1", t).replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        if len(self.known) > self.most:
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        known = self.known
        self._learn(words.difference(known))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _tokenised(path: str, capacity: int, with_ids: bool, cached_words: int):
    def run(batches):
        import gc
        import os

        import numpy as np
        import pandas as pd

        from .common import numbers, slices

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = WordCache(path, cached_words)
        gc.freeze()  # the cache holds strings and bytes only: nothing in it to look through again and again
        for frame in batches:
            ids, texts = numbers(frame["doc_id"]), [t or "" for t in frame["text"].tolist()]
            for a, b in slices(texts, 500_000):
                rows = []
                for doc, data in zip(ids[a:b], cache.encode(texts[a:b]), strict=True):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    for k in range(-(-n // capacity)):
                        part = data[4 * k * capacity : 4 * (k + 1) * capacity]
                        row = (doc, k, k * capacity, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").astype("i4")) if with_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
                out = pd.DataFrame(rows, columns=names)
                out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
                yield out

    return run


def tokenise(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of every document: ids by the tokenizer, then 0; cut after each ``capacity`` tokens."""
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(spelled(), "text").mapInPandas(
        tidied(_tokenised(tokenizer_path or default_tokenizer(), capacity, with_ids, cached_words)), schema
    )


# ---------------------------------------------------------------- the genetic algorithm, on one block


def best_fit(items, lengths, bins, room, capacity) -> None:
    """Put each item in turn where least room is left; open a bin where it fits nowhere. Changes bins and room."""
    mask, by_room = 0, defaultdict(list)
    for b, r in enumerate(room):
        if r:
            mask |= 1 << r
            by_room[r].append(b)
    for i in items:
        length = lengths[i]
        fits = mask >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            r -= length
            room[b] = r
        else:
            b, r = len(bins), capacity - length
            bins.append([i])
            room.append(r)
        if r:
            mask |= 1 << r
            by_room[r].append(b)


def lower_bound(lengths, capacity) -> int:
    return max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))


def cost(bins, lengths, capacity) -> tuple:
    """Fewer bins are better; among as many, those with fuller and emptier bins rather than even ones."""
    fill = [sum(lengths[i] for i in b) / capacity for b in bins]
    return len(bins), -sum(f * f for f in fill)


def _from_order(order, lengths, capacity):
    bins, room = [], []
    best_fit(order, lengths, bins, room, capacity)
    return bins


def crossover(receiver, giver, lengths, capacity, rng):
    """Inject well-filled bins of giver into receiver."""
    full = [b for b in giver if sum(lengths[i] for i in b) >= 0.98 * capacity] or giver
    injected = rng.sample(full, max(1, int(len(full) * rng.uniform(0.2, 0.6))))
    taken = {i for b in injected for i in b}
    kept, displaced = [list(b) for b in injected], []
    for b in receiver:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    return _refill(kept, displaced, lengths, capacity)


def mutate(bins, lengths, capacity, rng):
    """Dissolve the emptiest bins and some others."""
    order = sorted(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
    out = set(order[: max(1, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 20)))
    displaced = [i for b in out for i in bins[b]]
    return _refill([list(b) for k, b in enumerate(bins) if k not in out], displaced, lengths, capacity)


def _refill(kept, displaced, lengths, capacity):
    room = [capacity - sum(lengths[i] for i in b) for b in kept]
    displaced.sort(key=lambda i: (-lengths[i], i))
    best_fit(displaced, lengths, kept, room, capacity)
    return kept


def evolve(lengths, capacity, population, generations, seed, size=POPULATION):
    """Some generations on one island. population: lists of bins, empty at first. Best first in the result."""
    rng = random.Random(seed)
    longest = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    if not population:
        population = [_from_order(longest, lengths, capacity)]
    goal = lower_bound(lengths, capacity)
    rated = sorted(((cost(p, lengths, capacity), p) for p in population), key=lambda x: x[0])
    if rated[0][0][0] > goal:
        while len(rated) < size:
            order = sorted(longest, key=lambda i: -lengths[i] * rng.uniform(0.9, 1.1))
            p = _from_order(order, lengths, capacity)
            rated.append((cost(p, lengths, capacity), p))
        rated.sort(key=lambda x: x[0])
    for _ in range(generations):
        if rated[0][0][0] <= goal:
            break
        first, second = (min(rng.sample(range(len(rated)), 2)) for _ in range(2))
        child = crossover(rated[first][1], rated[second][1] if second != first else rated[-1 - first][1], lengths, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        rated.append((cost(child, lengths, capacity), child))
        rated.sort(key=lambda x: x[0])
        rated.pop()
    return [p for _, p in rated]


# ---------------------------------------------------------------- islands


def _to_bins(assigned):
    bins = defaultdict(list)
    for i, b in enumerate(assigned):
        bins[b].append(i)
    return list(bins.values())


def _to_array(bins, n):
    out = [0] * n
    for b, members in enumerate(bins):
        for i in members:
            out[i] = b
    return out


def _island(capacity: int, epoch: int):
    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                n = len(lengths)
                population = [_to_bins(p) for p in (r.population if r.population is not None else ())]
                if r.immigrant is not None:
                    population.append(_to_bins(r.immigrant))
                out = evolve(lengths, capacity, population, GENERATIONS, f"{r.block}/{r.island}/{epoch}")
                best = cost(out[0], lengths, capacity)
                rows.append((r.block, r.island, best[0], best[1], [_to_array(p, n) for p in out]))
            yield pd.DataFrame(rows, columns=["block", "island", "n_bins", "rating", "population"])

    return run


def _placed(capacity: int, share: float):
    """Sequence, offset and whether the bin is to be dissolved, for each piece of a block."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                bins = _to_bins(r.assigned)
                bins.sort(key=lambda b: sum(lengths[i] for i in b))
                left, seq, off, over = int(share * len(lengths)), [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
                for k, members in enumerate(bins):
                    at, left = 0, left - len(members)
                    loose = left >= 0 and sum(lengths[i] for i in members) < capacity
                    for i in members:
                        seq[i], off[i], over[i] = k, at, loose
                        at += lengths[i]
                rows.append((r.block, seq, off, over))
            yield pd.DataFrame(rows, columns=["block", "seq", "off", "over"])

    return run


def _round(pieces: DataFrame, n_blocks: int, level: int, capacity: int) -> DataFrame:
    """Evolve all blocks of one level; its pieces with level, block, seq, off and over."""
    spark = pieces.sparkSession
    n = parallelism(spark)
    fields = [c for c in pieces.columns if c not in ("level", "block", "seq", "off", "over")]
    dealt = pieces.select(*fields, F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_blocks)).alias("block"))
    blocks = materialize(
        dealt.repartition(n, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", *[f for f in fields if f != "uid"]))).alias("items")),
        f"pack-blocks-{level}",
    )
    lengths = blocks.select("block", F.col("items.length").alias("lengths"))
    islands = lengths.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state, evolved = None, "block long, island int, n_bins int, rating double, population array<array<int>>"
    for epoch in range(EPOCHS):
        if state is None:
            given = islands.select("*", F.lit(None).cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("immigrant"))
        else:
            elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("population", 1).alias("immigrant"))
            given = islands.join(state.select("block", "island", "population"), ["block", "island"]).join(elite, ["block", "island"])
        given = given.select("block", "island", "lengths", "population", "immigrant").repartition(n, "block", "island")
        state = materialize(given.mapInPandas(tidied(_island(capacity, epoch)), evolved), f"pack-islands-{level}-{epoch}")
    best = state.groupBy("block").agg(F.min_by(F.element_at("population", 1), F.struct("n_bins", "rating", "island")).alias("assigned"))
    share = 0.0 if n_blocks == 1 else 1 / MERGE
    places = lengths.join(best, "block").repartition(n, "block").mapInPandas(tidied(_placed(capacity, share)), "block long, seq array<int>, off array<int>, over array<boolean>")
    zipped = blocks.join(places, "block").select("block", F.explode(F.arrays_zip("items", "seq", "off", "over")).alias("z"))
    return materialize(zipped.select(F.lit(level).alias("level"), "block", "z.items.*", "z.seq", "z.off", "z.over"), f"pack-placed-{level}")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Each piece with its sequence and offset there: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    with_ids adds the piece's token ids, so that the sequences themselves can be written out. cached_words: how many words' ids
    a worker remembers; more take memory (some 300 bytes each), fewer take time.
    """
    cut = tokenise(docs, capacity, tokenizer_path, with_ids, cached_words)
    pieces = materialize(cut.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    columns = [*cut.columns]
    full = pieces.filter(F.col("length") == capacity)
    out = full.select(*columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity).select("uid", "doc_id", "piece", "start", "length", "ids_crc32")
    n, level = rest.count(), 0
    placed = []
    while n:
        n_blocks = math.ceil(n / BLOCK)
        done = _round(rest, n_blocks, level, capacity)
        placed.append(done.filter(~F.col("over")))
        rest = done.filter("over")
        n, level = (rest.count() if n_blocks > 1 else 0), level + 1
    for part in placed:
        sequence = (F.col("level").cast("long") * F.lit(1 << 56)) + F.col("block") * F.lit(1 << 16) + F.col("seq")
        part = part.withColumn("sequence_id", sequence).withColumn("offset", F.col("off").cast("long"))
        if with_ids:
            part = part.join(pieces.select("uid", "ids"), "uid")
        out = out.unionByName(part.select(*columns, "sequence_id", "offset"))
    return out
