"""Periodic runs of words: Kolpakov and Kucherov's algorithm, a whole text at a time.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q, of max(LEAST, 2 * q) words or more. Word for word:

1. LZ factorisation from a suffix automaton: a factor is the longest stretch that also begins earlier (the two may overlap), or one new word. The
   automaton's states know where their strings end first, so a walk down from the root finds a factor and its earlier place.
2. Main's algorithm at each border b between factors u and v: a run that is the leftmost of its kind and ends in v, or just at b, has fewer than
   2|u| + |v| words before b and a period below |u| + |v|. Two Z-arrays of that stretch give for each period how far both neighbours of b agree with
   their partners; what agrees for a period or more in all is a run.
3. Runs that lie inside a factor are copies of runs inside its earlier occurrence, and are copied from there, from left to right.

Step 2 finds for each stretch its smallest period too, as all its periods are seen at the same border.

Before that, words that can't lie in a run are set apart: each word of a run lies in a stretch of GRAM words that occurs twice or more in its text (a
run has 12 words or more and two periods, so every word has such a stretch on one of its sides). Hashes of those stretches are compared in whole batches; the algorithm
works on what lies together between the words left out, where runs are the same as in the whole text. Equal words have equal hashes, so nothing is lost.

A text's work is linear in its words (but for the order of its runs) and done in one task; memory is about 1 KB a word of its longest such stretch.

A null text has no words. A null doc_id is carried; rows that repeat an id are texts of their own. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, spelled, tidied

LEAST, GRAM = 12, 6


# ---------------------------------------------------------------- the algorithm


def factors(word: list[int]):
    """(start, length, earlier start or None) of the LZ factors of ``word``, from its suffix automaton."""
    size, link, first, follow = [0], [-1], [0], [{}]
    last = 0
    for i, c in enumerate(word):
        new = len(size)
        size.append(size[last] + 1)
        first.append(i + 1)
        follow.append({})
        link.append(0)
        at, last = last, new
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at < 0:
            continue
        other = follow[at][c]
        if size[other] == size[at] + 1:
            link[new] = other
            continue
        twin = len(size)
        size.append(size[at] + 1)
        first.append(first[other])
        follow.append(dict(follow[other]))
        link.append(link[other])
        while at >= 0 and follow[at].get(c) == other:
            follow[at][c] = twin
            at = link[at]
        link[other] = link[new] = twin
    start, n = 0, len(word)
    while start < n:
        at, end, place = 0, start, None
        while end < n:
            at = follow[at][word[end]]
            if first[at] > end:  # it ends here for the first time
                break
            end += 1
            place = first[at] - (end - start)
        yield start, max(1, end - start), place
        start = max(end, start + 1)


def z_array(s: list[int]) -> list[int]:
    """For each place the length of the longest prefix of ``s`` that begins there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    z[0] = n
    return z


def crossing(word: list[int], border: int, before: int, after: int, least: int):
    """(start, end, period) of runs that touch ``border``, reach no further than ``before`` words back and ``after`` on, for every period."""
    left, right = word[border - before : border], word[border : border + after]
    back = left[::-1]
    a, b = z_array([*right, -1, *left, *right]), z_array([*back, -1, *right[::-1], *back])
    n = len(word)
    for period in range(1, max(before, after) + 1):
        for backwards in (False, True):
            if backwards:  # border - period against border
                if period > before:
                    continue
                on, off, at = a[after + 1 + before - period], b[period] if period < before else 0, border - period
            else:  # border against border + period
                if period > after:
                    continue
                on, off, at = a[period] if period < after else 0, b[before + 1 + after - period], border
            on, off = min(on, after), min(off, before)
            if on + off < period or on + off + period < least:
                continue
            start, end = at - off, at + period + on
            if (start == 0 or word[start - 1] != word[start - 1 + period]) and (end == n or word[end] != word[end - period]):
                yield start, end, period


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least max(least, 2 * period) letters (whole numbers from 0), by start and period."""
    known: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []  # (start, end), sorted

    def add(start, end, period):
        if (start, end) not in known:
            insort(order, (start, end))
        known[start, end] = min(period, known.get((start, end), period))

    n, last = len(word), 0
    for start, size, place in [*factors(word), (len(word), 0, None)]:
        if start and 2 * last + 2 * size >= least:
            for run in crossing(word, start, min(start, 2 * last + size), min(size, n - start), least):
                add(*run)
        if place is not None:
            shift, k = start - place, bisect_right(order, (place, n + 1))
            while k < len(order) and order[k][0] < place + size:
                s, e = order[k]
                if e < place + size:
                    add(s + shift, e + shift, known[s, e])
                k += 1
        last = size
    return sorted((s, e - s, p) for (s, e), p in known.items())


# ---------------------------------------------------------------- texts


def planted(h: int, n: int) -> tuple[int, int] | None:
    """The contract's change of a text of n words whose id has the checksum h: word i >= a becomes word a + (i - a) % p."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def suspects(hashes, doc, gram: int = GRAM):
    """Which words lie in a stretch of ``gram`` words that occurs twice or more in their text (numpy)."""
    import numpy as np

    from .hashing import U, mix, randoms

    n = len(hashes) - gram + 1
    mark = np.zeros(len(hashes), bool)
    if n <= 1:
        return mark
    rolled = doc[:n].astype(np.uint64) * U(0x9E3779B97F4A7C15)
    for k, m in enumerate(randoms(gram, 31)):
        rolled += hashes[k : k + n] * m
    rolled = mix(rolled)
    order = np.argsort(rolled, kind="stable")
    twin = rolled[order[1:]] == rolled[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    again &= doc[:n] == doc[gram - 1 :]
    for k in range(gram):
        mark[k : k + n] |= again
    return mark


def _found(least: int, change: bool):
    def run(batches):
        import numpy as np
        import pandas as pd

        from .hashing import Words, doc_bounds

        for frame in batches:
            ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            for a, b in slices(texts):
                words = Words(texts[a:b], lower=False)
                hashes, bounds = words.hashes(), doc_bounds(words.doc, words.n_docs)
                source = np.arange(len(hashes))
                for k in range(b - a):
                    own = planted(crc32(ids[a + k].encode()), int(bounds[k + 1] - bounds[k])) if change and isinstance(ids[a + k], str) else None
                    if own:
                        tail = np.arange(bounds[k + 1] - bounds[k] - own[0])
                        source[bounds[k] + own[0] : bounds[k + 1]] = bounds[k] + own[0] + tail % own[1]
                mark = suspects(hashes[source], words.doc)
                raw = words.buf.tobytes()
                rows = []
                for k in range(b - a):
                    low, high = int(bounds[k]), int(bounds[k + 1])
                    own = source[low:high]
                    edge = np.flatnonzero(np.diff(mark[low:high].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    runs, gone = [], np.zeros(high - low, bool)
                    text = lambda at: raw[words.start[at] : words.end[at]]
                    for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                        if e - s >= least:
                            names: dict[bytes, int] = {}
                            letters = [names.setdefault(text(at), len(names)) for at in own[s:e].tolist()]
                            runs += [(s + x, size, p) for x, size, p in runs_of(letters, least)]
                    for s, size, p in runs:
                        gone[s + p : s + size] = True
                    kept = b" ".join(text(at) for at in own[~gone].tolist())
                    flat = [x for r in runs for x in r]
                    rows.append((ids[a + k] if isinstance(ids[a + k], str) else None, high - low, flat, kept.decode("utf-8", "surrogatepass")))
                yield pd.DataFrame(rows, columns=["doc_id", "n_words", "flat", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, change: bool = False) -> DataFrame:
    """doc_id, n_words, runs: array of (start, length, period) by start and period, collapsed: the text without the words after a run's first period.

    least: the fewest words of a run, at least 2 * GRAM. change: whether texts are changed first as ``planted`` says.
    """
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    small_batches(docs.sparkSession)
    found = docs.select(spelled(), "text").mapInPandas(tidied(_found(least, change)), "doc_id string, n_words long, flat array<long>, collapsed string")
    at = lambda k, j: F.get("flat", 3 * k + j)
    triple = lambda k: F.struct(at(k, 0).alias("start"), at(k, 1).alias("length"), at(k, 2).alias("period"))
    places = F.when(F.size("flat") > 0, F.sequence(F.lit(0), (F.size("flat") / 3 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.transform(places, triple).alias("runs"), "collapsed")
