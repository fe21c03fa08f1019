"""Language identification by words first, with backoff to ever shorter character n-grams.

Learned on a bounded sample: SAMPLE rows of each language, the first in the order of a hash of doc_id, of the rows
with a language and a text that aren't held out. Known words are all that occur twice or more in it, known n-grams (of 1 to
LONGEST characters, a word's borders being characters) all that occur: what is learned has no other bound than the sample's. A text's
score for a language adds, for each word, its log frequency in the language; for a word that isn't known, the mean log
frequency of its known n-grams of the longest length of which it has any; a word without any adds nothing. The
highest sum is the prediction, ties going to the language first by name; the score is its share of a softmax over the mean of a word, sharpened
by the number of words up to SHARP.

Nulls: a text that is null or has no letter is ``und`` with score 0, as is everything if nothing could be learned; rows with a null
language are predicted but not learned from. Repeated rows give a row each. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, held_out, small_batches, spelled, tidied

SAMPLE, LONGEST, SHARP, SMOOTH = 1500, 5, 30, 0.1


def has_letter(text) -> bool:
    return isinstance(text, str) and any(c.isalpha() for c in text)


class _Counts:
    """Occurrences of hashes in each language, gathered part by part."""

    def __init__(self, n_langs: int):
        import numpy as np

        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros((0, n_langs), np.int64)

    def add(self, hashes, labels) -> None:
        import numpy as np

        n = self.counts.shape[1]
        keys, place = np.unique(hashes, return_inverse=True)
        counts = np.bincount(place * n + labels, minlength=len(keys) * n).reshape(len(keys), n)
        union = np.union1d(self.keys, keys)
        total = np.zeros((len(union), n), np.int64)
        total[np.searchsorted(union, self.keys)] += self.counts
        total[np.searchsorted(union, keys)] += counts
        self.keys, self.counts = union, total

    def table(self, least: int):
        """Sorted keys and their log frequencies in each language, of those that occur ``least`` times or more."""
        import numpy as np

        chosen = np.flatnonzero(self.counts.sum(axis=1) >= least)
        logs = np.log((self.counts[chosen] + SMOOTH) / (self.counts.sum(axis=0) + SMOOTH * (len(self.keys) + 1)))
        return self.keys[chosen], logs.astype(np.float32)


def learn(texts: list[str], langs: list[str]):
    """(languages, word table, n-gram tables from the longest to single characters)."""
    import numpy as np

    from .common import slices
    from .hashing import Characters, Words

    names = sorted(set(langs))
    if not names:
        return None
    number = np.array([names.index(x) for x in langs])
    parts = list(slices(texts, 500_000))
    counts = _Counts(len(names))
    for a, b in parts:
        w = Words([t.lower() for t in texts[a:b]])
        counts.add(w.hashes(41), number[a:b][w.doc])
    word_table, grams = counts.table(2), []
    for n in range(LONGEST, 0, -1):
        counts = _Counts(len(names))
        for a, b in parts:
            c = Characters([t.lower() for t in texts[a:b]])
            h, at = c.grams(n, 7)
            counts.add(h, number[a:b][c.doc[at]])
        grams.append(counts.table(1))
    return names, word_table, grams


def _look_up(keys, hashes):
    import numpy as np

    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.searchsorted(keys, hashes).clip(max=len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def unseen_scores(words: list[str], model):
    """What each word adds for each language if it isn't a known one."""
    import numpy as np

    from .hashing import Characters

    names, _, grams = model
    out, todo = np.zeros((len(words), len(names))), np.arange(len(words))
    for n, (keys, logs) in zip(range(LONGEST, 0, -1), grams, strict=True):
        if not len(todo):
            break
        c = Characters([words[i] for i in todo])
        h, at = c.grams(n, 7)
        place = _look_up(keys, h)
        known = np.flatnonzero(place >= 0)
        doc = c.doc[at[known]]
        count = np.bincount(doc, minlength=len(todo))
        for j in range(len(names)):
            total = np.bincount(doc, weights=logs[place[known], j], minlength=len(todo))
            out[todo, j] = np.where(count > 0, total / np.maximum(count, 1), 0)
        todo = todo[count == 0]
    return out


def predict(texts, model):
    """(language, score) of each text."""
    import numpy as np

    from .hashing import Words

    if model is None:
        return [("und", 0.0)] * len(texts)
    names, (keys, logs), _ = model
    lowered = [t.lower() if isinstance(t, str) else "" for t in texts]
    w = Words(lowered)
    distinct, first, place = np.unique(w.hashes(41), return_index=True, return_inverse=True)
    known = _look_up(keys, distinct)
    added = np.zeros((len(distinct), len(names)))
    added[known >= 0] = logs[known[known >= 0]]
    new = np.flatnonzero(known < 0)
    if len(new):
        spelled = [w.buf[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace") for i in first[new]]
        added[new] = unseen_scores(spelled, model)
    sums = np.stack([np.bincount(w.doc, weights=added[place, j], minlength=len(texts)) for j in range(len(names))], axis=1)
    n = np.maximum(np.bincount(w.doc, minlength=len(texts)), 1)
    best = sums.argmax(axis=1)
    sharp = (sums - sums.max(axis=1, keepdims=True)) / n[:, None] * np.minimum(n, SHARP)[:, None]
    share = 1 / np.exp(sharp).sum(axis=1)
    return [(names[b], float(s)) if has_letter(t) else ("und", 0.0) for t, b, s in zip(texts, best, share, strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE):
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    first = first_by_hash(usable, "lang", "doc_id", sample)
    rows = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull()).join(F.broadcast(first), ["doc_id", "lang"])
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()
    return learn([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        import pandas as pd

        from .common import numbers, slices

        for frame in batches:
            texts = frame["text"].tolist()
            got = [x for a, b in slices([t if isinstance(t, str) else "" for t in texts], 500_000) for x in predict(texts[a:b], model.value)]
            columns = {"doc_id": pd.array(numbers(frame["doc_id"]), "Int64"), "held_out": frame["held_out"].tolist()}
            yield pd.DataFrame(columns | {"lang_pred": pd.array([g[0] for g in got], object), "score": pd.array([g[1] for g in got], float)})

    given = docs.select(spelled(), held_out().alias("held_out"), "text")
    return given.mapInPandas(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")
