"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words, the pairs of words that follow each other and the n-grams of its words' characters, each hashed to a row of an embedding table, and
an end mark in both groups. The rows of words, pairs and end
are averaged, those of n-grams and end are averaged, the sum goes through a linear layer to a softmax over the two labels.
All of it is trained together by stochastic gradient descent on the driver (the table BOOST times as fast as the layer), on a bounded sample: TRAIN rows of each
label, the first in the order of a hash of doc_id, from rows that aren't held out. As the output layer is linear, the table is
then folded to one number for each row, and scoring whole texts adds those up; the model that is sent out has
2 * BUCKETS float32 numbers whatever the corpus.

Nulls: a null text is an empty one, whose score is what the end marks and the layer's bias give; labels that are null are no labels; a
doc_id with several labels counts as bad if one is 0. Without both labels the score is the share of label 1 (0.5 without any).
Repeated rows give a row each. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, held_out, small_batches, spelled, tidied

BUCKETS, DIM, GRAMS, TRAIN, EPOCHS, RATE, BOOST, CUTOFF, SURE, SEED = 1 << 17, 8, (3, 4), 1200, 40, 0.5, 32, 0.7, 0.02, 17
END = 0  # the end mark's row in its group


def features(texts):
    """(row, text) pairs of all words, pairs and ends, and of all n-grams and ends. n-grams have rows of BUCKETS and above."""
    import numpy as np

    from .hashing import Characters, U, Words, mix

    place = lambda h: (h % U(BUCKETS - 1)).astype(np.int64) + 1
    every, end = np.arange(len(texts)), np.full(len(texts), END)
    words = Words(texts, lower=False)
    hashes = words.hashes(31)
    together = words.doc[1:] == words.doc[:-1]
    pairs = mix(hashes[:-1] * U(3) + hashes[1:])[together]
    letters = Characters(texts)
    rows, docs = [end + BUCKETS], [every]
    for n in GRAMS:
        h, at = letters.grams(n)
        rows.append(place(h) + BUCKETS)
        docs.append(letters.doc[at])
    return np.concatenate([end, place(hashes), place(pairs)]), np.concatenate([every, words.doc, words.doc[1:][together]]), np.concatenate(rows), np.concatenate(docs)


def _bags(texts):
    """For each text its distinct rows and their weights: each of both groups weighs 1 in all."""
    import numpy as np

    bags = []
    for text in texts:
        words, _, grams, _ = features([text])
        rows, weights = [], []
        for part in (words, grams):
            if len(part):
                r, n = np.unique(part, return_counts=True)
                rows.append(r)
                weights.append(n / len(part))
        bags.append((np.concatenate(rows).astype(np.int32), np.concatenate(weights).astype(np.float32)) if rows else (np.zeros(0, np.int32), np.zeros(0, np.float32)))
    return bags


def step(table, layer, bias, rows, w, label: int, rate: float, weight: float) -> None:
    """One step down the gradient of a text's loss, in place: rows of the table BOOST times as far as the layer and the bias."""
    import numpy as np

    mean = w @ table[rows]
    logits = mean @ layer + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    if -p[label] < SURE:  # far on the right side: nothing to learn, and the logits stay small
        return
    p *= weight * rate
    back = layer @ p
    layer -= np.outer(mean, p).astype(layer.dtype)
    bias -= p.astype(bias.dtype)
    table[rows] -= (w[:, None] * back[None, :] * BOOST).astype(table.dtype)


def train(texts: list[str], labels: list[int]):
    """(one number for each row, bias): the difference of the two labels' logits is their weighted sum plus the bias."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return np.zeros(2 * BUCKETS, np.float32), float(np.log(share / (1 - share)))
    bags = _bags(texts)
    table = rng.uniform(-1 / DIM, 1 / DIM, (2 * BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = np.array([0.5 / (1 - y.mean()), 0.5 / y.mean()])  # both labels count alike
    of, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / of)
            done += 1
            step(table, layer, bias, *bags[i], y[i], rate, weight[y[i]])
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts, folded, bias):
    import numpy as np

    words, word_doc, grams, gram_doc = features(texts)
    total = np.full(len(texts), bias)
    for row, doc in ((words, word_doc), (grams, gram_doc)):
        n = np.bincount(doc, minlength=len(texts))
        total += np.bincount(doc, weights=folded[row], minlength=len(texts)) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN):
    """``train`` on the bounded sample."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("label"))
    known = known.filter(~held_out())
    first = first_by_hash(known, "label", "doc_id", per_label)
    sample = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")
    # a doc_id with several texts stands in the sample once
    rows = sample.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return train([r["text"] or "" for r in rows], [r["label"] for r in rows])


def _scored(model):
    def run(batches):
        import numpy as np
        import pandas as pd

        from .common import numbers, slices

        folded, bias = model.value
        for frame in batches:
            texts = [t if isinstance(t, str) else "" for t in frame["text"].tolist()]
            parts = [score_texts(texts[a:b], folded, bias) for a, b in slices(texts, 250_000)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pd.DataFrame({"doc_id": pd.array(numbers(frame["doc_id"]), "Int64"), "held_out": frame["held_out"].tolist(), "score": score})

    return run


def classify(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, per_label))
    given = docs.select(spelled(), held_out().alias("held_out"), "text")
    out = given.mapInPandas(tidied(_scored(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN) -> DataFrame:
    """The rows that the classifier predicts to be good, with all their columns."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_label))

    def kept(batches):
        import numpy as np
        import pyarrow as pa

        from .common import slices

        folded, bias = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [score_texts(texts[a:b], folded, bias) for a, b in slices(texts, 250_000)]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) >= CUTOFF))

    return docs.mapInArrow(tidied(kept), docs.schema)
