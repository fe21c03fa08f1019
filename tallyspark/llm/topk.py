"""Exact top-k inner-product search: columnar branch and bound over blocks of vectors.

Candidates are held in blocks of at most CANDIDATES vectors in vertical layout (a row of the block is a dimension),
queries in blocks of QUERIES; blocks of long vectors have fewer of them, BLOCK_BYTES at most. Queries are broadcast BROADCAST_BYTES at a time, counted with what is
held for them; for each such lot every candidate block is read once, where it lies, and a task keeps each query's running k best
over all its blocks and writes those alone. Every query block meets every candidate block once: that is the work an exact search
of a query set against all rows has. In a pair of blocks
the products are accumulated STEP dimensions at a time, the heaviest dimensions first. What the dimensions still to
come can add to a score is at most the product of the norms of the rest of both vectors, so a candidate whose bound is
below the query's k-th lower bound, in this block or in those before it, can't enter; the columns of the survivors are compacted before the next step.

Components are floor(256 * x) of x as double. Vectors that are null, or hold a null or non-finite component, take no
part. Vectors of other lengths than the query's aren't compared. A query's own row is the one with its vec_id: rows
that repeat its id are not candidates of it; each repeated row of a query id is answered. Scores beyond a long count as its limits. Ties go to the smaller
vec_id. A null vec_id can't be named in a result: such rows take no part. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, session_conf, tidied

CANDIDATES, QUERIES, STEP = 2048, 128, 16
BLOCK_BYTES, BROADCAST_BYTES, FILE_BYTES = 4 << 20, 32 << 20, 64 << 20
BLOCKS = "dim int, n int, ids binary, cells binary"


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the vector as doubles, of the rows that take part."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def _blocks(most: int):
    def run(batches):
        import numpy as np
        import pandas as pd

        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, rows = held.pop(dim)
            cells = np.array(rows, "<f8").reshape(len(ids), dim).T
            return (dim, len(ids), np.array(ids, "<i8").tobytes(), np.ascontiguousarray(cells).tobytes())

        for frame in batches:
            out = []
            for key, x in zip(frame["vec_id"], frame["x"], strict=True):
                dim = len(x)
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(key)
                rows.append(np.floor(256.0 * np.asarray(x, float)))
                if len(ids) >= max(1, min(most, BLOCK_BYTES // (8 * dim or 1))):
                    out.append(block(dim))
            yield pd.DataFrame(out, columns=["dim", "n", "ids", "cells"])
        yield pd.DataFrame([block(d) for d in list(held)], columns=["dim", "n", "ids", "cells"])

    return run


def best_of_block(qid, q, cid, c, k, floors=None):
    """(query's place, vec_id, score) of each query's k best in one block. q: queries x dim, c: dim x candidates.

    floors: scores below which a candidate of a query needn't be named.
    """
    import numpy as np

    out, dim = [], c.shape[0]
    floors = np.full(len(q), -np.inf) if floors is None else floors
    largest = float((np.abs(q).sum(axis=1).max() if q.size else 0) * (np.abs(c).max() if c.size else 0))
    if largest >= 2**53:  # beyond exact doubles: whole numbers of any size
        qi, ci = [[int(v) for v in row] for row in q], [[int(v) for v in col] for col in c.T]
        for i, row in enumerate(qi):
            cut = lambda s: max(-(2**63), min(2**63 - 1, s))
            scored = sorted((-cut(sum(a * b for a, b in zip(row, col, strict=True))), int(v)) for col, v in zip(ci, cid, strict=True) if v != qid[i])
            out += [(i, v, -s) for s, v in scored[:k]]
        return out
    order = np.argsort(-(c * c).sum(axis=1) * ((q * q).sum(axis=0) + 1), kind="stable")
    q, c = q[:, order], c[order]
    steps = list(range(0, dim, STEP)) or [0]
    tail_c = [np.sqrt((c[t:] ** 2).sum(axis=0)) for t in steps[1:]]
    tail_q = [np.sqrt((q[:, t:] ** 2).sum(axis=1)) for t in steps[1:]]
    first = q[:, :STEP] @ c[:STEP]
    for i in range(len(q)):
        alive = np.flatnonzero(cid != qid[i])
        score = first[i, alive]
        for s, t in enumerate(steps[1:]):
            if len(alive):
                slack = tail_q[s][i] * tail_c[s][alive] * (1 + 1e-9) + 1e-6
                least = np.partition(score - slack, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf
                least = max(least, floors[i])
                keep = score + slack >= least
                if not keep.all():
                    alive, score = alive[keep], score[keep]
            score = score + q[i, t : t + STEP] @ c[t : t + STEP, alive]
        best = np.lexsort((cid[alive], -score))[:k]
        out += [(i, int(cid[alive[b]]), int(score[b])) for b in best]
    return out


def _searched(k: int, lot):
    """query_id, query_row, vec_id, score of the k best of each of the lot's queries among a task's candidates."""

    def run(batches):
        import numpy as np
        import pandas as pd

        asked, best = [], []
        for block, dim, n, ids, cells in lot.value:
            q = np.frombuffer(cells, "<f8").reshape(dim, n).T
            asked.append((block, np.frombuffer(ids, "<i8"), q))
            best.append(([[] for _ in range(n)], np.full(n, -np.inf)))
        for frame in batches:
            for r in frame.itertuples(index=False):
                cid, c = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.cells, "<f8").reshape(r.dim, r.n)
                for (_, qid, q), (held, floors) in zip(asked, best, strict=True):
                    if q.shape[1] != r.dim:
                        continue
                    found = {}
                    for i, v, score in best_of_block(qid, q, cid, c, k, floors):
                        found.setdefault(i, []).append((-score, v))
                    for i, new in found.items():
                        held[i] = sorted(held[i] + new)[:k]
                        if len(held[i]) == k:
                            floors[i] = float(-held[i][-1][0])
        for (block, qid, _), (held, _) in zip(asked, best, strict=True):
            rows = [(int(qid[i]), block * QUERIES + i, v, -minus) for i, one in enumerate(held) for minus, v in one]
            yield pd.DataFrame(rows, columns=["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where ``is_query`` holds.

    is_query: a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    schema = "query_id long, query_row long, vec_id long, score long"
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="512"):
        clean = materialize(clean_vectors(vectors, id_col, vector_col), "topk-vectors")
        n, size = clean.agg(F.count("*"), F.sum(F.size("x") * 8)).first()
        files = max(min(parallelism(spark), math.ceil(n / 256)), math.ceil((size or 0) / FILE_BYTES), 1)
        candidates = materialize(clean.repartition(files).mapInPandas(tidied(_blocks(CANDIDATES)), BLOCKS), "topk-candidates")
        asked = clean.filter(is_query)
        asked = asked.repartition(max(1, math.ceil(asked.count() / (64 * QUERIES)))).mapInPandas(tidied(_blocks(QUERIES)), BLOCKS)
        queries = materialize(asked.withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    held = queries.agg(F.sum(F.octet_length("cells") + F.col("n") * (8 + 200 * k))).first()[0] or 0
    lots = max(1, math.ceil(2 * held / BROADCAST_BYTES)) if held > BROADCAST_BYTES else 1  # dealt by a hash: half full on average
    parts = []
    with session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="8"):
        for i in range(lots):
            rows = queries.filter(F.pmod(F.xxhash64("block"), F.lit(lots)) == i).select("block", "dim", "n", "ids", "cells").collect()
            lot = spark.sparkContext.broadcast([(r[0], r[1], r[2], bytes(r[3]), bytes(r[4])) for r in rows])
            parts.append(materialize(candidates.mapInPandas(tidied(_searched(k, lot)), schema), "topk-found"))
            lot.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
