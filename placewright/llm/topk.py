"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, floor(1024 * x). Rows are cut into blocks, ranges of a task's rows in the
order of a coarse signature, so that a block's vectors resemble each other. Per block there is a
forward index (its matrix) and per dimension its maximum and minimum. A query's bound for a block
is the sum over dimensions of the larger of q * max and q * min. Each query visits blocks in
order of falling bound until a bound is below its k-th score: those blocks can't hold a better
row (an equal bound is still visited, since ties go to the smaller id).

Queries are held in chunks of at most ``CHUNK`` vectors, broadcast one chunk at a time, and each
chunk meets all blocks in one pass; what a task returns is k rows per query, whatever the table's
size, and a window takes the best of these.

Defined cases: vectors that are null, or hold a null, NaN or infinity, take no part; a shorter
vector counts as padded with zeros; an empty vector scores 0 with all; repeated rows are candidates each, and a
repeated query id is answered once (with its smallest vector), without rows of its own id; a null id takes no part. Scores
beyond 64 bits are cut to that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

SCALE, K, BLOCK, CHUNK = 1024, 10, 256, 16_384
#: The score and the id of an empty place.
EMPTY = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _matrix(vectors: list, dims: int | None = None) -> np.ndarray:
    """Rows of integers; 64-bit where inner products surely fit, else of any size."""
    dims = max(map(len, vectors), default=0) if dims is None else dims
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * out), -1e300, 1e300)


def _top(a: np.ndarray, b: np.ndarray) -> float:
    return float(a.max(initial=0.0)) * float(b.max(initial=0.0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly. Floats hold it while sums stay below 2**53; rows with larger numbers are
    multiplied apart, as 64-bit integers or as integers of any size, so an outlier slows itself alone."""
    dims = float(max(a.shape[1], 1))
    ta, tb = (np.abs(x).max(1, initial=0.0) for x in (a, b))
    if _top(ta, tb) * dims < 2**53:
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    tame = [t <= (2**53 / dims) ** 0.5 / 2 for t in (ta, tb)]
    for i, j in ((x, y) for x in (True, False) for y in (True, False)):
        p, q = np.flatnonzero(tame[0] == i), np.flatnonzero(tame[1] == j)
        if not len(p) or not len(q):
            continue
        top = _top(ta[p], tb[q]) * dims
        if top < 2**53:
            part = a[p] @ b[q].T
        elif top < 2**62:
            part = a[p].astype(np.int64) @ b[q].T.astype(np.int64)
        else:
            exact = np.array([[int(v) for v in row] for row in a[p]], object) @ np.array([[int(v) for v in row] for row in b[q]], object).T
            part = np.clip(exact, -(2**63), 2**63 - 1)
        out[np.ix_(p, q)] = part.astype(np.int64)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best by falling score, then rising id."""
    if scores.shape[1] > 4 * k:  # all that can matter: scores not below the k-th
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        wide = int((scores >= kth[:, None]).sum(1).max())
        if wide < scores.shape[1]:
            at = np.argpartition(~scores, wide - 1, axis=1)[:, :wide]
            scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Blocks:
    """One range of rows, cut into blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int):
        if rows.shape[1]:  # by signs of the leading dimensions and the strongest dimension
            lead = (rows[:, : min(6, rows.shape[1])] > 0) @ (1 << np.arange(min(6, rows.shape[1])))
            order = np.lexsort((np.abs(rows).argmax(1), lead))
            ids, rows = ids[order], rows[order]
        self.ids = [ids[i : i + size] for i in range(0, len(ids), size)]
        self.rows = [rows[i : i + size] for i in range(0, len(ids), size)]
        self.high = np.array([r.max(0) for r in self.rows])
        self.low = np.array([r.min(0) for r in self.rows])

    def search(self, qids: np.ndarray, queries: np.ndarray, scores: np.ndarray, found: np.ndarray, k: int) -> int:
        """Improve each query's best (scores, found); returns how many pairs of query and block were scored."""
        dims = self.high.shape[1]
        q = queries[:, :dims]
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        bound = bound * (1 + 1e-12 * np.sign(bound)) + 1  # rounding can only widen a bound
        order = np.argsort(-bound, axis=1, kind="stable")
        active, visited = np.arange(len(q)), 0
        for r in range(len(self.ids)):
            block = order[active, r]
            go = (bound[active, block] >= scores[active, k - 1]) | (found[active, k - 1] == EMPTY)
            active, block = active[go], block[go]  # later bounds are lower still
            if not len(active):
                break
            visited += len(active)
            by = np.argsort(block, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                b, who = block[part[0]], active[part]
                new = _product(q[who], self.rows[b])
                ids = np.broadcast_to(self.ids[b], new.shape)
                own = ids == qids[who, None]
                new, ids = np.where(own, EMPTY, new), np.where(own, EMPTY, ids)
                s, i = np.concatenate((scores[who], new), 1), np.concatenate((found[who], ids), 1)
                scores[who], found[who] = _ranked(s, i, k)
        return visited


def _ranked(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _best(s, np.where(i == EMPTY, _LAST, i), k)  # an empty place loses against any row
    return a, np.where(b == _LAST, EMPTY, b)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    asked = scratch.write(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-asked.count() // max(1, chunk // 2)))  # hashed chunks stay below twice their mean
    results = None
    for c in range(chunks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), [r.v for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qids, vectors_ = held.value
            queries_ = _matrix(vectors_)
            scores = np.full((len(qids), k), EMPTY)
            found = np.full((len(qids), k), EMPTY)
            ids, data, n = [], [], 0

            def use():
                nonlocal ids, data, n, queries_
                rows = _matrix([v for part in data for v in part])
                dims = max(rows.shape[1], queries_.shape[1])
                if queries_.shape[1] < dims:
                    queries_ = np.pad(queries_, ((0, 0), (0, dims - queries_.shape[1])))
                rows = np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))
                Blocks(np.concatenate(ids), rows, block).search(qids, queries_, scores, found, k)
                ids, data, n = [], [], 0

            for batch in batches:
                ids.append(batch.column("vec_id").to_numpy())
                data.append(_rows(batch.column("v")))
                n += batch.num_rows
                if n >= 64 * block:
                    use()
            if n:
                use()
            q, r = np.nonzero(found != EMPTY)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(found[q, r]), pa.array(scores[q, r])], names=["query_id", "vec_id", "score"])

        part = usable(vectors).mapInArrow(run, "query_id long, vec_id long, score long")
        best = part.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        results = best if results is None else results.unionByName(scratch.write(best, f"chunk{c}"))
    return results if results is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
