"""Exact top-k by inner product with a pivot table.

Distances of every vector to a few dozen pivots are computed once and written. For a query q and a candidate x the
triangle inequality gives |d(q, p) - d(x, p)| <= d(q, x) for every pivot p; the largest of these bounds the inner
product from above, since 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. Candidates are evaluated in the order of that
bound, until it falls below the k-th score that the query has already.

Queries and candidates are dealt to blocks of bounded size and every block of queries meets every block of
candidates, so a task holds one block of each, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

#: Pivots; rows, taken by the hash of their id, among which they are picked and which give each query a first k-th score.
PIVOTS, SAMPLE = 32, 1024
#: Most rows of a block of queries and of a block of candidates, and rows that a block of candidates has if there are
#: that many for each task.
QUERIES, CANDIDATES, LEAST = 16384, 65536, 1024
#: Candidates that a query evaluates first; each further step doubles.
STEP = 64

_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The first row, then time and again the row farthest from those picked; ties to the earlier."""
    if not len(sample):
        return sample
    picked, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def bounds(q: np.ndarray, dq: np.ndarray, nx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of one query with candidates of squared norms nx and distances dx to the
    pivots. Roots are rounded: a relative margin of 1e-9 covers that."""
    nq = q @ q
    gap = np.abs(dx - dq).max(1, initial=0.0)
    return (nq + nx - gap * gap) / 2 + 1e-9 * (nq + nx + 1)


def search(q: np.ndarray, ub: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best among candidates, of those that can reach ``floor``, and how many were
    evaluated. ub falls below every candidate that was passed over when the search stops, so none of them can win or tie."""
    live = np.flatnonzero(ub >= floor)
    order = live[np.argsort(-ub[live], kind="stable")]
    at, step = 0, STEP
    best, scores = np.empty(0, np.int64), np.empty(0)
    while at < len(order) and ub[order[at]] >= floor:
        take = order[at : at + step]
        best, scores = np.concatenate([best, take]), np.concatenate([scores, x[take] @ q])
        keep = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[keep], scores[keep]
        if len(scores) == k:
            floor = max(floor, scores[-1])
        at, step = at + step, step * 2
    return best, scores, min(at, len(order))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def searcher(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def block(asked: pa.Table, table: pa.Table) -> pa.Table:
        ids, x, dx, nx = table["vec_id"].to_numpy(), _matrix(table["v"]), _matrix(table["d"]), table["norm"].to_numpy()
        out = []
        if len(ids) and len(asked):
            for query, q, dq, floor in zip(asked["vec_id"].to_numpy(), _matrix(asked["v"]), _matrix(asked["d"]), asked["floor"].to_numpy(), strict=True):
                ub = bounds(q, dq, nx, dx)
                ub[ids == query] = -np.inf
                best, scores, _ = search(q, ub, ids, x, k, max(floor, -1e300))
                out.append((np.full(len(best), query), ids[best], scores))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_HITS, parts, strict=True)}, schema=_HITS)

    return block


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every`` the k highest inner products with
    the rows of other keys, ties to the smaller key.

    Components count as floor(scale * x); scores are exact while their sums stay under 2^53, and null beyond 64 bits. Rows with a null
    key, a null vector, or a null or non-finite component take no part; a shorter vector counts as if filled up with
    zeros. Rows of one key are candidates each; as a query the key is asked once, with the greatest of its vectors. A query
    without other rows has no result, one with fewer than k has them all. Other columns are ignored; an empty table
    gives no rows."""
    spark = vectors.sparkSession
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & whole)
    stats = rows.agg(F.max(F.size("v")).alias("wide"), F.count("*").alias("n"), F.sum(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")).first()
    wide = stats["wide"] or 0
    whole_part = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    filled = F.concat(F.transform("v", lambda x: whole_part(x * scale)), F.array_repeat(F.lit(0.0), F.lit(wide) - F.size("v")))
    rows = rows.select("vec_id", filled.alias("v"))
    # a bounded sample by hash, so the same rows in every run
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    ids, known = np.array([r.vec_id for r in sample], np.int64), np.array([r.v for r in sample], float).reshape(len(sample), wide)
    pivots = pick_pivots(known, PIVOTS)

    def measure(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(1)]))
            norm = (x * x).sum(1)
            d = np.sqrt(np.maximum(0.0, norm[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))
            score = np.where(b.column(0).to_numpy()[:, None] == ids, -np.inf, x @ known.T)
            # a lower bound of the k-th score, by rows that are candidates themselves
            floor = np.partition(score, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(x), -np.inf)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(norm), pa.array(floor)], ["vec_id", "v", "d", "norm", "floor"])

    table = cut(rows.mapInArrow(measure, "vec_id long, v array<double>, d array<double>, norm double, floor double").withColumn("uid", F.monotonically_increasing_id()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, c_blocks = -(-(stats["asked"] or 0) // QUERIES), -(-stats["n"] // max(LEAST, min(CANDIDATES, stats["n"] // tasks)))
    asked = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "d", "floor")).alias("r")).select("vec_id", "r.*")
    block = lambda by, blocks: F.pmod(F.xxhash64(by), F.lit(max(blocks, 1))).cast("int")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))
    left = asked.withColumn("qb", block("vec_id", q_blocks)).withColumn("cb", every_block(c_blocks)).groupBy("qb", "cb")
    right = table.withColumn("cb", block("uid", c_blocks)).withColumn("qb", every_block(q_blocks)).groupBy("qb", "cb")
    hits = left.cogroup(right).applyInArrow(searcher(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
