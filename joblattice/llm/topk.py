"""Exact top-k search by no-random-access aggregation, in blocks.

Each component of the vectors is a sorted list of contributions to the inner
product, read from its best end: descending for a positive query component,
ascending for a negative one.  At a depth, a candidate's score lies between
what has been read of it plus the lists' worst values for the rest, and what
has been read plus the last values read.  Candidates whose upper bound is below
the k-th lower bound cannot qualify; when few are left, reading stops and their
final scores are resolved.

Candidates and queries are dealt into blocks by hash and meet pairwise, the
stated query set against all rows.  Each block of candidates has lists of its
own, gives exact winners for each query, and winners are merged with a limit
before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblattice.llm.common import stored, table

#: Rows of a block of candidates, and of queries.
CANDIDATES, QUERIES = 1024, 1024
#: Depths, as shares of the lists, at which bounds are taken before the lists are read out.
DEPTHS = (0.125, 0.5)
#: Reading stops when at most this many candidates per place are left.
LEFT = 4


def quantized(vectors: DataFrame, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * component) of each usable vector.

    Rows with a null id or vector, or with null or non-finite components, take
    no part.  Of rows with one id, that with the smallest vector stands for all.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of numbers; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def winners(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k candidates of highest inner product (all, if fewer), but not itself: places in q, places in x, scores."""
    order = np.argsort(-x, axis=0, kind="stable")
    falling = np.empty_like(order)
    np.put_along_axis(falling, order, np.arange(len(x))[:, None], axis=0)  # place of each candidate in each list
    lists = np.take_along_axis(x, order, axis=0).astype(float)
    values, up, down = x.astype(float), np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    # sums of whole numbers are exact in floating point up to 2**53; beyond, bounds give way by the rounding
    slack = max(0.0, np.abs(values).max(initial=0) * np.abs(q.astype(float)).max(initial=0) * x.shape[1] - 2.0**52) * 1e-12
    own = q_ids[:, None] == ids[None, :]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = np.arange(len(q))
    for share in DEPTHS:
        depth = int(len(x) * share)
        if depth < 1 or len(x) <= LEFT * k or not len(open_):
            continue
        high, low = falling < depth, falling >= len(x) - depth
        seen = np.hstack([values * high, values * low, ~high, ~low]).T
        u, d = up[open_], down[open_]
        upper = np.hstack([u, d, u * lists[depth - 1], d * lists[len(x) - depth]]) @ seen
        lower = np.hstack([u, d, u * lists[-1], d * lists[0]]) @ seen
        mine = own[open_]
        lower[mine] = upper[mine] = -np.inf
        kth = np.partition(lower, -k, axis=1)[:, -k]
        may = upper + slack >= (kth - slack)[:, None]
        few = may.sum(axis=1) <= LEFT * k
        out += [(open_[i], np.flatnonzero(may[i] & ~mine[i])) for i in np.flatnonzero(few)]
        open_ = open_[~few]
    exact = slack == 0.0
    qi, xi, scores = [], [], []

    def take(i: int, places: np.ndarray, s: np.ndarray) -> None:
        best = np.lexsort((ids[places], -s))[:k]
        qi.append(np.full(len(best), i))
        xi.append(places[best])
        scores.append(s[best])

    for i, places in out:
        take(i, places, _scores(q[i:i + 1], x[places], exact)[0])
    if len(open_):  # lists read to their ends: all scores are final
        for i, s in zip(open_, _scores(q[open_], x, exact)):
            places = np.flatnonzero(~own[i])
            if len(places) > 2 * k:
                kth = np.partition(s[places], -k)[-k]
                places = places[s[places] >= kth]
            take(i, places, s[places])
    if not qi:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    return np.concatenate(qi), np.concatenate(xi), np.concatenate(scores)


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits stop at the ends of the range."""
    if exact:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    limits = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, limits.min, limits.max).astype(np.int64)


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best other rows for each row that meets `queries` (on column `id`).

    Ties go to the smaller id.  Vectors of different lengths are compared as if
    the shorter ended in zeros.  An empty table gives no rows.
    """
    rows = stored(quantized(vectors, scale, key, vector), "vectors")
    asked = rows.where(queries)
    n_blocks = max(1, -(-rows.count() // CANDIDATES))
    n_groups = max(1, -(-asked.count() // QUERIES))

    def dealt(df: DataFrame, seed: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.select("id", "v", dealt(rows, 1, n_blocks).alias("block"), each(n_groups).alias("part"))
    right = asked.select("id", "v", dealt(asked, 2, n_groups).alias("part"), each(n_blocks).alias("block"))

    def meet(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        ids, q_ids = candidates["id"].to_numpy(), wanted["id"].to_numpy()
        found = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
        if len(ids) and len(q_ids):
            x = _matrix(candidates["v"])
            q = _matrix(wanted["v"], x.shape[1])
            x = _matrix(candidates["v"], q.shape[1])
            found = winners(q_ids, q, ids, x, k)
        return pa.table({"query_id": q_ids[found[0]], "vec_id": ids[found[1]], "score": found[2]})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP1_SQL = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored) WHERE rank <= 10
"""
