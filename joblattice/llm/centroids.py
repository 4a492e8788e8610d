"""Centroid clustering over subvector dictionaries.

Vectors are stored once as stripes, each some thousand rows of one task.  A
stripe cuts its vectors into blocks of dimensions and keeps, per block, the
distinct subvectors and each vector's code among them, so nothing is lost.
Adjacent blocks are joined into wider ones while few distinct subvectors come
of it: copies end in one block of all dimensions, unlike vectors in blocks of
one dimension, whose values repeat anyway.

A round works out the distance of each distinct subvector to each centroid
once, adds up a vector's partial distances by its codes, and takes the new
centroids from counts by code.  Tasks hand on one sum per centroid and
dimension; the driver sees those k x d numbers and nothing else.  No row is
shuffled, and a lost executor costs reading its stripes again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import stored, table

#: Vectors of a stripe; codes have two bytes.
ROWS = 16384
#: Two blocks become one if it has at most one distinct subvector for so many vectors.
SHARE = 8
#: Whole components up to here are computed in machine integers, greater ones in Python's.
SMALL = 2**26
LARGEST = 2**63 - 1

STRIPE = "ids array<long>, n_codes array<int>, widths array<int>, subvectors binary, codes binary"


def quantized(vectors: DataFrame, dims: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * component) of vectors of `dims` components.

    Vectors that are null, of another length, or hold null or non-finite
    components take no part.  Those with a null or repeated id do, row by row.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where((F.size("x") == dims) & finite).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def blocks_of(x: np.ndarray, share: int = SHARE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, code of each row) for blocks of dimensions, from left to right."""
    blocks = []
    for column in x.T:
        values, codes = np.unique(column, return_inverse=True)
        blocks.append((values[:, None], codes))
    merged = True
    while merged:
        merged, out = False, []
        while blocks:
            if len(blocks) == 1:
                out.append(blocks.pop(0))
                continue
            (a, i), (b, j) = blocks.pop(0), blocks.pop(0)
            pairs, codes = np.unique(i.astype(np.int64) * len(b) + j, return_inverse=True)
            if len(pairs) * share <= len(x):
                out.append((np.hstack([a[pairs // len(b)], b[pairs % len(b)]]), codes))
                merged = True
            else:
                out += [(a, i), (b, j)]
        blocks = out
    return blocks


def stripes(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """The vectors (id, v) as stripes."""
    if size > 2**16:
        raise ValueError("a stripe holds at most 65,536 vectors")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                x = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                blocks = blocks_of(x)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([part["id"].to_pylist()], pa.list_(pa.int64())),
                    "n_codes": pa.array([[len(d) for d, _ in blocks]], pa.list_(pa.int32())),
                    "widths": pa.array([[d.shape[1] for d, _ in blocks]], pa.list_(pa.int32())),
                    "subvectors": [b"".join(d.astype("<i8").tobytes() for d, _ in blocks)],
                    "codes": [b"".join(c.astype("<u2").tobytes() for _, c in blocks)],
                })

    return rows.mapInArrow(encode, STRIPE)


class Stripe:
    """A stripe's ids and blocks: (first dimension, distinct subvectors, codes)."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        values, codes = np.frombuffer(row["subvectors"], "<i8"), np.frombuffer(row["codes"], "<u2")
        self.small = not len(values) or max(-int(values.min()), int(values.max())) <= SMALL
        self.blocks, n, first, at = [], len(self.ids), 0, 0
        for i, (m, w) in enumerate(zip(row["n_codes"], row["widths"])):
            self.blocks.append((first, values[at:at + m * w].reshape(m, w), codes[i * n:(i + 1) * n]))
            first, at = first + w, at + m * w

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, the first of equally near ones, and its squared distance."""
        small = self.small and all(abs(v) <= SMALL for c in centroids for v in c)
        exact = np.int64 if small else object
        c = np.array(centroids, exact)
        total = np.zeros((len(self.ids), len(c)), exact)
        for first, values, codes in self.blocks:
            apart = values.astype(exact)[:, None, :] - c[None, :, first:first + values.shape[1]]
            total += (apart * apart).sum(axis=2)[codes]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first dimension, sums by centroid and dimension) of each block, from the counts by code."""
        for first, values, codes in self.blocks:
            counts = np.bincount(best * len(values) + codes, minlength=k * len(values)).reshape(k, len(values))
            yield first, counts.astype(object) @ values.astype(object) if not self.small else counts @ values


def _striped(batches: Iterator[pa.RecordBatch]) -> Iterator[Stripe]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Stripe(batch.slice(i, 1).to_pylist()[0])


def next_centroids(store: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, d = len(centroids), len(centroids[0])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, d), object)
        for stripe in _striped(batches):
            best, _ = stripe.nearest(centroids)
            counts += np.bincount(best, minlength=k)
            for first, part in stripe.sums(best, k):
                sums[:, first:first + part.shape[1]] += part
        if counts.any():
            yield pa.RecordBatch.from_pydict({
                "cluster": np.repeat(np.arange(k), d + 1),
                "dim": np.tile(np.arange(-1, d), k),
                "total": pa.array([Decimal(int(v)) for c in range(k) for v in (counts[c], *sums[c])], pa.decimal128(38, 0)),
            })

    whole = store.mapInArrow(totals, "cluster long, dim long, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
    found = {(r.cluster, r.dim): int(r.total) for r in whole.collect()}
    return [[found[c, j] // found[c, -1] for j in range(d)] if found.get((c, -1)) else old for c, old in enumerate(centroids)]


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`; rows without an id come last, ties go by the vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()]


def fit(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """The stored stripes of vectors (id, v) and the centroids after the rounds; none without vectors."""
    store = stored(stripes(rows), "stripes")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(store, centroids)
    return store, centroids


def assign(store: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector of the stripes; distances beyond 64 bits stop at the end of the range."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe in _striped(batches):
            best, distance = stripe.nearest(centroids)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(stripe.ids, pa.int64()), "cluster": best.astype(np.int32),
                "distance": np.minimum(distance, LARGEST).astype(np.int64)})

    return store.mapInArrow(place, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024,
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid (array) of every usable vector.

    Fewer vectors than `k` give as many centroids; an empty table gives no rows.
    """
    store, centroids = fit(quantized(vectors, dims, scale, key, vector), k, rounds, seed)
    placed = stored(assign(store, centroids), "clusters")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)

    each = [F.lit(min(sums.get(c, 0), LARGEST)).cast("long") for c in range(len(centroids))]
    return placed.select(
        "id", "cluster", "distance", by_cluster(each).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), LARGEST)).cast("long").alias("inertia"),
        by_cluster([F.array(*[F.lit(v).cast("long") for v in c]) for c in centroids]).cast("array<long>").alias("centroid"))


def op12(spark, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    return out.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS MATERIALIZED (SELECT n, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM rows, c{r}), "
            f"a{r} AS MATERIALIZED (SELECT n, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM d{r} GROUP BY n)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT c, j, sum(y) AS s, count(*) AS m FROM (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM a{r} JOIN rows USING (n)) GROUP BY c, j), "
                f"m{r} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY j) AS x FROM s{r} GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, CAST(coalesce(m{r}.x, c{r}.x) AS BIGINT[]) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v AS x
    FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM rows ORDER BY h NULLS LAST, v LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{rounds} JOIN rows USING (n) JOIN c{rounds} USING (c)
"""


OP12_SQL = _sql()
