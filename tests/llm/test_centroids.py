"""Centroid clustering against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from joblattice.llm import centroids
from joblattice.llm import queries as llm
from tests.compare import checker, rows_of

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, seed):
    """rows: (id, list of whole components) -> [(id, cluster, distance)], centroids."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    cents = [list(v) for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(cents)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], cents


def test_blocks_lose_nothing_and_widen_over_copies():
    rng = np.random.default_rng(2)
    few = rng.integers(-9, 9, (6, 10))
    for x in (rng.integers(-500, 500, (700, 10)), few[rng.integers(0, 6, 700)], np.zeros((1, 3), np.int64), np.hstack([few[rng.integers(0, 6, 400)], rng.integers(0, 999, (400, 3))])):
        blocks = centroids.blocks_of(x)
        assert (np.hstack([d[c] for d, c in blocks]) == x).all()
        assert all(len(np.unique(d, axis=0)) == len(d) for d, _ in blocks)
    assert len(centroids.blocks_of(few[rng.integers(0, 6, 700)])) == 1
    assert len(centroids.blocks_of(rng.integers(-500, 500, (700, 10)))) == 10


@pytest.mark.parametrize("dims, high, n, k", [(4, 3, 300, 5), (7, 40, 500, 8), (3, 2**35, 60, 4), (2, 1, 50, 8)])
def test_rounds_equal_the_plain_version(spark, dims, high, n, k):
    rng = random.Random(dims)
    rows = [(i if i % 17 else None, [rng.randrange(-high, high + 1) for _ in range(dims)]) for i in range(n)]
    rows += rows[:40]  # repeated rows, ties
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    got = centroids.cluster(df, k, 4, 3, dims, 1).collect()
    want, cents = plain(rows, k, 4, 3)
    top = 2**63 - 1  # distances beyond stop here
    want = [(i, c, min(d, top)) for i, c, d in want]
    order = (lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    assert sorted(((r.id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    inertia = {c: sum(d for _, x, d in want if x == c) for c in range(k)}
    assert all(r.cluster_inertia == min(top, inertia[r.cluster]) and r.inertia == min(top, sum(inertia.values())) and list(r.centroid) == cents[r.cluster] for r in got)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0], 0), (4, [None, 1.0], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 0.0], 0), (None, [-0.3, 0.0], 0), (1, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").selectExpr("*", "1 AS id", "2 AS v")
    got = centroids.cluster(df, 2, 3, 3, 2, 10)
    want, _ = plain([(1, [10, 20]), (None, [-3, 0]), (1, [10, 20])], 2, 3, 3)
    assert sorted((r.id or -1, r.cluster, r.distance) for r in got.collect()) == sorted((i or -1, c, d) for i, c, d in want)
    assert centroids.cluster(df.limit(0), 2, 3, 3, 2).collect() == []
    assert centroids.cluster(df.where("vec_id = 2"), 2, 3, 3, 2).collect() == []


def test_the_query_equals_its_sql(spark):
    df = llm.QUERIES["op12_centroids"](spark, SF)
    cur = checker(SF).execute(llm.ORACLE_SQL["op12_centroids"])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
