"""Interleaved shards: counts, mixture, order and odd rows."""

import collections
import random
import zlib

import pytest

from joblattice.llm import queries as llm
from joblattice.llm import sharding
from tests.compare import checker, rows_of

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"


def docs(n, seed=1):
    """A hot source, small ones down to one row, rows without id, text or source, copies."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 41 == 0 else f"s{i % 7}" if i % 2 else f"lone{i}" if i % 10 == 4 else "mid"
        out.append((None if i % 53 == 0 else i, None if i % 29 == 0 else "" if i % 31 == 0 else rng.choice(("copy", f"text {i}")), source))
    return out + out[:5]


@pytest.mark.parametrize("n, shards, bucket", [(1200, 24, 50), (1200, 7, 20_000), (301, 24, 10), (5, 24, 3), (26, 1, 4)])
def test_every_shard_matches_the_mixture(spark, n, shards, bucket):
    rows = docs(n)
    df = spark.createDataFrame(rows, DOC).repartition(4)
    got = sharding.interleave(df, shards, bucket=bucket).collect()
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((i, s) for i, _, s in rows)
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) <= set(range(shards)) and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = collections.Counter(s for _, _, s in rows)
    for source, m in total.items():
        for shard in range(shards):
            mine = sum(r.source == source and r.shard == shard for r in got)
            assert abs(mine - m * sizes[shard] / len(rows)) < 3
    # sources alternate within a shard too: the hot third is never far from a third
    order = [r.source for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    if n > 1000:
        assert all(abs(sum(s == "hot" for s in order[i:i + 90]) - 90 * total["hot"] / len(rows)) <= 8 for i in range(0, len(order) - 90, 45))


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(docs(700), DOC)
    first = sorted(map(str, sharding.interleave(df, bucket=40).collect()))
    assert first == sorted(map(str, sharding.interleave(df.repartition(9), bucket=40).collect()))
    assert first != sorted(map(str, sharding.interleave(df, seed=14, bucket=40).collect()))


def test_places_do_not_depend_on_buckets(spark):
    df = spark.createDataFrame(docs(700), DOC)
    assert sorted(map(str, sharding.interleave(df, bucket=13).collect())) == sorted(map(str, sharding.interleave(df, bucket=10**6).collect()))


def test_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame(docs(30), DOC).selectExpr("*", "1 AS shard_of", "2 AS place", "3 AS n", "4 AS _bucket", "5 AS _n")
    assert sharding.interleave(df, 4).count() == 35
    assert sharding.interleave(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(df.withColumn("_at", df.n), 4, keep=("_at",))


def test_written_shards_hold_every_row_in_slot_order(spark, tmp_path):
    rows = docs(400)
    df = spark.createDataFrame(rows, DOC)
    sharding.write_shards(df, f"{tmp_path}/out", 6, rows_per_file=30)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = (lambda r: tuple(str(x) for x in r))
    assert sorted(((r.doc_id, r.text, r.source) for r in back.collect()), key=key) == sorted(rows, key=key)
    places = sorted((r.doc_id or -1, r.source or "", r.shard, r.slot) for r in sharding.interleave(df, 6).collect())
    assert sorted((r.doc_id or -1, r.source or "", r.shard, r.slot) for r in back.collect()) == places


def test_the_query_equals_its_sql(spark):
    df = llm.QUERIES["op13_interleaved_shards"](spark, SF)
    cur = checker(SF).execute(llm.ORACLE_SQL["op13_interleaved_shards"])
    names = [d[0] for d in cur.description]
    got = df.collect()
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 8 for r in got)
