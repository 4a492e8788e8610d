"""Ingest by buckets: equal to the whole-table form, and no file touched without need."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from joblattice.operators import changes, facets, maintain
from joblattice.sources.buckets import BucketTable, Snapshot
from joblattice.streaming import ingest

SOURCES = "id long, company string, ats string, category string"


def crawl(source, day, jobs, provider="greenhouse", pages=1, page=1):
    """One landed response: (id, title, location) jobs of a source."""
    at = dt.datetime(2001, 7, day, 12)
    body = {"jobs": [{"id": i, "title": t, "location": {"name": p}, "absolute_url": f"u{i}", "updated_at": "2001-07-01", "content": f"text of {t}"} for i, t, p in jobs]}
    entry = {"company": f"Board {source % 3}", "token": f"t{source if source < 90 else 1}", "category": "Retail"}
    return (source, f"c{day}", pages, f"board {source}", provider, json.dumps(entry), None, None, page, at, json.dumps(body))


A, B, C = (1, "Data Intern", "Reno"), (2, "Field Intern", "Boise"), (3, "Barista", "Reno")
#: Boards 1 and 4 are of one company, so their like jobs are the same one; board 91 lists board 1's ids as its own.
BATCHES = [
    [crawl(1, 1, [A, B, C]), crawl(2, 1, [A, B]), crawl(4, 2, [A, (7, "Night Intern", "Reno")]), crawl(5, 2, [(i, f"Intern {i}", "Ely") for i in range(9)])],
    [crawl(1, 3, [(2, "Field Intern II", "Boise"), C])],  # A closes: board 4's copy takes its place
    [crawl(1, 4, [A, B]), crawl(1, 5, [A]), crawl(91, 5, [A, (8, "Late Intern", "Reno")])],  # two crawls of one source
    [crawl(2, 6, [A], pages=2), (3, "c6", 1, "board 3", "greenhouse", "{}", None, None, 1, dt.datetime(2001, 7, 6), "{}")],  # unfinished, and broken
]


def files(target):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{target}/postings") for f in fs if f.endswith(".parquet")}


def plain_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("live"))
    whole = spark.createDataFrame([], ingest.POSTINGS)
    seen = []
    for n, rows in enumerate(BATCHES):
        landed = spark.createDataFrame(rows, ingest.LANDED)
        before = files(target)
        ingest.apply_batch(landed, n, target, buckets=8, keep=10)
        previous = whole
        whole_crawls = sorted((r[9], r[0], r[1]) for r in rows if r[2] == 1 and r[0] != 3)
        place = {c: sum(o[1] == c[1] and o <= c for o in whole_crawls) for c in whole_crawls}
        for turn in sorted(set(place.values())):
            wanted = [f"{s}:{c}" for (_, s, c), t in place.items() if t == turn]
            mine = landed.filter(F.concat_ws(":", F.col("source_id").cast("string"), "crawl_id").isin(wanted))
            ok = mine.select("source_id", "crawl_id", F.col("fetched_at").alias("seen_at"))
            fresh = maintain.derived(ingest._fetched(mine.join(ok, ["source_id", "crawl_id"])).filter(ingest.is_internship("title")), F.col("seen_at"))
            fresh = fresh.groupBy("id").agg(F.max(F.struct(*[c for c in fresh.columns if c != "id"])).alias("_r")).select("id", "_r.*")
            whole = maintain.dedup_sweep(maintain.reconcile(whole, fresh, ok).drop("action")).drop("changed")
            whole = spark.createDataFrame(whole.collect(), ingest.POSTINGS)
        seen.append((before, files(target), previous, whole))
    return target, seen


def test_equals_reconciling_and_sweeping_the_whole_table(spark, run):
    target, seen = run
    for n, (_, _, _, whole) in enumerate(seen):
        assert plain_rows(ingest.current(spark, target, n + 1).select(whole.columns)) == plain_rows(whole)


def test_a_closed_winner_gives_way_in_another_bucket(spark, run):
    target, _ = run
    held = {(n, r.id): r for n in (1, 2) for r in ingest.current(spark, target, n).collect()}
    assert held[1, "greenhouse:t4:1"].duplicate_of == "greenhouse:t1:1"
    assert held[2, "greenhouse:t1:1"].status == "closed" and held[2, "greenhouse:t4:1"].status == "open"


def test_an_id_stays_with_its_first_source(spark, run):
    target, _ = run
    rows = {r.id: r for r in ingest.current(spark, target).collect()}
    assert rows["greenhouse:t1:1"].source_id == 1 and rows["greenhouse:t1:8"].source_id == 91
    assert sum(r.id == "greenhouse:t1:1" for r in ingest.current(spark, target).collect()) == 1


def test_other_buckets_keep_their_files(spark, run):
    target, seen = run
    live = ingest.Live(target, 8)
    (b5, b1, b4) = (spark.range(1).select(live.postings.bucket(F.lit(s).cast("long"))).first()[0] for s in (5, 1, 4))
    assert b5 not in (b1, b4)
    before, after, _, _ = seen[1]
    assert before <= after and {f.split("bucket=")[1].split("/")[0] for f in after - before} == {str(b1), str(b4)}
    # an unfinished and a broken crawl write no postings at all
    assert seen[3][0] == seen[3][1]


def test_the_feed_equals_the_full_difference(spark, run):
    target, seen = run
    feed = ingest.feed(spark, target)
    for n, (_, _, old, new) in enumerate(seen[:2]):  # one round each
        names = [c.split()[0] for c in ingest.POSTINGS.split(", ")]
        want = changes.full_diff(old.select(names), new.select(names))
        assert plain_rows(feed.filter(F.col("batch") == n).drop("batch", "round")) == plain_rows(want)
    kinds = {(r.batch, r["round"], r.kind): r.n for r in feed.groupBy("batch", "round", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[1, 1, "closed"] == 1 and kinds[1, 1, "promoted"] == 1 and kinds[2, 1, "reopened"] == 1 and (3, 1, "inserted") not in kinds


def test_counts_equal_counting_afresh_after_every_batch(spark, run):
    target, seen = run
    for n, (_, _, _, whole) in enumerate(seen):
        counts = ingest.counts(spark, target, n + 1)
        open_ = whole.filter("status = 'open'")
        assert plain_rows(changes.counted_metadata(counts)) == plain_rows(facets.metadata(open_))
        assert plain_rows(changes.counted_totals(counts)) == plain_rows(facets.metadata_totals(open_))
        assert plain_rows(changes.counted_facets(counts)) == plain_rows(facets.facets(whole))
        assert plain_rows(changes.counted_sources(counts)) == plain_rows(facets.source_stats(whole))
        none = spark.createDataFrame([], SOURCES + ", status string")
        want = facets.platform_stats(whole, none).select("ats", "open_postings", "companies", "with_description")
        assert plain_rows(changes.counted_platforms(counts)) == plain_rows(want)
        assert counts.filter("n <= 0").count() == 0


def test_the_run_log_tells_what_crawls_changed(spark, run):
    target, _ = run
    log = {(r.source_id, r.crawl_id): r for r in ingest.run_log(spark, target).collect()}
    first, second = log[1, "c1"], log[1, "c3"]
    assert (first.fetched_count, first.internship_count, first.inserted, first.closed) == (3, 2, 2, 0)
    assert (second.inserted, second.closed, log[1, "c4"].reopened) == (0, 1, 1)
    assert not log[3, "c6"].ok and log[3, "c6"].inserted is None and (2, "c6") not in log


def test_events_from_the_feed(spark, run):
    target, _ = run
    rows = changes.posting_events(ingest.feed(spark, target).filter("batch = 1"), F.lit("2001-07-03").cast("timestamp")).collect()
    assert [(r.kind, r.detail) for r in rows] == [("postings_closed", "1 postings closed")]


def test_moved_sources_expiry_and_repeats(spark, tmp_path):
    target = str(tmp_path)
    company = (lambda name: spark.createDataFrame([(s, f"{name} {s}" if s == 5 else f"Board {s}", "greenhouse", "Retail") for s in (1, 2, 4, 5)], SOURCES))
    ingest.apply_batch(spark.createDataFrame(BATCHES[0], ingest.LANDED), 0, target, company("Board"), buckets=8)
    before = files(target)
    none = spark.createDataFrame([], ingest.LANDED)
    ingest.apply_batch(none, 1, target, company("Board"))
    assert files(target) == before  # nothing landed, no source moved
    for _ in range(2):  # a batch may be repeated
        ingest.apply_batch(none, 2, target, company("Renamed"))
    got = {r.company for r in ingest.current(spark, target).filter("source_id = 5").collect()}
    assert got == {"Renamed 5"} and ingest.current(spark, target).count() == 15 and ingest.current(spark, target, 2).filter("company = 'Renamed 5'").count() == 0
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(target) - before}) == 1
    assert ingest.feed(spark, target).filter("batch = 2 AND kind = 'updated'").count() == ingest.current(spark, target).filter("source_id = 5").count()
    whole = plain_rows(ingest.current(spark, target))
    assert ingest.expire_snapshots(spark, target, 1) > 0
    assert plain_rows(ingest.current(spark, target)) == whole and len(files(target)) == len(before)
    assert len(os.listdir(f"{target}/pointers")) == 1 and ingest.expire_snapshots(spark, target, 1) == 0


def test_bucket_tables_refuse_rows_of_other_buckets(spark, tmp_path):
    t = BucketTable("t", f"{tmp_path}/t", "k long, v string", "k", 4)
    rows = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "y")], "k long, v string")
    snap = t.write(rows, Snapshot(), range(4), "a")
    assert t.read(spark, snap).count() == 51 and sum(n for _, n in snap.of("t").values()) == 51
    with pytest.raises(ValueError):
        t.write(rows, snap, [0], "b")
    snap = t.write(rows.limit(0), snap, [1], "c")
    assert 1 not in snap.of("t") and t.read(spark, snap, [1]).count() == 0
    snap.save(spark, f"{tmp_path}/s")
    assert Snapshot.load(spark, f"{tmp_path}/s") == snap and Snapshot.load(spark, None) == Snapshot()


def test_pending_pages_are_spread_and_a_settled_row_takes_its_verdict(spark, tmp_path):
    """One file of pending responses is parsed by all cores; verdicts meet rows by id and key, also without an id."""
    from joblattice.operators.skew import spread

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    table = spark.createDataFrame(
        [("a", "k", "open", None), ("b", "k", "open", None), (None, "k", "open", None), ("c", None, "open", None)],
        "id string, dedup_key string, status string, duplicate_of string")
    verdicts = spark.createDataFrame(
        [("b", "k", "duplicate", "a"), (None, "k", "duplicate", "a"), (None, "k", "duplicate", "a")],
        "id string, dedup_key string, status string, duplicate_of string")
    got = {(r.id, r.status, r.duplicate_of) for r in ingest._settled(table, verdicts).collect()}
    assert got == {("a", "open", None), ("b", "duplicate", "a"), (None, "duplicate", "a"), ("c", "open", None)}
    assert ingest._settled(table, verdicts).count() == 4


def test_each_landed_page_is_written_by_all_cores(spark):
    from joblattice.plans import streams
    from joblattice.plans.bindings import given

    page = streams._crawl(spark, "/root/testdata/sf0.001", False, 1)
    assert page.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert page.count() == given(spark, "/root/testdata/sf0.001", "orders").count()
