"""What ingest does no more than once, or only where something changed, with the same results."""

import datetime as dt
import json

from pyspark.sql import functions as F

from joblattice.functions import dates, text
from joblattice.operators import changes
from joblattice.streaming import ingest
from tests.test_ingest import crawl


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_waiting_response_keeps_what_it_tells_of_its_crawl(spark, tmp_path):
    """Its body is parsed when it lands; batches after that read columns, and older files without them are still read."""
    landed = spark.createDataFrame([crawl(1, 1, [(1, "Data Intern", "Reno")], pages=2)], ingest.LANDED)
    ingest.apply_batch(landed, 0, f"{tmp_path}/t", buckets=2)
    held = ingest._pending(spark, f"{tmp_path}/t", None)
    assert [(r.stated, r.blank, r.unreadable, r.uncommon) for r in held.collect()] == [(1, False, False, False)]
    assert "from_json" not in plan(ingest._crawls(held)) and "get_json" not in plan(ingest._crawls(held))
    spark.read.schema(ingest.LANDED).parquet(f"{tmp_path}/t/pending/000000000000").write.parquet(f"{tmp_path}/old/pending/0")
    spark.createDataFrame([(0, None, f"{tmp_path}/old/pending/0", 2)], "batch long, snapshot string, pending string, buckets int").write.parquet(f"{tmp_path}/old/pointers/made=0")
    assert rows(ingest._pending(spark, f"{tmp_path}/old", None)) == rows(held)
    ingest.apply_batch(spark.createDataFrame([crawl(1, 1, [(2, "Field Intern", "Reno")], pages=2, page=2)], ingest.LANDED), 1, f"{tmp_path}/old", buckets=2)
    assert ingest.current(spark, f"{tmp_path}/old").count() == 2 and ingest.pending(spark, f"{tmp_path}/old").count() == 0


def test_responses_without_a_source_wait_and_settle_nothing(spark, tmp_path):
    nobody = (None, *crawl(1, 1, [(1, "Data Intern", "Reno")])[1:])
    ingest.apply_batch(spark.createDataFrame([nobody, crawl(2, 1, [(1, "Data Intern", "Reno")])], ingest.LANDED), 0, str(tmp_path), buckets=2)
    assert ingest.current(spark, str(tmp_path)).count() == 1 and ingest.run_log(spark, str(tmp_path)).count() == 1
    assert [r.source_id for r in ingest.pending(spark, str(tmp_path)).collect()] == [None]


def test_only_uncommon_references_go_through_python(spark):
    def landed(*contents):
        jobs = [{"id": i, "title": "Intern", "content": c} for i, c in enumerate(contents)]
        return (1, "c", 1, "b", "greenhouse", json.dumps({"token": "t"}), None, None, 1, dt.datetime(2001, 7, 1), json.dumps({"jobs": jobs}))

    def fetched(*contents):
        df = spark.createDataFrame([landed(*contents)], ingest.LANDED).withColumn("seen_at", F.col("fetched_at"))
        return ingest._fetched(df).select("description", "description_snippet")

    common, others = fetched("a &amp;lt;b&amp;gt; &nbsp; & c"), fetched("caf&eacute;", "&amp;copy 2", "AT&T &copy;")
    assert "_unescape" not in plan(common) and "_unescape" in plan(others)
    assert [r.description_snippet for r in common.collect()] == ["a & c"]
    assert sorted(r.description for r in others.collect()) == ["AT&T ©", "café", "© 2"]
    # as escaped by a writer of JSON
    escaped = landed("x")[:-1] + ('{"jobs": [{"id": 1, "title": "Intern", "content": "caf\\u0026eacute;"}]}',)
    one = ingest._fetched(spark.createDataFrame([escaped], ingest.LANDED).withColumn("seen_at", F.col("fetched_at")))
    assert [r.description for r in one.collect()] == ["café"]


def test_a_first_crawl_meets_no_earlier_rows(spark):
    none = ingest.Live("unused").postings.read(spark, ingest.Snapshot())
    other = spark.createDataFrame([("a",)], "id string")
    assert "Join" not in plan(none.select("id", "title").join(other, "id", "full_outer"))


def test_deltas_come_of_what_changed_only(spark, tmp_path):
    live = ingest.Live(str(tmp_path), 4)
    names = ingest._names(ingest.POSTINGS)

    def posting(id, status="open", title="Intern", key="k", source=1):
        d = {**dict.fromkeys(names), "id": id, "source_id": source, "status": status, "title": title, "dedup_key": key, "company": "A", "company_key": "a", "ats": "lever"}
        return tuple(d[n] for n in names)

    was = spark.createDataFrame([posting("same"), posting("gone"), posting("renamed"), posting("moved")], ingest.POSTINGS)
    now = spark.createDataFrame([posting("same", title="Other"), posting("gone", "closed"), posting("renamed", key="l"), posting("moved", source=9), posting("new")], ingest.POSTINGS)
    feed = changes.full_diff(was, now)
    keys = {(r.kind, r.hash): r.n for r in ingest._key_deltas(live, feed).groupBy("kind", "hash").agg(F.sum("n").alias("n")).collect()}
    hashed = {v: spark.range(1).select(F.xxhash64(F.lit(v))).first()[0] for v in ("new", "k", "l", "moved")}
    assert keys.pop(("id", hashed["moved"]), 0) == 0 and keys == {("id", hashed["new"]): 1, ("key", hashed["k"]): -1, ("key", hashed["l"]): 1}
    counted = {(r.measure, r.value): r.n for r in changes.count_deltas(feed).collect()}
    assert changes.count_deltas(feed.filter("id IN ('same', 'renamed')")).count() == 0
    assert counted[("source all", "9")] == 1 and ("source all", "1") not in counted and ("open ats", "lever") not in counted
    # a key whose only row stands open needs no sweep, others do
    names_before = changes.image(names).alias("_before")
    table = now.join(was.select("id", names_before), "id", "left")
    stirred = {r.dedup_key: (r.rows, r.bound) for r in ingest._stirred(table).collect()}
    assert stirred == {"k": (3, False), "l": (1, False)}


def test_instants_are_read_as_by_the_ladder(spark):
    texts = ["2001-07-01", "2001-07-01T10:20:30Z", "2001-07-01T10:20:30+02:00", "2001-07-01T10:20:30", "20010701", "2001-07-01 10:20:30-0400", "2001-02-30", "2001-07-01T25:00:00Z", "2001-07-01T10:20:30.5Z"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.date_format(dates.parse_posted_at("t", F.lit(None).cast("timestamp"))["ts"], "MM-dd HH:mm:ss").alias("v")).orderBy("i")
    assert [r.v for r in got.collect()] == ["07-01 00:00:00", "07-01 10:20:30", "07-01 08:20:30", "07-01 10:20:30", "07-01 00:00:00", "07-01 14:20:30", None, None, "07-01 10:20:30"]


def test_a_test_of_one_character_goes_ahead_of_a_bound(spark):
    assert text.phrases_pattern(["fall", "autumn"]).startswith("(?=[af])") and not text.phrases_pattern(["...x", "a"]).startswith("(?=")
    cases = {"Internist": False, "an INTERN, soon": True, "preintern": False, "Summer Analyst": True, "co-op": True, "recoop": False, "c++ dev": False}
    got = spark.createDataFrame(list(cases.items()), "t string, want boolean").withColumn("got", text.matches_any("t", ["intern", "co-op", "coop", "summer analyst", "#x"]))
    assert got.filter("got <> want").count() == 0
