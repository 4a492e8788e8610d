"""Registered queries: streams run to the end of what is given, and their batch forms."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.operators import changes
from joblattice.operators.skew import spread
from joblattice.plans import checks as k
from joblattice.plans.bindings import RUNS_AS_OF, TITLES, CheckDialect, Dialect, as_of, bound, given
from joblattice.plans.browse import RUNS_NOW
from joblattice.plans.columns import stamp
from joblattice.plans.registry import query
from joblattice.session import shared_dir
from joblattice.streaming import ingest, stall
from joblattice.streaming.lifecycle import lifecycle, run_summary


def _folder(spark, name):
    """A new folder per run in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


_ALERTED = "a AS (SELECT CAST(source_id AS VARCHAR) AS key, max(started_at) AS last_alert FROM runs WHERE NOT ok AND source_id % 2 = 0 GROUP BY 1)"


@query(f"""WITH {_ALERTED}, g AS (SELECT CAST(source_id AS VARCHAR) AS key, max(started_at) AS s FROM runs WHERE ok GROUP BY 1)
SELECT key, {k.stamp('s')} AS last_success, s < {RUNS_NOW} - to_hours(3) AS stalled, s < {RUNS_NOW} - to_hours(3) AND NOT coalesce(last_alert > s, false) AS emit FROM g LEFT JOIN a USING (key)""", ("runs",))
def stall_alerts(spark, sf_dir):
    """Per source; failures of even sources stand in for earlier alerts."""
    runs = bound(spark, sf_dir, "runs")
    told = runs.filter("NOT ok AND source_id % 2 = 0").select("source_id", F.col("started_at").alias("created_at"))
    return stall.stall_alerts(runs, told, as_of(RUNS_AS_OF), "source_id").select("key", stamp("last_success").alias("last_success"), "stalled", "emit")


@query(f"""SELECT 'stalled' AS kind, 'No source has been scraped successfully in ' || printf('%.1f', round((epoch({RUNS_NOW} + to_hours(9)) - epoch(date_trunc('second', max(started_at)))) / 3600, 1)) || ' hours — the feed is serving an ageing corpus' AS detail FROM runs WHERE ok""", ("runs",))
def feed_stall_activity(spark, sf_dir):
    """The whole feed, some hours after its last run."""
    now = F.timestamp_add("HOUR", F.lit(9), as_of(RUNS_AS_OF))
    runs = bound(spark, sf_dir, "runs")
    none = runs.limit(0).select("source_id", F.col("started_at").alias("created_at"))
    return stall.stall_log(stall.stall_alerts(runs, none, now), now).select("kind", "detail")


@query(f"""SELECT key, {k.stamp('s')} AS last_success, 'stalled' AS kind FROM (SELECT CAST(source_id AS VARCHAR) AS key, max(started_at) AS s FROM runs WHERE ok GROUP BY 1) WHERE date_trunc('millisecond', s) + to_hours(3) < (SELECT date_trunc('millisecond', max(started_at)) FROM runs WHERE ok)""", ("runs",))
def stall_stream(spark, sf_dir):
    """Alerts per source from the runs read as a stream."""
    out = _folder(spark, "stall")
    events = spark.readStream.schema(given(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    runs = events.selectExpr("user_id AS source_id", "CAST(ts AS TIMESTAMP) AS started_at", "event_type <> 'error' AS ok")
    alerts = stall.stall_stream(runs, "source_id")
    alerts.writeStream.option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").format("parquet").outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stall.ALERT).parquet(f"{out}/rows")
    return rows.select("key", stamp("last_success").alias("last_success"), "kind")


_SUMMARY = """o AS (SELECT source_id, id, started_at, ok, row_number() OVER w AS n, count(*) FILTER (ok) OVER w AS g FROM runs WINDOW w AS (PARTITION BY source_id ORDER BY started_at, id)),
b AS (SELECT source_id, g, count(*) FILTER (NOT ok) AS fails FROM o GROUP BY ALL),
s AS (SELECT source_id, count(*) AS runs, coalesce(min(n) FILTER (NOT ok) - 1, count(*)) AS lead_ok, coalesce(min(n) FILTER (ok) - 1, count(*)) AS lead_fail, bool_or(ok) AS any_ok, max(started_at) AS last_at FROM o GROUP BY source_id),
t AS (SELECT s.*, (SELECT max(fails) FROM b WHERE b.source_id = s.source_id) AS worst, (SELECT arg_max(fails, g) FROM b WHERE b.source_id = s.source_id) AS trail_fail FROM s)"""


@query(f"WITH {_SUMMARY} SELECT source_id, runs, lead_ok, lead_fail, trail_fail, worst, any_ok FROM t", ("runs",))
def run_summaries(spark, sf_dir):
    return run_summary(bound(spark, sf_dir, "runs")).select("source_id", "runs", "lead_ok", "lead_fail", "trail_fail", "worst", "any_ok")


_LIFE = f"""{_SUMMARY}, j AS (SELECT src.*, t.* EXCLUDE (source_id), CASE WHEN last_scraped_at IS NULL THEN 2 ELSE 1 END AS need FROM sources src LEFT JOIN t ON t.source_id = src.id),
f AS (SELECT *, runs IS NOT NULL AND status = 'active' AND lead_fail > 0 AND consecutive_failures + lead_fail >= 3 AS at_once, runs IS NOT NULL AND status = 'probation' AND lead_ok >= need AS confirmed FROM j)
SELECT id, CASE WHEN at_once OR ((confirmed OR (status = 'active' AND runs IS NOT NULL)) AND worst >= 3) THEN 'disabled' WHEN confirmed THEN 'active'
WHEN status = 'probation' AND lead_ok < runs THEN 'removed' ELSE status END AS status FROM f"""


@query(f"WITH {_LIFE}", ("runs", "sources"))
def source_lifecycle(spark, sf_dir):
    """All runs folded into their sources' states; three failures in a row disable."""
    return lifecycle(bound(spark, sf_dir, "sources"), bound(spark, sf_dir, "runs"), 3).select("id", "status")


@query(f"WITH {_LIFE.replace('>= 3', '>= 5')}", ("runs", "sources"))
def lifecycle_stream(spark, sf_dir):
    """The same from the runs read as a stream, with the usual five."""
    out = _folder(spark, "lifecycle")
    events = spark.readStream.schema(given(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    runs = events.selectExpr("user_id AS source_id", "event_id AS id", "CAST(ts AS TIMESTAMP) AS started_at", "event_type <> 'error' AS ok")
    ingest.lifecycle_stream(runs, bound(spark, sf_dir, "sources"), out, f"{out}/log", availableNow=True).awaitTermination()
    states = spark.read.parquet(f"{out}/states")
    return states.join(states.agg(F.max("batch").alias("batch")), "batch").select("id", "status")


def _crawl(spark, sf_dir, later: bool, page: int):
    """Each order a board of three jobs on two pages, read three seconds apart; two boards share each label.

    Later, the first job is gone, the rest retitled, and every seventh board's second page broken.
    """
    d = Dialect()
    job = "named_struct('id', o_orderkey * 3 + {i}, 'title', {t}, 'location', named_struct('name', 'Reno'), 'absolute_url', 'u', 'updated_at', '{u}', 'content', 'text')"
    picks = [d.pick(TITLES, f"(o_orderkey + {i}) % {len(TITLES)}") for i in range(3)]
    jobs = [job.format(i=i, t=f"{t} || ' {i}'" + (" || ' Again'" if later else ""), u="2001-08-01" if later else "2001-07-01") for i, t in enumerate(picks)]
    mine = jobs[2:] if page == 2 else jobs[1:2] if later else jobs[:2]
    body = f"to_json(named_struct('jobs', array({', '.join(mine)})))"
    if later and page == 2:
        body = f"CASE WHEN o_orderkey % 7 = 0 THEN '{{}}' ELSE {body} END"
    at = {(False, 1): "2001-07-01 23:59:57", (False, 2): "2001-07-02", (True, 1): "2001-08-01 23:59:57", (True, 2): "2001-08-02"}[later, page]
    return spread(given(spark, sf_dir, "orders")).selectExpr(
        "o_orderkey AS source_id", f"'crawl {int(later)}' AS crawl_id", "2 AS crawl_pages", "'board ' || o_orderkey DIV 2 AS source_entry", "'greenhouse' AS provider",
        "to_json(named_struct('company', 'Board ' || o_orderkey, 'token', 't' || o_orderkey, 'category', 'Retail')) AS entry",
        "CAST(NULL AS STRING) AS query_category", "CAST(NULL AS INT) AS category_pos", f"{page} AS page", f"TIMESTAMP '{at}' AS fetched_at", f"{body} AS payload")


_C = CheckDialect()
_JOBS = f"""jobs AS (SELECT o_orderkey AS o, i, {_C.pick(TITLES, f"(o_orderkey + i) % {len(TITLES)}")} || ' ' || i AS title FROM (SELECT *, unnest([0, 1, 2]) AS i FROM orders)), rel AS (SELECT * FROM jobs WHERE {k.has('lower(title)', vocab.INTERN_WORDS)})"""


_INGESTED: dict[tuple, str] = {}


def _ingested(spark, sf_dir, again: bool = False):
    """Two crawls, each page landed in files of its own and taken in by the stream in a batch of its own.

    The folder is kept for the queries that read what the stream left there.
    """
    made = (spark.sparkContext.applicationId, sf_dir)
    if made in _INGESTED and not again:
        return _INGESTED[made]
    out = _folder(spark, "ingest")
    for later in (False, True):
        for page in (1, 2):
            # all cores write a page, and one batch takes all its files
            _crawl(spark, sf_dir, later, page).write.mode("append").parquet(f"{out}/landing")
            ingest.ingest_stream(spark, f"{out}/landing", f"{out}/live", f"{out}/log", files_per_batch=1_000_000, availableNow=True).awaitTermination()
    _INGESTED[made] = f"{out}/live"
    return f"{out}/live"


@query(f"""WITH {_JOBS} SELECT 'greenhouse:t' || o || ':' || (o * 3 + i) AS id, CASE WHEN i = 0 AND o % 7 > 0 THEN 'closed' ELSE 'open' END AS status,
CASE WHEN i > 0 AND o % 7 > 0 THEN title || ' Again' ELSE title END AS title, '2001-07-02 00:00:00' AS first_seen,
CASE WHEN i > 0 AND o % 7 > 0 THEN '2001-07-01 00:00:00' ELSE '2001-07-01 00:00:00' END AS posted_at_ts,
CASE WHEN i > 0 AND o % 7 > 0 THEN '2001-08-02 00:00:00' ELSE '2001-07-02 00:00:00' END AS last_seen FROM rel""")
def ingest_stream(spark, sf_dir):
    """Dates are whole days, so approximate: the earlier one stays."""
    rows = ingest.current(spark, _ingested(spark, sf_dir, again=True))
    return rows.select("id", "status", "title", *[stamp(c).alias(c) for c in ("first_seen", "posted_at_ts", "last_seen")])


@query(f"""WITH {_JOBS} SELECT ok, count(*) AS sources, CAST(sum(f) AS BIGINT) AS fetched, CAST(sum(r) AS BIGINT) AS relevant FROM (
SELECT true AS ok, 3 AS f, (SELECT count(*) FROM rel WHERE o = o_orderkey) AS r FROM orders UNION ALL SELECT o_orderkey % 7 > 0, CASE WHEN o_orderkey % 7 > 0 THEN 2 END,
CASE WHEN o_orderkey % 7 > 0 THEN (SELECT count(*) FROM rel WHERE o = o_orderkey AND i > 0) END FROM orders) GROUP BY ok""")
def ingest_run_log(spark, sf_dir):
    log = ingest.run_log(spark, _ingested(spark, sf_dir))
    return log.groupBy("ok").agg(F.count("*").alias("sources"), F.sum("fetched_count").alias("fetched"), F.sum("internship_count").alias("relevant"))


_CHANGES = f"""WITH {_JOBS}, feed AS (SELECT 1 AS batch, 'greenhouse:t' || o || ':' || (o * 3 + i) AS id, o AS source_id, 'inserted' AS kind, NULL AS was, title AS now, NULL AS status_was, 'open' AS status_now FROM rel
UNION ALL SELECT 3, 'greenhouse:t' || o || ':' || (o * 3 + i), o, CASE WHEN i = 0 THEN 'closed' ELSE 'updated' END, title, CASE WHEN i = 0 THEN title ELSE title || ' Again' END, 'open', CASE WHEN i = 0 THEN 'closed' ELSE 'open' END FROM rel WHERE o % 7 > 0)"""


@query(f"{_CHANGES} SELECT * FROM feed")
def posting_changes(spark, sf_dir):
    """The change feed of the stream's batches: what each did to which posting."""
    feed = ingest.feed(spark, _ingested(spark, sf_dir))
    return feed.select(
        "batch", "id", "source_id", "kind", F.col("before.title").alias("was"), F.col("after.title").alias("now"),
        F.col("before.status").alias("status_was"), F.col("after.status").alias("status_now"))


@query(f"{_CHANGES} SELECT 'postings_' || kind AS kind, 'Board ' || source_id AS company, count(*) || ' postings ' || kind AS detail, batch FROM feed WHERE kind <> 'updated' GROUP BY batch, source_id, feed.kind")
def posting_activity(spark, sf_dir):
    """Activity rows of each batch, from the feed alone."""
    feed = ingest.feed(spark, _ingested(spark, sf_dir))
    each = [changes.posting_events(feed.filter(F.col("batch") == n), F.lit(n)).select("kind", "company", "detail", F.col("created_at").cast("int").alias("batch")) for n in (1, 3)]
    return each[0].unionByName(each[1])


_NOW = f"""WITH {_JOBS}, open AS (SELECT 'Board ' || o AS company, o, CASE WHEN o % 7 > 0 THEN title || ' Again' ELSE title END AS title FROM rel WHERE i > 0 OR o % 7 = 0)"""
_AXES = {
    "company": "company", "category": "'Retail'", "ats": "'greenhouse'", "location": "'Reno'", "cycle_season": k.season(), "cycle_year": f"CAST({k.year()} AS VARCHAR)",
}


@query(f"{_NOW} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {v} AS value, count(*) AS n FROM open WHERE {v} <> '' GROUP BY 2" for a, v in _AXES.items()))
def maintained_facets(spark, sf_dir):
    """Facet counts kept up by signed changes batch by batch, never recounted."""
    return changes.counted_metadata(ingest.counts(spark, _ingested(spark, sf_dir)))


@query(f"{_NOW} SELECT count(*) AS total_open_postings, count(DISTINCT company) AS total_companies FROM open")
def maintained_totals(spark, sf_dir):
    return changes.counted_totals(ingest.counts(spark, _ingested(spark, sf_dir)))


@query(f"WITH {_JOBS} SELECT o AS source_id, count(*) AS total, count(*) FILTER (i > 0 OR o % 7 = 0) AS open, CAST(1 AS BIGINT) AS companies, false AS is_aggregator FROM rel GROUP BY o")
def maintained_sources(spark, sf_dir):
    return changes.counted_sources(ingest.counts(spark, _ingested(spark, sf_dir)))


@query(f"{_NOW} SELECT 'greenhouse' AS ats, count(*) AS open_postings, (SELECT count(DISTINCT o) FROM rel) AS companies, count(*) AS with_description FROM open HAVING count(*) > 0")
def maintained_platforms(spark, sf_dir):
    return changes.counted_platforms(ingest.counts(spark, _ingested(spark, sf_dir)))
