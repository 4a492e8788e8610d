"""Registered queries: reconciling, sweeping and maintaining the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice import schema, vocab
from joblattice.operators import maintain, ranking
from joblattice.plans import checks as k
from joblattice.plans.bindings import RUNS_AS_OF, as_of, bound, given
from joblattice.plans.browse import NOW, RUNS_NOW, SWEPT, keyed, live, swept
from joblattice.plans.columns import stamp
from joblattice.plans.registry import query


def _sources(spark, sf_dir):
    return bound(spark, sf_dir, "sources")


def _candidates(spark, sf_dir):
    return bound(spark, sf_dir, "candidates")


# --- batch and live reconciliation ------------------------------------------------

# What a later crawl finds: most postings again, some retitled, some new ones.
_FRESH = """fresh AS (SELECT CASE WHEN o % 9 = 4 THEN 'new:' || id ELSE id END AS id, company, CASE WHEN o % 6 = 0 THEN title || ' Fall 2030' ELSE title END AS title, location, source_id, source_entry,
CASE WHEN o % 5 = 0 THEN 'fresh text ' || o ELSE '' END AS description, CASE WHEN o % 2 = 0 THEN 'Posted 3 Days Ago' ELSE '2001-07-01T00:00:00Z' END AS posted_at, o
FROM (SELECT *, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS o FROM postings) WHERE o % 4 <> 1)"""


def _fresh(spark, sf_dir):
    o = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    rows = live(spark, sf_dir).withColumn("_o", o).filter("_o % 4 <> 1")
    o = F.col("_o")
    return rows.select(
        F.when(o % 9 == 4, F.concat(F.lit("new:"), "id")).otherwise(F.col("id")).alias("id"), "company",
        F.when(o % 6 == 0, F.concat("title", F.lit(" Fall 2030"))).otherwise(F.col("title")).alias("title"),
        "location", "url", F.col("ats").alias("source"), "category", "job_function", "work_arrangement",
        F.when(o % 2 == 0, "Posted 3 Days Ago").otherwise("2001-07-01T00:00:00Z").alias("posted_at"), "description_snippet",
        F.when(o % 5 == 0, F.concat(F.lit("fresh text "), o)).otherwise("").alias("description"), "source_id", "source_entry")


@query(f"""WITH {_FRESH}, failed AS (SELECT DISTINCT source_entry FROM postings WHERE source_id % 7 = 3)
SELECT f.id, f.title, {k.stamp(f'coalesce(p.first_seen, {NOW})')} AS first_seen, p.id IS NULL AS is_new FROM fresh f LEFT JOIN postings p USING (id)
UNION ALL SELECT id, title, {k.stamp('first_seen')}, false FROM postings WHERE source_entry IN (SELECT source_entry FROM failed) AND id NOT IN (SELECT id FROM fresh)""", ("postings",))
def batch_rebuild(spark, sf_dir):
    before = live(spark, sf_dir)
    failed = before.filter("source_id % 7 = 3").select("source_entry")
    return maintain.rebuild(before, _fresh(spark, sf_dir), failed, as_of()).select("id", "title", stamp("first_seen").alias("first_seen"), "is_new")


@query(f"""WITH {_FRESH}, f AS (SELECT *, o % 2 = 0 AS approx, CASE WHEN o % 2 = 0 THEN {NOW} - to_days(3) ELSE TIMESTAMP '2001-07-01' END AS ts FROM fresh WHERE source_id % 7 <> 3),
j AS (SELECT coalesce(p.id, f.id) AS id, p.id IS NOT NULL AS was, f.id IS NOT NULL AS now, p.status AS old_status, p.description AS old_description, f.description AS new_description,
  p.posted_at_ts AS old_ts, f.ts, f.approx, p.title AS old_title, f.title AS new_title, p.first_seen, p.closed_at, p.source_id % 7 <> 3 AS ok, p.last_seen FROM postings p FULL JOIN f ON p.id = f.id),
a AS (SELECT *, CASE WHEN was AND NOT now AND ok AND old_status IN ('open', 'duplicate') THEN 'closed' WHEN NOT was THEN 'inserted' WHEN now AND old_status = 'closed' THEN 'reopened' WHEN now THEN 'updated' ELSE 'kept' END AS action FROM j)
SELECT id, action, CASE action WHEN 'closed' THEN 'closed' WHEN 'inserted' THEN 'open' WHEN 'reopened' THEN 'open' ELSE old_status END AS status, CASE WHEN now THEN new_title ELSE old_title END AS title,
coalesce(nullif(new_description, ''), old_description) AS description, {k.stamp("CASE WHEN now AND approx AND old_ts IS NOT NULL THEN least(old_ts, ts) ELSE coalesce(ts, old_ts) END")} AS posted_at_ts,
{k.stamp(f'coalesce(first_seen, {NOW})')} AS first_seen, {k.stamp(f'CASE WHEN now THEN {NOW} ELSE last_seen END')} AS last_seen,
{k.stamp(f"CASE action WHEN 'closed' THEN {NOW} WHEN 'reopened' THEN NULL ELSE closed_at END")} AS closed_at FROM a""", ("postings",))
def live_reconcile(spark, sf_dir):
    """Sources 3 in 7 failed: nothing of theirs may change."""
    before = keyed(spark, sf_dir)
    fetched = _fresh(spark, sf_dir).filter("source_id % 7 <> 3")
    ok = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id")).filter("source_id % 7 <> 3")
    out = maintain.reconcile(before, maintain.derived(fetched, as_of()), ok, as_of())
    return out.select("id", "action", "status", "title", "description", *[stamp(c).alias(c) for c in ("posted_at_ts", "first_seen", "last_seen", "closed_at")])


@query(f"""WITH {SWEPT} SELECT id, status, duplicate_of, status <> old_status OR duplicate_of IS NOT NULL AS changed FROM swept""", ("postings",))
def dedup_sweep(spark, sf_dir):
    return maintain.dedup_sweep(keyed(spark, sf_dir)).select("id", "status", "duplicate_of", "changed")


@query("SELECT count(*) AS changed_again FROM postings WHERE false", ("postings",))
def dedup_sweep_again(spark, sf_dir):
    """A sweep over a sweep's result changes nothing."""
    return maintain.dedup_sweep(swept(spark, sf_dir)).agg(F.count_if("changed").alias("changed_again"))


@query(f"""SELECT p.id, CASE WHEN f THEN s.company ELSE p.company END AS company, CASE WHEN f THEN s.category ELSE p.category END AS category, f AND (p.company, p.category) IS DISTINCT FROM (s.company, s.category) AS changed
FROM (SELECT *, {k.precedence()} = 0 AS direct FROM postings) p JOIN sources s ON s.id = p.source_id, LATERAL (SELECT direct AS f)""", ("postings", "sources"))
def source_sync(spark, sf_dir):
    return maintain.source_sync(live(spark, sf_dir), _sources(spark, sf_dir)).select("id", "company", "category", "changed")


@query(f"SELECT id, {k.company_key()} AS company_key, {k.company_key()} IS DISTINCT FROM CASE WHEN source_id % 2 = 0 THEN company END AS changed FROM postings", ("postings",))
def company_key_refresh(spark, sf_dir):
    rows = live(spark, sf_dir).withColumn("company_key", F.when(F.col("source_id") % 2 == 0, F.col("company")))
    return maintain.refresh_company_key(rows).select("id", "company_key", "changed")


@query(f"""SELECT id, s AS cycle_season, CAST(y AS VARCHAR) AS cycle_year, a AS work_arrangement, s <> cycle_season OR y IS DISTINCT FROM cycle_year OR a <> work_arrangement AS changed FROM
(SELECT id, cycle_season, cycle_year, work_arrangement, {k.season()} AS s, {k.year()} AS y, coalesce(nullif(work_arrangement, ''), {k.from_location()}) AS a FROM postings)""", ("postings",))
def cycle_sweep(spark, sf_dir):
    return maintain.cycle_sweep(live(spark, sf_dir)).select("id", "cycle_season", F.col("cycle_year").cast("string").alias("cycle_year"), "work_arrangement", "changed")


@query(f"""SELECT id, {k.stamp('coalesce(t, posted_at_ts)')} AS posted_at_ts, CASE WHEN t IS NULL THEN posted_at_approx ELSE x END AS posted_at_approx,
t IS NOT NULL AND (t, x) IS DISTINCT FROM (posted_at_ts, posted_at_approx) AS changed FROM (SELECT *, {k.posted_ts()} AS t, {k.posted_approx()} AS x FROM postings)""", ("postings",))
def posted_at_backfill(spark, sf_dir):
    return maintain.backfill_posted_at(live(spark, sf_dir)).select("id", stamp("posted_at_ts").alias("posted_at_ts"), "posted_at_approx", "changed")


_CHECKS = """checks AS (SELECT id AS cid, CASE o % 7 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 503 WHEN 3 THEN 403 WHEN 4 THEN 200 WHEN 5 THEN 410 END AS code, CASE WHEN o % 7 = 4 THEN 'Sorry, this Job has been CLOSED.' END AS body
FROM (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS o FROM postings) WHERE o % 8 < 7)"""


def _outcomes(spark, sf_dir):
    rows = live(spark, sf_dir).select("id", F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("o")).filter("o % 8 < 7")
    code = "CASE o % 7 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 503 WHEN 3 THEN 403 WHEN 4 THEN 200 WHEN 5 THEN 410 END"
    return rows.selectExpr("id", f"{code} AS status_code", "CASE WHEN o % 7 = 4 THEN 'Sorry, this Job has been CLOSED.' END AS body")


_LIVE = f"""{_CHECKS}, l AS (SELECT p.*, code, CASE WHEN cid IS NULL THEN NULL WHEN code IN (404, 410) OR (ats = 'workday' AND code = 403) OR (ats <> 'workday' AND code = 200 AND contains(lower(body), 'this job has been closed')) THEN 'closed'
WHEN code = 200 THEN 'alive' ELSE 'deferred' END AS liveness FROM postings p LEFT JOIN checks ON id = cid)"""


@query(f"""WITH {_LIVE} SELECT id, liveness, CASE WHEN liveness = 'closed' AND status = 'open' THEN 'closed' ELSE status END AS status,
CASE liveness WHEN 'alive' THEN 0 WHEN 'deferred' THEN liveness_attempts + 1 ELSE liveness_attempts END AS liveness_attempts,
{k.stamp(f"CASE liveness WHEN 'alive' THEN CASE WHEN posted_at_ts < {NOW} - to_days(180) THEN {NOW} + to_days(7) ELSE {NOW} + to_days(30) END WHEN 'deferred' THEN {k.backoff('liveness_attempts', vocab.LIVENESS_BACKOFF_HOURS, NOW)} ELSE liveness_next_check_at END")} AS next_check,
{k.stamp(f"CASE WHEN liveness = 'alive' OR (liveness = 'closed' AND status = 'open') THEN {NOW} ELSE liveness_checked_at END")} AS checked_at FROM l""", ("postings",))
def liveness_sweep(spark, sf_dir):
    out = maintain.apply_liveness(live(spark, sf_dir), _outcomes(spark, sf_dir), as_of())
    return out.select("id", "liveness", "status", "liveness_attempts", stamp("liveness_next_check_at").alias("next_check"), stamp("liveness_checked_at").alias("checked_at"))


@query(f"""WITH {_LIVE} SELECT 'expired' AS kind, company, 'HTTP ' || CASE WHEN code IN (404, 410) THEN code ELSE 404 END || ' on the posting''s own URL -- no longer applicable' AS detail, count(*) AS n
FROM l WHERE liveness = 'closed' AND status = 'open' GROUP BY ALL""", ("postings",))
def expired_activity(spark, sf_dir):
    outcomes = _outcomes(spark, sf_dir)
    rows = maintain.apply_liveness(live(spark, sf_dir), outcomes, as_of())
    return maintain.expired_log(rows, outcomes, as_of()).groupBy("kind", "company", "detail").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT id AS oid, CASE WHEN n % 6 = 0 THEN NULL ELSE 'https://d/' || n END AS u, CASE n % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 200 END AS code, CASE n % 3 WHEN 0 THEN 'text ' || n WHEN 1 THEN '' END AS t
FROM (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INT) AS n FROM postings WHERE description IS NULL)),
j AS (SELECT p.*, oid, CASE WHEN oid IS NULL THEN 'none' WHEN u IS NULL OR code IN (403, 404, 410) THEN 'final' WHEN code = 200 AND t IS NOT NULL THEN 'got' ELSE 'later' END AS what, t FROM postings p LEFT JOIN o ON id = oid)
SELECT id, CASE what WHEN 'final' THEN '' WHEN 'got' THEN t ELSE description END AS description, CASE what WHEN 'later' THEN description_attempts + 1 ELSE description_attempts END AS description_attempts,
{k.stamp(f"CASE what WHEN 'later' THEN {k.backoff('description_attempts', vocab.DESCRIPTION_BACKOFF_HOURS, NOW)} ELSE description_next_attempt_at END")} AS next_attempt FROM j""", ("postings",))
def description_fetches(spark, sf_dir):
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("int")
    o = live(spark, sf_dir).filter("description IS NULL").select("id", n.alias("n")).selectExpr(
        "id", "CASE WHEN n % 6 = 0 THEN NULL ELSE 'https://d/' || n END AS url",
        "CASE n % 5 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 200 END AS status_code", "CASE n % 3 WHEN 0 THEN 'text ' || n WHEN 1 THEN '' END AS text")
    out = maintain.apply_descriptions(live(spark, sf_dir), o, as_of())
    return out.select("id", "description", "description_attempts", stamp("description_next_attempt_at").alias("next_attempt"))


@query("""SELECT id, CASE WHEN m THEN category ELSE job_function END AS job_function, CASE WHEN m THEN '' ELSE category END AS category, m AS changed
FROM (SELECT *, ats = 'muse' AND job_function = '' AND category <> '' AS m FROM postings)""", ("postings",))
def axis_move(spark, sf_dir):
    return maintain.move_axis(live(spark, sf_dir)).select("id", "job_function", "category", "changed")


# --- sources ------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT id FROM sources WHERE status IN ('probation','active') AND next_scrape_at <= {RUNS_NOW} ORDER BY next_scrape_at, id LIMIT 20)
SELECT id, {k.stamp(f'CASE WHEN id IN (SELECT id FROM c) THEN {RUNS_NOW} + to_seconds(scrape_interval_seconds) ELSE next_scrape_at END')} AS next_scrape_at FROM sources""", ("sources",))
def claimed_sources_advance(spark, sf_dir):
    s = _sources(spark, sf_dir)
    now = as_of(RUNS_AS_OF)
    return maintain.advance(s, ranking.claim(s, "sources", 20, now), now).select("id", stamp("next_scrape_at").alias("next_scrape_at"))


_QUIET = "quiet AS (SELECT * REPLACE (CASE WHEN source_id % 3 = 0 THEN true ELSE ok END AS ok, CASE WHEN source_id % 3 = 0 THEN 0 ELSE fetched_count END AS fetched_count) FROM runs)"


def _quiet(spark, sf_dir):
    """Runs in which every third source is always fine and empty."""
    q = F.col("source_id") % 3 == 0
    return bound(spark, sf_dir, "runs").withColumns({
        "ok": F.when(q, True).otherwise(F.col("ok")), "fetched_count": F.when(q, 0).otherwise(F.col("fetched_count"))})


@query(f"""WITH {_QUIET}, r AS (SELECT source_id, count(*) AS n, count(*) FILTER (ok AND fetched_count = 0) AS e FROM (SELECT * FROM quiet QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) <= 10) GROUP BY source_id)
SELECT id, CASE WHEN h THEN 86400 ELSE scrape_interval_seconds END AS scrape_interval_seconds, {k.stamp(f'CASE WHEN h THEN {RUNS_NOW} + to_days(1) ELSE next_scrape_at END')} AS next_scrape_at, h AS changed
FROM (SELECT s.*, coalesce(n >= 10 AND e = n AND status = 'active' AND scrape_interval_seconds < 86400, false) AS h FROM sources s LEFT JOIN r ON r.source_id = s.id)""", ("sources", "runs"))
def empty_board_backoff(spark, sf_dir):
    out = maintain.empty_board_backoff(_sources(spark, sf_dir), _quiet(spark, sf_dir), as_of(RUNS_AS_OF))
    return out.select("id", "scrape_interval_seconds", stamp("next_scrape_at").alias("next_scrape_at"), "changed")


_RUN_OUT = f"""o AS (SELECT c_custkey AS oid, c_custkey % 5 < 2 AS ok, CASE WHEN c_custkey % 5 >= 2 THEN 'boom' END AS err FROM customer WHERE c_custkey % 6 <> 4),
a AS (SELECT s.*, ok, err, CASE WHEN ok AND status = 'probation' AND last_scraped_at IS NOT NULL THEN 'confirmed' WHEN NOT ok AND status = 'probation' THEN 'removed'
WHEN NOT ok AND consecutive_failures + 1 >= 5 AND status <> 'disabled' THEN 'disabled' END AS event FROM sources s LEFT JOIN o ON oid = id)"""


def _run_outcomes(spark, sf_dir):
    return given(spark, sf_dir, "customer").filter("c_custkey % 6 <> 4").selectExpr(
        "c_custkey AS source_id", "c_custkey % 5 < 2 AS ok", "CASE WHEN c_custkey % 5 >= 2 THEN 'boom' END AS error", f"TIMESTAMP '{RUNS_AS_OF}' AS finished_at")


@query(f"""WITH {_RUN_OUT} SELECT id, event, CASE event WHEN 'confirmed' THEN 'active' WHEN 'disabled' THEN 'disabled' ELSE status END AS status,
CASE WHEN ok THEN 0 WHEN NOT ok THEN consecutive_failures + 1 ELSE consecutive_failures END AS consecutive_failures, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'error' ELSE last_scrape_status END AS last_scrape_status,
CASE WHEN ok IS NULL THEN last_scrape_error ELSE err END AS last_scrape_error, {k.stamp(f'CASE WHEN ok IS NULL THEN last_scraped_at ELSE {RUNS_NOW} END')} AS last_scraped_at FROM a""", ("sources",))
def run_outcomes(spark, sf_dir):
    out = maintain.apply_runs(_sources(spark, sf_dir), _run_outcomes(spark, sf_dir))
    return out.select("id", "event", "status", "consecutive_failures", "last_scrape_status", "last_scrape_error", stamp("last_scraped_at").alias("last_scraped_at"))


@query(f"""WITH {_RUN_OUT} SELECT company, 'rejected' AS what, '{{"error":"boom","stage":"probation_confirmation"}}' AS detail FROM a WHERE event = 'removed'
UNION ALL SELECT company, 'disabled', consecutive_failures + 1 || ' consecutive failures, last error: boom' FROM a WHERE event = 'disabled'""", ("sources",))
def run_outcome_records(spark, sf_dir):
    out = maintain.apply_runs(_sources(spark, sf_dir), _run_outcomes(spark, sf_dir))
    now = as_of(RUNS_AS_OF)
    rejected = maintain.probation_rejects(out, now).select("company", F.col("review_status").alias("what"), F.col("evidence").alias("detail"))
    return rejected.unionByName(maintain.disabled_log(out, now).select("company", F.col("kind").alias("what"), "detail"))


@query(f"""SELECT id, CASE WHEN b THEN 'probation' ELSE status END AS status, CASE WHEN b THEN 0 ELSE consecutive_failures END AS consecutive_failures, {k.stamp(f'CASE WHEN b THEN {RUNS_NOW} ELSE next_scrape_at END')} AS next_scrape_at
FROM (SELECT *, status = 'disabled' AND id % 3 = 0 AS b FROM sources)""", ("sources",))
def reinstatements(spark, sf_dir):
    s = _sources(spark, sf_dir)
    verdicts = s.select("id", (F.col("id") % 3 == 0).alias("passed"))
    return maintain.reinstate(s, verdicts, as_of(RUNS_AS_OF)).select("id", "status", "consecutive_failures", stamp("next_scrape_at").alias("next_scrape_at"))


@query("SELECT 'reinstated' AS kind, company, 'was disabled, now probation' AS detail FROM sources WHERE status = 'disabled' AND id % 3 = 0", ("sources",))
def transition_activity(spark, sf_dir):
    s = _sources(spark, sf_dir)
    after = maintain.reinstate(s, s.select("id", (F.col("id") % 3 == 0).alias("passed")), as_of(RUNS_AS_OF))
    return maintain.events_from(s, after, as_of(RUNS_AS_OF)).select("kind", "company", "detail")


_RESULTS = """results AS (SELECT company AS token, 'Sector ' || id % 4 AS category, CASE id % 5 WHEN 0 THEN 'Renamed ' || id WHEN 1 THEN 'Customer#00000000' || (id + 9) % 10 WHEN 2 THEN 'Same ' || id % 20 END AS company_name FROM sources WHERE id % 3 < 2
UNION ALL SELECT 'nobody ' || id, 'x', NULL FROM sources WHERE id % 100 = 0)"""
_RENAMED = f"""{_RESULTS}, m AS (SELECT s.*, r.token, r.category AS rcat, coalesce(r.company_name, r.token) AS newname FROM sources s LEFT JOIN results r ON r.token = s.company AND s.added_by = 'discovery'),
c AS (SELECT *, token IS NOT NULL AND newname <> company AND (EXISTS (SELECT 1 FROM sources s WHERE s.company = newname AND s.ats = m.ats AND s.id <> m.id)
  OR EXISTS (SELECT 1 FROM m x WHERE x.token IS NOT NULL AND x.newname <> x.company AND x.newname = m.newname AND x.ats = m.ats AND x.id < m.id)) AS clash FROM m)"""


def _results(spark, sf_dir):
    s = _sources(spark, sf_dir)
    name = "CASE id % 5 WHEN 0 THEN 'Renamed ' || id WHEN 1 THEN 'Customer#00000000' || (id + 9) % 10 WHEN 2 THEN 'Same ' || id % 20 END AS company_name"
    known = s.filter("id % 3 < 2").selectExpr("company AS token", "'Sector ' || id % 4 AS category", name)
    return known.unionByName(s.filter("id % 100 = 0").selectExpr("'nobody ' || id AS token", "'x' AS category", "CAST(NULL AS STRING) AS company_name"))


@query(f"""WITH {_RENAMED} SELECT id, CASE WHEN clash THEN 'collision' WHEN token IS NOT NULL THEN 'updated' END AS outcome, CASE WHEN token IS NOT NULL AND NOT clash THEN newname ELSE company END AS company,
CASE WHEN token IS NOT NULL AND NOT clash THEN rcat ELSE category END AS category, CASE WHEN token IS NOT NULL AND NOT clash THEN newname END AS config_company, 't' || id AS config_tenant FROM c""", ("sources",))
def categorisations(spark, sf_dir):
    out = maintain.apply_categories(_sources(spark, sf_dir), _results(spark, sf_dir))
    return out.select("id", "outcome", "company", "category", F.get_json_object("config", "$.company").alias("config_company"), F.get_json_object("config", "$.tenant").alias("config_tenant"))


@query(f"WITH {_RESULTS} SELECT token FROM results WHERE token NOT IN (SELECT company FROM sources WHERE added_by = 'discovery')", ("sources",))
def unmatched_categorisations(spark, sf_dir):
    return maintain.unmatched_results(_sources(spark, sf_dir), _results(spark, sf_dir)).select("token")


@query("""WITH p AS (SELECT *, CASE id % 4 WHEN 0 THEN upper(company) WHEN 1 THEN 'Better ' || id % 30 WHEN 2 THEN 't' || (id - id % 4) END AS n FROM sources WHERE id % 7 < 5),
r AS (SELECT s.*, CASE WHEN lower(p.n) <> lower(s.company) THEN p.n END AS n FROM sources s LEFT JOIN p USING (id)),
c AS (SELECT *, n IS NOT NULL AND (EXISTS (SELECT 1 FROM sources s WHERE s.company = r.n AND s.ats = r.ats AND s.id <> r.id) OR EXISTS (SELECT 1 FROM r x WHERE x.n = r.n AND x.ats = r.ats AND x.id < r.id)) AS clash FROM r)
SELECT id, CASE WHEN clash THEN 'collision' WHEN n IS NOT NULL THEN 'applied' END AS outcome, CASE WHEN n IS NOT NULL AND NOT clash THEN n ELSE company END AS company FROM c""", ("sources",))
def resolved_names(spark, sf_dir):
    s = _sources(spark, sf_dir)
    proposals = s.filter("id % 7 < 5").selectExpr("id", "CASE id % 4 WHEN 0 THEN upper(company) WHEN 1 THEN 'Better ' || id % 30 WHEN 2 THEN 't' || (id - id % 4) END AS name")
    return maintain.apply_names(s, proposals).select("id", "outcome", "company")


@query(f"""WITH d AS (SELECT source_id, {k.strip(k.sub(k.strip('company'), r"(?:,?\s+(?:L\.?L\.?C|LLC|Incorporated|Inc|Corporation|Corp|Ltd|Limited|PLC|Co)\.?\.?)+$", "", "i"))} AS name FROM postings),
v AS (SELECT source_id, name FROM d WHERE name <> '' GROUP BY source_id, name QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, name) = 1)
SELECT s.id, s.company, v.name FROM sources s JOIN v ON v.source_id = s.id WHERE ats = 'workday' AND status IN ('active','probation') AND company = 't' || id AND lower(name) <> lower(company)
AND EXISTS (SELECT 1 FROM postings p WHERE p.source_id = s.id AND p.status = 'open')""", ("postings", "sources"))
def name_proposals(spark, sf_dir):
    rows = live(spark, sf_dir)
    details = rows.select("source_id", F.col("company").alias("organisation"))
    return maintain.name_proposals(_sources(spark, sf_dir), rows, details, as_of(RUNS_AS_OF)).select("id", "company", "name")


# --- candidates ------------------------------------------------------------------------


@query("""SELECT company, review_status, ats FROM candidates UNION ALL SELECT DISTINCT company, 'unchecked', 'workday' FROM sources WHERE id % 4 = 0 AND company NOT IN (SELECT company FROM candidates)""", ("candidates", "sources"))
def seeded_candidates(spark, sf_dir):
    names = _sources(spark, sf_dir).filter("id % 4 = 0").select("company", F.lit("workday").alias("ats"), "config")
    return maintain.seed_candidates(_candidates(spark, sf_dir), names.unionByName(names)).select("company", "review_status", "ats")


_VERDICT = """v AS (SELECT id AS vid, id % 5 > 0 AS hit, id % 5 = 1 AS passed, CASE id % 5 WHEN 2 THEN 'no_internship_titles' WHEN 3 THEN 'zero_postings' WHEN 4 THEN 'name_mismatch' END AS code FROM candidates WHERE id % 6 < 5),
j AS (SELECT c.*, vid IS NOT NULL AS judged, CASE WHEN NOT hit THEN 'no_match' WHEN passed THEN 'promoted' WHEN vid IS NOT NULL THEN 'rejected' END AS outcome, code FROM candidates c LEFT JOIN v ON vid = id)"""


def _judged(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    v = c.filter("id % 6 < 5").selectExpr(
        "id", "id % 5 > 0 AS hit", "id % 5 = 1 AS passed", "CASE id % 5 WHEN 2 THEN 'no_internship_titles' WHEN 3 THEN 'zero_postings' WHEN 4 THEN 'name_mismatch' END AS code",
        "'lever' AS ats", "'{\"token\":\"x\"}' AS config", "'{\"total\":1}' AS evidence")
    return maintain.apply_verdicts(c, v, as_of(RUNS_AS_OF))


@query(f"""WITH {_VERDICT} SELECT id, outcome, coalesce(outcome, review_status) AS review_status, CASE WHEN outcome IN ('promoted', 'rejected') THEN 'lever' ELSE ats END AS ats, CASE WHEN judged THEN 1 ELSE probe_set_version END AS probe_set_version,
{k.stamp(f"CASE WHEN outcome = 'no_match' THEN {RUNS_NOW} + to_days(90) WHEN outcome = 'rejected' THEN {RUNS_NOW} + to_days(CASE code WHEN 'no_internship_titles' THEN 14 WHEN 'zero_postings' THEN 30 ELSE 90 END) ELSE next_check_at END")} AS next_check_at FROM j""", ("candidates",))
def candidate_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", "outcome", "review_status", "ats", "probe_set_version", stamp("next_check_at").alias("next_check_at"))


@query(f"""WITH {_VERDICT} SELECT company, 'source' AS what, 'probation' AS detail FROM j WHERE outcome = 'promoted' AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.company = j.company AND s.ats = 'lever')
UNION ALL SELECT company, 'promoted', 'auto-promoted to probation via lever' FROM j WHERE outcome = 'promoted'""", ("candidates", "sources"))
def promotions(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    new = maintain.promoted_sources(judged, _sources(spark, sf_dir)).select("company", F.lit("source").alias("what"), F.col("status").alias("detail"))
    return new.unionByName(maintain.promoted_log(judged, as_of(RUNS_AS_OF)).select("company", F.col("kind").alias("what"), "detail"))


# --- constraints -------------------------------------------------------------------------


@query("""SELECT 'status is not allowed' AS rule, count(*) AS rows FROM postings WHERE status = 'duplicate' UNION ALL SELECT 'company is missing', count(*) FROM postings WHERE company = ''
UNION ALL SELECT 'id is not unique', CAST(sum(n) AS BIGINT) FROM (SELECT source_entry, count(*) AS n FROM postings GROUP BY 1 HAVING n > 1)""", ("postings",))
def constraint_violations(spark, sf_dir):
    rows = live(spark, sf_dir).withColumns({
        "id": F.col("source_entry"), "company": F.nullif(F.col("company"), F.lit("")), "status": F.when(F.col("status") == "duplicate", "weird").otherwise(F.col("status"))})
    return maintain.violations(rows, schema.RULES["postings"])


@query("SELECT id FROM postings WHERE source_id % 5 = 0", ("postings",))
def orphaned_postings(spark, sf_dir):
    parents = _sources(spark, sf_dir).filter("id % 5 > 0")
    return maintain.orphans(live(spark, sf_dir), parents, "source_id").select("id")


@query("SELECT id, CASE WHEN source_id % 5 > 0 THEN source_id END AS source_id FROM postings", ("postings",))
def cleared_orphans(spark, sf_dir):
    parents = _sources(spark, sf_dir).filter("id % 5 > 0")
    return maintain.clear_orphans(live(spark, sf_dir), parents, "source_id").select("id", "source_id")
