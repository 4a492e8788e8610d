"""Registered queries: filters, feed pages, search, joins, facets, summaries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.stem import with_stem
from joblattice.operators import entities, facets, filters, maintain, ranking, search, subscriptions
from joblattice.operators.skew import TASK_TEXTS
from joblattice.plans import checks as k
from joblattice.plans.bindings import AS_OF, RUNS_AS_OF, as_of, bound, given, spread, stored_once, unkeyed
from joblattice.plans.columns import stamp
from joblattice.plans.feed import feed, feed_rows, feed_total
from joblattice.plans.registry import query
from joblattice.session import shared_dir

NOW = f"TIMESTAMP '{AS_OF}'"
RUNS_NOW = f"TIMESTAMP '{RUNS_AS_OF}'"

PRESETS = {
    "default": filters.FilterSpec(
        name="Freight", keywords_any=["freight", "logistics", "supply chain", "warehouse"], exclude_keywords=["sales"],
        trusted_companies=["Acme Corporation", "sunworks"], locations_exclude=["toronto"]),
    "software": filters.FilterSpec(keywords_any=["software engineer", "machine learning"], max_age_days=300),
    "texas": filters.FilterSpec(keywords_any=["intern"], locations_include=["TX", "houston"]),
    "nothing": filters.FilterSpec(),
}


def any_of(expr: str, words) -> str:
    return k.has(f"lower({expr})", words) if words else "false"


def spec_sql(s: filters.FilterSpec) -> str:
    body = "title || ' ' || description_snippet"
    trusted = k.among("company", s.trusted_companies) if s.trusted_companies else "false"
    age = f"coalesce(posted_at_ts, first_seen) < {NOW} - to_days({s.max_age_days})" if s.max_age_days else "false"
    inside = any_of("location", s.locations_include) if s.locations_include else "true"
    return (
        f"(({trusted}) OR {any_of(body, s.keywords_any)}) AND NOT {any_of(body, s.exclude_keywords)} "
        f"AND NOT {any_of('location', s.locations_exclude)} AND NOT ({age}) AND {inside}"
    )


def keyed(spark, sf_dir):
    """Postings with their comparison keys, as stored."""
    return bound(spark, sf_dir, "postings")


def live(spark, sf_dir):
    """Postings as landed, before keys are set."""
    return unkeyed(spark, sf_dir, "postings")


KEYED = f"keyed AS (SELECT *, {k.dedup_key()} AS dedup_key, {k.company_key()} AS company_key FROM postings)"
# What the duplicate sweep must produce, by ranking where the sweep aggregates.
SWEPT = f"""{KEYED}, ranked AS (SELECT id, row_number() OVER w AS rn, first_value(id) OVER w AS winner FROM keyed
    WHERE status IN ('open', 'duplicate') AND dedup_key IS NOT NULL
    WINDOW w AS (PARTITION BY dedup_key ORDER BY {k.precedence()}, first_seen, id)),
swept AS (SELECT keyed.* EXCLUDE (status, duplicate_of), CASE WHEN rn IS NULL THEN status WHEN rn = 1 THEN 'open' ELSE 'duplicate' END AS status,
    CASE WHEN rn > 1 THEN winner END AS duplicate_of, status AS old_status FROM keyed LEFT JOIN ranked USING (id))"""
FEED_ORDER = "posted_at_ts DESC NULLS LAST, first_seen DESC, id"


def swept(spark, sf_dir):
    return maintain.dedup_sweep(keyed(spark, sf_dir)).drop("changed")


# --- presets, axes, cycles ---------------------------------------------------


@query(f"SELECT id FROM postings WHERE {spec_sql(PRESETS['default'])}", ("postings",))
def preset_filter(spark, sf_dir):
    return live(spark, sf_dir).filter(filters.passes(PRESETS["default"], as_of())).select("id")


_OVER = PRESETS["default"].override(keywords_any=["hydrology"], locations_include=["NY", "paris"])


@query(f"SELECT id FROM postings WHERE {spec_sql(_OVER)}", ("postings",))
def preset_override(spark, sf_dir):
    spec = filters.resolve_preset(None, PRESETS, keywords_any=["hydrology"], locations_include=["NY", "paris"])
    return live(spark, sf_dir).filter(filters.passes(spec, as_of())).select("id")


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS preset FROM postings WHERE {spec_sql(s)}" for n, s in PRESETS.items()), ("postings",))
def preset_membership(spark, sf_dir):
    return filters.apply_presets(live(spark, sf_dir), PRESETS, as_of()).select("id", "preset")


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS preset FROM postings WHERE {spec_sql(s)}" for n, s in PRESETS.items()), ("postings",))
def preset_subscriptions(spark, sf_dir):
    rows = subscriptions.preset_rows(spark, PRESETS)
    return subscriptions.apply_subscriptions(live(spark, sf_dir), rows, as_of()).select("id", "preset")


@query("SELECT id FROM postings WHERE category = 'Retail' AND job_function = 'Data Science' AND work_arrangement = 'onsite'", ("postings",))
def axis_filters(spark, sf_dir):
    return filters.axis_filter(live(spark, sf_dir), "Retail", "Data Science", " OnSite ").select("id")


@query("""SELECT id, CASE WHEN cycle_season = 'summer' AND cycle_year = 2027 THEN 0 ELSE 1 END AS cycle_order FROM postings
WHERE (cycle_season = 'summer' AND cycle_year = 2027) OR (cycle_season = '' AND cycle_year IS NULL)""", ("postings",))
def cycle_filters(spark, sf_dir):
    return filters.cycle_filter(live(spark, sf_dir), "Summer", 2027).select("id", "cycle_order")


@query("SELECT count(*) AS unstated_cycle FROM postings WHERE cycle_season = '' AND cycle_year IS NULL", ("postings",))
def unstated_cycles(spark, sf_dir):
    return filters.unstated_count(live(spark, sf_dir))


@query("SELECT id FROM postings WHERE contains(lower(company), 'co') OR contains(lower(title), 'co')", ("postings",))
def substring_matches(spark, sf_dir):
    return filters.substring_search(live(spark, sf_dir), " CO ").select("id")


# --- feed pages ---------------------------------------------------------------


@query(f"""SELECT id, row_number() OVER (ORDER BY {FEED_ORDER}) AS position FROM postings
WHERE status = 'open' AND {spec_sql(PRESETS['default'])} ORDER BY position LIMIT 200""", ("postings",))
def feed_page(spark, sf_dir):
    return feed(live(spark, sf_dir), as_of(), spec=PRESETS["default"]).select("id", "position")


@query(f"""SELECT id, row_number() OVER (ORDER BY o, {FEED_ORDER}) AS position FROM (SELECT *,
CASE WHEN cycle_year = 2027 THEN 0 WHEN cycle_season = '' AND cycle_year IS NULL THEN 1 END AS o FROM postings
WHERE status = 'open' AND NOT coalesce(posted_at_ts, first_seen) < {NOW} - to_days(900)) WHERE o IS NOT NULL
ORDER BY position LIMIT 150 OFFSET 300""", ("postings",))
def feed_page_by_cycle(spark, sf_dir):
    return feed(live(spark, sf_dir), as_of(), 150, 300, cycle_year=2027, max_age_days=900).select("id", "position")


@query(f"""SELECT count(*) AS total, count(*) FILTER (o = 1) AS unstated_cycle FROM (SELECT
CASE WHEN cycle_season = 'fall' THEN 0 WHEN cycle_season = '' AND cycle_year IS NULL THEN 1 END AS o FROM postings
WHERE status = 'open' AND category = 'Retail') WHERE o IS NOT NULL""", ("postings",))
def feed_totals(spark, sf_dir):
    return feed_total(live(spark, sf_dir), as_of(), category="Retail", cycle_season="fall")


@query(f"""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {FEED_ORDER}) AS n FROM postings WHERE status = 'open')
WHERE n BETWEEN 101 AND 200""", ("postings",))
def feed_page_after_key(spark, sf_dir):
    """The second hundred, found from the hundredth row rather than by offset."""
    rows = live(spark, sf_dir).filter("status = 'open'").select("id", "posted_at_ts", "first_seen")
    last = rows.orderBy(*ranking.feed_order()).offset(99).limit(1).first()
    return ranking.page_after(rows, last.asDict(), 100).select("id")


@query("SELECT id, false AS truncated FROM postings WHERE status = 'open'", ("postings",))
def feed_source_rows(spark, sf_dir):
    rows, flag = ranking.capped(live(spark, sf_dir).filter("status = 'open'").select("id", "posted_at_ts", "first_seen"))
    return rows.select("id", flag.scalar().alias("truncated"))


@query("""SELECT id, row_number() OVER (ORDER BY coalesce(nullif(category, ''), 'Uncategorized'), first_seen DESC, id) AS position
FROM postings ORDER BY position LIMIT 500""", ("postings",))
def category_listing(spark, sf_dir):
    return ranking.page(live(spark, sf_dir).select("id", "category", "first_seen"), ranking.category_order(), 500).select("id", "position")


@query(f"""WITH {SWEPT} SELECT d.id, d.title, d.ats AS source, c.id AS canonical_id, c.company AS canonical_company, c.ats AS canonical_source,
row_number() OVER (ORDER BY d.first_seen DESC, d.id) AS position
FROM swept d LEFT JOIN swept c ON c.id = d.duplicate_of WHERE d.status = 'duplicate' AND (contains(lower(d.company), 'a') OR contains(lower(d.title), 'a'))
ORDER BY position LIMIT 500""", ("postings",))
def duplicates_page(spark, sf_dir):
    return entities.duplicates_audit(swept(spark, sf_dir), "a", 500).select("id", "title", "source", "canonical_id", "canonical_company", "canonical_source", "position")


@query("""SELECT id, company, ats, review_status, json_extract_string(evidence, '$.reason') AS reason,
row_number() OVER (ORDER BY checked_at DESC NULLS FIRST, id DESC) AS position FROM candidates
WHERE contains(lower(company), '1') ORDER BY position LIMIT 200""", ("candidates",))
def candidates_page(spark, sf_dir):
    rows = entities.candidates_page(bound(spark, sf_dir, "candidates"), "1")
    return ranking.page(rows, entities.candidates_order(), 200).select("id", "company", "ats", "review_status", "reason", "position")


@query("SELECT DISTINCT ats FROM candidates WHERE ats <> ''", ("candidates",))
def candidate_platforms(spark, sf_dir):
    return entities.ats_options(bound(spark, sf_dir, "candidates"))


@query("""SELECT count(*) AS n, count(*) FILTER (review_status = 'rejected') AS rejected,
count(*) FILTER (review_status = 'promoted') AS promoted FROM candidates""", ("candidates",))
def candidate_totals(spark, sf_dir):
    return bound(spark, sf_dir, "candidates").agg(
        F.count("*").alias("n"), F.count_if(F.col("review_status") == "rejected").alias("rejected"),
        F.count_if(F.col("review_status") == "promoted").alias("promoted"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM events ORDER BY position LIMIT 50")
def activity_page(spark, sf_dir):
    log = given(spark, sf_dir, "events").select("event_id", "ts")
    return ranking.page(log, [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "position")


@query("SELECT id, row_number() OVER (PARTITION BY ats ORDER BY company, id) AS rank, count(*) OVER (PARTITION BY ats) > 250 AS truncated FROM sources QUALIFY rank <= 250", ("sources",))
def platform_sources(spark, sf_dir):
    return entities.ats_page(bound(spark, sf_dir, "sources"), 250).select("id", "rank", "truncated")


# --- work queues ---------------------------------------------------------------

_CLAIMS = {
    "sources": ("sources", RUNS_AS_OF, f"status IN ('probation','active') AND next_scrape_at <= {RUNS_NOW}", "next_scrape_at, id"),
    "descriptions": ("postings", AS_OF, f"status IN ('open','duplicate') AND description IS NULL AND (description_next_attempt_at IS NULL OR description_next_attempt_at <= {NOW})",
                     "description_next_attempt_at NULLS FIRST, first_seen DESC, id"),
    "liveness": ("postings", AS_OF, f"status = 'open' AND url <> '' AND (liveness_next_check_at IS NULL OR liveness_next_check_at <= {NOW})",
                 "liveness_next_check_at NULLS FIRST, posted_at_ts ASC NULLS LAST, id"),
    "candidates": ("candidates", RUNS_AS_OF, f"review_status = 'unchecked' OR (review_status IN ('no_match','rejected') AND (next_check_at <= {RUNS_NOW} OR probe_set_version < 1))",
                   "(review_status = 'unchecked') DESC, (probe_set_version >= 1) DESC, next_check_at, id"),
    "disabled": ("sources", RUNS_AS_OF, "status = 'disabled'", "last_scraped_at NULLS LAST, id"),
    "unresolved": ("sources", RUNS_AS_OF, "ats = 'workday' AND status IN ('active','probation') AND company = json_extract_string(config, '$.tenant')", "id"),
}


def _claim_query(name, table, now, where, order):
    @query(f"SELECT id, row_number() OVER (ORDER BY {order}) AS position FROM {table} WHERE {where} ORDER BY position LIMIT 100", (table,), f"claim_{name}")
    def run(spark, sf_dir):
        return ranking.claim(unkeyed(spark, sf_dir, table), name, 100, as_of(now)).select("id", "position")

    @query(f"SELECT id FROM {table} WHERE {where}", (table,), f"due_{name}")
    def due(spark, sf_dir):
        return ranking.due(unkeyed(spark, sf_dir, table), name, as_of(now)).select("id")


for _name, _spec in _CLAIMS.items():
    _claim_query(_name, *_spec)


# --- search ---------------------------------------------------------------------


def _texts(spark, sf_dir):
    return stored_once(spark, sf_dir, "texts", lambda: spread(given(spark, sf_dir, "documents"), TASK_TEXTS)).select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", F.substring_index("text", " ", 4)).alias("title"),
        F.col("lang").alias("location"), F.col("text").alias("description"))


INDEX = f"""texts AS (SELECT doc_id AS id, source || ' ' || array_to_string(string_split(text, ' ')[1:4], ' ') AS title, lang AS location, text AS description FROM documents),
fields AS (SELECT id, 'title' AS field, 1.0 AS weight, title AS body FROM texts UNION ALL SELECT id, 'location', 0.2, location FROM texts
           UNION ALL SELECT id, 'description', 0.1, description FROM texts),
listed AS (SELECT id, field, weight, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS words FROM fields),
placed AS (SELECT id, field, weight, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM listed),
said AS (SELECT * FROM placed WHERE NOT {k.among('word', search.STOP_WORDS)}), {k.stems('said')},
idx AS (SELECT id, field, weight, pos, term FROM said JOIN stems USING (word))"""


@query(f"WITH {INDEX} SELECT id, field, term, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM idx GROUP BY ALL")
def text_index(spark, sf_dir):
    return search.build_index(_texts(spark, sf_dir)).select(
        "id", "field", "term", F.size("positions").cast("long").alias("n"),
        F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


@query(f"""WITH {INDEX}, hits AS (SELECT id, term, sum(weight) AS w FROM (SELECT DISTINCT id, term, field, weight FROM idx) GROUP BY id, term)
SELECT id, CAST(round(sum(rank), 4) AS DOUBLE) AS rank FROM (
  SELECT id, w AS rank FROM hits WHERE term = 'fr' AND id NOT IN (SELECT id FROM hits WHERE term = 'que')
  UNION ALL SELECT a.id, a.w + b.w FROM hits a JOIN hits b USING (id) WHERE a.term = 'en' AND b.term = 'src4') GROUP BY id""")
def text_search(spark, sf_dir):
    return search.search_texts(_texts(spark, sf_dir), "FR -que OR en src4")


@query(f"""WITH {INDEX} SELECT id, CAST(round(sum(rank), 4) AS DOUBLE) AS rank FROM (
  SELECT id, 0.0 AS rank FROM texts WHERE id NOT IN (SELECT id FROM idx WHERE term = 'en')
  UNION ALL SELECT id, sum(weight) FROM (SELECT DISTINCT id, field, weight FROM idx WHERE term = 'src4') GROUP BY id) GROUP BY id""")
def negative_search(spark, sf_dir):
    """All texts without a word, or with another."""
    return search.search_texts(_texts(spark, sf_dir), "-en OR src4")


@query(f"""WITH {INDEX} SELECT id, CAST(round(sum(w), 4) AS DOUBLE) AS rank FROM (SELECT DISTINCT id, field, weight AS w FROM idx WHERE term = 'fr') GROUP BY id""")
def stored_index_search(spark, sf_dir):
    """From an index written once; the scan reads one bucket and one term."""
    path = f"{shared_dir(spark)}/index-{uuid4().hex}"
    search.write_index(search.build_index(_texts(spark, sf_dir), buckets=search.BUCKETS), path)
    return search.search(spark.read.parquet(path), "FR")


@query(f"""WITH {INDEX}, p AS (SELECT DISTINCT a.id, a.field, a.weight FROM idx a JOIN idx b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1
  WHERE a.term = 'les' AND b.term = 'de') SELECT id, CAST(round(sum(weight) * 2, 4) AS DOUBLE) AS rank FROM p GROUP BY id""")
def phrase_search(spark, sf_dir):
    return search.search_texts(_texts(spark, sf_dir), '"les de"')


@query(f"""WITH {INDEX}, hits AS (SELECT id, round(sum(weight), 4) AS rank FROM (SELECT DISTINCT id, field, weight FROM idx WHERE term = 'en') GROUP BY id)
SELECT id, coalesce(CAST(rank AS DOUBLE), 0) AS search_rank FROM texts LEFT JOIN hits USING (id) WHERE rank IS NOT NULL OR contains(lower(title), 'en')""")
def search_with_substrings(spark, sf_dir):
    texts = _texts(spark, sf_dir).withColumn("company", F.lit(""))
    return search.search_feed(texts, search.build_index(texts), "EN").select("id", "search_rank")


_PLACED = f"""{INDEX}, ends AS (SELECT id, coalesce(max(pos + 1) FILTER (field = 'title'), 0) AS t, coalesce(max(pos + 1) FILTER (field = 'location'), 0) AS l FROM said GROUP BY id),
spots AS (SELECT id, term, weight, pos + 1 + CASE field WHEN 'title' THEN 0 WHEN 'location' THEN t ELSE t + l END AS pos FROM idx JOIN ends USING (id))"""


@query(f"""WITH {_PLACED}, hits AS (SELECT id FROM spots GROUP BY id HAVING bool_or(term = 'en') AND bool_or(term = 'src4')),
pairs AS (SELECT a.id, a.weight * b.weight AS w, abs(a.pos - b.pos) AS d FROM spots a JOIN spots b ON a.id = b.id AND a.term = 'en' AND b.term = 'src4' AND a.pos <> b.pos SEMI JOIN hits h ON h.id = a.id)
SELECT id, round(1 - product(1 - sqrt(w * CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)), 6) AS rank FROM pairs GROUP BY id""")
def closeness_ranks(spark, sf_dir):
    return search.ranked_search(_texts(spark, sf_dir), "en src4").withColumn("rank", F.round("rank", 6))


@query(f"""WITH {_PLACED}, n AS (SELECT id, term, weight, row_number() OVER (PARTITION BY id, term ORDER BY pos) AS i FROM spots WHERE term IN ('en', 'src4', 'ing')),
each AS (SELECT id, term, (max(weight) + sum(weight / (i * i)) - max(weight) / pow(arg_min(i, (-weight, i)), 2)) / 1.64493406685 AS r FROM n GROUP BY id, term)
SELECT id, round(sum(r) / 3, 6) AS rank FROM each GROUP BY id""")
def frequency_ranks(spark, sf_dir):
    return search.ranked_search(_texts(spark, sf_dir), "en or src4 OR ing").withColumn("rank", F.round("rank", 6))


@query(f"""WITH {INDEX} SELECT word, term, count(*) AS n FROM said JOIN stems USING (word) GROUP BY ALL""")
def word_stems(spark, sf_dir):
    """Every word of the texts with its stem and how often it stands."""
    words = _texts(spark, sf_dir).select(F.explode(F.concat(*[search.words_of(c) for c in ("title", "location", "description")])).alias("word"))
    counts = words.filter(~F.col("word").isin(search.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))
    return with_stem(counts).select("word", "term", "n")


# --- joins ------------------------------------------------------------------------


@query("""SELECT p.id, s.company AS source_company, json_extract_string(s.config, '$.tenant') AS tenant
FROM postings p JOIN sources s ON p.source_id = s.id WHERE p.ats = 'workday'""", ("postings", "sources"))
def postings_with_sources(spark, sf_dir):
    return entities.with_source(live(spark, sf_dir), bound(spark, sf_dir, "sources"), "workday").select(
        "id", "source_company", F.get_json_object("config", "$.tenant").alias("tenant"))


@query(f"WITH {KEYED} SELECT id, dedup_key, count(*) OVER (PARTITION BY dedup_key) AS group_size FROM keyed WHERE dedup_key IS NOT NULL QUALIFY group_size > 1", ("postings",))
def listing_groups(spark, sf_dir):
    return entities.listing_groups(keyed(spark, sf_dir)).select("id", "dedup_key", "group_size")


@query(f"""WITH {KEYED} SELECT id, status, dedup_key, CASE WHEN dedup_key IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY dedup_key) - 1 END AS n_elsewhere FROM keyed""", ("postings",))
def also_listed(spark, sf_dir):
    """Other listings of every posting: its group and how many others are in it; the group's rows are the list."""
    return entities.also_listed_groups(keyed(spark, sf_dir)).select("id", "status", "dedup_key", "n_elsewhere")


@query(f"""WITH {KEYED}, asked AS (SELECT id AS asked_id, company_key FROM keyed WHERE company_key IS NOT NULL),
newest AS (SELECT id, company_key, posted_at_ts, row_number() OVER (PARTITION BY company_key ORDER BY posted_at_ts DESC NULLS LAST, id) AS n
FROM keyed WHERE status = 'open' AND company_key IS NOT NULL QUALIFY n <= 26)
SELECT asked_id, id, row_number() OVER (PARTITION BY asked_id ORDER BY n) AS rank FROM asked JOIN newest USING (company_key) WHERE id <> asked_id QUALIFY rank <= 25""", ("postings",))
def same_company(spark, sf_dir):
    """Every posting with its employer's 25 newest other open postings."""
    return entities.same_company(keyed(spark, sf_dir)).select("asked_id", "id", "rank")


@query(f"""WITH {KEYED}, newest AS (SELECT id, company_key, row_number() OVER (PARTITION BY company_key ORDER BY posted_at_ts DESC NULLS LAST, id) AS n
FROM keyed WHERE status = 'open' AND company_key IS NOT NULL QUALIFY n <= 26),
lists AS (SELECT company_key, string_agg(id, ' ' ORDER BY n) AS newest FROM newest GROUP BY company_key)
SELECT company_key, newest, count(*) AS members, count(*) FILTER (n IS NOT NULL) AS listed FROM keyed LEFT JOIN newest USING (company_key, id) JOIN lists USING (company_key) GROUP BY ALL""", ("postings",))
def company_lists(spark, sf_dir):
    """One short list per employer, and how many of its postings read it."""
    return entities.company_lists(keyed(spark, sf_dir)).select("company_key", F.array_join("newest", " ").alias("newest"), "members", "listed")


@query(f"""WITH {KEYED}, via AS (SELECT DISTINCT company_key, source_entry, ats, source_id FROM keyed WHERE company_key IS NOT NULL),
one AS (SELECT company_key, source_entry, ats, min(source_id) AS source_id FROM via GROUP BY ALL),
lr AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1)
SELECT company_key, source_entry, one.ats, s.status AS source_status, lr.ok AS last_run_ok, {k.stamp('lr.started_at')} AS last_run_at
FROM one LEFT JOIN sources s ON s.id = one.source_id LEFT JOIN lr ON lr.source_id = one.source_id""", ("postings", "sources", "runs"))
def company_reached_via(spark, sf_dir):
    rows = entities.reached_via(keyed(spark, sf_dir), bound(spark, sf_dir, "sources"), bound(spark, sf_dir, "runs"))
    return rows.select("company_key", "source_entry", "ats", "source_status", "last_run_ok", stamp("last_run_started_at").alias("last_run_at"))


@query("""SELECT s.id, (SELECT max_by(p.id, (p.first_seen, p.id)) FROM postings p WHERE p.source_id = s.id AND p.status = 'open') AS sample_posting_id FROM sources s""",
       ("postings", "sources"))
def sample_postings(spark, sf_dir):
    return entities.sample_posting(bound(spark, sf_dir, "sources"), live(spark, sf_dir)).select("id", "sample_posting_id")


@query("""SELECT c.company, c.ats FROM (SELECT company, coalesce(ats, 'greenhouse') AS ats FROM candidates UNION ALL SELECT upper(company), ats FROM sources WHERE status = 'disabled'
UNION ALL SELECT company, 'nowhere' FROM sources) c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE lower(s.company) = lower(c.company) AND s.ats = c.ats)""", ("candidates", "sources"))
def seeds_not_yet_sources(spark, sf_dir):
    c, s = bound(spark, sf_dir, "candidates"), bound(spark, sf_dir, "sources")
    seeds = (
        c.select("company", F.coalesce("ats", F.lit("greenhouse")).alias("ats"))
        .unionByName(s.filter("status = 'disabled'").select(F.upper("company").alias("company"), "ats"))
        .unionByName(s.select("company", F.lit("nowhere").alias("ats"))))
    return entities.not_yet_sources(seeds, s)


@query(f"""WITH {KEYED} SELECT source_id, id, rank, n > 200 AS truncated FROM (SELECT source_id, id, count(*) OVER (PARTITION BY source_id) AS n,
row_number() OVER (PARTITION BY source_id ORDER BY {FEED_ORDER}) AS rank FROM keyed WHERE status = 'open') WHERE rank <= 200""", ("postings",))
def source_pages(spark, sf_dir):
    return entities.source_page(keyed(spark, sf_dir)).select("source_id", "id", "rank", "truncated")


@query(f"""WITH {KEYED} SELECT company_key, id, status, rank, n > 200 AS truncated FROM (SELECT company_key, id, status, count(*) OVER (PARTITION BY company_key) AS n,
row_number() OVER (PARTITION BY company_key ORDER BY status = 'open' DESC, {FEED_ORDER}) AS rank FROM keyed WHERE company_key IS NOT NULL) WHERE rank <= 200""", ("postings",))
def company_pages(spark, sf_dir):
    return entities.company_page(keyed(spark, sf_dir)).select("company_key", "id", "status", "rank", "truncated")


# --- facets and summaries -----------------------------------------------------------


def _facet_sql(table, axes):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS axis, CAST({a} AS VARCHAR) AS value, count(*) AS open_postings FROM {table} WHERE status = 'open' AND {a} IS NOT NULL AND CAST({a} AS VARCHAR) <> '' GROUP BY {a}"
        for a in axes)


@query(f"WITH {SWEPT} {_facet_sql('swept', ['category', 'job_function', 'work_arrangement'])}", ("postings",))
def facets_after_dedup(spark, sf_dir):
    return facets.facets(swept(spark, sf_dir))


@query(_facet_sql("postings", ["category", "job_function", "work_arrangement"]), ("postings",))
def axis_facets(spark, sf_dir):
    return facets.facets(live(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (category <> '') AS with_industry, count(*) FILTER (job_function <> '') AS with_function,
count(*) FILTER (cycle_year IS NOT NULL OR cycle_season <> '') AS with_cycle, count(*) FILTER (work_arrangement <> '') AS with_arrangement
FROM postings WHERE status = 'open'""", ("postings",))
def axis_coverage(spark, sf_dir):
    return facets.coverage(live(spark, sf_dir))


@query(_facet_sql("postings", ["cycle_year", "cycle_season"]), ("postings",))
def cycle_counts(spark, sf_dir):
    return facets.cycle_counts(live(spark, sf_dir))


@query(f"""WITH {KEYED} SELECT source_id, count(*) AS total, count(*) FILTER (status = 'open') AS open, count(DISTINCT company_key) AS companies,
count(DISTINCT company_key) > 1 AS is_aggregator FROM keyed GROUP BY source_id""", ("postings",))
def source_statistics(spark, sf_dir):
    return facets.source_stats(keyed(spark, sf_dir))


@query(f"""WITH {KEYED} SELECT source_id, company_key, company, count(*) AS n, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, company_key, company) AS rank
FROM keyed WHERE status = 'open' AND company_key IS NOT NULL GROUP BY source_id, company_key, company""", ("postings",))
def source_employers(spark, sf_dir):
    return facets.source_employers(keyed(spark, sf_dir)).drop("truncated")


@query(f"""WITH {KEYED}, s AS (SELECT ats, count(*) AS sources, count(*) FILTER (status = 'active') AS active FROM sources GROUP BY ats),
p AS (SELECT ats, count(*) FILTER (status = 'open') AS open_postings, count(DISTINCT company_key) AS companies,
      count(*) FILTER (status = 'open' AND description <> '') AS with_description FROM keyed GROUP BY ats)
SELECT ats, coalesce(sources, 0) AS sources, coalesce(active, 0) AS active, coalesce(open_postings, 0) AS open_postings,
coalesce(companies, 0) AS companies, coalesce(with_description, 0) AS with_description FROM s FULL JOIN p USING (ats)""", ("postings", "sources"))
def platform_statistics(spark, sf_dir):
    return facets.platform_stats(keyed(spark, sf_dir), bound(spark, sf_dir, "sources"))


@query(f"""WITH {KEYED}, n AS (SELECT company_key, company, count(*) AS n, count(*) FILTER (status = 'open') AS o FROM keyed WHERE company_key IS NOT NULL GROUP BY ALL)
SELECT company_key, arg_min(company, (-n, company)) AS display_name, string_agg(company, ' / ' ORDER BY company) AS name_variants, CAST(sum(o) AS BIGINT) AS open_count
FROM n GROUP BY company_key""", ("postings",))
def company_summaries(spark, sf_dir):
    return facets.company_summary(keyed(spark, sf_dir)).withColumn("name_variants", F.array_join("name_variants", " / "))


def _meta_sql(axis):
    off = {"category": "Uncategorized", "location": "Not Specified"}.get(axis)
    cut = f" AND {axis} <> '{off}'" if off else ""
    top = " QUALIFY row_number() OVER (ORDER BY count(*) DESC, location) <= 30" if axis == "location" else ""
    return f"SELECT '{axis}' AS axis, CAST({axis} AS VARCHAR) AS value, count(*) AS n FROM postings WHERE CAST({axis} AS VARCHAR) <> ''{cut} GROUP BY {axis}{top}"


@query(" UNION ALL ".join(f"({_meta_sql(a)})" for a in facets.META_AXES), ("postings",))
def metadata_facets(spark, sf_dir):
    return facets.metadata(live(spark, sf_dir))


@query("SELECT count(*) AS total_open_postings, count(DISTINCT nullif(company, '')) AS total_companies FROM postings WHERE status = 'open'", ("postings",))
def metadata_totals(spark, sf_dir):
    return facets.metadata_totals(live(spark, sf_dir).filter("status = 'open'"))


@query(f"""WITH {KEYED}, r AS (SELECT *, coalesce(company_key, lower(trim(company))) AS key FROM keyed WHERE trim(company) <> '')
SELECT key, arg_min(trim(company), (first_seen, id)) AS name, count(*) AS postings_count,
array_to_string(list_sort(list(DISTINCT ats)), '|') AS ats_platforms,
coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (category NOT IN ('', 'Uncategorized'))), '|'), '') AS categories,
coalesce(array_to_string(list_sort(list(DISTINCT location) FILTER (location NOT IN ('', 'Not Specified')))[1:5], '|'), '') AS locations_sample FROM r GROUP BY key""", ("postings",))
def company_directory(spark, sf_dir):
    lists = ["ats_platforms", "categories", "locations_sample"]
    return facets.company_directory(keyed(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in lists})


def _stat_sql(name):
    v = f"CAST(json_extract_string(evidence, '$.{name}') AS DOUBLE)"
    return (
        f"SELECT '{name}' AS section, review_status AS label, count({v}) AS n, round(min({v}), 2) AS min, round(max({v}), 2) AS max, round(avg({v}), 2) AS mean, "
        f"round(median({v}), 2) AS median FROM candidates WHERE review_status IN ('promoted', 'rejected') GROUP BY review_status")


@query(f"""SELECT 'review_status' AS section, review_status AS label, count(*) AS n, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median
FROM candidates WHERE checked_at IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'rejected_reason', json_extract_string(evidence, '$.reason'), count(*), NULL, NULL, NULL, NULL FROM candidates WHERE review_status = 'rejected' GROUP BY 2
UNION ALL {_stat_sql('name_similarity')} UNION ALL {_stat_sql('intern_count')}""", ("candidates",))
def evidence_summary(spark, sf_dir):
    return facets.evidence_summary(bound(spark, sf_dir, "candidates"))


def _promotable(spark, sf_dir):
    """Candidates, some of which carry a source's name and platform."""
    c = bound(spark, sf_dir, "candidates")
    return c.withColumn("company", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id"))).otherwise(F.col("company"))).withColumn("review_status", F.lit("promoted"))


@query("""WITH c AS (SELECT CASE WHEN id % 3 > 0 THEN 't' || id ELSE company END AS company, ats FROM candidates)
SELECT count(*) FILTER (s.status = 'active') AS confirmed_active, count(*) FILTER (s.status = 'probation') AS still_on_probation,
count(*) FILTER (s.id IS NULL) AS no_longer_in_sources FROM c LEFT JOIN sources s ON s.company = c.company AND s.ats = c.ats AND s.added_by = 'discovery'""", ("candidates", "sources"))
def confirmation_rates(spark, sf_dir):
    return facets.confirmation_rates(_promotable(spark, sf_dir), bound(spark, sf_dir, "sources"))


_GATE_NAMES = {"candidate": "'board ' || CAST(c_custkey AS STRING)", "candidate_name": "CASE WHEN c_custkey % 2 = 0 THEN 'Solar Power Group' ELSE 'Acme' END"}


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, 'board ' || c_custkey AS candidate, CASE WHEN c_custkey % 2 = 0 THEN 'solarpowergroup' ELSE 'acme' END AS a FROM customer),
f AS (SELECT source_entry AS candidate, id, title, company, {k.has('lower(title)', vocab.INTERN_WORDS)} AS i FROM postings),
m AS (SELECT candidate, count(*) AS total, count(*) FILTER (i) AS intern_count, count(DISTINCT title) AS distinct_titles FROM f GROUP BY candidate),
t AS (SELECT candidate, string_agg(title, '|' ORDER BY id) AS sample_titles FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY i DESC, id) AS n,
      bool_or(i) OVER (PARTITION BY candidate) AS any_i FROM f) WHERE n <= 5 AND i = any_i GROUP BY candidate),
b AS (SELECT candidate, a, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS b FROM c JOIN f USING (candidate) WHERE company <> ''),
pairs AS (SELECT DISTINCT a, b FROM b), {k.matched_blocks('pairs')},
s AS (SELECT candidate, max({k.RATIO}) AS sim FROM b JOIN matched USING (a, b) GROUP BY candidate)
SELECT candidate, coalesce(total, 0) AS total, coalesce(intern_count, 0) AS intern_count, coalesce(distinct_titles, 0) AS distinct_titles, sample_titles,
round(coalesce(sim, 0), 2) AS name_similarity, CASE WHEN total IS NULL THEN 'zero_postings' WHEN intern_count < 1 THEN 'no_internship_titles'
WHEN total >= 2 AND distinct_titles < 2 THEN 'not_distinct' WHEN coalesce(sim, 0) < {vocab.NAME_MATCH_THRESHOLD} THEN 'name_mismatch' ELSE 'ok' END AS code
FROM c LEFT JOIN m USING (candidate) LEFT JOIN t USING (candidate) LEFT JOIN s USING (candidate)""", ("postings",))
def verification_gate(spark, sf_dir):
    c = given(spark, sf_dir, "customer").selectExpr(*[f"{v} AS {n}" for n, v in _GATE_NAMES.items()])
    fetched = live(spark, sf_dir).select(F.col("source_entry").alias("candidate"), "id", "company", "title")
    return facets.verify_gate(c, fetched).select(
        "candidate", "total", "intern_count", "distinct_titles", F.array_join("sample_titles", "|").alias("sample_titles"), "name_similarity", "code")


@query(f"SELECT source_id, id, {k.stamp('started_at')} AS started, ok FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1", ("runs",))
def latest_runs(spark, sf_dir):
    return facets.latest_run(bound(spark, sf_dir, "runs")).select("source_id", "id", stamp("started_at").alias("started"), "ok")


@query("""SELECT source_id, count(*) AS runs, count(*) FILTER (ok AND fetched_count = 0) AS empty_ok, count(*) FILTER (NOT ok) AS failures
FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) <= 10) GROUP BY source_id""", ("runs",))
def recent_runs(spark, sf_dir):
    return facets.recent_runs(bound(spark, sf_dir, "runs"))


@query("""SELECT source_id, count(*) AS runs, CAST(sum(fetched_count) AS BIGINT) AS fetched, CAST(sum(internship_count) AS BIGINT) AS relevant,
count(*) FILTER (NOT ok) AS failed FROM runs GROUP BY source_id""", ("runs",))
def run_counts(spark, sf_dir):
    return facets.run_counts(bound(spark, sf_dir, "runs"))


@query(f"""SELECT count(*) AS open, count(*) FILTER (posted_at_ts >= {NOW} - to_days(7)) AS last_7_days, count(*) FILTER (posted_at_ts >= {NOW} - to_days(90)) AS last_90_days,
count(*) FILTER (posted_at_ts < {NOW} - to_days(365)) AS over_a_year, {k.stamp('min(posted_at_ts)')} AS oldest FROM postings WHERE status = 'open'""", ("postings",))
def corpus_age(spark, sf_dir):
    return facets.age_buckets(live(spark, sf_dir), as_of()).withColumn("oldest", stamp("oldest"))


@query("SELECT event_type AS outcome, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY 1")
def outcome_shares(spark, sf_dir):
    return facets.outcome_tally(given(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"))


@query("""SELECT source_id, company AS name, count(*) AS votes FROM (SELECT source_id, title AS company, id FROM postings QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) <= 7)
WHERE company <> '' GROUP BY source_id, company QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, company) = 1""", ("postings",))
def majority_names(spark, sf_dir):
    named = live(spark, sf_dir).select("source_id", "id", F.col("title").alias("name"))
    return facets.majority_vote(named, n=7, order=[F.asc("id")])


@query(f"SELECT substring(posted_at, 1, 24) AS prefix, count(*) AS n FROM postings WHERE posted_at IS NOT NULL AND ({k.posted_ts()}) IS NULL GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10", ("postings",))
def unparseable_dates(spark, sf_dir):
    return facets.unparseable_dates(live(spark, sf_dir))


@query("""SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM postings) AS rows_after, true AS matches
UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM runs WHERE ok), (SELECT count(*) FROM events) = (SELECT count(*) FROM runs WHERE ok)""", ("postings", "runs"))
def snapshot_counts(spark, sf_dir):
    return facets.reconcile_counts(
        {"orders": given(spark, sf_dir, "orders"), "events": given(spark, sf_dir, "events")},
        {"orders": live(spark, sf_dir), "events": bound(spark, sf_dir, "runs").filter("ok")})
