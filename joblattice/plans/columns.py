"""Registered queries: one column function each, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions import classify, cycle, dates, identity, places, text, titles
from joblattice.operators.facets import name_similarity
from joblattice.operators.standardize import standardize_posting
from joblattice.plans import checks as k
from joblattice.plans.bindings import AS_OF, as_of, given, unkeyed
from joblattice.plans.registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, STAMP)


def scalar(name: str, columns, sql: dict, table: str = "postings", key: str = "id"):
    """A query giving ``key`` and some computed columns of every row of a table."""
    logical = table in ("postings", "sources", "runs", "candidates")

    def run(spark, sf_dir):
        df = unkeyed(spark, sf_dir, table) if logical else given(spark, sf_dir, table)
        return df.select(key, *[c.alias(n) for n, c in columns().items()])

    body = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    query(f"SELECT {key}, {body} FROM {table}", (table,) if logical else (), name)(run)


scalar("intern_titles", lambda: {"is_intern": text.is_internship("title")},
       {"is_intern": k.has("lower(title)", vocab.INTERN_WORDS)})

_KEYWORDS = ["freight", "logistics", "c++", "real estate", "brokers"]
scalar("keyword_matches", lambda: {"hit": text.matches_any("description_snippet", _KEYWORDS)},
       {"hit": k.has("lower(description_snippet)", [w for w in _KEYWORDS if w != "c++"])})

scalar("job_functions", lambda: {"fn": classify.job_function()}, {"fn": k.job_function()})
scalar("location_arrangements", lambda: {"arrangement": classify.arrangement_from_location()},
       {"arrangement": k.from_location()})
scalar("standard_arrangements", lambda: {"arrangement": classify.standardize_arrangement()},
       {"arrangement": k.standard_arrangement()})
scalar("normalised_arrangements", lambda: {"arrangement": classify.normalise_arrangement(F.concat("work_arrangement", F.lit(" ")))},
       {"arrangement": k.normalised_arrangement("work_arrangement || ' '")})
scalar("picked_arrangements", lambda: {"arrangement": classify.pick_arrangement()},
       {"arrangement": f"coalesce(nullif(work_arrangement, ''), {k.from_location()})"})
scalar("title_cycles", lambda: {"season": cycle.parse_cycle()["season"], "year": cycle.parse_cycle()["year"].cast("string")},
       {"season": k.season(), "year": f"CAST({k.year()} AS VARCHAR)"})
scalar("standard_cycles", lambda: {
    "season": cycle.standardize_cycle()["season"], "year": cycle.standardize_cycle()["year"].cast("string")},
    {"season": k.standard_season(), "year": f"CAST({k.standard_year()} AS VARCHAR)"})
scalar("industries", lambda: {"industry": classify.infer_category()}, {"industry": k.industry()})
scalar("posted_dates", lambda: {"posted": stamp(dates.parse_posted_at()["ts"]), "approx": dates.parse_posted_at()["approx"]},
       {"posted": k.stamp(k.posted_ts()), "approx": k.posted_approx()})
scalar("company_keys", lambda: {"key": identity.company_key()}, {"key": k.company_key()})
scalar("dedup_keys", lambda: {"key": identity.dedup_key()}, {"key": k.dedup_key()})
scalar("source_precedence", lambda: {"precedence": identity.precedence()}, {"precedence": k.precedence()})
scalar("slugs", lambda: {"slug": text.slug("company")}, {"slug": k.sub("lower(company)", "[^a-z0-9]")})
scalar("legal_names", lambda: {"name": text.clean_legal_name("company")},
       {"name": k.strip(k.sub(k.strip("company"), rf"(?:,?\s+(?:{'|'.join(s.replace('.', r'\.?') for s in vocab.REGISTERED_SUFFIXES)})\.?\.?)+$", "", "i"))})
scalar("names_without_ledger_codes", lambda: {"name": text.drop_ledger_code("company")},
       {"name": k.strip(k.sub("company", r"^\s*\d{2,6}[\s\-:]+", "", ""))})
scalar("safe_ids", lambda: {"safe_id": identity.safe_id()}, {"safe_id": "substring(sha256(id), 1, 20)"})
scalar("detail_urls", lambda: {
    "workday": identity.workday_detail_url("id", F.lit("acme"), F.lit("wd5"), F.col("source_entry")),
    "smartrecruiters": identity.smartrecruiters_detail_url("id", F.lit("acme")),
    "liveness": identity.workday_liveness_url()},
    {"workday": "CASE WHEN len(string_split(id, ':')) >= 4 THEN 'https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/' || source_entry || string_split(id, ':')[4] END",
     "smartrecruiters": "'https://api.smartrecruiters.com/v1/companies/acme/postings/' || regexp_extract(id, '^[^:]*:[^:]*:(.*)$', 1)",
     "liveness": "CASE WHEN len(string_split(id, ':')) >= 4 THEN 'https://' || string_split(id, ':')[2] || '.wd5.myworkdayjobs.com/wday/cxs/' || string_split(id, ':')[2] || '/' || string_split(id, ':')[3] || string_split(id, ':')[4] END"})
scalar("too_old", lambda: {"old_30": dates.is_too_old(days=30, as_of=as_of()), "old_400": dates.is_too_old(days=400, as_of=as_of())},
       {f"old_{n}": f"coalesce(posted_at_ts, first_seen) < TIMESTAMP '{AS_OF}' - to_days({n})" for n in (30, 400)})
scalar("retry_times", lambda: {
    "liveness": stamp(dates.backoff("liveness_attempts", vocab.LIVENESS_BACKOFF_HOURS, as_of())),
    "description": stamp(dates.backoff("description_attempts", vocab.DESCRIPTION_BACKOFF_HOURS, as_of()))},
    {"liveness": k.stamp(k.backoff("liveness_attempts", vocab.LIVENESS_BACKOFF_HOURS, f"TIMESTAMP '{AS_OF}'")),
     "description": k.stamp(k.backoff("description_attempts", vocab.DESCRIPTION_BACKOFF_HOURS, f"TIMESTAMP '{AS_OF}'"))})
scalar("iso_times", lambda: {"iso": dates.iso_text("first_seen"), "rfc": dates.rfc3339("first_seen")},
       {"iso": "strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ')", "rfc": "strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ')"})
scalar("xml_texts", lambda: {"body": text.xml_escape("company"), "attribute": text.xml_attribute(F.concat("company", F.lit('"<'), "title"))},
       {"body": "replace(replace(replace(company, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
        "attribute": "CASE WHEN contains(company || title, '''') THEN '\"' || replace(replace(replace(company || '\"<' || title, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') || '\"' "
                     "ELSE '''' || replace(replace(company || '\"<' || title, '&', '&amp;'), '<', '&lt;') || '''' END"})
_SPREAD = r"^(?:[\s\p{Z}]|[,/|:;-])+|(?:[\s\p{Z}]|[,/|:;-])+$"
_PLACE = k.squeeze(k.sub(k.sub("location", rf"\b(?:remote|hybrid|on-?site|virtual|flexible)\b", "", "gi"), _SPREAD))
scalar("map_places", lambda: {"place": places.map_place()},
       {"place": f"CASE WHEN NOT {k.rx(_PLACE, r'^(?:united states of america|united states|usa|us|n/?a|\d+\s+locations?|multiple locations?|not specified)?$', 'i')} THEN {_PLACE} END"})
scalar("recheck_waits", lambda: {"days": dates.recheck_days(F.regexp_replace(F.get_json_object("evidence", "$.reason"), " .*", "_postings"))},
       {"days": "CASE WHEN json_extract_string(evidence, '$.reason') LIKE 'zero %' THEN 30 ELSE 90 END"}, "candidates")
scalar("json_fields", lambda: {"k": text.json_field("props", "$.k").cast("int"), "missing": text.json_field("props", "$.x")},
       {"k": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "missing": "json_extract_string(props, '$.x')"}, "events", "event_id")

_ENTITIES = {"&amp;": "&", "&middot;": "·", "&copy;": "©", "&quot;": '"', "&lt;": "<", "&gt;": ">"}


def _unescaped(expr: str) -> str:
    """The entities the pages hold, twice over; ``&amp;amp;`` does not occur."""
    for raw, plain in [(r, p) for r, p in _ENTITIES.items() if r != "&amp;"] + [("&amp;", "&")]:
        expr = f"replace({expr}, {k.lit(raw)}, {k.lit(plain)})"
    return expr


_TAGLESS = k.sub(_unescaped("html"), "<[^>]+>", " ")
scalar("unescaped_pages", lambda: {"plain": F.md5(text.unescape_html("html"))}, {"plain": f"md5({_unescaped('html')})"}, "pages", "page_id")
scalar("stripped_pages", lambda: {"plain": text.strip_html("html")}, {"plain": k.squeeze(_TAGLESS)}, "pages", "page_id")
_DISPLAY = k.sub(_unescaped("html"), r"<li\b[^>]*>", "\n• ", "gi")
_DISPLAY = k.sub(_DISPLAY, r"</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)\s*>|<br\s*/?>", "\n", "gi")
_DISPLAY = k.sub(k.sub(k.sub(k.sub(_DISPLAY, "<[^>]+>"), r"[ \t\r\f\p{Z}]+", " "), " *\n *", "\n"), r"\n{3,}", "\n\n")
scalar("page_texts", lambda: {"plain": text.display_text("html"), "n": F.length(text.display_text("html"))},
       {"plain": k.strip(_DISPLAY), "n": f"length({k.strip(_DISPLAY)})"}, "pages", "page_id")
scalar("gone_pages", lambda: {"gone": text.is_gone_page(F.concat("text", F.when(F.col("doc_id") % 5 == 0, " This Posting has EXPIRED").otherwise("")))},
       {"gone": "regexp_matches(lower(text), '" + "|".join(k.esc(p).replace("'", "''") for p in vocab.GONE_PHRASES) + "') OR doc_id % 5 = 0"}, "documents", "doc_id")


@query(f"WITH {k.location_steps('postings', keep='id, location')} SELECT id, place FROM placed", ("postings",))
def standard_locations(spark, sf_dir):
    return places.standardize_location(unkeyed(spark, sf_dir, "postings").select("id", "location"), into="place").select("id", "place")


@query(f"SELECT id, {k.company_name()} AS name FROM postings", ("postings",))
def company_names(spark, sf_dir):
    return classify.company_name(unkeyed(spark, sf_dir, "postings").select("id", "company"), into="name").select("id", "name")


@query(f"SELECT id, {k.title()} AS shown FROM postings", ("postings",))
def display_titles(spark, sf_dir):
    return titles.clean_title(unkeyed(spark, sf_dir, "postings").select("id", "title"), into="shown").select("id", "shown")


_CODE = r"^[A-Za-z0-9_-]{3,25}$"


@query(f"""
WITH read AS (SELECT id, title AS raw_title, location, description_snippet, category,
       {k.standard_arrangement()} AS work_arrangement, {k.job_function()} AS job_function,
       {k.standard_season()} AS cycle_season, {k.standard_year()} AS cycle_year,
       CASE WHEN lower(company) = 'globalhr' THEN 'Pratt & Whitney' ELSE {k.company_name()} END AS company, ats,
       lower(company) = 'globalhr' AS tenant FROM postings),
{k.location_steps('read')}
SELECT id, {k.title('raw_title')} AS title, company, place AS location, ats, work_arrangement, job_function, cycle_season,
       CAST(cycle_year AS VARCHAR) AS cycle_year,
       CASE WHEN tenant THEN 'prattwhitney' ELSE coalesce(nullif({k.sub('lower(company)', '[^a-z0-9]+')}, ''), 'unidentified') END AS company_key,
       CASE WHEN {k.rx('trim(description_snippet)', _CODE)} THEN '' ELSE description_snippet END AS description_snippet,
       CASE WHEN tenant THEN 'Aerospace & Defense' ELSE {k.industry()} END AS category FROM placed
""", ("postings",))
def standardized_postings(spark, sf_dir):
    return standardize_posting(unkeyed(spark, sf_dir, "postings")).select(
        "id", "title", "company", "location", "ats", "work_arrangement", "job_function", "cycle_season",
        F.col("cycle_year").cast("string").alias("cycle_year"), "company_key", "description_snippet", "category")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN place = '' THEN 'Remote' ELSE 'Remote - ' || place END ELSE place END AS place,
       CASE WHEN c_custkey % 5 = 0 THEN 'hybrid' WHEN c_custkey % 3 = 0 THEN 'remote' ELSE '' END AS arrangement
FROM (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 > 0 THEN trim(c_name) END, CASE WHEN c_custkey % 7 > 0 THEN lower(r_name) END,
      CASE WHEN c_custkey % 4 > 1 THEN upper(n_name) END], lambda x: x IS NOT NULL), ', ') AS place
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
""")
def joined_locations(spark, sf_dir):
    c, n, r = (given(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = F.col("c_custkey")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    city = F.when(key % 4 > 0, F.concat(F.col("c_name"), F.lit(" "))).otherwise(" ")
    region = F.when(key % 7 > 0, F.lower("r_name"))
    country = F.when(key % 4 > 1, F.lower("n_name")).otherwise("")
    return rows.select(
        "c_custkey", places.join_location(city, region, country, key % 3 == 0).alias("place"),
        places.flag_arrangement(key % 5 == 0, (key % 5 == 0) | (key % 3 == 0)).alias("arrangement"))


def _name_pairs(spark, sf_dir):
    """Each nation, as candidate, against the company names of every 25th source's postings."""
    picked = F.pmod(F.col("source_id"), F.lit(25)).cast("int")
    pairs = unkeyed(spark, sf_dir, "postings").select(picked.alias("nation"), "company").distinct()
    n = given(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return pairs.join(n, "nation").select(
        F.col("n_name").alias("candidate"), F.concat(F.lower("n_name"), F.lit(" works")).alias("candidate_name"), "company")


@query(f"""
SELECT candidate, max(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0
       ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END) AS name_similarity
FROM (SELECT DISTINCT n_name AS candidate, regexp_replace(lower(n_name || ' works'), '[^a-z0-9]', '', 'g') AS a,
      regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS b FROM postings JOIN nation ON source_id % 25 = n_nationkey)
GROUP BY candidate
""", ("postings",))
def name_edit_similarities(spark, sf_dir):
    return name_similarity(_name_pairs(spark, sf_dir), edits=True)


@query(f"""
WITH RECURSIVE named AS (SELECT DISTINCT n_name AS candidate, regexp_replace(lower(n_name || ' works'), '[^a-z0-9]', '', 'g') AS a,
      regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS b FROM postings JOIN nation ON source_id % 25 = n_nationkey),
pairs AS (SELECT DISTINCT a, b FROM named), {k.matched_blocks('pairs')}
SELECT candidate, max({k.RATIO}) AS name_similarity FROM named JOIN matched USING (a, b) GROUP BY candidate
""", ("postings",))
def name_similarities(spark, sf_dir):
    """By common blocks, as the verification gate compares names."""
    return name_similarity(_name_pairs(spark, sf_dir))
