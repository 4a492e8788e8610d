"""Registered queries: landed payloads, pages, crawl lines, stores and exports.

The landed bodies are built from whole given tables, several jobs to a body,
and normalised back; the checking SQL computes the rows without any JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.operators import filters, ranking
from joblattice.operators.skew import TASK_ROWS
from joblattice.plans import checks as k
from joblattice.plans import export
from joblattice.plans.bindings import LOCATIONS, TITLES, CheckDialect, Dialect, as_of, bound, given, spread, stored_once
from joblattice.plans.browse import KEYED, NOW, PRESETS, keyed, live, spec_sql
from joblattice.plans.columns import stamp
from joblattice.plans.registry import query
from joblattice.sources import crawl, pages, payloads, store

_D, _C = Dialect(), CheckDialect()
JOBS = 3


def _title(d, i):
    return d.pick(TITLES, f"(o_orderkey + {i}) % {len(TITLES)}")


def _place(d, i):
    return d.pick(LOCATIONS, f"(o_orderkey + {i}) % {len(LOCATIONS)}")


HTML = "'&lt;p&gt;Team ' || o_orderpriority || ' &amp;amp; co&lt;/p&gt;'"
PLAIN = "'Team ' || o_orderpriority || ' & co'"


def _landed(spark, sf_dir, name, fields: dict, wrap, page="1"):
    """One body per order with JOBS jobs, stored as it landed; ``fields`` are Spark SQL of (i) per job field."""
    jobs = ", ".join(f"struct({', '.join(f'{f(i)} AS {n}' for n, f in fields.items())})" for i in range(JOBS))
    entry = "to_json(named_struct('company', 'Board ' || o_custkey % 50, 'token', 't' || o_custkey, 'tenant', 't' || o_custkey, 'wd_host', 'wd5', 'site', 'ext', 'host', 'h' || o_custkey, 'job_detail_base', 'https://x.example/job', 'category', 'Retail'))"
    return stored_once(spark, sf_dir, f"landed-{name}", lambda: spread(given(spark, sf_dir, "orders"), TASK_ROWS).selectExpr(
        "'entry ' || o_custkey AS source_entry", f"{entry} AS entry", f"{page} AS page", f"to_json({wrap(f'array({jobs})')}) AS payload"))


def _check(cols: dict, where: str = "true") -> str:
    body = ", ".join(f"{v} AS {n}" for n, v in cols.items())
    return f"SELECT {body} FROM (SELECT *, unnest(range({JOBS})) AS i FROM orders) WHERE {where}"


_COMMON = ["id", "company", "title", "location", "url", "posted_at", "description_snippet", "job_function", "work_arrangement", "source_entry"]


def _payload_query(name, fields, wrap, cols, where="true", page="1"):
    base = {
        "company": "'Board ' || o_custkey % 50", "title": _title(_C, "i"), "location": _place(_C, "i"), "job_function": "''",
        "work_arrangement": "''", "source_entry": "'entry ' || o_custkey", "description_snippet": PLAIN, **cols}

    @query(_check({c: base[c] for c in _COMMON}, where), name=f"payload_{name}")
    def run(spark, sf_dir):
        return payloads.normalize(_landed(spark, sf_dir, name, fields, wrap, page), name).select(*_COMMON)


_N = "o_orderkey * 3"
_DAY = ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')")

_payload_query("greenhouse", {
    "id": lambda i: f"{_N} + {i}", "title": lambda i: _title(_D, i), "location": lambda i: f"struct({_place(_D, i)} AS name)",
    "absolute_url": lambda i: f"'https://g.example/' || ({_N} + {i})", "updated_at": lambda i: _DAY[0], "content": lambda i: HTML},
    lambda a: f"struct({a} AS jobs)",
    {"id": f"'greenhouse:t' || o_custkey || ':' || ({_N} + i)", "url": f"'https://g.example/' || ({_N} + i)", "posted_at": _DAY[1]})

_payload_query("lever", {
    "id": lambda i: f"'L' || ({_N} + {i})", "text": lambda i: _title(_D, i), "categories": lambda i: f"struct({_place(_D, i)} AS location)",
    "hostedUrl": lambda i: f"'https://l.example/' || ({_N} + {i})", "createdAt": lambda i: "unix_millis(CAST(o_orderdate AS TIMESTAMP))",
    "descriptionPlain": lambda i: PLAIN, "description": lambda i: HTML},
    lambda a: a,
    {"id": f"'lever:t' || o_custkey || ':L' || ({_N} + i)", "url": f"'https://l.example/' || ({_N} + i)",
     "posted_at": "CAST(epoch_ms(o_orderdate) AS VARCHAR)"})

_payload_query("ashby", {
    "id": lambda i: f"CASE WHEN ({_N} + {i}) % 11 = 0 THEN NULL ELSE 'A' || ({_N} + {i}) END", "title": lambda i: f"' ' || {_title(_D, i)} || ' '",
    "location": lambda i: _place(_D, i), "isListed": lambda i: f"CASE WHEN ({_N} + {i}) % 7 = 0 THEN false WHEN ({_N} + {i}) % 7 = 1 THEN true END",
    "isRemote": lambda i: f"({_N} + {i}) % 2 = 0", "workplaceType": lambda i: f"CASE ({_N} + {i}) % 3 WHEN 0 THEN 'On-Site' WHEN 1 THEN 'weird' END",
    "jobUrl": lambda i: f"CASE WHEN ({_N} + {i}) % 5 = 0 THEN '' ELSE 'https://a.example/' || ({_N} + {i}) END",
    "applyUrl": lambda i: "'https://a.example/apply'", "publishedAt": lambda i: _DAY[0], "descriptionPlain": lambda i: PLAIN, "descriptionHtml": lambda i: HTML},
    lambda a: f"struct({a} AS jobs)",
    {"id": f"'ashby:t' || o_custkey || ':A' || ({_N} + i)", "url": f"CASE WHEN ({_N} + i) % 5 = 0 THEN 'https://a.example/apply' ELSE 'https://a.example/' || ({_N} + i) END",
     "posted_at": _DAY[1], "work_arrangement": f"CASE WHEN ({_N} + i) % 3 = 0 THEN 'onsite' WHEN ({_N} + i) % 2 = 0 THEN 'remote' ELSE '' END",
     "title": f"trim({_title(_C, 'i')})"},
    f"({_N} + i) % 11 <> 0 AND ({_N} + i) % 7 <> 0")

_payload_query("smartrecruiters", {
    "id": lambda i: f"'S' || ({_N} + {i})", "name": lambda i: _title(_D, i), "releasedDate": lambda i: _DAY[0],
    "function": lambda i: f"CASE WHEN ({_N} + {i}) % 3 = 0 THEN struct('Sales' AS label) END",
    "location": lambda i: f"struct('Reno ' AS city, CASE WHEN ({_N} + {i}) % 2 = 0 THEN 'NV' END AS region, 'us' AS country, ({_N} + {i}) % 5 < 2 AS remote, ({_N} + {i}) % 5 = 0 AS hybrid)"},
    lambda a: f"struct({JOBS} AS totalFound, {a} AS content)",
    {"id": f"'smartrecruiters:t' || o_custkey || ':S' || ({_N} + i)", "url": f"'https://jobs.smartrecruiters.com/t' || o_custkey || '/S' || ({_N} + i)",
     "posted_at": _DAY[1], "job_function": f"CASE WHEN ({_N} + i) % 3 = 0 THEN 'Sales' ELSE '' END",
     "location": f"CASE WHEN ({_N} + i) % 5 < 2 THEN 'Remote - ' ELSE '' END || CASE WHEN ({_N} + i) % 2 = 0 THEN 'Reno, NV, US' ELSE 'Reno, US' END",
     "work_arrangement": f"CASE ({_N} + i) % 5 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'remote' ELSE '' END", "description_snippet": "''"})

_payload_query("workday", {
    "title": lambda i: _title(_D, i), "externalPath": lambda i: f"'/job/' || ({_N} + {i})", "locationsText": lambda i: _place(_D, i),
    "postedOn": lambda i: "'Posted ' || o_orderkey % 40 || ' Days Ago'", "bulletFields": lambda i: f"CASE WHEN ({_N} + {i}) % 2 = 0 THEN array('<b>R-' || o_orderkey || '</b>', 'x') END"},
    lambda a: f"struct({JOBS} AS total, {a} AS jobPostings)",
    {"id": f"'workday:t' || o_custkey || ':ext:/job/' || ({_N} + i)", "url": f"'https://t' || o_custkey || '.wd5.myworkdayjobs.com/ext/job/' || ({_N} + i)",
     "posted_at": "'Posted ' || o_orderkey % 40 || ' Days Ago'", "description_snippet": f"CASE WHEN ({_N} + i) % 2 = 0 THEN 'R-' || o_orderkey ELSE '' END"})

_payload_query("oracle_recruiting", {
    "Id": lambda i: f"{_N} + {i}", "Title": lambda i: _title(_D, i), "PrimaryLocation": lambda i: _place(_D, i), "PostedDate": lambda i: _DAY[0],
    "ShortDescriptionStr": lambda i: "'<i>Short</i>'", "ExternalQualificationsStr": lambda i: f"CASE WHEN ({_N} + {i}) % 2 = 0 THEN '' END",
    "ExternalResponsibilitiesStr": lambda i: PLAIN},
    lambda a: f"struct(array(struct({JOBS} AS TotalJobsCount, {a} AS requisitionList)) AS items)",
    {"id": f"'oracle_recruiting:h' || o_custkey || ':' || ({_N} + i)", "url": f"'https://x.example/job/' || ({_N} + i)", "posted_at": _DAY[1],
     "description_snippet": f"'Short ' || {PLAIN}"})

_payload_query("rippling", {
    "id": lambda i: f"CASE WHEN {i} = 0 THEN 'r' || ({_N}) END", "uuid": lambda i: f"'u' || ({_N} + {i})", "name": lambda i: f"CASE WHEN {i} = 1 THEN '' ELSE {_title(_D, i)} END",
    "title": lambda i: f"CASE WHEN {i} = 1 AND o_orderkey % 2 = 0 THEN ' Yard Intern ' END",
    "location": lambda i: "struct(CASE WHEN o_orderkey % 3 > 0 THEN 'Reno' END AS city, CASE WHEN o_orderkey % 3 > 0 THEN 'NV' END AS region)",
    "workplaceType": lambda i: "CASE o_orderkey % 3 WHEN 0 THEN 'Fully REMOTE' WHEN 1 THEN 'hybrid_2' END",
    "url": lambda i: "CAST(NULL AS STRING)", "description": lambda i: HTML, "updated_at": lambda i: _DAY[0]},
    lambda a: f"struct({a} AS jobs)",
    {"id": f"'rippling:t' || o_custkey || ':' || CASE WHEN i = 0 THEN 'r' || ({_N}) ELSE 'u' || ({_N} + i) END",
     "url": f"'https://ats.rippling.com/t' || o_custkey || '/jobs/' || CASE WHEN i = 0 THEN 'r' || ({_N}) ELSE 'u' || ({_N} + i) END",
     "title": f"CASE WHEN i = 1 THEN 'Yard Intern' ELSE {_title(_C, 'i')} END", "location": "CASE WHEN o_orderkey % 3 > 0 THEN 'Reno, NV' ELSE 'Multiple Locations' END",
     "work_arrangement": "CASE o_orderkey % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE '' END", "posted_at": _DAY[1]},
    "i <> 1 OR o_orderkey % 2 = 0")


@query(f"""SELECT 'muse:' || (o_orderkey + i) AS id, {_title(_C, 'i')} AS title, 'Reno, ' || {_place(_C, 'i')} AS location, arg_max(q, (o_orderkey % 10, i)) AS job_function
FROM (SELECT *, unnest(range(3)) AS i, 'cat ' || o_orderkey % 10 AS q FROM orders) GROUP BY 1, 2, 3""")
def payload_muse(spark, sf_dir):
    """Neighbouring orders list the same jobs under different categories; the last category queried wins."""
    d = _D
    jobs = {"id": lambda i: f"o_orderkey + {i}", "name": lambda i: _title(d, i), "contents": lambda i: HTML, "company": lambda i: "struct('Acme' AS name)",
            "locations": lambda i: f"array(struct('Reno' AS name), struct({_place(d, i)} AS name))", "refs": lambda i: "struct('https://m.example' AS landing_page)"}
    raw = _landed(spark, sf_dir, "muse", jobs, lambda a: f"struct(1 AS page_count, {a} AS results)", "o_orderkey % 10")
    raw = raw.withColumn("query_category", F.concat(F.lit("cat "), "page"))
    return payloads.normalize(raw.withColumn("page", F.col("page").cast("int")), "muse", columns=("id", "title", "location", "job_function"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def unreadable_payloads(spark, sf_dir):
    """Every third body lacks its jobs."""
    raw = given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "'e' AS source_entry", "'{}' AS entry", "CASE WHEN o_orderkey % 3 = 0 THEN '{\"error\":1}' ELSE '{\"jobs\":[]}' END AS payload")
    return payloads.unreadable(raw, "greenhouse").select("o_orderkey")


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS page, l_orderkey % 60 + 1 AS total, l_quantity < 4 AS hollow FROM lineitem),
b AS (SELECT k, min(page) FILTER (hollow) AS stop, max(total) FILTER (page = 1) AS total FROM p GROUP BY k)
SELECT p.k, count(*) AS pages FROM p JOIN b USING (k) WHERE (page = 1 OR (page - 1) * 20 < b.total) AND page <= least(3, coalesce(stop, 3)) GROUP BY p.k""")
def workday_page_counts(spark, sf_dir):
    """Orders as boards, their lines as pages; only page 1 tells the true total."""
    raw = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.col("l_linenumber").alias("page")).selectExpr(
        "CAST(l_orderkey AS STRING) AS source_entry", "'{\"max_pages\": 3}' AS entry", "page",
        "'{\"total\":' || CASE WHEN page = 1 THEN l_orderkey % 60 + 1 ELSE 0 END || ',\"jobPostings\":' || CASE WHEN l_quantity < 4 THEN '[]}' ELSE '[{\"title\":\"x\"}]}' END AS payload")
    return payloads.workday_wanted_pages(raw).groupBy(F.col("source_entry").cast("long").alias("k")).agg(F.count("*").alias("pages"))


@query(f"SELECT source_entry, count(*) AS fetched, count(*) FILTER ({k.has('lower(title)', vocab.INTERN_WORDS)}) AS relevant FROM postings GROUP BY source_entry", ("postings",))
def fetch_report(spark, sf_dir):
    return payloads.run_report(live(spark, sf_dir))


@query("SELECT p.id, s.config AS entry FROM postings p LEFT JOIN sources s ON s.id = p.source_id AND s.id % 3 > 0", ("postings", "sources"))
def responses_with_entries(spark, sf_dir):
    """Every third source is unknown; its responses stay, without an entry."""
    raw = live(spark, sf_dir).select("id", "source_id")
    return payloads.attach_entries(raw, bound(spark, sf_dir, "sources").filter("id % 3 > 0")).select("id", "entry")


# --- pages --------------------------------------------------------------------


def _tagged_pages(spark, sf_dir):
    """The pages with linked data put into their heads; every fourth has only broken or other blocks."""
    other = "<script type=\"application/ld+json\">{\"@type\": \"WebPage\"}</script><script type='application/ld+json'>{broken</script>"
    job = (
        "'<script type=\"application/ld+json\">{\"@type\": \"JobPosting\", \"title\": \"Intern ' || page_id || '\", \"datePosted\": \"2026-07-09\", "
        "\"identifier\": {\"value\": ' || page_id || '}, \"hiringOrganization\": {\"name\": \"Org ' || page_id % 5 || '\"}, \"jobLocation\": {\"address\": "
        "{\"addressLocality\": \"Reno\", \"addressRegion\": {\"name\": \"NV\"}, \"addressCountry\": \"\"}}, \"description\": \"<p>Do &amp; learn</p>\"}</script>'")
    return given(spark, sf_dir, "pages").selectExpr(
        "page_id", "'entry ' || page_id % 7 AS source_entry", "'{\"company\": \"Entry Co\", \"category\": \"Retail\"}' AS entry", "url",
        f"replace(html, '</head>', {_D.text(other)} || CASE WHEN page_id % 4 > 0 THEN {job} ELSE '' END || '</head>') AS html")


@query("""SELECT 'jsonld:Entry Co:' || page_id AS id, 'Org ' || page_id % 5 AS company, 'Intern ' || page_id AS title, 'Reno, NV' AS location, url,
'2026-07-09' AS posted_at, 'Do & learn' AS description, 'entry ' || page_id % 7 AS source_entry FROM pages WHERE page_id % 4 > 0""")
def linked_data_postings(spark, sf_dir):
    return pages.extract_jobposting(_tagged_pages(spark, sf_dir)).select(
        "id", "company", "title", "location", "url", "posted_at", "description", "source_entry")


@query("""SELECT page_id, CASE WHEN page_id % 4 > 0 THEN 'jsonld' WHEN page_id % 8 = 0 THEN 'microdata' END AS markup FROM pages""")
def page_markup(spark, sf_dir):
    mark = F.when(F.col("page_id") % 8 == 0, '<div itemtype="https://schema.org/JobPosting">').otherwise("")
    return _tagged_pages(spark, sf_dir).select("page_id", pages.classify_markup(F.concat("html", mark)).alias("markup"))


def _sitemaps(spark, sf_dir):
    """Each order a site: one sitemap of six pages, or for every third an index of two sitemaps of three."""
    loc = "'<loc>https://s' || n || '.example/' || CASE WHEN i % 4 = 0 THEN 'about/' ELSE 'job/' END || i || '</loc>'"
    sites = given(spark, sf_dir, "orders").selectExpr("o_orderkey AS n", "'https://s' || o_orderkey || '.example/' AS home")

    def body(first, last):
        return f"array_join(transform(sequence({first}, {last}), i -> {loc}), '\\n')"

    files = sites.selectExpr("n", f"""inline(CASE WHEN n % 3 = 0 THEN array(
        struct(home || 'sitemap' AS url, '<loc>' || home || '1.XML?v=2</loc><loc>' || home || '0.XML?v=2</loc>' AS body),
        struct(home || '1.XML?v=2' AS url, {body(4, 6)} AS body), struct(home || '0.XML?v=2' AS url, {body(1, 3)} AS body))
        ELSE array(struct(home || 'sitemap' AS url, {body(1, 6)} AS body)) END)""")
    roots = sites.selectExpr("'entry ' || n AS source_entry", "home || 'sitemap' AS sitemap_url", "'/job/' AS url_pattern",
                             "CASE WHEN n % 4 > 0 THEN n % 4 + 2 END AS max_pages")
    return files.selectExpr("'entry ' || n AS source_entry", "url", "body"), roots


@query("""SELECT 'entry ' || o_orderkey AS source_entry, 'https://s' || o_orderkey || '.example/job/' || i AS url,
row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN o_orderkey % 3 = 0 AND i >= 4 THEN 0 ELSE 1 END, i) AS rank
FROM (SELECT o_orderkey, unnest([1, 2, 3, 5, 6]) AS i FROM orders) QUALIFY o_orderkey % 4 = 0 OR rank <= o_orderkey % 4 + 2""")
def sitemap_urls(spark, sf_dir):
    """Limits of three, four and five addresses, and none, as each source's row states."""
    return pages.extract_sitemap_urls(*_sitemaps(spark, sf_dir))


@query("SELECT 'entry ' || o_orderkey AS source_entry FROM orders WHERE o_orderkey % 10 NOT IN (1, 2, 3, 5, 6)")
def sources_without_urls(spark, sf_dir):
    files, roots = _sitemaps(spark, sf_dir)
    roots = roots.drop("max_pages")
    found = pages.extract_sitemap_urls(files, roots)
    same = F.regexp_extract("url", r"(\d)$", 1) == F.regexp_extract("source_entry", r"(\d)$", 1)
    return pages.sources_without_urls(roots, found.filter(same)).select("source_entry")


@query("""SELECT 'd' || c_custkey AS domain, i AS pos, 'https://d' || c_custkey || '.example/' || i || '.xml' AS sitemap FROM (SELECT *, unnest(range(c_custkey % 4)) AS i FROM customer)""")
def robots_sitemaps(spark, sf_dir):
    lines = "concat_ws('\\n', 'User-agent: *', transform(sequence(0, 3), i -> CASE WHEN i < c_custkey % 4 THEN '  SiteMap: https://d' || c_custkey || '.example/' || i || '.xml' ELSE 'Disallow: /sitemap:' END))"
    files = given(spark, sf_dir, "customer").selectExpr("'d' || c_custkey AS domain", f"{lines} AS body")
    return pages.extract_robots_sitemaps(files)


@query("""WITH j AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM (SELECT page_id, replace(url, '/en/', '/en/jobs/') AS url, regexp_extract(url, '\\.example\\.([a-z]+)', 1) AS domain FROM pages))
SELECT domain, arg_min(url, page_id) AS first_url, regexp_replace(arg_min(path, page_id), '[^/]*$', '') AS url_pattern FROM j WHERE regexp_matches(path, '/(?:job|jobs|position|req|career)s?[/_-]', 'i') GROUP BY domain""")
def job_url_patterns(spark, sf_dir):
    urls = given(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"\.example\.([a-z]+)", 1).alias("domain"), F.col("page_id").alias("pos"), F.replace("url", F.lit("/en/"), F.lit("/en/jobs/")).alias("url"))
    return pages.job_url_pattern(urls)


# --- crawl lines and names ------------------------------------------------------


def _crawl(spark, sf_dir):
    """One crawl line per order; some blank, some broken."""
    line = f"CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 13 = 1 THEN '{{\"url\": \"' || {_URL} || '\"' ELSE '{{\"url\": \"' || {_URL} || '\", \"status\": \"200\"}}' END"
    return given(spark, sf_dir, "orders").selectExpr(f"{line} AS value")


_URL = (
    "CASE o_orderkey % 4 WHEN 0 THEN 'https://boards.greenhouse.io/Acme' || o_custkey % 90 || '/jobs/' || o_orderkey WHEN 1 THEN 'https://job-boards.greenhouse.io/acme' || o_custkey % 70 || '?x=1' "
    "WHEN 2 THEN 'https://jobs.smartrecruiters.com/' || CASE WHEN o_custkey % 50 = 0 THEN 'favicon.ico' ELSE 'Acme' || o_custkey % 40 END || '/1' "
    "ELSE 'https://T' || o_custkey % 60 || '.wd' || o_custkey % 3 || '.myworkdayjobs.com/' || CASE o_orderkey % 5 WHEN 0 THEN 'en-US' WHEN 1 THEN 'robots.txt' WHEN 2 THEN 'Ext' ELSE 'Site' || o_orderkey % 3 END || '/job' END")
_URLS = f"WITH u AS (SELECT {_URL} AS url FROM orders WHERE o_orderkey % 13 > 1)"


def _urls(spark, sf_dir):
    return crawl.parse_crawl_lines(_crawl(spark, sf_dir))


@query(f"{_URLS} SELECT url, count(*) AS n FROM u GROUP BY url")
def crawl_urls(spark, sf_dir):
    return _urls(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n"))


@query(f"{_URLS} SELECT DISTINCT lower(regexp_extract(url, 'boards\\.greenhouse\\.io/([^/?]*)', 1)) AS token FROM u WHERE contains(url, 'greenhouse')")
def greenhouse_tokens(spark, sf_dir):
    return crawl.board_tokens(_urls(spark, sf_dir), ["boards.greenhouse.io", "job-boards.greenhouse.io"])


@query(f"{_URLS} SELECT DISTINCT regexp_extract(url, 'smartrecruiters\\.com/([^/?]*)', 1) AS token FROM u WHERE contains(url, 'smartrecruiters') AND NOT contains(url, 'favicon')")
def smartrecruiters_tokens(spark, sf_dir):
    return crawl.board_tokens(_urls(spark, sf_dir), ["jobs.smartrecruiters.com"], lower=False)


@query(f"""{_URLS}, v AS (SELECT lower(regexp_extract(url, '//([^.]+)\\.', 1)) AS tenant, regexp_extract(url, '//[^.]+\\.([^.]+)\\.', 1) AS wd_host, regexp_extract(url, '\\.com/([^/?]*)', 1) AS site FROM u WHERE contains(url, 'myworkdayjobs'))
SELECT tenant, wd_host, site FROM v WHERE site NOT IN ('en-US', 'robots.txt') GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY tenant, wd_host, site QUALIFY row_number() OVER (PARTITION BY tenant, wd_host ORDER BY count(*) DESC, site) = 1"))
def workday_sites(spark, sf_dir):
    return crawl.workday_sites(_urls(spark, sf_dir))


@query("""SELECT c_name AS company FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Lists of ' ELSE '' END || s_name FROM supplier WHERE s_suppkey % 4 > 0""")
def company_name_seeds(spark, sf_dir):
    tickers = given(spark, sf_dir, "customer").selectExpr("'{\"0\": {\"title\": \"' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END || '\"}}' AS payload")
    members = given(spark, sf_dir, "supplier").selectExpr(
        "'{\"query\": {\"categorymembers\": [{\"title\": \"' || CASE WHEN s_suppkey % 4 = 0 THEN 'List of ' WHEN s_suppkey % 3 = 0 THEN 'Lists of ' ELSE '' END || s_name || '\"}]}}' AS payload")
    return crawl.name_seeds(tickers, members)


# --- stores, sources, presets ----------------------------------------------------


@query("""WITH n AS (SELECT company, CASE WHEN id % 10 > 0 THEN ats END AS ats, 'New' AS category, 'new ' || id AS config FROM sources WHERE id % 2 = 0 UNION ALL SELECT 'fresh ' || id, 'lever', NULL, 'c' FROM sources WHERE id % 3 = 0)
SELECT coalesce(s.company, n.company) AS company, coalesce(s.ats, n.ats) AS ats, CASE WHEN n.company IS NULL THEN s.category ELSE coalesce(n.category, '') END AS category, coalesce(n.config, s.config) AS config,
coalesce(s.status, 'active') AS status, coalesce(s.scrape_interval_seconds, 7200) AS scrape_interval_seconds FROM sources s FULL JOIN (SELECT * FROM n WHERE ats IS NOT NULL) n ON s.company = n.company AND s.ats = n.ats""", ("sources",))
def source_list_upsert(spark, sf_dir):
    s = bound(spark, sf_dir, "sources")
    known = s.filter("id % 2 = 0").selectExpr("company", "CASE WHEN id % 10 > 0 THEN ats END AS ats", "'New' AS category", "'new ' || id AS config")
    fresh = s.filter("id % 3 = 0").selectExpr("'fresh ' || id AS company", "'lever' AS ats", "CAST(NULL AS STRING) AS category", "'c' AS config")
    return store.load_sources(known.unionByName(fresh), s).select("company", "ats", "category", "config", "status", "scrape_interval_seconds")


@query("SELECT id, company, title, location, url, ats AS source, category, posted_at, description_snippet, source_entry, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM postings WHERE status = 'open'", ("postings",))
def batch_store_rows(spark, sf_dir):
    return store.to_batch_shape(live(spark, sf_dir))


@query("SELECT id, title, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen FROM postings WHERE status = 'open'", ("postings",))
def store_round_trip(spark, sf_dir):
    """Written as a JSON store in the shared folder and read back."""
    from uuid import uuid4

    from joblattice.session import shared_dir

    path = f"{shared_dir(spark)}/store-{uuid4().hex}"
    store.write_store(store.to_batch_shape(live(spark, sf_dir)), path)
    return store.read_store(spark, path).select("id", "title", "first_seen")


@query(f"""WITH o AS (SELECT * FROM postings WHERE status = 'open')
SELECT id, {k.title()} AS title, CASE WHEN {k.rx('trim(description_snippet)', '^[A-Za-z0-9_-]{3,25}$')} THEN '' ELSE description_snippet END AS description_snippet,
coalesce(strftime(posted_at_ts, '%Y-%m-%dT%H:%M:%SZ'), posted_at, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ')) AS posted_at_ts, substring(sha256(id), 1, 20) AS desc_id FROM o""", ("postings",))
def edge_feed_index(spark, sf_dir):
    return export.feed_index(keyed(spark, sf_dir)).select("id", "title", "description_snippet", "posted_at_ts", "desc_id")


@query("""WITH live AS (SELECT * FROM postings WHERE status = 'open'), parts AS (
SELECT id, description, 1 AS p FROM live WHERE description <> '' UNION ALL SELECT id, 'store ' || id, 2 FROM postings WHERE cycle_year = 2026 UNION ALL SELECT id, 'older ' || id, 3 FROM postings)
SELECT id, arg_min(description, p) AS description, substring(sha256(id), 1, 20) AS desc_id FROM parts WHERE id IN (SELECT id FROM live) GROUP BY id""", ("postings",))
def description_shards(spark, sf_dir):
    rows = live(spark, sf_dir)
    stored = rows.filter("cycle_year = 2026").withColumn("description", F.concat(F.lit("store "), "id"))
    older = rows.withColumn("description", F.concat(F.lit("older "), "id"))
    return export.description_shards(rows, stored, older).select("id", "description", "desc_id")


def _feeds(spark, sf_dir):
    return filters.apply_presets(live(spark, sf_dir).filter("status = 'open'"), PRESETS, as_of()).withColumnRenamed("preset", "feed_key")


_FEEDS = "feeds AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS feed_key FROM postings WHERE status = 'open' AND {spec_sql(s)}" for n, s in PRESETS.items()) + ")"


@query(f"""WITH {_FEEDS}, c AS (SELECT feed_key, count(*) AS n FROM feeds GROUP BY feed_key), g AS (SELECT DISTINCT feed_key, coalesce(nullif(category, ''), 'Uncategorized') AS category FROM feeds)
SELECT feed_key, '' AS category, unnest([0, 1, 2, 2, 3, 4, 4]) AS part, '' AS id, unnest(['# Live Opportunity Feed — ' || feed_key, '', 'Auto-generated by `joblattice` — last updated 2001-09-01 00:00 UTC.',
'Do not hand-edit; changes are overwritten on the next run.', '', n || ' open posting(s) currently tracked.', '']) AS line FROM c
UNION ALL SELECT feed_key, category, unnest([5, 5, 7]), '', unnest(['## ' || category, '', '']) FROM g
UNION ALL SELECT feed_key, coalesce(nullif(category, ''), 'Uncategorized'), 6, id, '- [' || company || ': ' || title || '](' || url || ')' || CASE WHEN location <> '' THEN ' — ' || location ELSE '' END || ' (first seen ' || strftime(first_seen, '%Y-%m-%d') || ')' FROM feeds""", ("postings",))
def markdown_feeds(spark, sf_dir):
    return export.markdown_feed(_feeds(spark, sf_dir), as_of()).select("feed_key", "category", "part", "id", "line")


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {_FEEDS}, top AS (SELECT *, row_number() OVER (PARTITION BY feed_key ORDER BY posted_at_ts DESC NULLS LAST, first_seen DESC, id) AS n, coalesce(posted_at_ts, first_seen) AS dated FROM feeds QUALIFY n <= 50)
SELECT feed_key, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10) || '  <title>' || feed_key || '</title>' || chr(10) || '  <id>{export.FEED_TAG}' || feed_key || '</id>' || chr(10)
|| '  <updated>' || strftime(max(dated), '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || chr(10) || '  <link rel="self" href="https://feeds.example.com/' || feed_key || '"/>' || chr(10) || '  <subtitle>{export.SUBTITLE}</subtitle>' || chr(10)
|| string_agg('  <entry>' || chr(10) || '    <title>' || {_ESC.format('title')} || '</title>' || chr(10) || '    <id>{export.FEED_TAG}posting/' || id || '</id>' || chr(10) || '    <link rel="alternate" href="' || url || '"/>' || chr(10)
|| '    <updated>' || strftime(dated, '%Y-%m-%dT%H:%M:%SZ') || '</updated>' || chr(10) || '    <author><name>' || {_ESC.format("coalesce(nullif(company, ''), 'Unknown company')")} || '</name></author>' || chr(10)
|| '    <summary>' || {_ESC.format("array_to_string(list_filter([company, location, category], lambda x: x <> ''), ' · ')")} || CASE WHEN posted_at_ts IS NOT NULL AND posted_at_approx THEN '{export.APPROXIMATE}' ELSE '' END
|| '</summary>' || chr(10) || '  </entry>', chr(10) ORDER BY n) || chr(10) || '</feed>' || chr(10) AS document FROM top GROUP BY feed_key""", ("postings",))
def atom_feeds(spark, sf_dir):
    return export.atom_feed(_feeds(spark, sf_dir), as_of=as_of())


@query(f"""WITH {KEYED}, s AS (SELECT id, 'store' AS src FROM postings WHERE cycle_year = 2026), h AS (SELECT 'seed:' || id AS id FROM postings WHERE cycle_year = 2027)
SELECT p.id, p.status, {k.stamp('p.first_seen')} AS first_seen, CASE WHEN s.id IS NOT NULL THEN {k.title('p.title')} ELSE p.title END AS title FROM keyed p LEFT JOIN s USING (id)
UNION ALL SELECT 'seed:' || id, 'open', {k.stamp(NOW)}, {k.title()} FROM postings WHERE cycle_year = 2027""", ("postings",))
def seed_merged(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    stored = rows.filter("cycle_year = 2026")
    shards = rows.filter("cycle_year = 2027").withColumn("id", F.concat(F.lit("seed:"), "id")).drop("first_seen", "last_seen")
    return export.seed_merge(rows, stored, shards, as_of()).select("id", "status", stamp("first_seen").alias("first_seen"), "title")


@query("""SELECT id, arg_min(src, p) AS src FROM (SELECT id, 'a' AS src, 1 AS p FROM postings WHERE cycle_year = 2026 UNION ALL SELECT id, 'b', 2 FROM postings WHERE cycle_season = 'summer'
UNION ALL SELECT id, 'c', 3 FROM postings) GROUP BY id""", ("postings",))
def priority_union(spark, sf_dir):
    rows = live(spark, sf_dir)
    parts = [("a", "cycle_year = 2026"), ("b", "cycle_season = 'summer'"), ("c", "true")]
    return ranking.priority_union([rows.filter(w).select("id", F.lit(n).alias("src")) for n, w in parts])


_SPECS = [
    {"id": "default", "name": "Freight", "keywords_any": ["freight"]}, {"id": "operations-logistics-supply-chain"},
    {"id": "texas-only", "locations_include": ["TX"], "max_age_days": 30}, {"id": "data"},
]


@query("""SELECT p.preset_id AS id, p.name, p.max_age_days, count(*) AS postings FROM (VALUES ('default', 'Freight', NULL), ('data', 'Data', NULL), ('texas-only', 'Texas Only', 30)) p(preset_id, name, max_age_days)
JOIN postings ON CASE preset_id WHEN 'default' THEN contains(lower(description_snippet), 'freight') WHEN 'texas-only' THEN contains(location, 'TX') ELSE true END GROUP BY ALL""", ("postings",))
def preset_table(spark, sf_dir):
    """Presets as rows, and how many postings mention their first word."""
    p = store.load_presets(spark, _SPECS)
    first = F.coalesce(F.get("keywords_any", F.lit(0)), F.get("locations_include", F.lit(0)), F.lit(""))
    rows = live(spark, sf_dir).select(F.concat(F.lower("description_snippet"), F.lit(" "), "location").alias("text"))
    hits = rows.select(F.explode(F.lit(["freight", "TX", ""])).alias("word"), "text").filter(F.col("text").contains(F.col("word"))).groupBy("word").agg(F.count("*").alias("postings"))
    return p.withColumn("word", first).join(hits, "word").select("id", "name", "max_age_days", "postings")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'About' || chr(10) || p_name || chr(10) || chr(10) END || 'Needs ' || p_brand AS text FROM part")
def detail_texts(spark, sf_dir):
    from joblattice.sources.details import detail_text

    section = "CASE WHEN p_partkey % 3 = 0 THEN '{}' ELSE '{\"title\": \"About \", \"text\": \"<p>' || p_name || '</p>\"}' END"
    body = f"'{{\"jobAd\": {{\"sections\": {{\"qualifications\": {{\"text\": \"Needs ' || p_brand || '\"}}, \"jobDescription\": ' || {section} || '}}}}}}'"
    return spread(given(spark, sf_dir, "part"), TASK_ROWS).selectExpr("p_partkey", f"{body} AS payload").select("p_partkey", detail_text("payload", "smartrecruiters").alias("text"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || '• ' || p_brand AS text FROM part")
def workday_detail_texts(spark, sf_dir):
    from joblattice.sources.details import detail_text

    body = "'{\"jobPostingInfo\": {\"jobDescription\": \"<p>' || p_name || '</p><li>' || p_brand || '</li>\"}}'"
    return spread(given(spark, sf_dir, "part"), TASK_ROWS).selectExpr("p_partkey", f"{body} AS payload").select("p_partkey", detail_text("payload", "workday").alias("text"))
