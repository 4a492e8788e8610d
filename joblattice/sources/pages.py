"""Web pages, sitemaps and robots files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import SNIPPET, as_col, blank_to_null, display_text, strip_html, text_of
from joblattice.schema import POSTING_COLUMNS
from joblattice.operators.ranking import numbered

# fixed values: the marks of linked data, microdata and job addresses in a page
_LD_JSON = r"""(?s)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_MICRODATA = r"""(?i)itemtype=["'][^"']*schema\.org/JobPosting["']"""
_JOB_PATH = r"(?i)/(?:job|jobs|position|req|career)s?[/_-]"


def _blocks(html) -> Column:
    return F.regexp_extract_all(text_of(html), F.lit(_LD_JSON), F.lit(1))


def extract_jobposting(pages: DataFrame) -> DataFrame:
    """Posting rows from pages ``(source_entry, entry, url, html)``.

    Of a page's linked-data blocks the first whose type is exactly JobPosting
    counts; broken JSON is passed over.
    """
    def is_posting(block):
        return F.try_variant_get(F.try_parse_json(block), "$['@type']", "string") == "JobPosting"

    found = F.get(F.filter(_blocks("html"), is_posting), F.lit(0))
    docs = pages.withColumn("_doc", F.try_parse_json(found)).filter(F.col("_doc").isNotNull())

    def at(path: str) -> Column:
        return F.try_variant_get("_doc", path, "string")

    def part(field: str) -> Column:
        """A part of the address: plain text, or an object with a name."""
        base = f"$.jobLocation.address.{field}"
        text = at(base)
        return blank_to_null(F.when(text.startswith("{"), at(f"{base}.name")).otherwise(text))

    company = F.get_json_object("entry", "$.company")
    row = {
        "id": F.concat_ws(":", F.lit("jsonld"), company, F.coalesce(at("$.identifier.value"), F.col("url"))),
        "company": F.coalesce(at("$.hiringOrganization.name"), text_of(company)),
        "title": text_of(at("$.title")),
        "location": F.concat_ws(", ", part("addressLocality"), part("addressRegion"), part("addressCountry")),
        "url": F.col("url"),
        "source": F.lit("jsonld"),
        "category": text_of(F.get_json_object("entry", "$.category")),
        "job_function": F.lit(""),
        "work_arrangement": F.lit(""),
        "posted_at": at("$.datePosted"),
        "description_snippet": strip_html(at("$.description"), SNIPPET),
        "description": display_text(at("$.description")),
        "source_entry": F.col("source_entry"),
    }
    return docs.select(*[row[c].alias(c) for c in POSTING_COLUMNS])


def classify_markup(html="html") -> Column:
    """'jsonld', 'microdata' or NULL."""
    typed = F.exists(_blocks(html), lambda b: F.replace(b, F.lit(" "), F.lit("")).contains('"@type":"JobPosting"'))
    return F.when(typed, "jsonld").when(text_of(html).rlike(_MICRODATA), "microdata")


def locs(body) -> Column:
    return F.regexp_extract_all(text_of(body), F.lit(r"<loc>([^<]+)</loc>"), F.lit(1))


def _is_index(found: Column) -> Column:
    return (F.size(found) > 0) & F.forall(found, lambda u: F.split_part(F.lower(u), F.lit("?"), F.lit(1)).endswith(".xml"))


def sitemap_locs(files: DataFrame, roots: DataFrame, children: int | None = None) -> DataFrame:
    """Every page address a source's root sitemap leads to, in reading order.

    ``files``: (source_entry, url, body); ``roots``: (source_entry, sitemap_url).
    An index is opened one level deep: all its sitemaps, or its first ``children``.
    """
    read = files.select("source_entry", "url", locs("body").alias("_locs"))
    top = read.join(
        roots.select("source_entry", F.col("sitemap_url").alias("url")), ["source_entry", "url"], "left_semi",
    ).withColumn("_index", _is_index(F.col("_locs")))
    flat = top.filter(~F.col("_index")).select(
        "source_entry", F.lit(0).alias("child"), F.posexplode("_locs").alias("pos", "loc"),
    )
    inner = (
        top.filter("_index")
        .select("source_entry", F.posexplode("_locs" if children is None else F.slice("_locs", 1, children)).alias("child", "url"))
        .join(read, ["source_entry", "url"])
        .select("source_entry", "child", F.posexplode("_locs").alias("pos", "loc"))
    )
    return flat.unionByName(inner)


def extract_sitemap_urls(files: DataFrame, roots: DataFrame, max_pages: int | None = None, children: int | None = None) -> DataFrame:
    """The addresses per source holding its ``url_pattern``: the first ``max_pages`` that its row in ``roots`` or the argument
    states, all if neither does."""
    own = F.col("max_pages").cast("int") if "max_pages" in roots.columns else F.lit(None).cast("int")
    most = F.coalesce(own, F.lit(max_pages).cast("int"))
    found = sitemap_locs(files, roots, children).join(roots.select("source_entry", "url_pattern", most.alias("_most")), "source_entry")
    kept = found.filter(F.col("loc").contains(F.col("url_pattern")))
    return (
        numbered(kept, "source_entry", [F.asc("child"), F.asc("pos")])
        .filter(F.col("_most").isNull() | (F.col("rank") <= F.col("_most")))
        .select("source_entry", "rank", F.col("loc").alias("url"))
    )


def sources_without_urls(roots: DataFrame, urls: DataFrame) -> DataFrame:
    """Sources whose sitemap matched nothing, which is an error, not an empty board."""
    return roots.join(urls, "source_entry", "left_anti")


def extract_robots_sitemaps(files: DataFrame) -> DataFrame:
    """(domain, pos, sitemap) for every Sitemap line of robots files (domain, body)."""
    lines = F.regexp_extract_all(text_of("body"), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return files.select("domain", F.posexplode(lines).alias("pos", "sitemap"))


def path_of(url) -> Column:
    return text_of(F.try_parse_url(as_col(url), F.lit("PATH")))


def is_job_path(url) -> Column:
    return path_of(url).rlike(_JOB_PATH)


def job_url_pattern(urls: DataFrame, key: str = "domain") -> DataFrame:
    """Per key, the folder of the first job-shaped address; urls: (key, pos, url)."""
    first = F.min_by("url", "pos")
    return (
        urls.filter(is_job_path("url")).groupBy(key).agg(first.alias("first_url"))
        .withColumn("url_pattern", F.regexp_replace(path_of("first_url"), r"[^/]*$", ""))
    )
