"""Joins between postings, sources and runs: the pages about one thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import text_of
from joblattice.operators.facets import latest_run
from joblattice.operators.filters import substring_search
from joblattice.operators.ranking import feed_order, first_per, page, shown_per, top_n_per, total_order
from joblattice.operators.skew import lookup

RUN_COLUMNS = ["ok", "error", "started_at", "fetched_count", "internship_count"]


def with_source(postings: DataFrame, sources: DataFrame, ats: str | None = None) -> DataFrame:
    """Postings with their source's id, company and configuration, for detail work."""
    rows = postings.filter(F.col("ats") == ats) if ats else postings
    s = sources.select(F.col("id").alias("source_id"), F.col("company").alias("source_company"), "config")
    return rows.join(s, "source_id")


def duplicates_audit(postings: DataFrame, q: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Each duplicate beside the posting it repeats; order by first_seen down, id.

    With a limit the page is cut first, so only its rows are joined.
    """
    d = substring_search(postings.filter("status = 'duplicate'"), q or "", ("company", "title")).select(
        "id", "company", "title", "location", F.col("ats").alias("source"), "first_seen", "duplicate_of",
    )
    if limit is not None:
        d = page(d, total_order(d, [F.desc("first_seen")], "id"), limit, offset)
    c = postings.select(
        F.col("id").alias("canonical_id"), F.col("company").alias("canonical_company"),
        F.col("title").alias("canonical_title"), F.col("ats").alias("canonical_source"),
    )
    return d.join(c, d["duplicate_of"] == c["canonical_id"], "left").drop("duplicate_of")


def listing_groups(postings: DataFrame) -> DataFrame:
    """Postings that share their dedup key with others, and how many share it.

    One row per posting, never one per pair: rows of a key belong together.
    """
    sizes = postings.groupBy("dedup_key").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return lookup(postings, sizes, "dedup_key", "id").filter(F.col("group_size").isNotNull())


def also_listed(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """For the few postings asked about (``id``): the same job listed elsewhere."""
    asked = postings.join(ids, "id", "left_semi").filter(F.col("dedup_key").isNotNull()).select(
        F.col("id").alias("asked_id"), "dedup_key")
    other = postings.select("id", "company", "title", "location", "ats", "source_entry", "url", "status", "first_seen", "dedup_key")
    return asked.join(other, "dedup_key").filter(F.col("id") != F.col("asked_id")).drop("dedup_key")


def also_listed_groups(postings: DataFrame) -> DataFrame:
    """Every posting with its dedup key and how many other postings have it: the same job listed elsewhere.

    The rows of a key are the group's members, so no posting's list is left out and no pair is built.
    """
    sizes = postings.filter(F.col("dedup_key").isNotNull()).groupBy("dedup_key").agg((F.count("*") - 1).alias("n_elsewhere"))
    return lookup(postings, sizes, "dedup_key", "id").withColumn("n_elsewhere", F.coalesce("n_elsewhere", F.lit(0)))


def _newest_of(postings: DataFrame, n: int) -> DataFrame:
    open_ = postings.filter((F.col("status") == "open") & F.col("company_key").isNotNull())
    order = [F.desc_nulls_last("posted_at_ts"), F.asc("id")]
    return top_n_per(open_.select("id", "title", "location", "posted_at_ts", "company_key"), "company_key", order, n + 1)


def company_lists(postings: DataFrame, n: int = 25) -> DataFrame:
    """(company_key, newest, members, listed): each employer's newest n+1 open postings, as one list that all its postings share.

    A posting's related ones are the list without itself, at most n.  Nothing is
    written per posting: `members` counts them, `listed` those in the list.
    """
    short = _newest_of(postings, n).groupBy("company_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda p: p["id"]).alias("newest"))
    sizes = postings.filter(F.col("company_key").isNotNull()).groupBy("company_key").agg(F.count("*").alias("members"))
    return short.join(sizes, "company_key").withColumn("listed", F.size("newest").cast("long"))


def same_company(postings: DataFrame, asked: DataFrame | None = None, n: int = 25) -> DataFrame:
    """For the postings asked about (``id``; all, if none are given): their employer's n newest other open postings.

    An employer's newest n+1 form one short list, looked up by each posting;
    leaving itself out, a posting has its n.
    """
    short = _newest_of(postings, n).groupBy("company_key").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "title", "location", "posted_at_ts"))).alias("_newest"))
    rows = postings.filter(F.col("company_key").isNotNull()).select(F.col("id").alias("asked_id"), "company_key")
    if asked is not None:
        rows = rows.join(asked.select(F.col("id").alias("asked_id")), "asked_id", "left_semi")
    met = lookup(rows, short, "company_key", "asked_id")
    others = F.slice(F.filter("_newest", lambda p: p["id"] != F.col("asked_id")), 1, n)
    return met.select("asked_id", F.posexplode(others).alias("_at", "_p")).select(
        "asked_id", (F.col("_at") + 1).alias("rank"), "_p.id", "_p.title", "_p.location", "_p.posted_at_ts")


def reached_via(postings: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Per company: the sources its postings come through, with their latest run."""
    through = postings.filter(F.col("company_key").isNotNull()).select(
        "company_key", "source_entry", "ats", "source_id").distinct()
    one = first_per(through, ["company_key", "source_entry", "ats"], [F.coalesce("source_id", F.lit(1 << 62))])
    s = sources.select(
        F.col("id").alias("source_id"), F.col("status").alias("source_status"),
        F.col("category").alias("source_category"), "last_scraped_at", "consecutive_failures", "scrape_interval_seconds",
    )
    r = latest_run(runs).select("source_id", *[F.col(c).alias(f"last_run_{c}") for c in RUN_COLUMNS])
    return one.join(s, "source_id", "left").join(r, "source_id", "left")


def company_order() -> list[Column]:
    """Open before others, newest first."""
    return [F.desc(F.col("status") == "open"), *feed_order()]


def company_page(postings: DataFrame, n: int = 200) -> DataFrame:
    """Each company's first n postings, open before others, newest first, and whether there were more."""
    return shown_per(postings.filter(F.col("company_key").isNotNull()), "company_key", company_order(), n)


def source_page(postings: DataFrame, n: int = 200) -> DataFrame:
    """Each source's newest open postings, and whether there were more."""
    rows = postings.filter((F.col("status") == "open") & F.col("source_id").isNotNull())
    cols = ["source_id", "id", "title", "company", "company_key", "location", "posted_at_ts", "first_seen"]
    return shown_per(rows.select(*cols), "source_id", feed_order(), n)


def ats_page(sources: DataFrame, n: int | None = None) -> DataFrame:
    """Each platform's sources by company: all, or the first n and whether there were more."""
    cols = ["ats", "id", "company", "category", "status", "consecutive_failures"]
    return shown_per(sources.select(*cols), "ats", [F.asc("company"), F.asc("id")], n)


def sample_posting(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """Sources with the id of their newest open posting."""
    newest = postings.filter(F.col("status") == "open").groupBy("source_id").agg(
        F.max_by("id", F.struct("first_seen", "id")).alias("sample_posting_id"))
    return sources.join(newest.withColumnRenamed("source_id", "id"), "id", "left")


def not_yet_sources(seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Seeds (company, ats) that no source has, in any case."""
    known = sources.select(F.lower("company").alias("_c"), F.col("ats").alias("_a")).distinct()
    return seeds.join(known, (F.lower(seeds["company"]) == known["_c"]) & (seeds["ats"] == known["_a"]), "left_anti")


def candidates_page(candidates: DataFrame, q: str | None = None, review_status=None, ats=None) -> DataFrame:
    """Candidates with the one reason read out of their evidence, never the evidence itself."""
    rows = substring_search(candidates, q or "", ("company",))
    if review_status:
        rows = rows.filter(F.col("review_status") == review_status)
    if ats:
        rows = rows.filter(F.col("ats") == ats)
    return rows.select(
        "id", "company", "ats", "review_status", F.get_json_object("evidence", "$.reason").alias("reason"),
        "checked_at", "next_check_at",
    )


def candidates_order():
    return [F.desc_nulls_first("checked_at"), F.desc("id")]


def ats_options(candidates: DataFrame) -> DataFrame:
    return candidates.filter(text_of("ats") != "").select("ats").distinct().orderBy("ats")
