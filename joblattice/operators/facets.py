"""Counts and summaries over postings, runs and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.similarity import with_ratio
from joblattice.functions.text import blank_to_null, is_internship, slug, text_of
from joblattice.operators.ranking import first_per, shown_per, top_n_per

OPEN = "open"


def _is_open() -> Column:
    return F.col("status") == OPEN


def _axis_rows(df: DataFrame, axes, drop: dict | None = None) -> DataFrame:
    """(axis, value) for every stated axis of every row, in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    rows = df.select(F.explode(pairs).alias("p")).select("p.axis", "p.value")
    rows = rows.filter(text_of("value") != "")
    for axis, value in (drop or {}).items():
        rows = rows.filter(~((F.col("axis") == axis) & (F.col("value") == value)))
    return rows


def facets(postings: DataFrame, axes=("category", "job_function", "work_arrangement")) -> DataFrame:
    """Open postings by value, for all axes at once; order by count down, value."""
    return _axis_rows(postings.filter(_is_open()), axes).groupBy("axis", "value").agg(
        F.count("*").alias("open_postings"),
    )


def coverage(postings: DataFrame) -> DataFrame:
    """How many open postings state each axis at all."""
    def stated(c):
        return F.count_if(text_of(c) != "")

    return postings.filter(_is_open()).agg(
        F.count("*").alias("total"),
        stated("category").alias("with_industry"),
        stated("job_function").alias("with_function"),
        F.count_if(F.col("cycle_year").isNotNull() | (text_of("cycle_season") != "")).alias("with_cycle"),
        stated("work_arrangement").alias("with_arrangement"),
    )


def cycle_counts(postings: DataFrame) -> DataFrame:
    """Open postings by cycle year and by season."""
    return facets(postings, ("cycle_year", "cycle_season"))


META_AXES = [
    "company", "category", "job_function", "work_arrangement", "cycle_season", "cycle_year", "ats", "location",
]


def metadata(postings: DataFrame, top_locations: int = 30) -> DataFrame:
    """(axis, value, n, rank): every axis' counts, locations cut to the most frequent."""
    rows = _axis_rows(postings, META_AXES, {"category": "Uncategorized", "location": "Not Specified"})
    counts = rows.groupBy("axis", "value").agg(F.count("*").alias("n"))
    places = top_n_per(counts.filter("axis = 'location'"), "axis", [F.desc("n"), F.asc("value")], top_locations)
    return counts.filter("axis <> 'location'").unionByName(places.drop("rank"))


def metadata_totals(postings: DataFrame) -> DataFrame:
    return postings.agg(
        F.count("*").alias("total_open_postings"),
        F.count_distinct(blank_to_null("company")).alias("total_companies"),
    )


def company_directory(postings: DataFrame, sample: int = 5) -> DataFrame:
    """Per employer key: first name seen, postings, platforms, industries, a few places.

    Sets are taken over distinct values and places are cut to the sample
    before they are gathered, so no employer's rows meet in one place.
    """
    key = F.coalesce(blank_to_null("company_key"), F.lower(F.trim("company")))
    rows = postings.withColumn("key", key).filter((F.trim(text_of("company")) != "") & F.col("key").isNotNull())
    base = rows.groupBy("key").agg(
        F.min_by(F.trim("company"), F.struct(F.col("first_seen"), F.col("id"))).alias("name"),
        F.count("*").alias("postings_count"),
        F.sort_array(F.collect_set(blank_to_null("ats"))).alias("ats_platforms"),
        F.sort_array(F.collect_set(F.when(F.col("category") != "Uncategorized", blank_to_null("category")))).alias("categories"),
    )
    named = rows.filter((text_of("location") != "") & (F.col("location") != "Not Specified"))
    places = top_n_per(named.select("key", "location").distinct(), "key", [F.asc("location")], sample)
    samples = places.groupBy("key").agg(F.sort_array(F.collect_list("location")).alias("locations_sample"))
    return base.join(samples, "key", "left").withColumn(
        "locations_sample", F.coalesce("locations_sample", F.array().cast("array<string>")),
    )


def company_summary(postings: DataFrame) -> DataFrame:
    """Per company key: most frequent spelling, all spellings sorted, open postings."""
    named = postings.filter(F.col("company_key").isNotNull())
    spellings = named.groupBy("company_key", "company").agg(
        F.count("*").alias("n"), F.count_if(_is_open()).alias("open"),
    )
    return spellings.groupBy("company_key").agg(
        F.min_by("company", F.struct(-F.col("n"), F.col("company"))).alias("display_name"),
        F.sort_array(F.collect_set("company")).alias("name_variants"),
        F.sum("open").alias("open_count"),
    )


def source_stats(postings: DataFrame) -> DataFrame:
    """Per source: postings, open ones, distinct employers, whether it aggregates several."""
    return postings.filter(F.col("source_id").isNotNull()).groupBy("source_id").agg(
        F.count("*").alias("total"),
        F.count_if(_is_open()).alias("open"),
        F.count_distinct("company_key").alias("companies"),
    ).withColumn("is_aggregator", F.col("companies") > 1)


def source_employers(postings: DataFrame, n: int | None = None) -> DataFrame:
    """The employers of each source by open postings: all, or the first n and whether there were more."""
    counts = postings.filter(_is_open() & F.col("company_key").isNotNull() & F.col("source_id").isNotNull()).groupBy(
        "source_id", "company_key", "company").agg(F.count("*").alias("n"))
    return shown_per(counts, "source_id", [F.desc("n"), F.asc("company_key"), F.asc("company")], n)


def platform_stats(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Per platform: its sources, and its postings."""
    s = sources.groupBy("ats").agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "active").alias("active"))
    p = postings.groupBy("ats").agg(
        F.count_if(_is_open()).alias("open_postings"),
        F.count_distinct("company_key").alias("companies"),
        F.count_if(_is_open() & (text_of("description") != "")).alias("with_description"),
    )
    zero = ["sources", "active", "open_postings", "companies", "with_description"]
    return s.join(p, "ats", "full_outer").na.fill(0, zero).filter(
        (F.col("sources") > 0) | (F.col("open_postings") > 0))


# --- evidence about candidates ----------------------------------------------


def evidence_summary(candidates: DataFrame) -> DataFrame:
    """(section, label, n, min, max, mean, median) over checked candidates."""
    checked = candidates.filter(F.col("checked_at").isNotNull())

    def field(name):
        return F.get_json_object("evidence", f"$.{name}")

    none = [F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "median")]
    statuses = checked.groupBy(F.col("review_status").alias("label")).agg(F.count("*").alias("n")).select(
        F.lit("review_status").alias("section"), "label", "n", *none)
    why = F.coalesce(field("reason"), F.lit("(no reason recorded)"))
    reasons = checked.filter("review_status = 'rejected'").groupBy(why.alias("label")).agg(
        F.count("*").alias("n")).select(F.lit("rejected_reason").alias("section"), "label", "n", *none)

    def stats(name):
        # Equal values are counted first, so the exact median works on (value, count) pairs.
        values = checked.filter(F.col("review_status").isin("promoted", "rejected")).select(
            F.col("review_status").alias("label"), field(name).cast("double").alias("v"),
        ).filter(F.col("v").isNotNull()).groupBy("label", "v").agg(F.count("*").alias("c"))
        return values.groupBy("label").agg(
            F.sum("c").alias("n"), F.round(F.min("v"), 2).alias("min"), F.round(F.max("v"), 2).alias("max"),
            F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 2).alias("mean"),
            F.round(F.percentile("v", F.lit(0.5), F.col("c")), 2).alias("median"),
        ).select(F.lit(name).alias("section"), "label", "n", "min", "max", "mean", "median")

    return reduce(lambda a, b: a.unionByName(b), [statuses, reasons, stats("name_similarity"), stats("intern_count")])


def confirmation_rates(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """What became of promoted candidates: active, on probation, or gone."""
    s = sources.filter("added_by = 'discovery'").select("company", "ats", F.col("status").alias("now"), F.lit(True).alias("here"))
    return candidates.filter("review_status = 'promoted'").join(s, ["company", "ats"], "left").agg(
        F.count_if(F.col("now") == "active").alias("confirmed_active"),
        F.count_if(F.col("now") == "probation").alias("still_on_probation"),
        F.count_if(F.col("here").isNull()).alias("no_longer_in_sources"),
    )


def _levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(pairs: DataFrame, key: str = "candidate", edits: bool = False) -> DataFrame:
    """(candidate, name_similarity): the best match among a candidate's fetched names.

    Names are compared as slugs, each distinct pair of slugs once, by their
    common blocks; ``edits`` takes an edit-distance ratio instead, which differs.
    """
    named = pairs.select(key, slug("candidate_name").alias("a"), slug("company").alias("b")).distinct()
    distinct = named.select("a", "b").distinct()
    ratios = distinct.withColumn("r", _levenshtein_ratio(F.col("a"), F.col("b"))) if edits else with_ratio(distinct, into="r")
    return named.join(ratios, ["a", "b"]).groupBy(key).agg(F.max("r").alias("name_similarity"))


def verify_gate(candidates: DataFrame, fetched: DataFrame, distinct_titles: int = 2,
                threshold: float = vocab.NAME_MATCH_THRESHOLD, samples: int = 5) -> DataFrame:
    """Whether a candidate's trial fetch is worth trusting, and the first reason why not.

    candidates: (candidate, candidate_name); fetched: (candidate, id, company, title).
    """
    rows = fetched.withColumn("_intern", is_internship("title"))
    counts = rows.groupBy("candidate").agg(
        F.count("*").alias("total"), F.count_if("_intern").alias("intern_count"),
        F.count_distinct("title").alias("distinct_titles"),
    )
    # Intern titles first: a candidate with any shows only those.
    shown = top_n_per(rows, "candidate", [F.desc("_intern"), F.asc("id")], samples)
    has_intern = F.max("_intern").over(Window.partitionBy("candidate"))
    titles = shown.withColumn("_any", has_intern).filter(F.col("_intern") == F.col("_any")).groupBy("candidate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("sample_titles"))
    named = rows.filter(text_of("company") != "").select("candidate", "company").distinct()
    similar = name_similarity(named.join(candidates, "candidate"))
    out = (
        candidates.join(counts, "candidate", "left").join(titles, "candidate", "left").join(similar, "candidate", "left")
        .na.fill(0, ["total", "intern_count", "distinct_titles"]).na.fill(0.0, ["name_similarity"])
    )
    code = (
        F.when(F.col("total") == 0, "zero_postings")
        .when(F.col("intern_count") < 1, "no_internship_titles")
        .when((F.col("total") >= distinct_titles) & (F.col("distinct_titles") < distinct_titles), "not_distinct")
        .when(F.col("name_similarity") < threshold, "name_mismatch")
        .otherwise("ok")
    )
    return out.withColumn("code", code).withColumn("passed", F.col("code") == "ok").withColumn(
        "name_similarity", F.round("name_similarity", 2))


# --- runs -------------------------------------------------------------------


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest run of each source."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("started_at", "id")).alias("_run")
    return runs.groupBy("source_id").agg(newest).select("_run.*")


def recent_runs(runs: DataFrame, n: int = vocab.EMPTY_RUNS_BEFORE_BACKOFF) -> DataFrame:
    """Per source, of its last n runs: how many, how many fine but empty, how many failed."""
    last = top_n_per(runs, "source_id", [F.desc("started_at"), F.desc("id")], n)
    return last.groupBy("source_id").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("ok") & (F.col("fetched_count") == 0)).alias("empty_ok"),
        F.count_if(~F.col("ok")).alias("failures"),
    )


def run_counts(runs: DataFrame) -> DataFrame:
    """Per source over all its runs: fetched, relevant, failed."""
    return runs.groupBy("source_id").agg(
        F.count("*").alias("runs"), F.sum("fetched_count").alias("fetched"),
        F.sum("internship_count").alias("relevant"), F.count_if(~F.col("ok")).alias("failed"),
    )


# --- audits -----------------------------------------------------------------


def age_buckets(postings: DataFrame, as_of: Column) -> DataFrame:
    """How old the open corpus is by its employers' own dates."""
    def within(days):
        return F.col("posted_at_ts") >= F.timestamp_add("DAY", F.lit(-days), as_of)

    return postings.filter(_is_open()).agg(
        F.count("*").alias("open"),
        F.count_if(within(7)).alias("last_7_days"),
        F.count_if(within(90)).alias("last_90_days"),
        F.count_if(F.col("posted_at_ts").isNotNull() & ~within(365)).alias("over_a_year"),
        F.min("posted_at_ts").alias("oldest"),
    )


def outcome_tally(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    """Counts of each outcome and their share of all, in percent."""
    counts = outcomes.groupBy(column).agg(F.count("*").alias("n"))
    # One row per distinct outcome reaches this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 1))


def majority_vote(named: DataFrame, key: str = "source_id", name: str = "name", n: int | None = None,
                  order: list[Column] | None = None) -> DataFrame:
    """The name most rows of a key carry; ties go to the first by name.  ``n`` samples per key, if given."""
    rows = top_n_per(named, key, order, n) if n else named
    votes = rows.filter(text_of(name) != "").groupBy(key, name).agg(F.count("*").alias("votes"))
    return first_per(votes, key, [-F.col("votes"), F.col(name)])


def unparseable_dates(postings: DataFrame, n: int = 10) -> DataFrame:
    """Raw dates no rule reads, by their first 24 characters, most frequent first."""
    from joblattice.functions.dates import parse_posted_at

    bad = postings.filter(F.col("posted_at").isNotNull() & parse_posted_at()["ts"].isNull())
    return bad.groupBy(F.substring("posted_at", 1, 24).alias("prefix")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "prefix").limit(n)


def reconcile_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Row counts of two snapshots, table by table."""
    def counts(tables, name):
        one = [d.agg(F.count("*").alias(name)).select(F.lit(t).alias("table"), name) for t, d in tables.items()]
        return reduce(lambda a, b: a.unionByName(b), one)

    both = counts(before, "rows_before").join(counts(after, "rows_after"), "table", "full_outer")
    return both.withColumn("matches", F.col("rows_before").eqNullSafe(F.col("rows_after")))
