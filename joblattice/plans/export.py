"""What is published: indexes, directories, description shards, Markdown and Atom feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions import dates, identity
from joblattice.functions.text import blank_to_null, text_of, xml_attribute, xml_escape
from joblattice.operators import facets
from joblattice.operators.ranking import feed_order, priority_union, top_n_per
from joblattice.operators.standardize import standardize_posting

INDEX_COLUMNS = [
    "id", "company", "company_key", "title", "location", "url", "ats", "category", "job_function", "work_arrangement",
    "cycle_season", "cycle_year", "posted_at", "posted_at_ts", "posted_at_approx", "first_seen", "description_snippet",
    "dedup_key", "desc_id",
]
SHARD_COLUMNS = [
    "id", "company", "company_key", "title", "location", "url", "ats", "category", "job_function", "work_arrangement",
    "cycle_season", "cycle_year", "posted_at", "description", "dedup_key",
]

# The tag authority of feed and entry ids; a publisher sets its own.
FEED_TAG = "tag:feeds.example.com,2026:"

# fixed values: the feed formats
SUBTITLE = "Internship postings sourced directly from company career sites."
APPROXIMATE = (
    " (date approximate — the source gave a bound, not a date: this posting is AT LEAST this old and may be considerably older)"
)


def feed_index(postings: DataFrame, snippet: int = 280) -> DataFrame:
    """Open postings, standardised, without descriptions; sort by ``feed_order`` when writing."""
    rows = standardize_posting(postings.filter("status = 'open'").drop("description"))
    text = F.col("description_snippet")
    short = F.when(F.length(text) > snippet, F.concat(F.substring(text, 1, snippet), F.lit("…"))).otherwise(text)
    posted = F.coalesce(dates.iso_text("posted_at_ts"), blank_to_null("posted_at"), dates.iso_text("first_seen"))
    return rows.withColumns({
        "posted_at_ts": posted, "first_seen": dates.iso_text("first_seen"),
        "description_snippet": short, "desc_id": identity.safe_id(),
    }).select(*[c for c in INDEX_COLUMNS if c in rows.columns or c == "desc_id"])


def description_shards(table: DataFrame, store: DataFrame | None = None, older: DataFrame | None = None) -> DataFrame:
    """One record per open posting with a description; table before store before older shards.

    Older shards keep their own title and place; the rest is standardised anew.
    """
    has_text = text_of("description") != ""
    live = table.filter("status = 'open'")

    def whole(df):
        std = standardize_posting(df.filter(has_text).withColumn("_text", F.col("description")))
        return std.withColumn("description", F.col("_text")).select(*[c for c in SHARD_COLUMNS if c in std.columns])

    # Who supplies an id is settled by ids alone; only the rows that go out are standardised.
    inputs = [whole(live)]
    wanting = live.filter(~has_text).select("id")
    if store is not None:
        store = store.filter(has_text).join(wanting, "id", "left_semi")
        inputs.append(whole(store))
        wanting = wanting.join(store.select("id"), "id", "left_anti")
    if older is not None:
        kept = ["title", "location", "job_function", "cycle_season", "cycle_year", "description"]
        older = older.filter(has_text).join(wanting, "id", "left_semi")
        again = standardize_posting(older.withColumns({f"_{c}": F.col(c) for c in kept}))
        again = again.withColumns({c: F.col(f"_{c}") for c in kept})
        inputs.append(again.select(*[c for c in SHARD_COLUMNS if c in again.columns]))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
    return merged.withColumn("desc_id", identity.safe_id())


def write_shards(shards: DataFrame, path: str, parts: int = 64) -> None:
    """JSON, gathered into files by the first digits of the record's key."""
    bucketed = shards.withColumn("bucket", F.substring("desc_id", 1, 2))
    bucketed.repartition(parts, "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_bundle(postings: DataFrame, presets: DataFrame, out: str, as_of: Column, store: DataFrame | None = None,
                 older: DataFrame | None = None) -> None:
    """Every published file under ``out``; the index is standardised once and reused."""
    index = feed_index(postings)
    index.orderBy(F.desc_nulls_last("posted_at_ts"), F.desc("first_seen"), "id").write.mode("overwrite").json(f"{out}/feed")
    index = postings.sparkSession.read.schema(index.schema).json(f"{out}/feed")
    facets.metadata(index).write.mode("overwrite").json(f"{out}/meta")
    facets.metadata_totals(index).withColumn("generated_at", dates.iso_text(as_of)).coalesce(1).write.mode("overwrite").json(f"{out}/totals")
    facets.company_directory(index).orderBy(F.desc("postings_count"), "key").write.mode("overwrite").json(f"{out}/companies")
    presets.coalesce(1).write.mode("overwrite").json(f"{out}/presets")
    write_shards(description_shards(postings, store, older), f"{out}/descriptions")
    every = postings.filter("status = 'open'").withColumn("feed_key", F.lit("global"))
    atom_feed(every, as_of=as_of).select("document").coalesce(1).write.mode("overwrite").text(f"{out}/atom")


def seed_rows(store: DataFrame, shards: DataFrame, snippet: int = 280) -> DataFrame:
    """Store rows, then shard rows for ids the store lacks, standardised and keyed."""
    late = shards.withColumns({
        "description_snippet": F.substring(text_of("description"), 1, snippet),
        "first_seen": F.col("first_seen") if "first_seen" in shards.columns else F.lit(None).cast("timestamp"),
    })
    rows = standardize_posting(priority_union([store, late]))
    return rows.withColumns({
        "dedup_key": identity.dedup_key(), "company_key": identity.company_key(),
        "source_entry": F.coalesce(blank_to_null("source_entry"), "company"),
    })


_SEEDED = [
    "company", "title", "location", "category", "job_function", "work_arrangement", "cycle_season", "cycle_year",
    "company_key", "dedup_key", "last_seen",
]


def seed_merge(postings: DataFrame, store: DataFrame, shards: DataFrame, as_of: Column) -> DataFrame:
    """Seed rows merged into the table: new ids whole and open, known ids in the derived columns only."""
    rows = seed_rows(store, shards)
    cols = [c for c in postings.columns if c in rows.columns or c in ("status", "first_seen", "last_seen")]
    rows = rows.withColumns({
        "status": F.lit("open"), "first_seen": F.coalesce(F.col("first_seen").cast("timestamp"), as_of),
        "last_seen": F.coalesce(F.col("last_seen").cast("timestamp"), as_of) if "last_seen" in rows.columns else as_of,
    })
    new = rows.select("id", F.struct(*[c for c in cols if c != "id"]).alias("_n"))
    old = postings.select("id", F.struct(*[c for c in postings.columns if c != "id"]).alias("_o"))
    both = old.join(new, "id", "full_outer")
    was, now = F.col("_o").isNotNull(), F.col("_n").isNotNull()

    def value(c):
        o = F.col(f"_o.{c}")
        if c not in cols:
            return o
        n = F.col(f"_n.{c}")
        return F.when(now, n).otherwise(o) if c in _SEEDED else F.when(was, o).otherwise(n)

    return both.select("id", *[value(c).alias(c) for c in postings.columns if c != "id"])


# --- documents per feed ------------------------------------------------------


def markdown_feed(postings: DataFrame, as_of: Column, feed_key: str = "feed_key", label: str = "joblattice", new_ids: DataFrame | None = None) -> DataFrame:
    """The lines of every feed's listing, grouped by industry, newest first.

    One row per line, never one per document, so a feed may be of any size.
    ``part`` 0-4 is the head, then by category 5 heading, 6 entry, 7 blank.
    """
    rows = postings.withColumn("_category", F.coalesce(blank_to_null("category"), F.lit("Uncategorized")))
    flag = F.lit("")
    if new_ids is not None:
        rows = rows.join(new_ids.select("id", F.lit(True).alias("_new")), "id", "left")
        flag = F.when(F.col("_new"), " 🆕").otherwise("")
    place = F.when(text_of("location") != "", F.concat(F.lit(" — "), "location")).otherwise("")
    entry = F.concat(
        F.lit("- ["), "company", F.lit(": "), "title", F.lit("]("), "url", F.lit(")"), place, flag,
        F.lit(" (first seen "), F.date_format("first_seen", "yyyy-MM-dd"), F.lit(")"))
    entries = rows.select(
        feed_key, F.col("_category").alias("category"), F.lit(6).alias("part"), "first_seen", "id", entry.alias("line"))
    none = [F.lit(None).cast("timestamp").alias("first_seen"), F.lit("").alias("id")]

    def lines(df, *pairs):
        return df.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), t.alias("line")) for p, t in pairs])).alias("_l"))

    by_category = rows.select(feed_key, F.col("_category").alias("category")).distinct()
    heads = lines(by_category, (5, F.concat(F.lit("## "), "category")), (5, F.lit("")), (7, F.lit("")))
    counts = rows.groupBy(feed_key).agg(F.count("*").alias("n"))
    stamp = F.date_format(as_of, "yyyy-MM-dd HH:mm 'UTC'")
    top = lines(
        counts,
        (0, F.concat(F.lit("# Live Opportunity Feed — "), feed_key)), (1, F.lit("")),
        (2, F.concat(F.lit(f"Auto-generated by `{label}` — last updated "), stamp, F.lit("."))),
        (2, F.lit("Do not hand-edit; changes are overwritten on the next run.")), (3, F.lit("")),
        (4, F.concat(F.col("n").cast("string"), F.lit(" open posting(s) currently tracked."))), (4, F.lit("")),
    ).withColumn("category", F.lit(""))
    cols = [feed_key, "category", F.col("_l.part").alias("part"), *none, F.col("_l.line").alias("line")]
    return entries.unionByName(heads.select(*cols)).unionByName(top.select(*cols))


def write_markdown(lines: DataFrame, path: str, feed_key: str = "feed_key") -> None:
    """Text files per feed; read in name order they are the listing."""
    order = [F.asc(feed_key), F.asc("category"), F.asc("part"), F.desc("first_seen"), F.asc("id"), F.desc("line")]
    lines.orderBy(*order).select(feed_key, "line").write.mode("overwrite").partitionBy(feed_key).text(path)


def atom_entry() -> Column:
    company, url = text_of("company"), text_of("url")
    note = F.when(F.col("posted_at_ts").isNotNull() & F.col("posted_at_approx"), APPROXIMATE).otherwise("")
    summary = F.concat(F.concat_ws(" · ", blank_to_null("company"), blank_to_null("location"), blank_to_null("category")), note)
    ident = F.concat(F.lit(FEED_TAG + "posting/"), F.coalesce(blank_to_null("id"), url))
    return F.concat(
        F.lit("  <entry>\n    <title>"), xml_escape(F.coalesce(blank_to_null("title"), F.lit("Untitled posting"))),
        F.lit("</title>\n    <id>"), xml_escape(ident),
        F.lit('</id>\n    <link rel="alternate" href='), xml_attribute(url),
        F.lit("/>\n    <updated>"), dates.rfc3339("_updated"),
        F.lit("</updated>\n    <author><name>"), xml_escape(F.coalesce(blank_to_null(company), F.lit("Unknown company"))),
        F.lit("</name></author>\n    <summary>"), xml_escape(summary), F.lit("</summary>\n  </entry>"),
    )


def atom_feed(postings: DataFrame, feed_key: str = "feed_key", top: int = 50, as_of: Column | None = None,
              base_url: str = "https://feeds.example.com/") -> DataFrame:
    """(feed_key, document): one Atom document per feed over its first ``top`` postings."""
    now = F.current_timestamp() if as_of is None else as_of
    shown = top_n_per(postings, feed_key, feed_order(), top)
    dated = shown.withColumn("_at", F.coalesce("posted_at_ts", "first_seen")).withColumn("_updated", F.coalesce("_at", now))
    # Groups hold at most ``top`` entries here.
    feeds = dated.select(feed_key, "rank", "_at", atom_entry().alias("entry")).groupBy(feed_key).agg(
        F.coalesce(F.max("_at"), F.max(now)).alias("newest"),
        F.sort_array(F.collect_list(F.struct("rank", "entry"))).alias("entries"))
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")
    key = F.col(feed_key)
    document = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n  <title>'),
        xml_escape(key), F.lit("</title>\n  <id>"), xml_escape(F.concat(F.lit(FEED_TAG), key)),
        F.lit("</id>\n  <updated>"), dates.rfc3339("newest"),
        F.lit('</updated>\n  <link rel="self" href='), xml_attribute(F.concat(F.lit(base_url), key)),
        F.lit(f"/>\n  <subtitle>{SUBTITLE}</subtitle>\n"), body, F.lit("\n</feed>\n"))
    return feeds.select(feed_key, document.alias("document"))
