"""Line dedup by site-relative frequency: lines on too large a share of a site's pages are boilerplate.

Native throughout.  A page names each of its distinct lines once, counts are
combined before the shuffle, and what is boilerplate is at most the mean number
of lines of a page divided by the ratio for each site, so the lists per site
are small.  Pages never move: the lists are stored first, so their size is
known, and adaptive execution broadcasts them if they are small or else splits
the pages of a hot site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import stored, whole_text

RATIO, MIN_PAGES = 0.08, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _print(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per site (null is a site) and line fingerprint: `pages` that have the line, and the site's `total`.

    Only lines with a word count; a line must be on at least `min_pages` pages,
    and on more than `ratio` of the site's.
    """
    pages = docs.select(F.col(site).alias("site"), whole_text(text).alias("t"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    each = pages.select("site", F.explode(F.array_distinct(F.filter(_lines(F.col("t")), _has_word))).alias("line"))
    counted = each.groupBy("site", _print(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("pages"))
    counted = counted.where(F.col("pages") >= min_pages).alias("c")
    return counted.join(totals.alias("t"), F.expr("c.site <=> t.site")).where(F.col("pages") > ratio * F.col("total")).select(
        "c.site", "line", "pages", "total")


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` without boilerplate lines, plus `n_lines` and `n_dropped` (replacing columns of those names).

    Null texts stay null with no lines, and a text that loses all its lines
    becomes empty; no row goes.  Repeated rows are pages like any other.
    """
    lists = boilerplate(docs, site, text, ratio, min_pages).groupBy(F.col("site").alias("__ld_site")).agg(
        F.collect_list("line").alias("__ld_bad"))
    lists = stored(lists, "boilerplate")
    df = docs.join(lists, docs[site].eqNullSafe(lists["__ld_site"]), "left")
    all_lines = _lines(F.col(text))
    df = df.withColumn("__ld_keep", F.when(F.col("__ld_bad").isNotNull(), F.filter(
        all_lines, lambda x: ~_has_word(x) | ~F.array_contains(F.col("__ld_bad"), _print(x)))).otherwise(all_lines))
    df = df.withColumn("n_lines", F.coalesce(F.size(F.when(F.col(text).isNotNull(), all_lines)), F.lit(0)).cast("long"))
    df = df.withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines") - F.size("__ld_keep")).cast("long"))
    df = df.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__ld_keep", "\n")).otherwise(F.col(text)))
    return df.drop("__ld_site", "__ld_bad", "__ld_keep")


def op5(spark, sf_dir: str) -> DataFrame:
    from joblattice.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP5_SQL = rf"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
counted AS (
    SELECT source, line, count(*) AS c
    FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM pages)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
bad AS (
    SELECT c.source, list(c.line) AS bad FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
    WHERE c.c >= {MIN_PAGES} AND c.c > {RATIO} * t.total GROUP BY c.source),
kept AS (
    SELECT p.doc_id, p.source, p.text, p.lines,
           list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.bad, x), false)) AS keep
    FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source,
       CASE WHEN len(keep) < len(lines) THEN array_to_string(keep, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(keep), 0) AS BIGINT) AS n_dropped
FROM kept
"""
