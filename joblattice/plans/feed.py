"""The feed query: filters, optional search, order and page as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.dates import is_too_old
from joblattice.operators import filters, ranking, search


def feed_rows(postings: DataFrame, as_of: Column, spec: filters.FilterSpec | None = None, max_age_days: int | None = None,
              category=None, job_function=None, work_arrangement=None, cycle_season=None, cycle_year=None,
              include_unstated_cycle: bool = True, q: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Open postings a request asks for, with ``cycle_order`` and ``search_rank`` to sort by.

    ``spec`` None is the whole corpus.  ``q`` needs the text index.
    """
    rows = filters.without(postings.filter("status = 'open'"))
    if spec is not None:
        rows = rows.filter(filters.passes(spec, as_of))
    rows = rows.filter(~is_too_old(days=max_age_days, as_of=as_of))
    rows = filters.axis_filter(rows, category, job_function, work_arrangement)
    rows = filters.cycle_filter(rows, cycle_season, cycle_year, include_unstated_cycle)
    if q and q.strip():
        return search.search_feed(rows, index, q)
    return rows.withColumn("search_rank", F.lit(0.0))


def feed_sort() -> list[Column]:
    """Best match first, confirmed cycles before unstated ones, then the feed's own order."""
    return [F.desc("search_rank"), F.asc("cycle_order"), *ranking.feed_order()]


def feed(postings: DataFrame, as_of: Column, limit: int = 200, offset: int = 0, **request) -> DataFrame:
    """One page of the feed, numbered by ``position``."""
    return ranking.page(feed_rows(postings, as_of, **request), feed_sort(), limit, offset)


def feed_total(postings: DataFrame, as_of: Column, **request) -> DataFrame:
    """How many postings a request matches, and how many of them state no cycle."""
    rows = feed_rows(postings, as_of, **request)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("cycle_order") == 1).alias("unstated_cycle"))
