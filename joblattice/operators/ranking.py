"""Orders, pages, top-n per group, work queues, unions by priority."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblattice.operators.filters import ready
from joblattice.session import shared_dir

PAGE_MAX = 5000


def feed_order() -> list[Column]:
    return [F.desc_nulls_last("posted_at_ts"), F.desc("first_seen"), F.asc("id")]


def category_order() -> list[Column]:
    """By industry, then newest first seen."""
    name = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Uncategorized"))
    return [name.asc(), F.desc("first_seen"), F.asc("id")]


def total_order(df: DataFrame, keys: list[Column], tiebreak: str) -> list[Column]:
    """Sort keys ending in a unique column; paging on anything less loses rows."""
    if tiebreak not in df.columns:
        raise ValueError(f"'{tiebreak}' is not a column; a paged sort must end in a unique one")
    return [*keys, F.asc(tiebreak)]


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """A page by offset, numbered from offset+1.

    Sort, offset and limit plan as one take-ordered step.  For deep pages use
    ``page_after``, whose cost does not grow with depth.
    """
    if not 0 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be within 0..{PAGE_MAX} and offset not negative")
    rows = df.orderBy(*order).offset(offset).limit(limit)
    # The numbering window sees one page of at most PAGE_MAX rows.
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset)


def page_after(df: DataFrame, last: dict, limit: int = 200) -> DataFrame:
    """The feed page following the row with these posted_at_ts, first_seen and id."""
    ts, seen, rid = F.col("posted_at_ts"), F.col("first_seen"), F.col("id")
    at_seen, at_id = F.lit(last["first_seen"]), F.lit(last["id"])
    tie = (seen < at_seen) | ((seen == at_seen) & (rid > at_id))
    if last["posted_at_ts"] is None:
        later = ts.isNull() & tie
    else:
        at = F.lit(last["posted_at_ts"])
        later = ts.isNull() | (ts < at) | ((ts == at) & tie)
    return df.filter(later).orderBy(*feed_order()).limit(limit)


def capped(df: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The feed's source rows, and one row saying whether a cap cut any off; without one, all rows."""
    rows = df.orderBy(*feed_order())
    if cap is None:
        return rows, df.sparkSession.createDataFrame([(False,)], "truncated boolean")
    return rows.limit(cap), df.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))


def top_n_per(df: DataFrame, key, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group.

    Spark limits every group before the shuffle as well, so a hot group sends
    n rows per task, not all of its own.
    """
    keys = [key] if isinstance(key, str) else list(key)
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(rank) <= n)


def numbered(df: DataFrame, key: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """All rows with their number within their group, from 1, however large a group is.

    Rows are dealt by range over key and order, so a hot group spans many
    tasks, and stored as dealt; each stretch is numbered by itself and starts
    where the counts of the group's stretches before it end.  ``order`` should
    end in a unique column.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/numbered-{uuid4().hex}"
    df.repartitionByRange(F.asc(key), *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    # a row per group and stretch, as many as tasks at most for one group
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    starts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), before.alias("_before"))
    mine = dealt.withColumn("_mine", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    met = mine.join(starts, mine[key].eqNullSafe(starts["_key"]) & (mine["_part"] == starts["_at"]))
    return met.select(*df.columns, (F.col("_before") + F.col("_mine")).cast("int").alias(rank))


def shown_per(df: DataFrame, key: str, order: list[Column], n: int | None) -> DataFrame:
    """Rows of each group with their rank, and `truncated`: whether n left any out.  All rows if n is None."""
    if n is None:
        return numbered(df, key, order).withColumn("truncated", F.lit(False))
    sizes = df.groupBy(key).agg((F.count("*") > n).alias("truncated"))
    return top_n_per(df, key, order, n).join(sizes, key)


def first_per(df: DataFrame, key, order) -> DataFrame:
    """One row per key: the least by ``order`` (columns), found by plain aggregation."""
    keys = [key] if isinstance(key, str) else list(key)
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select("_row.*")


def priority_union(inputs: list[DataFrame], key: str = "id") -> DataFrame:
    """Union where the earlier input wins a key."""
    tagged = [d.withColumn("_from", F.lit(i)) for i, d in enumerate(inputs)]
    names = list(dict.fromkeys(c for d in inputs for c in d.columns))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = F.min_by(F.struct(*names), "_from").alias("_row")
    return both.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select("_row.*")


# --- work queues ------------------------------------------------------------


def _due_sources(as_of):
    return F.col("status").isin("probation", "active") & (F.col("next_scrape_at") <= as_of)


def _due_descriptions(as_of):
    return (
        F.col("status").isin("open", "duplicate") & F.col("description").isNull()
        & ready("description_next_attempt_at", as_of)
    )


def _due_liveness(as_of):
    return (F.col("status") == "open") & (F.col("url") != "") & ready("liveness_next_check_at", as_of)


def _due_candidates(as_of, version: int):
    again = (F.col("next_check_at") <= as_of) | (F.col("probe_set_version") < version)
    return (F.col("review_status") == "unchecked") | (F.col("review_status").isin("no_match", "rejected") & again)


def _unresolved():
    return (
        (F.col("ats") == "workday") & F.col("status").isin("active", "probation")
        & (F.col("company") == F.get_json_object("config", "$.tenant"))
    )


def due(df: DataFrame, queue: str, as_of: Column, probe_version: int = 1) -> DataFrame:
    """Rows a queue may hand out: sources, descriptions, liveness, candidates, disabled, unresolved."""
    tests = {
        "sources": lambda: _due_sources(as_of),
        "descriptions": lambda: _due_descriptions(as_of),
        "liveness": lambda: _due_liveness(as_of),
        "candidates": lambda: _due_candidates(as_of, probe_version),
        "disabled": lambda: F.col("status") == "disabled",
        "unresolved": lambda: _unresolved(),
    }
    return df.filter(tests[queue]())


def claim(df: DataFrame, queue: str, n: int, as_of: Column, probe_version: int = 1) -> DataFrame:
    """The first n due rows of a queue, with their place in it."""
    orders = {
        "sources": [F.asc("next_scrape_at"), F.asc("id")],
        "descriptions": [F.asc_nulls_first("description_next_attempt_at"), F.desc("first_seen"), F.asc("id")],
        "liveness": [F.asc_nulls_first("liveness_next_check_at"), F.asc_nulls_last("posted_at_ts"), F.asc("id")],
        "candidates": [
            (F.col("review_status") == "unchecked").desc(), (F.col("probe_set_version") >= probe_version).desc(),
            F.asc("next_check_at"), F.asc("id"),
        ],
        "disabled": [F.asc_nulls_last("last_scraped_at"), F.asc("id")],
        "unresolved": [F.asc("id")],
    }
    rows = due(df, queue, as_of, probe_version).orderBy(*orders[queue]).limit(n)
    # The numbering window sees the n claimed rows only.
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*orders[queue])))
