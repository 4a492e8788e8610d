"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the session must allow for ``lookup`` to split a hot key's rows at run time.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def lookup(left: DataFrame, right: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join to rows unique per ``key``, whatever the key's distribution.

    Adaptive execution broadcasts a right side it has measured to be small,
    and else splits the partition of a hot key over many tasks, each joined
    with a copy of that key's one right row.  Rows without a key match nothing
    and are spread by ``row_id``, so they never meet in one task.
    """
    payload = [c for c in right.columns if c != key]
    spread = F.concat(F.lit("\u0000"), F.col(row_id).cast("string"))
    keyed = left.withColumn("_key", F.coalesce(F.col(key).cast("string"), spread))
    answers = right.select(F.col(key).cast("string").alias("_key"), *[F.col(c).alias(f"_right_{c}") for c in payload])
    return keyed.join(answers, "_key", "left").select(
        *[F.col(c) for c in left.columns], *[F.col(f"_right_{c}").alias(c) for c in payload])


#: Rows of a table of short rows, and of whole texts, that one task deals with.
TASK_ROWS, TASK_TEXTS = 50_000, 2_500


def spread(rows: DataFrame, per_task: int | None = None) -> DataFrame:
    """The rows over all cores where their files are too few to be read by all.

    ``per_task`` bounds a task's rows, so that tasks grow in number and not in
    size; the rows are counted for it, which files answer by their footers.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if per_task is not None:
        tasks = max(tasks, -(-rows.count() // per_task))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
