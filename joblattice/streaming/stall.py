"""Noticing that nothing succeeds any more, once per episode."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from joblattice import vocab

ALERT = "key string, last_success timestamp, kind string"


def stall_alerts(runs: DataFrame, alerts: DataFrame, as_of: Column, key: str | None = None, hours: int = vocab.STALL_HOURS) -> DataFrame:
    """Per key (the whole feed if none): last success, stalled or not, and whether to alert now.

    A key that never succeeded is not stalled.  An alert newer than the last
    success has told of this episode already.
    """
    def keyed(df):
        return df.withColumn("_k", F.lit("all") if key is None else F.col(key).cast("string"))

    good = keyed(runs.filter("ok")).groupBy("_k").agg(F.max("started_at").alias("last_success"))
    told = keyed(alerts).groupBy("_k").agg(F.max("created_at").alias("last_alert"))
    late = F.col("last_success") < F.timestamp_add("HOUR", F.lit(-hours), as_of)
    again = F.coalesce(F.col("last_alert") > F.col("last_success"), F.lit(False))
    gap = (F.unix_timestamp(as_of) - F.unix_timestamp("last_success")) / 3600
    return good.join(told, "_k", "left").select(
        F.col("_k").alias("key"), "last_success", late.alias("stalled"), (late & ~again).alias("emit"),
        F.round(gap, 1).alias("hours"))


def stall_log(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Activity rows for the alerts to emit."""
    detail = F.format_string(
        "No source has been scraped successfully in %.1f hours — the feed is serving an ageing corpus", F.col("hours"))
    company = F.when(F.col("key") != "all", F.col("key"))
    return alerts.filter("emit").select(F.lit("stalled").alias("kind"), company.alias("company"), detail.alias("detail"), as_of.alias("created_at"))


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only each key's newest success of a stretch of rows goes into the shuffle."""
    for batch in batches:
        yield batch.groupby("key", as_index=False)["started_at"].max()


def stall_stream(runs: DataFrame, key: str | None = None, hours: int = vocab.STALL_HOURS, clock: str = "event") -> DataFrame:
    """A stream of alerts from a stream of runs (started_at, ok, key).

    With the event clock time is what the newest success of any key says; with
    the processing clock it is the machine's, so silence is noticed too.
    """
    waits_event = clock == "event"
    named = F.lit("all") if key is None else F.col(key).cast("string")
    good = runs.filter("ok").select(named.alias("key"), "started_at").mapInPandas(_newest, "key string, started_at timestamp")
    if waits_event:
        good = good.withWatermark("started_at", f"{hours} hours")  # a success may come that late

    def step(k, pdfs, state: GroupState):
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_success": [pd.Timestamp(seen, unit="us")], "kind": ["stalled"]})
            return
        seen = state.get[0] if state.exists else 0
        for pdf in pdfs:
            if len(pdf):
                seen = max(seen, int(pdf["started_at"].max().value // 1000))
        state.update((seen,))
        if waits_event:
            # the watermark is the stall time behind the newest success of any key
            state.setTimeoutTimestamp(max(seen // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(hours * 3600 * 1000)

    timeout = GroupStateTimeout.EventTimeTimeout if waits_event else GroupStateTimeout.ProcessingTimeTimeout
    return good.groupBy("key").applyInPandasWithState(step, ALERT, "seen long", "append", timeout)
