"""A source's life over many runs, without gathering any source's runs in one place.

Runs are split by range over (source, time), so one busy source spans many
tasks.  Each task folds its stretch into one short summary per source;
summaries of neighbouring stretches combine associatively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice import vocab

SUMMARY = (
    "source_id long, first_at timestamp, first_id long, last_at timestamp, runs long, lead_ok long, lead_fail long, "
    "trail_fail long, worst long, any_ok boolean"
)
_FIELDS = [f.split()[0] for f in SUMMARY.split(", ")]


def _stretch(ok: np.ndarray) -> dict:
    """Leading, trailing and longest stretches of one run of outcomes."""
    good, bad = np.flatnonzero(ok), np.flatnonzero(~ok)
    edges = np.concatenate([[-1], good, [len(ok)]])
    return {
        "runs": len(ok), "lead_ok": int(bad[0]) if len(bad) else len(ok), "lead_fail": int(good[0]) if len(good) else len(ok),
        "trail_fail": int(len(ok) - 1 - good[-1]) if len(good) else len(ok), "worst": int(np.diff(edges).max() - 1), "any_ok": bool(len(good)),
    }


def _joined(a: dict, b: dict) -> dict:
    return {
        **a, "last_at": b["last_at"], "runs": a["runs"] + b["runs"],
        "lead_ok": a["lead_ok"] if a["lead_ok"] < a["runs"] else a["runs"] + b["lead_ok"],
        "lead_fail": a["lead_fail"] if a["any_ok"] else a["runs"] + b["lead_fail"],
        "trail_fail": b["trail_fail"] if b["any_ok"] else a["trail_fail"] + b["runs"],
        "worst": max(a["worst"], b["worst"], a["trail_fail"] + b["lead_fail"]), "any_ok": a["any_ok"] or b["any_ok"],
    }


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted runs of one task in, one summary per source out; holds one summary at a time."""
    held = None
    for batch in batches:
        if batch.empty:
            continue
        ids = batch["source_id"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        done = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.iloc[a:b]
            one = {
                "source_id": ids[a], "first_at": part["started_at"].iloc[0], "first_id": part["id"].iloc[0],
                "last_at": part["started_at"].iloc[-1], **_stretch(part["ok"].to_numpy(dtype=bool)),
            }
            if held is not None and held["source_id"] == one["source_id"]:
                held = _joined(held, one)
            else:
                if held is not None:
                    done.append(held)
                held = one
        if done:
            yield pd.DataFrame(done)[_FIELDS]
    if held is not None:
        yield pd.DataFrame([held])[_FIELDS]


def _combined(parts: Column) -> Column:
    """Summaries in time order into one; there are at most as many as tasks."""
    def step(a: Column, b: Column) -> Column:
        def c(f):
            return a[f], b[f]

        runs = a["runs"] + b["runs"]
        return F.struct(
            F.greatest(*c("last_at")).alias("last_at"), runs.alias("runs"),
            F.when(a["lead_ok"] < a["runs"], a["lead_ok"]).otherwise(a["runs"] + b["lead_ok"]).alias("lead_ok"),
            F.when(a["any_ok"], a["lead_fail"]).otherwise(a["runs"] + b["lead_fail"]).alias("lead_fail"),
            F.when(b["any_ok"], b["trail_fail"]).otherwise(a["trail_fail"] + b["runs"]).alias("trail_fail"),
            F.greatest(a["worst"], b["worst"], a["trail_fail"] + b["lead_fail"]).alias("worst"),
            (a["any_ok"] | b["any_ok"]).alias("any_ok"),
        )

    zero = F.struct(
        F.lit(None).cast("timestamp").alias("last_at"), *[F.lit(0).cast("long").alias(f) for f in ("runs", "lead_ok", "lead_fail", "trail_fail", "worst")],
        F.lit(False).alias("any_ok"))
    return F.aggregate(parts, zero, step)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per source: runs, leading and trailing failures, the longest failing stretch."""
    ordered = runs.select("source_id", "started_at", "id", "ok").repartitionByRange(
        "source_id", "started_at", "id").sortWithinPartitions("source_id", "started_at", "id")
    stretches = ordered.mapInPandas(_fold, SUMMARY)
    inner = [f for f in _FIELDS if f != "source_id"]
    return stretches.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("_s")).select(
        "source_id", _combined(F.col("_s")).alias("_t")).select("source_id", "_t.*")


def lifecycle(sources: DataFrame, runs: DataFrame, threshold: int = vocab.DISABLE_AFTER_FAILURES) -> DataFrame:
    """Sources after all their runs, taken in order.

    A failure on probation removes a source; on probation two successes in
    all make it active; ``threshold`` failures in a row disable it.  Disabled
    and removed sources are not run again, so later runs do not count.
    """
    met = sources.join(run_summary(runs).withColumnRenamed("source_id", "id"), "id", "left")
    ran = F.col("runs").isNotNull()
    probation, active = ran & (F.col("status") == "probation"), ran & (F.col("status") == "active")
    need = F.when(F.col("last_scraped_at").isNull(), 2).otherwise(1)
    confirmed = probation & (F.col("lead_ok") >= need)
    removed = probation & ~confirmed & (F.col("lead_ok") < F.col("runs"))
    at_once = active & (F.col("lead_fail") > 0) & (F.col("consecutive_failures") + F.col("lead_fail") >= threshold)
    disabled = at_once | ((active | confirmed) & (F.col("worst") >= threshold))
    lasting = F.when(F.col("any_ok"), F.col("trail_fail")).otherwise(F.col("consecutive_failures") + F.col("runs"))
    failures = (
        F.when(at_once, F.greatest(F.lit(threshold), F.col("consecutive_failures") + 1))
        .when(disabled, threshold)
        .when(confirmed, F.col("trail_fail"))
        .when(removed, F.col("consecutive_failures") + F.when(F.col("lead_ok") > 0, 1 - F.col("consecutive_failures")).otherwise(1))
        .when(probation, 0)
        .when(active, lasting)
        .otherwise(F.col("consecutive_failures"))
    )
    status = F.when(disabled, "disabled").when(removed, "removed").when(confirmed, "active").otherwise(F.col("status"))
    new = {
        "status": status, "consecutive_failures": failures.cast("int"),
        "last_scraped_at": F.when(probation | active, F.col("last_at")).otherwise(F.col("last_scraped_at")),
    }
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in sources.columns])
