"""Predicates: presets, axes, cycles, substrings, queues, change."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.dates import is_too_old
from joblattice.functions.text import as_col, matches_any, strip, text_of

FEED_EXCLUDED = ["description", "description_attempts", "description_next_attempt_at"]


@dataclass(frozen=True)
class FilterSpec:
    """A preset: what to keep, by plain lists."""

    keywords_any: list = field(default_factory=list)
    exclude_keywords: list = field(default_factory=list)
    trusted_companies: list = field(default_factory=list)
    locations_include: list = field(default_factory=list)
    locations_exclude: list = field(default_factory=list)
    max_age_days: int | None = None
    name: str = ""

    @classmethod
    def from_dict(cls, spec: dict) -> "FilterSpec":
        known = {k: v for k, v in spec.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**known)

    def override(self, **lists) -> "FilterSpec":
        """Lists given by a request replace the preset's; they are not merged."""
        return replace(self, **{k: v for k, v in lists.items() if v is not None})


def resolve_preset(name: str | None, presets: dict[str, FilterSpec], **overrides) -> FilterSpec | None:
    """The named preset with overrides; None for 'all', which filters nothing."""
    if name == "all":
        return None
    key = name or "default"
    if key not in presets:
        raise KeyError(f"no such preset '{key}'")
    return presets[key].override(**overrides)


def passes(spec: FilterSpec, as_of: Column) -> Column:
    """One native predicate for a preset.  An empty preset matches nothing."""
    text = F.concat_ws(" ", text_of("title"), text_of("description_snippet"))
    place = text_of("location")
    trusted = F.col("company").isin(list(spec.trusted_companies)) if spec.trusted_companies else F.lit(False)
    wanted = F.coalesce(trusted, F.lit(False)) | matches_any(text, spec.keywords_any)
    ok = (
        wanted
        & ~matches_any(text, spec.exclude_keywords)
        & ~matches_any(place, spec.locations_exclude)
        & ~is_too_old(days=spec.max_age_days, as_of=as_of)
    )
    return ok & matches_any(place, spec.locations_include) if spec.locations_include else ok


def apply_presets(postings: DataFrame, presets: dict[str, FilterSpec], as_of: Column) -> DataFrame:
    """Every (preset, posting) that passes, reading the postings once."""
    hits = F.array_compact(F.array(*[F.when(passes(s, as_of), F.lit(n)) for n, s in presets.items()]))
    return postings.select("*", F.explode(hits).alias("preset"))


def axis_filter(df: DataFrame, category=None, job_function=None, work_arrangement=None) -> DataFrame:
    wanted = {"category": category, "job_function": job_function,
              "work_arrangement": work_arrangement.strip().lower() if work_arrangement else None}
    return reduce(lambda d, kv: d.filter(text_of(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1]], df)


def states_cycle() -> Column:
    return (text_of("cycle_season") != "") | F.col("cycle_year").isNotNull()


def cycle_filter(df: DataFrame, season=None, year=None, include_unstated: bool = True) -> DataFrame:
    """Confirmed matches (``cycle_order`` 0), then rows stating no cycle (1) if wanted."""
    if not (season or year):
        return df.withColumn("cycle_order", F.lit(0))
    match = states_cycle()
    if season:
        match = match & (text_of("cycle_season") == season.lower())
    if year:
        match = match & F.coalesce(F.col("cycle_year") == year, F.lit(False))
    order = F.when(match, 0).when(~states_cycle(), 1)
    out = df.withColumn("cycle_order", order).filter(F.col("cycle_order").isNotNull())
    return out if include_unstated else out.filter(F.col("cycle_order") == 0)


def unstated_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~states_cycle()).alias("unstated_cycle"))


def contains_any(q: str, columns) -> Column:
    """Case-insensitive; ``%`` and ``_`` stand for themselves."""
    needle = q.strip().lower()
    return reduce(lambda a, b: a | b, [F.lower(text_of(c)).contains(needle) for c in columns])


def substring_search(df: DataFrame, q: str, columns=("company", "title")) -> DataFrame:
    return df.filter(contains_any(q, columns)) if q and q.strip() else df


def changed(a, b) -> Column:
    """Differs, NULLs comparing as values."""
    return ~as_col(a).eqNullSafe(as_col(b))


def without(df: DataFrame, columns=FEED_EXCLUDED) -> DataFrame:
    return df.drop(*columns)


def ready(column: str, as_of: Column) -> Column:
    return F.col(column).isNull() | (F.col(column) <= as_of)
