"""Posted dates, ages, retry ladders and time formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import as_col, blank_to_null, literal_map, strip, text_of

_LAST_MS = 253402300799999  # end of year 9999
_FIRST_MS = -62135596800000  # start of year 1


def _days_ago(seen_at: Column, n: Column) -> Column:
    sane = F.when(n <= 700000, n)
    return F.timestamp_add("DAY", -sane, seen_at)


def _epoch(text: Column) -> Column:
    """Below 10^11 it is seconds, from there on milliseconds; nothing past year 9999."""
    millis = text.try_cast("bigint")
    return F.when(text.rlike(r"^-?0*\d{1,11}$"), F.timestamp_seconds(text.try_cast("bigint"))).when(
        millis.between(_FIRST_MS, _LAST_MS), F.timestamp_millis(millis))


def _prose_days(lowered: Column) -> Column:
    """Whole days back told by 'posted ...' prose, NULL if it tells none."""
    counted = blank_to_null(F.regexp_extract(lowered, r"posted\s+(\d+)\+?\s*days?\s+ago", 1))
    return F.coalesce(
        counted.try_cast("int"),
        F.when(lowered.rlike(r"posted\s+today"), 0),
        F.when(lowered.rlike(r"posted\s+yesterday"), 1),
    )


# fixed value: the ISO-8601 forms read
_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)

_DAY, _INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"


def _iso(text: Column) -> Column:
    """ISO-8601 instants; one without an offset is UTC whatever the session zone is."""
    full = reduce(lambda t, step: F.regexp_replace(t, *step), [
        (_ISO, "$1-$2-$3T$4:$5:$6.$7$8"),
        (r"(?<=[T:])(?=[:.])", "00"),
        (r"\.(?=Z|[+-]|$)", ""),
        (r"([+-]\d{2})(\d{2})$", "$1:$2"),
        (r"(?<!Z|[+-]\d{2}:\d{2})$", "Z"),
    ], text)
    # whole days and full instants, which most sources write, need no step of the ladder
    return F.when(text.rlike(_ISO), F.when(text.rlike(_DAY), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(_INSTANT), text).otherwise(full).try_cast("timestamp"))


def parse_posted_at(raw="posted_at", seen_at="first_seen") -> Column:
    """struct(ts, approx) from epochs, 'Posted N Days Ago' prose or ISO text; never fails."""
    ts, coarse = posted_parts(raw, seen_at)
    return F.struct(ts.alias("ts"), is_approximate(coarse, ts).alias("approx"))


def is_approximate(coarse: Column, ts: Column) -> Column:
    return F.coalesce(coarse & ts.isNotNull(), F.lit(False))


def posted_parts(raw="posted_at", seen_at="first_seen") -> tuple[Column, Column]:
    """The instant, and whether the text tells no more than a day; apart, so that a plan may keep the instant before it is used again."""
    text, seen = strip(as_col(raw)), as_col(seen_at).cast("timestamp")
    lowered = F.lower(text)
    numeric, prose = text.rlike(r"^-?\d{9,}$"), lowered.contains("posted")
    ts = (
        F.when(numeric, _epoch(text))
        .when(prose, _days_ago(seen, _prose_days(lowered)))
        .otherwise(_iso(text))
    )
    return ts, ~numeric & (prose | (F.length(text) <= 10))


def is_too_old(posted_at_ts="posted_at_ts", first_seen="first_seen", days=None, as_of=None) -> Column:
    """Strictly older than ``days``; unknown ages are never too old."""
    if not days:
        return F.lit(False)
    when = F.coalesce(as_col(posted_at_ts), as_col(first_seen))
    return F.coalesce(when < F.timestamp_add("DAY", F.lit(-int(days)), as_of), F.lit(False))


def recheck_days(code="code", table=vocab.RECHECK_DAYS) -> Column:
    return F.coalesce(literal_map(table)[text_of(code)], F.lit(vocab.DEFAULT_RECHECK_DAYS))


def next_attempts(attempts) -> Column:
    return F.least(as_col(attempts) + 1, F.lit(32767)).cast("int")


def backoff(attempts, hours, as_of) -> Column:
    """When to try again after one more failure, from the count before it."""
    ladder = F.array(*[F.lit(h) for h in hours])
    rung = F.least(as_col(attempts) + 1, F.lit(len(hours))).cast("int")
    return F.timestamp_add("HOUR", F.element_at(ladder, rung), as_of)


def rfc3339(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_text(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")
