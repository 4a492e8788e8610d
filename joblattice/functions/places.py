"""Locations: assembling them from parts, standardising them, mapping them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import (
    NOT_AFTER, NOT_BEFORE, SPACE, as_col, blank_to_null, literal_map, squeeze, strip, text_of, title_case,
)


def join_location(city, region, country, remote=None) -> Column:
    """City, region, COUNTRY without the missing ones; remote places say so first."""
    place = F.concat_ws(
        ", ", blank_to_null(strip(city)), blank_to_null(strip(region)), blank_to_null(F.upper(strip(country))),
    )
    if remote is None:
        return place
    far = F.when(place == "", "Remote").otherwise(F.concat(F.lit("Remote - "), place))
    return F.when(F.coalesce(as_col(remote), F.lit(False)), far).otherwise(place)


def flag_arrangement(hybrid, remote) -> Column:
    yes = F.lit(True)
    return F.when(as_col(hybrid) == yes, "hybrid").when(as_col(remote) == yes, "remote").otherwise("")


def _parts(text: Column, separators: str) -> Column:
    return F.filter(F.transform(F.split(text, separators), strip), lambda p: p != "")


def _several(loc: Column) -> Column:
    counted = loc.rlike(rf"(?i){NOT_BEFORE}(?:\d+|multiple)\s+locations?{NOT_AFTER}")
    listed = loc.contains(";") | loc.contains(" | ")
    return counted | (listed & (F.size(_parts(loc, "[;|]")) >= 2))


def _just_remote(loc: Column) -> Column:
    bare = F.lower(strip(F.regexp_replace(loc, r"^[\s\-|:/]+|[\s\-|:/]+$", "")))
    return bare.rlike(
        r"^(?:remote|virtual|flexible\s*/\s*remote)(?:\s*-\s*(?:us|usa|united states|united states of america))?$"
    ) | bare.rlike(r"^(?:us|usa|united states)\s*-\s*remote$")


# fixed values: affixes and address forms cleaned off a place, in this order
_AFFIXES = [
    r"(?i)^(?:remote|virtual|hybrid|flexible\s*/\s*remote)\s*-\s*",
    r"(?i)\s*\((?:remote|hybrid|onsite|virtual)\)$",
    r"(?i)[,\s]+(?:remote|virtual|hybrid)$",
]
_ADDRESS = [
    rf"(?i)^\d+\s+[A-Za-z0-9.\s]+(?:{'|'.join(vocab.STREET_WORDS)})\s*,\s*",
    r"[,\s]+\d{5}(?:-\d{4})?\s*$",
    r"(?i)[,\s]+(?:USA|United States of America|United States|US)\s*$",
]
_SITE_CODE = r"^(?:CA|US|USA)-([A-Z]{2})-([A-Z\s]+)(?:-[\p{L}\p{N}_]+)?$"
_COUNTRY_STATE_CITY = r"(?i)^(?:USA?|United States)\s*-\s*([A-Za-z\s]+)\s*-\s*(.+)$"


def _drop(text: Column, patterns) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), patterns, text)


def standardize_location(df: DataFrame, column: str = "location", into: str | None = None) -> DataFrame:
    """Raw location text to a display place.

    Runs as a few staged columns, each evaluated once: cleaning, then the
    address code before ``~``, then what is left of a street address.  The
    first rule that applies gives the answer.
    """
    into = into or column
    states, metros = literal_map(vocab.US_STATES), literal_map(vocab.US_METROS)
    cities, countries = literal_map(vocab.WORLD_CITIES), literal_map(vocab.COUNTRY_CODES)
    codes = sorted(set(vocab.US_STATES.values()))

    raw = F.col("_raw")
    staged = (
        df.withColumn("_raw", F.replace(strip(text_of(column)), F.lit("\u00a0"), F.lit(" ")))
        .withColumn("_loc", _drop(raw, _AFFIXES))
        .withColumn("_code", F.when(F.col("_loc").contains("~"), strip(F.split_part("_loc", F.lit("~"), F.lit(1)))))
        .withColumn("_loc", F.coalesce("_code", "_loc"))
        .withColumn("_dash", _parts(F.col("_loc"), "-"))
        .withColumn("_place", _drop(F.col("_loc"), _ADDRESS))
        .withColumn("_key", F.lower(strip("_place")))
        .withColumn("_comma", _parts(F.col("_place"), ","))
    )
    loc, code, dash, comma = (F.col(c) for c in ("_loc", "_code", "_dash", "_comma"))
    key = F.col("_key")

    coded = F.when(
        code.rlike(_SITE_CODE),
        F.concat(title_case(F.regexp_extract(code, _SITE_CODE, 2)), F.lit(", "), F.regexp_extract(code, _SITE_CODE, 1)),
    )
    country = F.when(F.size(dash) >= 2, countries[F.lower(F.get(dash, F.lit(0)))])
    abroad = F.when(country == "Singapore", country).otherwise(
        F.concat(title_case(F.element_at(dash, -1)), F.lit(", "), country)
    )
    state = strip(F.regexp_extract(loc, _COUNTRY_STATE_CITY, 1))
    state_code = F.coalesce(
        states[F.lower(state)], F.when(F.length(state) == 2, F.upper(state)).otherwise(state),
    )
    home = F.when(
        loc.rlike(_COUNTRY_STATE_CITY),
        F.concat(strip(F.regexp_extract(loc, _COUNTRY_STATE_CITY, 2)), F.lit(", "), state_code),
    )
    second = strip(F.regexp_replace(F.get(comma, F.lit(1)), r"\s*\d{5}(?:-\d{4})?$", ""))
    short = F.coalesce(states[F.lower(second)], F.when(F.upper(second).isin(codes), F.upper(second)))
    city_state = F.when(F.size(comma) == 2, F.concat(F.get(comma, F.lit(0)), F.lit(", "), short))

    answer = (
        F.when((raw == "") | F.lower(raw).isin(vocab.NOT_A_PLACE), "Not Specified")
        .when(_several(raw), "Multiple Locations")
        .when(_just_remote(raw), "Remote, United States")
        .otherwise(F.coalesce(coded, abroad, home, metros[key], cities[key], city_state, squeeze("_place")))
    )
    return staged.withColumn("_answer", answer).drop(
        *([into] if into in df.columns else []), "_raw", "_loc", "_code", "_dash", "_place", "_key", "_comma",
    ).withColumnRenamed("_answer", into)


_ARRANGEMENT_WORDS = rf"(?i){NOT_BEFORE}(?:remote|hybrid|on-?site|virtual|flexible){NOT_AFTER}"
_TOO_WIDE = rf"(?i)^(?:united states of america|united states|usa|us|n/?a|\d+\s+locations?|multiple locations?|not specified)?$"


def map_place(location="location") -> Column:
    """The part of a location worth a map pin; NULL for none or a whole country."""
    named = F.regexp_replace(text_of(location), _ARRANGEMENT_WORDS, "")
    trimmed = F.regexp_replace(named, rf"^(?:{SPACE}|[,/|:;-])+|(?:{SPACE}|[,/|:;-])+$", "")
    place = squeeze(trimmed)
    return F.when(~place.rlike(_TOO_WIDE), place)
