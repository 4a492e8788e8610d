"""Hiring cycle: the season and year a title advertises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.classify import first_label
from joblattice.functions.text import (
    NOT_AFTER, NOT_BEFORE, as_col, blank_to_null, phrases_pattern, text_of,
)

# fixed values: how short years are written
_FISCAL = rf"{NOT_BEFORE}(?:FY|fy)\s*'?([23][0-9]){NOT_AFTER}"
_QUOTED = rf"{NOT_BEFORE}'([23][0-9]){NOT_AFTER}"


def _number(text: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, 1)).cast("int")


def parse_cycle(title="title") -> Column:
    """struct(season, year) by first position; years 2020-2039, else FY27 or '27."""
    t = text_of(title)
    season = F.regexp_extract(F.lower(t), f"({phrases_pattern(['summer', 'fall', 'autumn', 'winter', 'spring'])})", 1)
    short = rf"(?=[Ff'])(?:{NOT_BEFORE}(?:FY|fy)\s*'?|{NOT_BEFORE}')([23][0-9]){NOT_AFTER}"
    year = F.coalesce(
        _number(t, rf"(?=20){NOT_BEFORE}(20[23][0-9]){NOT_AFTER}"),
        _number(t, short) + 2000,
    )
    return F.struct(F.when(season == "autumn", "fall").otherwise(season).alias("season"), year.alias("year"))


def standardize_cycle(title="title", snippet="description_snippet", season="cycle_season",
                      year="cycle_year", words=vocab.SEASON_WORDS) -> Column:
    """Keeps what is given, then reads the title, then how the snippet begins.

    Seasons go by rule order in several languages, not by position.
    """
    t, opening = text_of(title), F.substring(text_of(snippet), 1, 150)

    def year_in(text):
        return F.coalesce(
            _number(text, rf"{NOT_BEFORE}(202[4-9]|203[0-5]){NOT_AFTER}"),
            _number(text, _FISCAL) + 2000,
            _number(text, _QUOTED) + 2000,
        )

    return F.struct(
        F.coalesce(
            blank_to_null(season), first_label(F.lower(t), words), first_label(F.lower(opening), words), F.lit(""),
        ).alias("season"),
        F.coalesce(as_col(year).cast("int"), year_in(t), year_in(opening)).alias("year"),
    )
