"""Job function, work arrangement, employer name and industry."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import (
    NOT_AFTER, NOT_BEFORE, SPACE, as_col, begins_with, blank_to_null, has_phrase, literal_map,
    phrases_pattern, strip, text_of, title_case,
)


def first_label(lowered: Column, rules: dict) -> Column:
    """The first label, in rule order, one of whose phrases occurs; NULL if none does."""
    chain = F
    for label, phrases in rules.items():
        chain = chain.when(has_phrase(lowered, phrases), label)
    return chain


def job_function(title="title", snippet="description_snippet", current="job_function",
                 rules=vocab.JOB_FUNCTION_PHRASES, labels=vocab.JOB_FUNCTION_LABELS) -> Column:
    """The title decides; then the label given; then how the snippet begins."""
    given = literal_map(labels)[F.lower(strip(text_of(current)))]
    opening = F.lower(F.substring(text_of(snippet), 1, 300))
    return F.coalesce(
        first_label(F.lower(text_of(title)), rules), given, first_label(opening, rules), F.lit("Other"),
    )


_HYBRID = phrases_pattern(["hybrid"])
_ONSITE = rf"(?=[oi]){NOT_BEFORE}(?:on[-\s]?site|in[-\s]?(?:office|person)){NOT_AFTER}"


def _remote(*more: str) -> str:
    words = ["remote", "telework", r"work\s?from\s?home", "wfh", "virtual", *more]
    return f"{begins_with(words)}{NOT_BEFORE}(?:{'|'.join(words)}){NOT_AFTER}"


def _arrangement(lowered: Column, remote: str) -> Column:
    return (
        F.when(lowered.rlike(_HYBRID), "hybrid")
        .when(lowered.rlike(remote), "remote")
        .when(lowered.rlike(_ONSITE), "onsite")
        .otherwise("")
    )


def arrangement_from_location(location="location") -> Column:
    return _arrangement(F.lower(text_of(location)), _remote())


def standardize_arrangement(title="title", location="location", current="work_arrangement") -> Column:
    given = F.lower(strip(text_of(current)))
    both = F.lower(F.concat_ws(" | ", text_of(title), text_of(location)))
    read = _arrangement(both, _remote("telecommute", r"flexible\s*/\s*remote"))
    return F.when(given.isin("remote", "hybrid", "onsite"), given).otherwise(read)


def normalise_arrangement(value, spellings=vocab.ARRANGEMENT_SPELLINGS) -> Column:
    squashed = F.translate(F.lower(strip(text_of(value))), "_- ", "")
    return F.coalesce(literal_map(spellings)[squashed], F.lit(""))


def pick_arrangement(structured="work_arrangement", location="location") -> Column:
    """What the platform states outright, else what the location says."""
    return F.coalesce(blank_to_null(structured), arrangement_from_location(location))


# --- employer ---------------------------------------------------------------


def company_name(df: DataFrame, column: str = "company", into: str | None = None) -> DataFrame:
    """Display names from slugs, tenant ids and registered names.

    Staged, so each clean-up step is evaluated once.
    """
    into = into or column
    name = F.col("_name")
    joined = "|".join(vocab.JOINED_NAMES)
    spaced = reduce(
        lambda c, kv: F.regexp_replace(c, f"(?i){NOT_BEFORE}{kv[0]}{NOT_AFTER}", kv[1]), vocab.JOINED_NAMES.items(), name)
    suffixes = "|".join(re.escape(s) for s in vocab.NAME_SUFFIXES)
    suffix = rf"(?i)(?:,|{SPACE})+(?:{suffixes})\.?{SPACE}*$"
    staged = (
        df.withColumn("_raw", strip(text_of(column)))
        .withColumn("_name", F.regexp_replace("_raw", r"(?<=[a-zA-Z])\d+$", ""))
        .withColumn("_name", F.when(name.rlike(f"(?i){joined}"), spaced).otherwise(name))
        .withColumn("_name", F.when(name.isin(vocab.NAMES_KEEPING_SUFFIX), name).otherwise(F.regexp_replace(name, suffix, "")))
    )
    numbered = F
    for brand, shown in vocab.NUMBERED_SUBSIDIARIES.items():
        numbered = numbered.when(F.col("_raw").rlike(rf"(?i)^\d{{4,5}}{SPACE}+{brand}{NOT_AFTER}"), shown)
    bare_slug = (name == F.lower(name)) & ~name.contains(" ") & (F.length(name) > 2)
    answer = F.when(text_of(column) == "", "Unknown Company").otherwise(F.coalesce(
        literal_map(vocab.COMPANY_NAMES)[F.lower("_raw")], numbered,
        F.when(bare_slug, title_case(name)).otherwise(strip(name)),
    ))
    return staged.withColumn("_name", answer).drop("_raw", *([into] if into in df.columns else [])).withColumnRenamed("_name", into)


def infer_category(company="company", function="job_function", current="category",
                   known=vocab.COMPANY_INDUSTRY, by_function=vocab.FUNCTION_INDUSTRY) -> Column:
    """Industry: as given, else by employer, by words in its name, by job function."""
    given = strip(text_of(current))
    unsure = (given == "") | (text_of(current) == "Uncategorized")
    return F.when(~unsure, given).otherwise(F.coalesce(
        literal_map(known)[text_of(company)],
        first_label(F.lower(text_of(company)), vocab.INDUSTRY_WORDS),
        literal_map(by_function)[text_of(function)],
        blank_to_null(current),
        F.lit("Uncategorized"),
    ))
