"""Crawl-index lines and name lists: where new sources are found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import blank_to_null, text_of

# fixed values: what is no board token, and the forms of board addresses
NOT_TOKENS = ["robots.txt", "favicon.ico"]
_WORKDAY = r"(?i)^https?://([a-z0-9-]+)\.([a-z0-9]+)\.myworkdayjobs\.com/([^/?]*)"
_LOCALE = r"^[a-z]{2}(?:-[A-Za-z]{2,4})?$"


def parse_crawl_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses of JSON lines; blank and broken lines are passed over."""
    url = F.try_variant_get(F.try_parse_json(column), "$.url", "string")
    return lines.select(blank_to_null(url).alias("url")).filter(F.col("url").isNotNull())


def board_token(url, host: str, lower: bool = True) -> Column:
    """What follows ``host/`` up to the next slash or query; NULL if nothing does."""
    token = F.regexp_extract(text_of(url), re.escape(host) + r"/([^/?]*)", 1)
    token = F.lower(token) if lower else token
    return F.when(~token.isin(NOT_TOKENS), blank_to_null(token))


def board_tokens(urls: DataFrame, hosts: list[str], lower: bool = True) -> DataFrame:
    """Distinct board tokens over one or more hosts, sorted."""
    found = F.array(*[board_token("url", h, lower) for h in hosts])
    tokens = urls.select(F.explode(found).alias("token")).filter(F.col("token").isNotNull())
    return tokens.distinct().orderBy("token")


def workday_sites(urls: DataFrame) -> DataFrame:
    """Per tenant and host the site most addresses use; ties go to the first name."""
    site = F.regexp_extract("url", _WORKDAY, 3)
    votes = (
        urls.filter(F.col("url").rlike(_WORKDAY))
        .select(
            F.lower(F.regexp_extract("url", _WORKDAY, 1)).alias("tenant"),
            F.lower(F.regexp_extract("url", _WORKDAY, 2)).alias("wd_host"),
            site.alias("site"),
        )
        .filter((F.col("site") != "") & (F.lower("site") != "robots.txt") & ~F.col("site").rlike(_LOCALE))
        .groupBy("tenant", "wd_host", "site").agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct(-F.col("n"), "site"))["site"]
    return votes.groupBy("tenant", "wd_host").agg(best.alias("site"))


def name_seeds(tickers: DataFrame, members: DataFrame) -> DataFrame:
    """Company names from ticker files and category member lists (one JSON per row, ``payload``)."""
    listed = tickers.select(
        F.explode(F.map_values(F.from_json("payload", "map<string, struct<title: string>>"))).alias("r")
    ).select(blank_to_null(F.col("r.title")).alias("company"))
    shape = "struct<query: struct<categorymembers: array<struct<title: string>>>>"
    named = members.select(
        F.explode(F.from_json("payload", shape)["query"]["categorymembers"]).alias("r")
    ).select(blank_to_null(F.col("r.title")).alias("company")).filter(~F.lower("company").startswith("list of"))
    return listed.unionByName(named).filter(F.col("company").isNotNull())
