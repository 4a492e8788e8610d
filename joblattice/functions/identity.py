"""Keys that say when two listings, or two employers, are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import (
    SPACE, WORD, as_col, blank_to_null, phrases_pattern, squeeze, text_of,
)


def _plain(c) -> Column:
    return squeeze(F.regexp_replace(c, rf"[^{WORD}\s]", " "))


def _plain_company(c, legal_words) -> Column:
    lowered = F.lower(text_of(c))
    named = F.regexp_replace(lowered, phrases_pattern(legal_words) + r"\.?", "")
    return F.regexp_replace(F.regexp_replace(named, rf"[^{WORD}\s]", " "), rf"{SPACE}+", "")


def company_key(c="company", legal_words=vocab.LEGAL_WORDS) -> Column:
    return blank_to_null(_plain_company(c, legal_words))


def dedup_key(company="company", title="title", location="location") -> Column:
    """company|title|place; NULL when company or title holds nothing to compare."""
    return keyed(company_key(company), title, location)


def keyed(who: Column, title="title", location="location") -> Column:
    """``dedup_key`` where the company's key is known."""
    what = blank_to_null(_plain(F.lower(text_of(title))))
    where = _plain(F.lower(text_of(location)))
    return F.concat(who, F.lit("|"), what, F.lit("|"), where)


def precedence(ats="ats", direct=vocab.DIRECT_PLATFORMS) -> Column:
    return F.when(as_col(ats).isin(list(direct)), 0).otherwise(1)


def safe_id(c="id") -> Column:
    return F.substring(F.sha2(as_col(c), 256), 1, 20)


def id_part(c, n: int, parts: int) -> Column:
    """The n-th (1-based) of at most ``parts`` colon-separated pieces; NULL if there are fewer."""
    pieces = F.split(as_col(c), ":", parts)
    return F.when(F.size(pieces) == parts, F.element_at(pieces, n))


def workday_detail_url(posting_id="id", tenant="tenant", wd_host="wd_host", site="site") -> Column:
    path = blank_to_null(id_part(posting_id, 4, 4))
    t, h, s = (blank_to_null(x) for x in (tenant, wd_host, site))
    return F.concat(F.lit("https://"), t, F.lit("."), h, F.lit(".myworkdayjobs.com/wday/cxs/"), t, F.lit("/"), s, path)


def workday_liveness_url(posting_id="id", url="url") -> Column:
    """Built from the id alone; the host shard is read off the public url, else wd5."""
    path = blank_to_null(id_part(posting_id, 4, 4))
    shard = blank_to_null(F.regexp_extract(text_of(url), r"\.(wd\d+)\.myworkdayjobs\.com", 1))
    tenant, site = id_part(posting_id, 2, 4), id_part(posting_id, 3, 4)
    return F.concat(
        F.lit("https://"), tenant, F.lit("."), F.coalesce(shard, F.lit("wd5")),
        F.lit(".myworkdayjobs.com/wday/cxs/"), tenant, F.lit("/"), site, path,
    )


def smartrecruiters_detail_url(posting_id="id", token="token") -> Column:
    job = blank_to_null(id_part(posting_id, 3, 3))
    return F.concat(
        F.lit("https://api.smartrecruiters.com/v1/companies/"), blank_to_null(token), F.lit("/postings/"), job,
    )
