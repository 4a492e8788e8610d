"""Detail payloads of single postings: where a platform keeps the description.

``DETAILS`` is open to further platforms: an address and a text per platform,
both column functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice.functions import identity
from joblattice.functions.text import as_col, blank_to_null, display_text, strip, text_of

# fixed values: the order a reader expects, not the order they arrive in
SECTIONS = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]


@dataclass(frozen=True)
class DetailSource:
    """``url`` is NULL for a posting that can never be asked about."""

    url: Callable[[], Column]
    text: Callable[[Column], Column]


def _workday_text(payload: Column) -> Column:
    return display_text(F.get_json_object(payload, "$.jobPostingInfo.jobDescription"))


def _smartrecruiters_text(payload: Column) -> Column:
    def field(name, of):
        return F.get_json_object(payload, f"$.jobAd.sections.{name}.{of}")

    # an array of the sections, so that no text is cleaned once to be tested and once to be used
    parts = F.array(*[
        F.struct(blank_to_null(strip(text_of(field(s, "title")))).alias("title"), display_text(field(s, "text")).alias("text")) for s in SECTIONS])
    told = F.filter(parts, lambda p: p["text"] != "")
    return F.array_join(F.transform(told, lambda p: F.concat_ws("\n", p["title"], p["text"])), "\n\n")


DETAILS = {
    "workday": DetailSource(identity.workday_detail_url, _workday_text),
    "smartrecruiters": DetailSource(identity.smartrecruiters_detail_url, _smartrecruiters_text),
}


def detail_text(payload="payload", ats: str = "workday") -> Column:
    """Display text of a detail payload; '' when it holds none, NULL when it is no JSON at all."""
    body = as_col(payload)
    return F.when(F.try_parse_json(body).isNotNull(), DETAILS[ats].text(body))
