"""Row schemas and the constraints the tables keep."""

from joblattice import vocab

POSTING = (
    "id string, company string, title string, location string, url string, source string, "
    "category string, job_function string, work_arrangement string, posted_at string, "
    "description_snippet string, description string, source_entry string"
)
POSTING_COLUMNS = [c.split()[0] for c in POSTING.split(", ")]

BATCH_COLUMNS = [
    "id", "company", "title", "location", "url", "source", "category", "posted_at",
    "description_snippet", "source_entry", "first_seen",
]
BATCH = ", ".join(f"{c} string" for c in BATCH_COLUMNS)

PRESET = (
    "id string, name string, keywords_any array<string>, exclude_keywords array<string>, "
    "trusted_companies array<string>, locations_include array<string>, "
    "locations_exclude array<string>, max_age_days int"
)

RULES = {
    "postings": {
        "not_null": ["id", "source_entry", "company", "title", "status", "first_seen", "last_seen"],
        "one_of": {"status": vocab.POSTING_STATUSES},
        "unique": [["id"]],
    },
    "sources": {
        "not_null": ["id", "company", "ats", "status", "added_by"],
        "one_of": {"status": vocab.SOURCE_STATUSES, "added_by": ["manual", "discovery"]},
        "unique": [["id"], ["company", "ats"]],
    },
    "candidates": {
        "not_null": ["company", "review_status"],
        "one_of": {"review_status": vocab.CANDIDATE_STATUSES},
        "unique": [["company"]],
    },
    "activity_log": {
        "not_null": ["kind", "detail", "created_at"],
        "one_of": {"kind": vocab.ACTIVITY_KINDS},
        "unique": [],
    },
}
