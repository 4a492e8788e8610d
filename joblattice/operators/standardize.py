"""The whole standardisation of a posting row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.functions import classify
from joblattice.functions.cycle import standardize_cycle
from joblattice.functions.places import standardize_location
from joblattice.functions.text import blank_to_null, strip, text_of
from joblattice.functions.titles import clean_title

# fixed values: the tenant whose postings belong to another employer
_TENANT, _TENANT_HOST = "globalhr", "globalhr.wd5.myworkdayjobs.com"
_TENANT_COMPANY, _TENANT_KEY, _TENANT_INDUSTRY = "Pratt & Whitney", "prattwhitney", "Aerospace & Defense"

_OPTIONAL = [
    "company", "title", "location", "url", "source", "ats", "category", "job_function", "work_arrangement",
    "cycle_season", "description", "description_snippet", "company_key",
]
_BARE_CODE = r"^[A-Za-z0-9_-]{3,25}$"


def standardize_posting(df: DataFrame) -> DataFrame:
    """Cleaned, classified rows; industry is inferred last, from the cleaned values.

    Function, arrangement and cycle are read from the raw title and location,
    before those are cleaned.
    """
    missing = {c: F.lit(None).cast("string") for c in _OPTIONAL if c not in df.columns}
    if "cycle_year" not in df.columns:
        missing["cycle_year"] = F.lit(None).cast("int")
    full = df.withColumns(missing) if missing else df

    url, company, key = text_of("url"), text_of("company"), text_of("company_key")
    tenant = url.contains(_TENANT_HOST) | (F.lower(company) == _TENANT) | (F.lower(key) == _TENANT)
    read = full.withColumns({
        "work_arrangement": classify.standardize_arrangement(),
        "job_function": classify.job_function(),
        "_cycle": standardize_cycle(),
        "_tenant": tenant,
        "category": F.when(tenant, _TENANT_INDUSTRY).otherwise(F.col("category")),
        "company_key": F.when(tenant, _TENANT_KEY).otherwise(F.col("company_key")),
    })
    named = classify.company_name(read).withColumn("company", F.when(F.col("_tenant"), _TENANT_COMPANY).otherwise(F.col("company")))
    cleaned = standardize_location(clean_title(named))

    squashed = F.regexp_replace(F.lower("company"), "[^a-z0-9]+", "")
    prefix = F.when(F.col("id").contains(":"), F.split_part("id", F.lit(":"), F.lit(1)))
    platform = F.coalesce(blank_to_null("ats"), blank_to_null("source"), blank_to_null(prefix), F.lit("direct"))

    def without_code(name):
        return F.when(strip(text_of(name)).rlike(_BARE_CODE), "").otherwise(F.col(name))

    out = cleaned.withColumns({
        "cycle_season": F.col("_cycle.season"),
        "cycle_year": F.col("_cycle.year"),
        "company_key": F.coalesce(blank_to_null("company_key"), blank_to_null(squashed), F.lit("unidentified")),
        "ats": platform,
        "description": without_code("description"),
        "description_snippet": without_code("description_snippet"),
        "category": classify.infer_category(),
    })
    return out.drop("_cycle", "_tenant")
