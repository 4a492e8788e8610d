"""Posting-shaped tables derived from the given ones.

The given tables hold no postings, so each logical table is an expression
list over one of them, row for row.  The expressions are written once and
rendered for Spark and for the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions import identity
from joblattice.operators.skew import ADAPTIVE, TASK_ROWS, spread
from joblattice.session import shared_dir

AS_OF = "2001-09-01 00:00:00"
RUNS_AS_OF = "2024-01-31 00:00:00"

PLATFORMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday", "muse", "jsonld", "oracle_recruiting", "rippling"]

TITLES = [
    "Software Engineer Intern - Summer 2026", "DATA SCIENCE INTERN", "Warehouse Operations Internship", "Fleet Manager",
    "PCB Layout Co-op (REQ-12345)", "Stagiaire Hiver 2026", "Avionics Co-op Fall '25", "Product Design Intern (Hybrid)",
    "Real Estate Private Equity Intern", "Growth Marketing Intern - JR001923", "International Sales Director",
    "Supply Chain & Logistics Intern", "Clinical Pharmacology Intern FY27", "Talent Acquisition Coop",
    "Legal & Regulatory Compliance Intern", "Hydrology Intern [Remote]", "Management Consulting Summer Analyst",
    "Stage Chimie / Internship Chemistry", "AI / ML LAB INTERN", "Refinery Intern", "Becario de verano 2027",
    "Intern", "Barista", "Fall/Winter Intern 2026-2027", "Machine Learning Intern, Autumn 2031", "Intern été 2025",
    "Accounting Intern  Spring", "Nursing Intern - On site", "Internal Audit Lead", "Quality Intern R-12345",
    "Work from home Support Intern", "Paralegal Intern 2023", "BI Analyst Intern", "Mechanical Engineering Co-op",
    "HR INTERN", "Robotics Engineer Intern", "Virtual Events Intern",
]
LOCATIONS = [
    "San Francisco, California, USA", "New York, New York", "Tacoma, WA 98401", "1100 Main Street, Quincy, MA 02169",
    "USA - Ohio - Columbus", "US - CA - Fresno", "chicago", "12 Locations", "Austin, TX; Reno, NV", "Reno | Tacoma",
    "SGP - Jurong", "MYS - Penang", "CHL - Region - santiago centro", "London, UK", "Toronto, ON", "Remote - US",
    "USA - Remote", "Remote - Los Angeles, CA", "Toronto, Canada (Hybrid)", "In-Office", "", "CA-QC-LAVAL-J01 ~ 1 Main Blvd",
    "Plant 7 ~ gate", "Lyon,  Rhône", "münchen", "Hybrid - Remote/Chicago", "In-Person, Boise", "Flexible / Remote",
    "Remote", "N/A", "Multiple Locations", "Houston", "Portland, Oregon 97201", "Paris", "são paulo", "Headquarters",
    "Berlin HQ", "Denver, CO, US", "MEX-Queretaro-Queretaro", "Springfield, il", "Nashville, Tennessee Remote",
]
COMPANIES = [
    "cvshealth", "Acme Corporation", "ACME, Inc.", "NBCUniversal3", "GE Aerospace", "geaerospace", "HP Inc.", "Moog Inc.",
    "10442 Expedia do Brasil", "sunworks", "globalhr", "Lakeside Hospital LLC", "Nordic Bank plc", "Éclat & Fils Ltd.",
    "A.P. Moller - Maersk", "Kraft Heinz Co", "CityAndCountyOfSanFrancisco1", "3M", "nvidia", "Zeta S.A.", "Solar Power Group",
    "Auto Motors Holdings", "Grand Hotel", "Retail Brands", "Civil Works", "Daily News Media", "The Vita Coco Company",
    "", "Ubisoft2", "4231 Airframe Works, Inc., LLC", "Samsara Inc.",
]
SNIPPETS = [
    "Join our freight team for summer 2027.", "Work on hydrology models.", "R5036878", "",
    "We ship logistics software for carriers & brokers in Winter.", "Study real estate debt and equity markets.",
    "No keywords here at all.",
]
CURRENT_FUNCTIONS = ["", "Data Science", "unknown", "accounting and finance"]
CATEGORIES = ["", "Uncategorized", "Retail", "Energy & Power", "Logistics"]


class Dialect:
    """How Spark spells what the engines spell differently."""

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pick(self, values, index: str) -> str:
        return f"element_at(array({', '.join(self.text(v) for v in values)}), CAST({index} AS INT) + 1)"

    def plus(self, ts: str, n: str, unit: str) -> str:
        return f"timestampadd({unit}, {n}, {ts})"

    def stamp(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\")"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM-dd')"

    def millis(self, ts: str) -> str:
        return f"unix_millis({ts})"

    def at(self, text: str) -> str:
        return f"TIMESTAMP '{text}'"

    def utc(self, column: str) -> str:
        return f"CAST({column} AS TIMESTAMP)"


class CheckDialect(Dialect):
    """The checking engine's spelling."""

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def pick(self, values, index):
        return f"list_extract([{', '.join(self.text(v) for v in values)}], CAST({index} AS INT) + 1)"

    def plus(self, ts, n, unit):
        return f"({ts} + to_{unit.lower()}s(CAST({n} AS INT)))"

    def stamp(self, ts):
        return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"

    def iso(self, ts):
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

    def day(self, ts):
        return f"strftime({ts}, '%Y-%m-%d')"

    def millis(self, ts):
        return f"epoch_ms({ts})"

    def utc(self, column):
        return column


def _postings(d: Dialect) -> list[tuple[str, str]]:
    n, c = "o_orderkey", "o_custkey"
    ats = d.pick(PLATFORMS, f"{c} % 9")
    seen = d.plus(d.plus(d.utc("o_orderdate"), f"{n} % 30", "DAY"), f"{n} * 37 % 86400", "SECOND")
    back = d.plus(seen, f"-({n} % 400)", "DAY")
    status = f"CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN {n} % 11 = 5 THEN 'duplicate' ELSE 'open' END"
    raw = (
        f"CASE {n} % 9 WHEN 0 THEN {d.iso(seen)} || '-04:00' WHEN 1 THEN CAST({d.millis(back)} AS STRING) "
        f"WHEN 2 THEN 'Posted ' || ({n} % 29) || ' Days Ago' WHEN 3 THEN 'Posted 30+ Days Ago' WHEN 4 THEN {d.day(back)} "
        f"WHEN 5 THEN CASE WHEN {n} % 2 = 0 THEN 'Posted Today' ELSE 'Posted Yesterday' END WHEN 6 THEN NULL "
        f"WHEN 7 THEN 'sometime last spring, by ' || {c} % 3 ELSE {d.iso(back)} || 'Z' END"
    )
    return [
        ("id", f"CASE WHEN {c} % 9 = 4 THEN 'workday:t' || {c} || ':ext:/job/' || {n} ELSE {ats} || ':t' || {c} || ':' || {n} END"),
        ("source_id", c),
        ("source_entry", f"'board ' || {c}"),
        ("company", d.pick(COMPANIES, f"{c} % {len(COMPANIES)}")),
        ("title", d.pick(TITLES, f"{n} % {len(TITLES)}")),
        ("location", d.pick(LOCATIONS, f"({n} % 37 + {n} % 4 * 10) % {len(LOCATIONS)}")),
        ("url", f"CASE WHEN {n} % 17 = 0 THEN '' ELSE 'https://boards.example.com/t' || {c} || '/jobs/' || {n} END"),
        ("ats", ats),
        ("category", d.pick(CATEGORIES, f"{c} % 5")),
        ("job_function", d.pick(CURRENT_FUNCTIONS, f"{n} % 4")),
        ("work_arrangement", d.pick(["", "", "remote", "Hybrid", "onsite"], f"{n} % 5")),
        ("cycle_season", d.pick(["", "summer", "fall", "winter", "spring", ""], f"{n} % 6")),
        ("cycle_year", f"CASE {n} % 5 WHEN 0 THEN 2026 WHEN 1 THEN 2027 WHEN 2 THEN 2028 END"),
        ("posted_at", raw),
        ("posted_at_ts", f"CASE WHEN {n} % 9 <> 6 THEN {back} END"),
        ("posted_at_approx", f"{n} % 6 = 0"),
        ("description_snippet", d.pick(SNIPPETS, f"{n} % 7")),
        ("description", f"CASE {n} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'R-' || {n} ELSE 'About the job: ' || o_orderpriority || ' for ' || {n} END"),
        ("status", status),
        ("duplicate_of", "CAST(NULL AS STRING)"),
        ("first_seen", seen),
        ("last_seen", d.plus(seen, "5", "DAY")),
        ("closed_at", f"CASE WHEN o_orderstatus = 'F' THEN {d.plus(seen, '5', 'DAY')} END"),
        ("liveness_checked_at", f"CASE WHEN {n} % 3 = 0 THEN {seen} END"),
        ("liveness_attempts", f"CAST({n} % 7 AS INT)"),
        ("liveness_next_check_at", f"CASE WHEN {n} % 3 = 0 THEN {d.plus(d.at(AS_OF), f'{n} % 200 - 100', 'HOUR')} END"),
        ("description_attempts", f"CAST({n} % 8 AS INT)"),
        ("description_next_attempt_at", f"CASE WHEN {n} % 5 = 0 THEN {d.plus(d.at(AS_OF), f'{n} % 90 - 45', 'HOUR')} END"),
    ]


def _sources(d: Dialect) -> list[tuple[str, str]]:
    c = "c_custkey"
    name = d.pick(COMPANIES, f"{c} % {len(COMPANIES)}")
    return [
        ("id", c),
        ("company", f"CASE WHEN {c} % 4 = 0 THEN 't' || {c} WHEN {c} % 4 = 1 THEN c_name ELSE {name} || ' ' || {c} END"),
        ("ats", d.pick(PLATFORMS, f"{c} % 9")),
        ("category", f"CASE WHEN {c} % 7 = 0 THEN 'Uncategorized' ELSE c_mktsegment END"),
        ("config", f"'{{\"tenant\":\"t' || {c} || '\",\"wd_host\":\"wd5\",\"site\":\"ext\",\"max_pages\":5}}'"),
        ("status", d.pick(["active", "probation", "disabled", "active"], f"{c} % 4")),
        ("added_by", f"CASE WHEN {c} % 3 = 0 THEN 'manual' ELSE 'discovery' END"),
        ("scrape_interval_seconds", f"CAST(CASE {c} % 3 WHEN 0 THEN 3600 WHEN 1 THEN 21600 ELSE 86400 END AS INT)"),
        ("next_scrape_at", d.plus(d.at(RUNS_AS_OF), f"{c} * 37 % 2000 - 1000", "MINUTE")),
        ("consecutive_failures", f"CAST({c} % 6 AS INT)"),
        ("last_scrape_status", f"CASE WHEN {c} % 6 = 0 THEN 'ok' ELSE 'error' END"),
        ("last_scrape_error", f"CASE WHEN {c} % 6 <> 0 THEN 'timeout' END"),
        ("last_scraped_at", f"CASE WHEN {c} % 8 <> 1 THEN {d.plus(d.at(RUNS_AS_OF), f'-({c} * 13 % 5000)', 'MINUTE')} END"),
    ]


def _runs(d: Dialect) -> list[tuple[str, str]]:
    ts = d.utc("ts")
    ok = "event_type <> 'error'"
    return [
        ("id", "event_id"),
        ("source_id", "user_id"),
        ("started_at", ts),
        ("finished_at", d.plus(ts, "event_id % 60", "SECOND")),
        ("ok", ok),
        ("fetched_count", f"CASE WHEN {ok} THEN CAST(floor(value) AS INT) END"),
        ("internship_count", f"CASE WHEN {ok} THEN CAST(floor(value / 3) AS INT) END"),
        ("error", f"CASE WHEN NOT ({ok}) THEN 'fetch failed ' || event_id % 5 END"),
    ]


REASONS = ["zero postings returned", "no internship-shaped titles found", "postings aren't distinct"]


def _candidates(d: Dialect) -> list[tuple[str, str]]:
    s = "s_suppkey"
    status = d.pick(["unchecked", "no_match", "rejected", "promoted"], f"{s} % 4")
    known = (
        f"CASE WHEN {s} % 4 = 2 THEN '{{\"reason\":\"' || {d.pick(REASONS, f'{s} % 3')} || '\",\"name_similarity\":0.' || {s} % 9 || "
        f"',\"intern_count\":' || {s} % 13 || '}}' WHEN {s} % 4 = 3 THEN '{{\"name_similarity\":0.9' || {s} % 10 || "
        f"',\"intern_count\":' || {s} % 31 || '}}' END"
    )
    return [
        ("id", s),
        ("company", f"CASE WHEN {s} % 8 = 3 THEN 't' || {s} ELSE s_name END"),
        ("ats", f"CASE WHEN {s} % 4 >= 2 THEN {d.pick(PLATFORMS, f'{s} % 9')} END"),
        ("config", "CAST(NULL AS STRING)"),
        ("review_status", status),
        ("evidence", known),
        ("probe_set_version", f"CAST({s} % 3 AS INT)"),
        ("checked_at", f"CASE WHEN {s} % 4 > 0 THEN {d.plus(d.at(RUNS_AS_OF), f'-({s} * 17 % 3000)', 'HOUR')} END"),
        ("next_check_at", d.plus(d.at(RUNS_AS_OF), f"{s} * 29 % 400 - 200", "HOUR")),
    ]


TABLES = {
    "postings": ("orders", _postings),
    "sources": ("customer", _sources),
    "runs": ("events", _runs),
    "candidates": ("supplier", _candidates),
}


#: Bytes of files that one task reads: stored rows repeat a lot, so many lie in few bytes.
TASK_BYTES = 16 << 20
#: Bytecode of a method from which on the JVM interprets it for good; Spark splits a longer stage into its operators and short methods.
METHOD_BYTES = 8000


def prepare(spark: SparkSession) -> None:
    """Times are read as UTC, hot join keys may be split, a task reads no more than TASK_BYTES, and wide rules run compiled."""
    split = min(TASK_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    values = {"spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": str(split),
              "spark.sql.codegen.hugeMethodLimit": str(METHOD_BYTES), **ADAPTIVE}
    for name, value in values.items():
        spark.conf.set(name, value)


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as given."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_STORED: dict[tuple, str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made and stored once per session, as a live one lies in storage, in files for all cores."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    prepare(spark)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table over the given one, stored once per session like a live table.

    Postings are stored with their comparison keys, as ingest stores them, so
    scans prune columns and push filters down to the files.
    """
    def make() -> DataFrame:
        rows = _rows(spark, sf_dir, name)
        return rows.withColumns({c: key() for c, key in KEYS.items()}) if name == "postings" else rows

    return stored_once(spark, sf_dir, name, make)


#: Columns that postings get when they are compared.
KEYS = {"dedup_key": identity.dedup_key, "company_key": identity.company_key}


def unkeyed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table, postings as they are before keys are set: those stored with keys if they are there, else stored without."""
    if name != "postings" or (spark.sparkContext.applicationId, sf_dir, name) in _STORED:
        return bound(spark, sf_dir, name).drop(*KEYS)
    return stored_once(spark, sf_dir, "postings-unkeyed", lambda: _rows(spark, sf_dir, name))


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    return spread(given(spark, sf_dir, source), TASK_ROWS).selectExpr(*[f"{sql} AS {c}" for c, sql in columns(Dialect())])


def check_cte(name: str) -> str:
    """The same table as a WITH item of the checking SQL."""
    source, columns = TABLES[name]
    body = ", ".join(f"{sql} AS {c}" for c, sql in columns(CheckDialect()))
    return f"{name} AS (SELECT {body} FROM {source})"


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")
