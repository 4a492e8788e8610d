"""Landed responses of job boards, normalised into posting rows.

A landed response is a row ``(source_entry, entry, page, payload)``: the
source's label, its configuration as JSON, the page number and the raw body.
``normalize(raw, provider)`` yields posting rows; bodies without the shape the
provider promises are in ``unreadable(raw, provider)``, never silently empty.
New providers register with ``@provider``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.classify import normalise_arrangement
from joblattice.functions.places import flag_arrangement, join_location
from joblattice.functions.text import (
    SNIPPET, SPACE, blank_to_null, display_text, has_uncommon_references, strip, strip_html, text_of,
)
from joblattice.schema import POSTING_COLUMNS


@dataclass(frozen=True)
class Provider:
    name: str
    body: str
    items: Callable[[Column], Column]
    row: Callable[[Column, Callable[[str], Column]], dict]
    keep: Callable[[Column], Column]
    stages: tuple[Callable[[Column], dict], ...] = ()


PROVIDERS: dict[str, Provider] = {}


def provider(name: str, body: str, items, keep=lambda job: F.lit(True), stages=()):
    """Registers ``row(job, entry) -> {column: Column}`` for one provider's bodies.

    ``stages`` are columns made before, one after the other, for values that a row uses more than once.
    """

    def register(row):
        PROVIDERS[name] = Provider(name, body, items, row, keep, tuple(stages))
        return row

    return register


def _items(spec: Provider) -> Column:
    """The jobs of a body, null if it does not have the provider's shape."""
    if spec.body.startswith("array"):
        return spec.items(F.when(F.ltrim("payload").startswith("["), F.from_json("payload", spec.body)))
    return spec.items(F.from_json("payload", spec.body))


def _parsed(raw: DataFrame, spec: Provider) -> DataFrame:
    return raw.withColumn("_items", _items(spec))


def normalize(raw: DataFrame, name: str, keep: tuple[str, ...] = (), columns: tuple[str, ...] = tuple(POSTING_COLUMNS)) -> DataFrame:
    """Posting rows; ``keep`` names columns of the responses that go along, such as the source's id, ``columns`` those of postings that are wanted."""
    spec = PROVIDERS[name]
    order = [c for c in ("category_pos", "query_category", "page") if c in raw.columns]
    jobs = _parsed(raw, spec).withColumn("_entry", F.from_json("entry", "map<string, string>")).select(
        "source_entry", "_entry", *dict.fromkeys([*order, *keep]),
        # the outer form, as the plain one has the optimizer parse each body again to test its length
        F.posexplode_outer("_items").alias("_pos", "_job"),
    ).filter(F.col("_pos").isNotNull())
    job = F.col("_job")

    def entry(field: str) -> Column:
        return F.col("_entry")[field]

    made = spec.row(job, entry)
    blanks = {c: F.lit("") for c in ("category", "job_function", "work_arrangement", "description_snippet")}
    made = {**blanks, "description": F.lit(None).cast("string"), "source": F.lit(name), **made}
    jobs = jobs.filter(spec.keep(job))
    for step in spec.stages:
        jobs = jobs.withColumns(step(job))
    names = list(dict.fromkeys(["id", *columns]))
    rows = jobs.select(
        *[made[c].alias(c) if c != "source_entry" else F.col(c) for c in names], *dict.fromkeys([*order, "_pos", *keep]),
    )
    if name == "muse":
        rows = _last_by_id(rows, [*order, "_pos"], keep, names)
    return rows.select(*columns, *keep)


def unreadable(raw: DataFrame, name: str) -> DataFrame:
    """Responses that do not have the provider's shape."""
    return _parsed(raw, PROVIDERS[name]).filter(F.col("_items").isNull()).drop("_items")


def _last_by_id(rows: DataFrame, order: list[str], keep: tuple[str, ...], names: list[str]) -> DataFrame:
    """One job listed under several categories is kept once per fetch, as in the last category that the source lists."""
    best = F.max_by(F.struct(*names), F.struct(*order)).alias("_row")
    return rows.groupBy("id", *keep).agg(best).select("_row.*", *keep)


def _brief(c) -> Column:
    return F.substring(text_of(c), 1, SNIPPET)


@provider(
    "greenhouse",
    "struct<jobs: array<struct<id: string, title: string, location: struct<name: string>, "
    "absolute_url: string, updated_at: string, content: string>>>",
    lambda doc: doc["jobs"],
)
def _greenhouse(job, entry):
    return {
        "id": F.concat_ws(":", F.lit("greenhouse"), entry("token"), job["id"]),
        "company": F.coalesce(entry("company"), entry("token")),
        "title": text_of(job["title"]),
        "location": text_of(job["location"]["name"]),
        "url": text_of(job["absolute_url"]),
        "category": text_of(entry("category")),
        "posted_at": job["updated_at"],
        "description_snippet": strip_html(job["content"], SNIPPET),
        "description": display_text(job["content"]),
    }


@provider(
    "lever",
    "array<struct<id: string, text: string, categories: struct<location: string>, hostedUrl: string, "
    "createdAt: string, descriptionPlain: string, description: string>>",
    lambda doc: doc,
)
def _lever(job, entry):
    return {
        "id": F.concat_ws(":", F.lit("lever"), entry("token"), job["id"]),
        "company": F.coalesce(entry("company"), entry("token")),
        "title": text_of(job["text"]),
        "location": text_of(job["categories"]["location"]),
        "url": text_of(job["hostedUrl"]),
        "category": text_of(entry("category")),
        "posted_at": job["createdAt"],
        "description_snippet": _brief(job["descriptionPlain"]),
        "description": display_text(
            F.coalesce(blank_to_null(job["description"]), job["descriptionPlain"])
        ),
    }


@provider(
    "ashby",
    "struct<jobs: array<struct<id: string, title: string, location: string, isListed: boolean, "
    "isRemote: boolean, workplaceType: string, jobUrl: string, applyUrl: string, publishedAt: string, "
    "descriptionPlain: string, descriptionHtml: string>>>",
    lambda doc: doc["jobs"],
    keep=lambda job: F.coalesce(job["isListed"], F.lit(True)) & (text_of(job["id"]) != ""),
)
def _ashby(job, entry):
    stated = blank_to_null(normalise_arrangement(job["workplaceType"]))
    return {
        "id": F.concat_ws(":", F.lit("ashby"), entry("token"), job["id"]),
        "company": F.coalesce(entry("company"), entry("token")),
        "title": strip(text_of(job["title"])),
        "location": text_of(job["location"]),
        "url": F.coalesce(blank_to_null(job["jobUrl"]), text_of(job["applyUrl"])),
        "category": text_of(entry("category")),
        "work_arrangement": F.coalesce(stated, F.when(job["isRemote"], "remote"), F.lit("")),
        "posted_at": job["publishedAt"],
        "description_snippet": _brief(job["descriptionPlain"]),
        "description": display_text(
            F.coalesce(blank_to_null(job["descriptionHtml"]), job["descriptionPlain"])
        ),
    }


@provider(
    "smartrecruiters",
    "struct<totalFound: int, content: array<struct<id: string, name: string, releasedDate: string, "
    "function: struct<label: string>, location: struct<city: string, region: string, country: string, "
    "remote: boolean, hybrid: boolean>>>>",
    lambda doc: doc["content"],
    keep=lambda job: text_of(job["id"]) != "",
)
def _smartrecruiters(job, entry):
    at = job["location"]
    return {
        "id": F.concat_ws(":", F.lit("smartrecruiters"), entry("token"), job["id"]),
        "company": F.coalesce(entry("company"), entry("token")),
        "title": strip(text_of(job["name"])),
        "location": join_location(at["city"], at["region"], at["country"], at["remote"]),
        "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), entry("token"), F.lit("/"), job["id"]),
        "category": text_of(entry("category")),
        "job_function": text_of(job["function"]["label"]),
        "work_arrangement": flag_arrangement(at["hybrid"], at["remote"]),
        "posted_at": job["releasedDate"],
    }


@provider(
    "workday",
    "struct<total: int, jobPostings: array<struct<title: string, externalPath: string, "
    "locationsText: string, postedOn: string, bulletFields: array<string>>>>",
    lambda doc: doc["jobPostings"],
)
def _workday(job, entry):
    site = F.concat(entry("tenant"), F.lit(":"), entry("site"))
    host = F.concat(
        F.lit("https://"), entry("tenant"), F.lit("."), entry("wd_host"), F.lit(".myworkdayjobs.com/"), entry("site"),
    )
    return {
        "id": F.concat(F.lit("workday:"), site, F.lit(":"), text_of(job["externalPath"])),
        "company": F.coalesce(entry("company"), entry("tenant")),
        "title": text_of(job["title"]),
        "location": text_of(job["locationsText"]),
        "url": F.concat(host, text_of(job["externalPath"])),
        "category": text_of(entry("category")),
        "posted_at": job["postedOn"],
        "description_snippet": strip_html(F.get(job["bulletFields"], F.lit(0)), SNIPPET),
        "description": F.lit(""),
    }


@provider(
    "muse",
    "struct<page_count: int, results: array<struct<id: string, name: string, contents: string, "
    "publication_date: string, company: struct<name: string>, locations: array<struct<name: string>>, "
    "categories: array<struct<name: string>>, refs: struct<landing_page: string>>>>",
    lambda doc: doc["results"],
)
def _muse(job, entry):
    def names(items):
        return F.array_join(F.transform(items, lambda x: text_of(x["name"])), ", ")

    return {
        "id": F.concat(F.lit("muse:"), job["id"]),
        "company": text_of(job["company"]["name"]),
        "title": text_of(job["name"]),
        "location": text_of(names(job["locations"])),
        "url": text_of(job["refs"]["landing_page"]),
        "job_function": F.coalesce(blank_to_null("query_category"), names(job["categories"]), F.lit("")),
        "posted_at": job["publication_date"],
        "description_snippet": strip_html(job["contents"], SNIPPET),
        "description": display_text(job["contents"]),
    }


@provider(
    "oracle_recruiting",
    "struct<items: array<struct<TotalJobsCount: int, requisitionList: array<struct<Id: string, Title: string, "
    "PrimaryLocation: string, PostedDate: string, ShortDescriptionStr: string, "
    "ExternalQualificationsStr: string, ExternalResponsibilitiesStr: string>>>>>",
    lambda doc: F.when(F.size(doc["items"]) > 0, F.coalesce(F.get(doc["items"], F.lit(0))["requisitionList"], F.array())),
)
def _oracle(job, entry):
    text = F.concat_ws(
        " ", *[blank_to_null(job[f]) for f in
               ("ShortDescriptionStr", "ExternalQualificationsStr", "ExternalResponsibilitiesStr")],
    )
    return {
        "id": F.concat_ws(":", F.lit("oracle_recruiting"), entry("host"), job["Id"]),
        "company": text_of(entry("company")),
        "title": text_of(job["Title"]),
        "location": text_of(job["PrimaryLocation"]),
        "url": F.concat(entry("job_detail_base"), F.lit("/"), job["Id"]),
        "category": text_of(entry("category")),
        "posted_at": job["PostedDate"],
        "description_snippet": strip_html(text, SNIPPET),
        "description": display_text(text),
    }


_RIPPLING_JOB = (
    "struct<id: string, uuid: string, name: string, title: string, location: string, workplaceType: string, "
    "locationType: string, url: string, description: string, descriptionHtml: string, created_at: string, "
    "updated_at: string>"
)


def _rippling_title(job) -> Column:
    return strip(F.coalesce(blank_to_null(job["name"]), text_of(job["title"])))


def _rippling_id(job) -> Column:
    return F.coalesce(blank_to_null(job["id"]), text_of(job["uuid"]))


def _rippling_place(job) -> Column:
    """The location may be an object or plain text; it lands as text either way."""
    at = F.col("_at")
    parts = F.concat_ws(
        ", ", blank_to_null(at["city"]), F.coalesce(blank_to_null(at["state"]), blank_to_null(at["region"])),
        blank_to_null(at["country"]),
    )
    return F.coalesce(
        blank_to_null(F.when(at.isNotNull(), parts).otherwise(strip(text_of(job["location"])))), F.lit("Multiple Locations"),
    )


@provider(
    "rippling",
    f"struct<jobs: array<{_RIPPLING_JOB}>>",
    lambda doc: F.when(
        F.ltrim("payload").startswith("["), F.from_json("payload", f"array<{_RIPPLING_JOB}>"),
    ).when(F.ltrim("payload").startswith("{"), F.coalesce(doc["jobs"], F.array())),
    keep=lambda job: (_rippling_id(job) != "") & (_rippling_title(job) != ""),
    stages=(
        lambda job: {"_at": F.from_json(
            F.when(job["location"].startswith("{"), job["location"]), "struct<city: string, state: string, region: string, country: string>")},
        lambda job: {"_place": _rippling_place(job)},
    ),
)
def _rippling(job, entry):
    place = F.col("_place")
    kind = F.lower(F.coalesce(blank_to_null(job["workplaceType"]), text_of(job["locationType"])))
    text = display_text(F.coalesce(blank_to_null(job["description"]), job["descriptionHtml"]))
    words = F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")
    return {
        "id": F.concat_ws(":", F.lit("rippling"), entry("token"), _rippling_id(job)),
        "company": F.coalesce(entry("company"), entry("token")),
        "title": _rippling_title(job),
        "location": place,
        "url": F.coalesce(
            blank_to_null(job["url"]),
            F.concat(F.lit("https://ats.rippling.com/"), entry("token"), F.lit("/jobs/"), _rippling_id(job)),
        ),
        "category": text_of(entry("category")),
        "work_arrangement": F.when(kind.contains("remote"), "remote").when(kind.contains("hybrid"), "hybrid")
        .otherwise(normalise_arrangement(place)),
        "posted_at": F.coalesce(blank_to_null(job["created_at"]), job["updated_at"]),
        "description_snippet": F.array_join(F.slice(words, 1, 80), " "),
        "description": text,
    }


def workday_wanted_pages(raw: DataFrame, page_size: int = 20, max_pages: int | None = None, by: tuple[str, ...] = ("source_entry",)) -> DataFrame:
    """The pages a crawl would have read.

    The total is only right on page 1 (later pages report 0); reading stops at
    the total, at an empty page, or at the entry's page limit (``max_pages`` if
    it states none; None: no limit).  ``by`` tells crawls apart.
    """
    doc = F.from_json("payload", PROVIDERS["workday"].body)
    sized = raw.withColumn("_n", F.size(doc["jobPostings"])).withColumn("_total", doc["total"])
    bounds = sized.groupBy(*by).agg(
        F.max(F.when(F.col("page") == 1, F.coalesce("_total", "_n"))).alias("_all"),
        F.min(F.when(F.col("_n") == 0, F.col("page"))).alias("_empty"),
    )
    limit = F.coalesce(F.get_json_object("entry", "$.max_pages").cast("int"), F.lit(max_pages).cast("int"))
    return (
        sized.join(bounds, list(by))
        .filter((F.col("page") == 1) | ((F.col("page") - 1) * page_size < F.col("_all")))
        .filter(F.col("page") <= F.coalesce(F.least(limit, "_empty"), "page"))
        .select(*raw.columns)
    )


#: How many jobs a page holds, for providers that state a total of jobs.
PAGE_SIZES = {"workday": 20, "smartrecruiters": 100}


def page_facts(raw: DataFrame) -> DataFrame:
    """Responses with what each tells of its crawl, so that bodies need not be parsed for it again.

    `stated`: the responses that its category has by its own word; `blank`: it
    lists nothing where reading ends at such a page; `max_pages`: its entry's
    limit; `unreadable`: not in its provider's shape, or of no known provider;
    `uncommon`: may hold references outside the common ones.
    """
    def number(path: str) -> Column:
        return F.get_json_object("payload", path).cast("int")

    name = F.col("provider")
    jobs = F.when(name == "workday", F.when(F.col("page") == 1, number("$.total"))).when(name == "smartrecruiters", number("$.totalFound"))
    size = F.when(name == "workday", PAGE_SIZES["workday"]).otherwise(PAGE_SIZES["smartrecruiters"])
    stated = F.when(name == "muse", number("$.page_count")).when(
        name.isin(list(PAGE_SIZES)), F.greatest(F.lit(1), F.ceil(jobs / size))).otherwise(F.lit(1))
    first = F.when(name == "workday", F.get_json_object("payload", "$.jobPostings[0]")).when(
        name == "smartrecruiters", F.get_json_object("payload", "$.content[0]")).otherwise(F.lit(""))
    shapeless = F
    for known, spec in PROVIDERS.items():
        shapeless = shapeless.when(name == known, _items(spec).isNull())
    # a text has no reference that its body, still escaped, does not show
    texts = F.concat(text_of("payload"), F.lit(" "), text_of("entry"))
    return raw.withColumns({
        "stated": stated.cast("int"), "blank": first.isNull(), "max_pages": F.get_json_object("entry", "$.max_pages").cast("int"),
        "unreadable": shapeless.otherwise(F.lit(True)),
        "uncommon": texts.contains("\\u0026") | has_uncommon_references(texts),
    })


def pages_wanted(facts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per crawl (``by``) of ``page_facts``: `seen_at` (its newest fetch), `unreadable`, whether any page is, `complete`, whether all are there.

    Workday tells its total of jobs on page 1, SmartRecruiters on each page, The
    Muse its pages per category; reading ends early at an empty page or at the
    entry's limit.  Other bodies are whole.  `crawl_pages`, where a fetcher
    states how many responses a crawl has, must be reached as well.
    """
    # a page is one row first, so that distinct pages are counted without another kind of aggregation
    pages = facts.groupBy(*by, "query_category", "page").agg(
        F.max("stated").alias("stated"), F.max("blank").alias("blank"), F.max("max_pages").alias("limit"),
        F.max("crawl_pages").alias("responses"), F.max("unreadable").alias("unreadable"), F.max("fetched_at").alias("seen_at"))
    each = pages.groupBy(*by, "query_category").agg(
        F.max("stated").alias("stated"), F.min(F.when(F.col("blank"), F.col("page"))).alias("empty"), F.max("limit").alias("limit"),
        F.count("page").alias("have"), F.max("responses").alias("responses"), F.max("unreadable").alias("unreadable"), F.max("seen_at").alias("seen_at"))
    enough = F.coalesce(F.col("have") >= F.least("stated", "empty", "limit"), F.lit(False)) & F.col("stated").isNotNull()
    # a source's crawls meet here once; what follows by crawl or source is not shuffled again
    return each.repartition(by[0]).groupBy(*by).agg(
        F.max("seen_at").alias("seen_at"), F.max("unreadable").alias("unreadable"),
        (F.min(enough) & (F.sum("have") >= F.coalesce(F.max("responses"), F.lit(0)))).alias("complete"))


def attach_entries(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds each response's source configuration by the source's id; NULL for responses without a known source."""
    return raw.join(sources.select(F.col("id").alias("source_id"), F.col("config").alias("entry")), "source_id", "left")


def run_report(fetched: DataFrame) -> DataFrame:
    """Per source entry: rows fetched and rows with an intern title."""
    from joblattice.functions.text import is_internship

    return fetched.groupBy("source_entry").agg(
        F.count("*").alias("fetched"), F.count_if(is_internship("title")).alias("relevant"),
    )
