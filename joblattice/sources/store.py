"""Posting stores, source lists and presets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import literal_map, text_of
from joblattice.schema import BATCH, BATCH_COLUMNS, PRESET


def read_store(spark: SparkSession, path: str, multi_line: bool = False, schema: str = BATCH) -> DataFrame:
    """A JSON store, one row per id: the last one read wins; a missing path is an empty store."""
    try:
        rows = spark.read.schema(schema).json(path, multiLine=multi_line)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    names = rows.columns
    placed = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return placed.groupBy("id").agg(F.max_by(F.struct(*names), "_at").alias("_row")).select("_row.*")


def write_store(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Newest ``first_seen`` first; range-sorted, so part files are in order."""
    df.orderBy(F.desc("first_seen"), "id").write.mode("overwrite").format(fmt).save(path)


def to_batch_shape(postings: DataFrame) -> DataFrame:
    """Open postings with exactly the batch store's fields."""
    return (
        postings.filter(F.col("status") == "open")
        .withColumnRenamed("ats", "source")
        .withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ssXXX"))
        .select(*BATCH_COLUMNS)
    )


def scrape_interval(ats="ats"):
    return F.coalesce(literal_map(vocab.SCRAPE_INTERVAL_SECONDS)[F.col(ats)], F.lit(vocab.DEFAULT_INTERVAL_SECONDS))


def load_sources(listed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Source list rows (company, ats, category, config) as sources.

    Rows lacking company or ats are passed over.  Of known sources only
    configuration and category change.
    """
    usable = listed.filter((text_of("company") != "") & (text_of("ats") != "")).select(
        "company", "ats", text_of("category").alias("category"), "config",
        F.lit("active").alias("status"), F.lit("manual").alias("added_by"),
        scrape_interval().alias("scrape_interval_seconds"),
    )
    if existing is None:
        return usable
    key = ["company", "ats"]
    new = usable.select(*key, F.struct("*").alias("_new"))
    old = existing.select(*key, F.struct(*[c for c in usable.columns]).alias("_old"))
    both = old.join(new, key, "full_outer")
    pick = {c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) for c in usable.columns if c not in key}
    for c in ("category", "config"):
        pick[c] = F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}"))
    return both.select(*key, *[v.alias(c) for c, v in pick.items()])


def load_presets(spark: SparkSession, specs: list[dict], skip=("operations-logistics-supply-chain", "default")) -> DataFrame:
    """Preset files as rows: the default first, then the others by id; lists default to empty."""
    lists = ["keywords_any", "exclude_keywords", "trusted_companies", "locations_include", "locations_exclude"]

    def row(spec):
        return (
            spec["id"], spec.get("name") or spec["id"].replace("-", " ").title(),
            *[list(spec.get(k) or []) for k in lists], spec.get("max_age_days"),
        )

    default = [s for s in specs if s["id"] == "default"]
    others = sorted((s for s in specs if s["id"] not in skip), key=lambda s: s["id"])
    return spark.createDataFrame([row(s) for s in default + others], PRESET)
