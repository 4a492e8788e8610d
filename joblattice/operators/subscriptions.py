"""Presets as a table: which postings pass which of very many presets.

`filters.apply_presets` is one expression per preset.  Here a keyword is found
by the rarest of its runs: wherever a keyword stands as a whole, each run of word
characters in it, and each run of others, is a whole run of the text.  Texts are
joined to the presets by such runs and by trusted companies; the full predicate
then decides on the pairs that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions.text import NOT_AFTER, NOT_BEFORE, WORD, text_of
from joblattice.operators.filters import FilterSpec

SCHEMA = ("preset string, keywords_any array<string>, exclude_keywords array<string>, trusted_companies array<string>, "
          "locations_include array<string>, locations_exclude array<string>, max_age_days int")
_RUNS = rf"([{WORD}]+|[^{WORD}]+)"


def preset_rows(spark: SparkSession, presets: dict[str, FilterSpec]) -> DataFrame:
    rows = [(n, *[list(getattr(s, c)) for c in ("keywords_any", "exclude_keywords", "trusted_companies", "locations_include", "locations_exclude")],
             s.max_age_days) for n, s in presets.items()]
    return spark.createDataFrame(rows, SCHEMA)


def _runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_RUNS)))


def _filled(words: str) -> Column:
    return F.filter(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))


def _pattern(words: str) -> Column:
    """One pattern of a preset's words, each bounded as `keyword_pattern` bounds it; null without words."""
    def one(word: Column) -> Column:
        w = F.lower(word)
        before = F.when(w.rlike(rf"^[{WORD}]"), NOT_BEFORE).otherwise(rf"(?<=[{WORD}])")
        after = F.when(w.rlike(rf"[{WORD}]\z"), NOT_AFTER).otherwise(rf"(?=[{WORD}])")
        return F.concat(before, F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), after)

    return F.when(F.size(_filled(words)) > 0, F.array_join(F.transform(_filled(words), one), "|"))


def apply_subscriptions(postings: DataFrame, presets: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """Every (posting, preset) that passes, as `apply_presets` gives them, with the preset's name in `preset`.

    `presets` has the columns of `SCHEMA`; null lists are empty, a preset without
    keywords and trusted companies matches nothing.  Postings need a key: rows
    without one take no part, rows that share one are each judged on their own.
    """
    text = F.concat_ws(" ", text_of("title"), text_of("description_snippet"))
    words = presets.select("preset", F.explode(F.array_distinct(F.transform(_filled("keywords_any"), F.lower))).alias("word"))
    runs = _runs(F.col("word"))
    wordy = F.filter(runs, lambda r: r.rlike(f"[{WORD}]"))  # blanks are in nearly every text: only words of nothing else need such runs
    parts = words.select("word").distinct().select("word", F.explode(F.when(F.size(wordy) > 0, wordy).otherwise(runs)).alias("run"))
    said = postings.select(F.col(key).alias("key"), F.explode(_runs(text)).alias("run")).join(parts.select("run").distinct(), "run")
    often = said.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # a word of which a run is nowhere cannot be found, and its rarest run is that one
    rarest = parts.join(often, "run", "left").groupBy("word").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    by_word = said.join(rarest, "run").select("key", "word").join(words, "word").select("key", "preset")
    trusted = presets.select("preset", F.explode(F.array_distinct(_filled_or_blank("trusted_companies"))).alias("company"))
    by_company = postings.select(F.col(key).alias("key"), "company").join(trusted, "company").select("key", "preset")
    hits = by_word.unionByName(by_company).distinct()

    rules = presets.select(
        "preset", _filled_or_blank("trusted_companies").alias("_trusted"), F.col("max_age_days").alias("_days"),
        F.coalesce(F.size("locations_include") > 0, F.lit(False)).alias("_inside"),
        *[_pattern(c).alias(f"_{n}") for c, n in (("keywords_any", "any"), ("exclude_keywords", "not"),
                                                  ("locations_include", "in"), ("locations_exclude", "out"))])
    rows = postings.drop("preset").join(hits, F.col(key) == F.col("key")).drop("key").join(rules, "preset")

    def found(t: Column, pattern: str) -> Column:
        return F.coalesce(F.rlike(F.lower(t), F.col(pattern)), F.lit(False))

    place = text_of("location")
    since = F.coalesce("posted_at_ts", "first_seen")
    old = F.coalesce((F.col("_days") != 0) & (since < F.timestamp_add("DAY", -F.col("_days"), as_of)), F.lit(False))
    ok = ((F.coalesce(F.array_contains("_trusted", F.col("company")), F.lit(False)) | found(text, "_any"))
          & ~found(text, "_not") & ~found(place, "_out") & ~old & (~F.col("_inside") | found(place, "_in")))
    return rows.filter(ok).select(*[c for c in postings.columns if c != "preset"], "preset")


def _filled_or_blank(words: str) -> Column:
    return F.filter(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: w.isNotNull())
