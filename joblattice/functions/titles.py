"""Display titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions.text import NOT_AFTER, NOT_BEFORE, SPACE, WORD, squeeze, strip, text_of

# fixed values: how requisition codes are written
# A requisition word must end where the word ends, so "Refinery" is kept.
_REQUISITION = (
    rf"(?i)\s*[\[(]?{NOT_BEFORE}(?:req(?:uisition)?|job\s*id|ref(?:erence)?|req\s*#|req\s*no\.?)(?!\p{{L}})"
    r"\s*[:#-]?\s*[a-z0-9_-]+[\])]?"
)
_NUMBER = rf"(?i)\s*(?:{NOT_BEFORE}(?:JR\d{{4,}}|R-\d{{4,}})|(?<=[{WORD}])#\d{{4,}}){NOT_AFTER}"


def clean_title(df: DataFrame, column: str = "title", into: str | None = None) -> DataFrame:
    """Requisition codes, doubled languages and capitals cleaned out of a title."""
    into = into or column
    plain = strip(F.replace(text_of(column), F.lit("\u00a0"), F.lit(" ")))
    uncoded = F.regexp_replace(F.regexp_replace(plain, _REQUISITION, ""), _NUMBER, "")
    t = F.col("_t")
    bilingual = t.contains(" / Intern") | t.contains(" | Intern")
    staged = df.withColumn("_t", uncoded).withColumn(
        "_t", F.when(bilingual, strip(F.regexp_replace(t, r"(?is)^.*[/|]\s*(?=Intern)", ""))).otherwise(t),
    )

    def recase(word: Column) -> Column:
        return F.when(F.upper(word).isin(vocab.TITLE_ACRONYMS), F.upper(word)).otherwise(
            F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))
        )

    shouting = (F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) > 4)
    words = F.filter(F.split(t, rf"{SPACE}+"), lambda w: w != "")
    cased = F.when(shouting, F.array_join(F.transform(words, recase), " ")).otherwise(t)
    answer = squeeze(F.regexp_replace(cased, r"^[\s\-|:/]+|[\s\-|:/]+$", ""))
    return staged.withColumn("_t", answer).drop(*([into] if into in df.columns else [])).withColumnRenamed("_t", into)
