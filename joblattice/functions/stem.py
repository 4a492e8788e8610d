"""English stems by the usual suffix algorithm, as staged native columns.

A word has two regions: the first begins after the first non-vowel that follows
a vowel, the second likewise within the first.  Steps take the longest suffix
of a list and act only if it lies in the region they name.  A ``y`` that counts
as a consonant is written as a capital while the steps run.

Stem distinct words and join them back: each stage is a few regular
expressions per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice.functions.text import literal_map

# fixed values: words with a stem of their own, and words left as they are after their plural went
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# fixed values: beginnings that set the first region
PREFIXES = ["gener", "commun", "arsen"]
# fixed values: suffixes and what they become, for the second and third step, and those that the fourth removes
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

VOWEL = "[aeiouy]"
REGION = r"^[^aeiouy]*[aeiouy]+[^aeiouy]"
#: A short syllable at the end, and at the end of a word that is nothing else.
SHORT = r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"


def _suffix(w: Column, suffixes) -> Column:
    """The longest of these suffixes, or the empty text."""
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def _cut(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def with_stem(df: DataFrame, word: str = "word", into: str = "term") -> DataFrame:
    """Adds the stem of each lower-case word; words of one or two letters, and nulls as empty texts, stay as they are."""
    w, s = F.col("_w"), F.col("_s")
    region1, region2 = F.col("_p1"), F.col("_p2")
    start = F.coalesce(F.col(word), F.lit(""))

    def inside(region: Column) -> Column:
        return (s != "") & (F.length(w) - F.length(s) >= region)

    def step(frame: DataFrame, new: Column, suffixes=None) -> DataFrame:
        if suffixes is not None:
            frame = frame.withColumn("_s", _suffix(w, suffixes))
        return frame.withColumn("_w", new)

    def past(text: Column) -> Column:
        return F.length(F.regexp_extract(text, REGION, 0))

    out = df.withColumn("_w", F.regexp_replace(F.regexp_replace(start, "^y", "Y"), "([aeiouy])y", "$1Y"))
    prefix = F.regexp_extract(w, f"^({'|'.join(PREFIXES)})", 1)
    first = F.when(prefix != "", F.length(prefix)).when(past(w) > 0, past(w)).otherwise(F.length(w))
    out = out.withColumn("_p1", first)
    rest = F.substring(w, region1 + 1, F.length(w))
    out = out.withColumn("_p2", F.when(past(rest) > 0, region1 + past(rest)).otherwise(F.length(w)))

    # plurals
    out = step(out, (
        F.when(s == "sses", _cut(w, 2)).when(s.isin("ied", "ies"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
        .when((s == "s") & w.rlike(VOWEL + ".+s$"), _cut(w, 1)).otherwise(w)), ["sses", "ied", "ies", "us", "ss", "s"])
    out = out.withColumn("_kept", F.when(w.isin(KEPT), w))
    # -ed and -ing, and the letter that they took or doubled
    out = out.withColumn("_s", _suffix(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"]))
    out = out.withColumn("_b", F.when((s != "") & ~s.isin("eed", "eedly") & _cut(w, F.length(s)).rlike(VOWEL), _cut(w, F.length(s))))
    b = F.col("_b")
    out = step(out, (
        F.when(s.isin("eed", "eedly"), F.when(inside(region1), F.concat(_cut(w, F.length(s)), F.lit("ee"))).otherwise(w))
        .when(b.isNull(), w).when(b.rlike("(at|bl|iz)$"), F.concat(b, F.lit("e"))).when(b.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(b, 1))
        .when((F.length(b) == region1) & b.rlike(SHORT), F.concat(b, F.lit("e"))).otherwise(b)))
    out = step(out, F.when(w.rlike(".[^aeiouy][yY]$"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    # double suffixes, then single ones
    fits2 = inside(region1) & ((s != "ogi") | w.rlike("logi$")) & ((s != "li") | w.rlike("[cdeghkmnrt]li$"))
    out = step(out, F.when(fits2, F.concat(_cut(w, F.length(s)), literal_map(STEP2)[s])).otherwise(w), STEP2)
    fits3 = inside(region1) & ((s != "ative") | inside(region2))
    out = step(out, F.when(fits3, F.concat(_cut(w, F.length(s)), literal_map(STEP3)[s])).otherwise(w), STEP3)
    fits4 = inside(region2) & ((s != "ion") | w.rlike("[st]ion$"))
    out = step(out, F.when(fits4, _cut(w, F.length(s))).otherwise(w), STEP4)
    last = F.length(w) - 1
    out = step(out, F.when(
        w.endswith("e") & ((last >= region2) | (last >= region1) & ~_cut(w, 1).rlike(SHORT)) | w.endswith("ll") & (last >= region2), _cut(w, 1)).otherwise(w))
    # never null, so that no join on it adds a test for null, which the optimizer would carry through all stages
    done = F.coalesce(literal_map(IRREGULAR)[start], F.when(F.length(start) <= 2, start), F.translate(F.coalesce("_kept", "_w"), "Y", "y"), F.lit(""))
    return out.withColumn(into, done).drop("_w", "_s", "_b", "_p1", "_p2", "_kept")
