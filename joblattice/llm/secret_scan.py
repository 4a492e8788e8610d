"""Secret scans: patterns propose candidates, a random forest removes false positives.

Features of a candidate are its length and makeup, how usual its character
transitions are and how much of it dictionary words cover (both from word
counts over the whole corpus), its path, and the words before and after it.
The forest is Spark ML's, trained on a bounded sample of labelled findings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblattice.llm.common import stored, table, whole_text, words

#: Share of all words, and times at least, that a word of the dictionary occurs; labelled findings in the training sample.
SHARE, LEAST, SAMPLE = 1e-6, 3, 5_000
TREES, DEPTH, SEED, THRESHOLD = 20, 6, 8, 0.5
#: Words that announce a secret, and path parts that speak of examples.
ANNOUNCE = frozenset("token key secret password passwd pwd api apikey auth bearer credential credentials private access".split())
EXAMPLE = ("test", "example", "sample", "mock", "fixture", "doc", "demo")
#: Characters whose transitions are told apart; digits count as one, all others as another.
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0?"
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?")
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[a-z]{4,}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")

FEATURES = (
    "length", "entropy", "digit_share", "upper_share", "hex", "class_changes", "transition_bits", "dictionary_share",
    "path_depth", "path_example", "announced", "announced_far", "assigned", "quoted", "after_word")
SEEN = tuple(f for f in FEATURES if f != "dictionary_share")
FOUND = "text_hash long, start long, end long, candidate string, " + ", ".join(f"{f} double" for f in SEEN)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word of letters occurs in all texts, in lower case."""
    each = docs.select(F.explode(words(F.lower(whole_text(text)))).alias("w"))
    return each.select(F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word")).where("word <> ''").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def dictionary(counts: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(word): all words of four plain letters or more, however long, that make up at least `share` of all words.

    Other letters and signs do not occur in candidates.
    """
    most = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("word").rlike("^[a-z]{4,}$") & (F.col("n") >= max(least, share * most))).select("word")


def transitions(counts: DataFrame) -> dict[str, float]:
    """Bits that each pair of neighbouring characters is worth, from all words weighed by their counts (28 x 28 at most)."""
    plain = F.regexp_replace(F.regexp_replace("word", "[0-9]", "0"), "[^a-z0]", "?")
    pairs = counts.select(plain.alias("p"), "n").where(F.length("p") > 1).select(
        "n", F.explode(F.expr("transform(sequence(1, length(p) - 1), i -> substring(p, i, 2))")).alias("pair"))
    seen = {r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("n")).collect()}
    out = {}
    for a in _SYMBOLS:
        total = sum(seen.get(a + b, 0) + 1 for b in _SYMBOLS)
        out |= {a + b: -log2((seen.get(a + b, 0) + 1) / total) for b in _SYMBOLS}
    return out


def _covered(s: str, known: set[str]) -> float:
    """The share of characters in dictionary words, the longest first at each place."""
    lengths = sorted(set(map(len, known)), reverse=True)
    s, at, hit = s.lower(), 0, 0
    while at < len(s):
        n = next((n for n in lengths if s[at:at + n] in known), 0)
        hit += n
        at += n or 1
    return hit / len(s)


def coverage(strings: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, dictionary_share) of different candidates.

    Their parts between places in runs of letters, of the lengths that dictionary words have, are joined to the stored
    dictionary.
    """
    lengths = sorted(r[0] for r in known.select(F.length("word")).distinct().collect())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array((x[k] for x in held), pa.string()) for k in (0, 1)], ["candidate", "word"])
            held.clear()
            return out

        for b in batches:
            for c in b.column(0).to_pylist():
                seen = set()
                for run in _LETTERS.findall(c.lower()):
                    for n in lengths:
                        if n > len(run):
                            break
                        seen.update(run[i:i + n] for i in range(len(run) - n + 1))
                for w in sorted(seen):
                    held.append((c, w))
                    if len(held) >= 10_000:
                        yield batch()
        yield batch()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [_covered(c, set(w or ())) for c, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each, pa.float64())], ["candidate", "dictionary_share"])

    met = strings.mapInArrow(parts, "candidate string, word string").join(known, "word")
    words_of = met.groupBy("candidate").agg(F.collect_list("word").alias("known"))
    return words_of.mapInArrow(shares, "candidate string, dictionary_share double")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _assigned(text: str, start: int) -> bool:
    return text[max(0, start - 60):start].rstrip("\"' \t")[-1:] in ("=", ":")


def features(text: str, start: int, end: int, path: str, bits: dict[str, float]) -> tuple[float, ...]:
    """`SEEN` of one candidate: all of `FEATURES` but what the dictionary covers."""
    s = text[start:end]
    n = len(s)
    plain = "".join(c if c in _SYMBOLS[:26] else "0" if c.isdigit() else "?" for c in s.lower())
    before, after = text[max(0, start - 60):start], text[end:end + 40]
    near = [w.lower() for w in _WORD.findall(before)][-5:]
    return (
        float(n), -sum(k / n * log2(k / n) for k in Counter(s).values()), sum(map(str.isdigit, s)) / n, sum(map(str.isupper, s)) / n,
        float(_HEX.fullmatch(s) is not None), sum(_kind(a) != _kind(b) for a, b in zip(s, s[1:])) / (n - 1),
        sum(bits[a + b] for a, b in zip(plain, plain[1:])) / (n - 1),
        float(path.count("/")), float(any(w in path.lower() for w in EXAMPLE)),
        float(bool(near) and near[-1] in ANNOUNCE), float(any(w in ANNOUNCE for w in near)),
        float(_assigned(text, start)), float(before[-1:] in ("\"", "'") and after[:1] == before[-1:]),
        float(bool(_WORD.match(after.lstrip("\"'., ")))))


def candidates(docs: DataFrame, known: DataFrame, bits: dict[str, float], key: str = "doc_id", path: str = "source", text: str = "text") -> DataFrame:
    """A row per candidate of each whole text: key, path, the text's hash, place in code points, the string, and `FEATURES`.

    Strings of 16 characters or more that keys are made of, with a digit, or at
    least 24 long, or assigned; = parts them but at the end.  Null and empty texts have
    none; a null path is empty.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, (p, t) in enumerate(zip(b.column(1).to_pylist(), b.column(3))):
                t = t.as_py() or ""
                for m in _CANDIDATE.finditer(t):
                    if len(m[0]) >= 24 or any(map(str.isdigit, m[0])) or _assigned(t, m.start()):
                        at.append(i)
                        found.append((m.start(), m.end(), m[0], *features(t, m.start(), m.end(), p, bits)))
            columns = list(zip(*found)) or [[]] * (3 + len(SEEN))
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * len(SEEN)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(pa.array(at, pa.int32())) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["key", "path", "text_hash", "start", "end", "candidate", *SEEN])

    found = stored(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, path string, " + FOUND), "found")
    shares = coverage(found.select("candidate").distinct(), known)
    return found.join(shares, "candidate", "left").fillna(0.0, ["dictionary_share"])


def weak_labels(found: DataFrame) -> DataFrame:
    """`found` with `label` where its makeup and repetition settle it, for corpora without reviewed findings.

    1: after a word that announces a secret and a sign of assignment, high in entropy, whatever its length, quotes or
    copies.  0: numbers, words that the dictionary covers by half, and strings low in entropy that three different texts
    or more share; copies of a text count once.
    """
    shared = found.groupBy("candidate").agg(F.count_distinct("text_hash").alias("__n_texts"))
    out = found.join(shared, "candidate")
    good = (F.col("announced") == 1) & (F.col("assigned") == 1) & (F.col("entropy") >= 3)
    bad = (F.col("digit_share") == 1) | (F.col("dictionary_share") >= 0.5) | ((F.col("__n_texts") >= 3) & (F.col("entropy") < 3))
    return out.withColumn("label", F.when(bad, 0).when(good, 1)).drop("__n_texts")


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(df)


def train(findings: DataFrame, most: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (`FEATURES`, label 0 or 1; other labels are ignored).

    About `most` of each label, chosen by hash among different findings, in one small partition so that training repeats
    exactly.  None if a label is missing.
    """
    known = findings.where(F.col("label").isin(0, 1)).select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64(*FEATURES).alias("h")).distinct()
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, F.lit(most / counts[1])).otherwise(F.lit(most / counts[0]))
    picked = stored(known.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).repartition(1).sortWithinPartitions("h", *FEATURES), "findings")
    if picked.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(_assembled(picked))


def scan(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """`found` with `score` and `secret`; without a model all candidates stay but those labelled 0."""
    if model is None:
        stays = ~F.col("label").eqNullSafe(0) if "label" in found.columns else F.lit(True)
        return found.withColumns({"score": stays.cast("double"), "secret": stays})
    scored = model.transform(_assembled(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("secret", F.col("score") >= threshold).drop("features", "rawPrediction", "probability", "prediction")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counts = stored(word_counts(docs), "words")
    known = stored(dictionary(counts), "dictionary")
    found = stored(candidates(docs, known, transitions(counts)), "candidates")
    labelled = stored(weak_labels(found), "labelled")
    return scan(labelled, train(labelled)).select(F.col("key").alias("doc_id"), "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")
