"""Full-text search over an inverted index kept as a table.

The index holds one row per (term, id, field) with the term's positions.  A
query reads only its own terms' rows; terms, and buckets of a stored index, are
literal lists, so the scan is pruned.  Words are stemmed by the English suffix
algorithm (``functions.stem``), each distinct word once.  Ranks add field weights, title above company above
location above description.
"""

from __future__ import annotations

import re
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.functions.stem import with_stem
from joblattice.functions.text import text_of
from joblattice.operators.filters import contains_any
from joblattice.operators.skew import TASK_ROWS, TASK_TEXTS
from joblattice.session import shared_dir

# fixed values: field weights A, B, C, D of weighted text search
WEIGHTS = {"title": 1.0, "company": 0.4, "location": 0.2, "description": 0.1}

# fixed values: English words carrying no meaning of their own
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()

def _kept(df: DataFrame, name: str) -> DataFrame:
    """Stored in the shared folder: of a size known before joins are planned."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vocabulary(placed: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(word, term) of all words, of these terms only if any are given; a word is stemmed once, however often it stands.

    The distinct words are stored, so a vocabulary of a size to be sent to all
    tasks is, and the places of words are not shuffled to meet it.
    """
    # the aggregation, which needs no further shuffle, keeps tests of terms from being carried into the stages
    vocabulary = with_stem(placed.select("word").distinct()).groupBy("word").agg(F.max("term").alias("term"))
    if terms is not None:
        vocabulary = vocabulary.filter(F.col("term").isin(terms))
    return _kept(vocabulary, "vocabulary")


def stems_of(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """The stems of a query's few words."""
    rows = with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect() if words else []
    return {r["word"]: r["term"] for r in rows}


def words_of(text) -> Column:
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"([\p{L}\p{N}]+)"))


def build_index(df: DataFrame, key: str = "id", weights: dict = WEIGHTS, only: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(term, id, field, weight, positions); stop words are left out, their places are not.

    ``only`` keeps the terms of a query's words, for a search without a stored
    index.  With ``buckets`` rows also have their `bucket`, and those of a
    bucket and a part of the texts lie in one task, as ``write_index`` stores them.
    """
    fields = [f for f in weights if f in df.columns]
    each = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(float(weights[f])).alias("weight"), F.col(f).alias("text")) for f in fields])

    def placed(rows: DataFrame) -> DataFrame:
        texts = rows.select(key, *fields).select(key, F.explode(each).alias("t")).select(key, "t.field", "t.weight", words_of("t.text").alias("words"))
        kept = texts.select(key, "field", "weight", F.posexplode_outer("words").alias("pos", "word")).filter(~F.col("word").isin(STOP_WORDS))
        return kept if only is None else kept.filter(F.substring("word", 1, 1).isin(sorted({w[0] for w in only})))

    vocabulary = _vocabulary(placed(df), None if only is None else sorted(set(stems_of(df.sparkSession, only).values())))
    if only is not None:
        return placed(df).join(vocabulary, "word").groupBy("term", key, "field").agg(
            F.max("weight").alias("weight"), F.sort_array(F.collect_list("pos")).alias("positions"))

    # Texts are dealt by their key, a small part of what their index takes: a text's places meet in its task, and
    # where the vocabulary is sent to all tasks, a text's terms as well.  Rows of the index are moved once, to be stored.
    n = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_TEXTS))
    met = placed(df.repartition(tasks, key)).groupBy("word", key, "field").agg(
        F.max("weight").alias("weight"), F.collect_list("pos").alias("positions")).join(vocabulary, "word").drop("word")
    by = ["term", key, "field"]
    if buckets is not None:
        # a frequent term's rows are as many as texts, so a bucket is cut by parts of the texts that grow in number
        part = F.pmod(F.xxhash64(key), F.lit(-(-n // TASK_ROWS) or 1)).cast("int")
        met = met.withColumns({"bucket": bucket_of(F.col("term"), buckets), "part": part}).repartition("bucket", "part")
        by = ["bucket", "part", *by]
    return met.groupBy(*by).agg(
        F.max("weight").alias("weight"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")).drop("part")


BUCKETS = 64


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets))


def write_index(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Clustered by term, so a query's scan skips what it does not need; rows that lie by bucket already are not moved again."""
    if "bucket" not in index.columns:
        index = index.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange("bucket", "term", "id")
    index.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_query(q: str) -> list[dict]:
    """A web-style query as alternatives of required and forbidden phrases.

    Words join by AND, ``or`` starts an alternative, quotes make a phrase and a
    leading minus forbids.  Anything else, stray quotes included, is ignored.
    """
    groups: list[dict] = [{"must": [], "not": []}]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', q or ""):
        if word.lower() == "or" and not minus:
            groups.append({"must": [], "not": []})
            continue
        run = [(i, w) for i, w in enumerate(re.findall(r"[^\W_]+", (quoted or word).lower())) if w not in STOP_WORDS]
        if run:
            groups[-1]["not" if minus else "must"].append(run)
    return [g for g in groups if g["must"] or g["not"]]


def query_words(q: str) -> list[str]:
    return sorted({w for g in read_query(q) for run in g["must"] + g["not"] for _, w in run})


def search_texts(df: DataFrame, q: str, weights: dict = WEIGHTS) -> DataFrame:
    """``search`` straight over the texts; only the query's words are grouped."""
    return search(build_index(df, weights=weights, only=query_words(q)), q, df)


def search(index: DataFrame, q: str, texts: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, rank) of the texts matching a query, reading the index once, and of it only the query's terms.

    A phrase is met where all its words stand at their distances from one
    starting place in one field.  An alternative that only forbids is met, with
    rank 0, by all texts (``texts``, or those of the index) without what it forbids.
    """
    groups = read_query(q)
    if not groups:
        return index.select("id", F.lit(0.0).alias("rank")).limit(0)
    runs = [run for g in groups for kind in ("must", "not") for run in g[kind]]
    at = {id(run): n for n, run in enumerate(runs)}
    stems = stems_of(index.sparkSession, query_words(q))
    rows = [(n, len(run), stems[w], i - run[0][0]) for n, run in enumerate(runs) for i, w in run]
    wanted = index.sparkSession.createDataFrame(rows, "run int, size int, term string, at int")
    known = index.select("id").distinct() if texts is None else texts.select("id").distinct()
    if "bucket" in index.columns:
        # stored: the few terms of a query and their buckets become literals that reach the scan
        terms = wanted.select("term", bucket_of(F.col("term"), buckets).alias("b")).distinct().collect()
        index = index.filter(F.col("bucket").isin(sorted({r["b"] for r in terms})) & F.col("term").isin(sorted({r["term"] for r in terms})))
    places = F.when(F.col("size") == 1, F.array(F.lit(0))).otherwise(F.col("positions"))
    met = (
        index.join(F.broadcast(wanted), "term")
        .select("id", "field", "run", "size", F.col("weight").cast("double").alias("weight"), "at", F.explode(places).alias("pos"))
        .groupBy("id", "field", "run", "size", (F.col("pos") - F.col("at")).alias("start"))
        .agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
        .filter(F.col("n") == F.col("size"))
        .groupBy("id", "field", "run").agg(F.max(F.col("weight") * F.col("size")).alias("weight"))
    )
    by_text = met.groupBy("id").agg(*[
        F.sum(F.when(F.col("run") == n, F.col("weight"))).alias(f"_run{n}") for n in range(len(runs))])

    if not all(g["must"] for g in groups):
        by_text = known.join(by_text, "id", "left")

    def rank_of(group) -> Column:
        must = [F.col(f"_run{at[id(r)]}") for r in group["must"]]
        never = [F.col(f"_run{at[id(r)]}").isNull() for r in group["not"]]
        return F.when(reduce(lambda a, b: a & b, [m.isNotNull() for m in must] + never), reduce(lambda a, b: a + b, must, F.lit(0.0)))

    ranks = F.array_compact(F.array(*[rank_of(g) for g in groups]))
    total = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + r)
    return by_text.filter(F.size(ranks) > 0).select("id", F.round(total, 4).alias("rank"))


def search_feed(df: DataFrame, index: DataFrame, q: str) -> DataFrame:
    """Rows matching by text or by substring of title or company.

    ``search_rank`` is 0 for a substring only; sort by it, descending, before
    the feed's own order.
    """
    ranked = search(index, q, df)
    return (
        df.join(ranked, "id", "left")
        .filter(F.col("rank").isNotNull() | contains_any(q, ("title", "company")))
        .withColumn("search_rank", F.coalesce("rank", F.lit(0.0)))
        .drop("rank")
    )


# --- rank by frequency and closeness ------------------------------------------

# fixed values: the sum of 1/n^2, and how closeness falls with distance
_SQUARES = 1.64493406685
_NEAR = {"base": 1.005, "rise": 0.05, "width": 1.5, "shift": 2.0, "far": 100, "least": 1e-30}


def placed_terms(df: DataFrame, words: list[str], key: str = "id", weights: dict = WEIGHTS) -> DataFrame:
    """(id, term, pos, weight): where the terms of some words stand, fields counted on one after the other.

    A field starts where the last word of meaning of the one before it stood.
    """
    fields = [f for f in weights if f in df.columns]
    texts = df.select(key, *[words_of(f).alias(f"_{f}") for f in fields])

    def last(f: str) -> Column:
        return F.coalesce(F.array_max(F.transform(f"_{f}", lambda w, i: F.when(w.isin(STOP_WORDS), 0).otherwise(i + 1))), F.lit(0))

    before, parts = F.lit(0), []
    for f in fields:
        parts.append(F.struct(before.alias("base"), F.lit(float(weights[f])).alias("weight"), F.col(f"_{f}").alias("words")))
        before = before + last(f)
    first = sorted({w[0] for w in words})
    rows = texts.select(key, F.explode(F.array(*parts)).alias("f")).select(key, "f.base", "f.weight", F.posexplode("f.words").alias("at", "word"))
    rows = rows.filter(~F.col("word").isin(STOP_WORDS) & F.substring("word", 1, 1).isin(first))
    terms = sorted(set(stems_of(df.sparkSession, words).values()))
    return rows.join(_vocabulary(rows, terms), "word").select(key, "term", (F.col("base") + F.col("at") + 1).alias("pos"), "weight")


def rank_by_frequency(placed: DataFrame, n_terms: int, key: str = "id") -> DataFrame:
    """(id, rank): per term its occurrences, each counting less by the square of its place in order, but the best weighted one in full.

    The sum goes over the query's number of terms.
    """
    places = placed.groupBy(key, "term").agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("p"))
    weights = F.transform("p", lambda x: x["weight"])
    falling = F.aggregate(F.transform(weights, lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(weights)
    at = F.array_position(weights, best)
    each = places.withColumn("r", (best + falling - best / (at * at)) / F.lit(_SQUARES))
    return each.groupBy(key).agg((F.sum("r") / F.lit(float(n_terms))).alias("rank"))


def rank_by_closeness(placed: DataFrame, key: str = "id") -> DataFrame:
    """(id, rank): one minus what is left after each pair of places of two different terms took its share, more the closer they are."""
    a = placed.select(key, F.col("term").alias("ta"), F.col("pos").alias("pa"), F.col("weight").alias("wa"))
    b = placed.select(key, F.col("term").alias("tb"), F.col("pos").alias("pb"), F.col("weight").alias("wb"))
    apart = F.abs(F.col("pa") - F.col("pb")).cast("double")
    near = F.when(apart > _NEAR["far"], _NEAR["least"]).otherwise(
        1.0 / (_NEAR["base"] + _NEAR["rise"] * F.exp(apart / _NEAR["width"] - _NEAR["shift"])))
    met = a.join(b, key).filter((F.col("ta") < F.col("tb")) & (F.col("pa") != F.col("pb")))
    share = F.sqrt(F.col("wa") * F.col("wb") * near)
    return met.select(key, (1.0 - share).alias("left")).groupBy(key).agg((1.0 - F.product("left")).alias("rank"))


def ranked_search(df: DataFrame, q: str, key: str = "id", weights: dict = WEIGHTS) -> DataFrame:
    """(id, rank) of the texts that match a query.

    One alternative of several terms ranks by closeness; alternatives, and a
    single term, by frequency.  Texts found only for what they do not hold rank 0.
    """
    groups, words = read_query(q), query_words(q)
    matches = search_texts(df, q, weights).select(key)
    if not words:
        return matches.withColumn("rank", F.lit(0.0))
    placed = placed_terms(df.join(matches, key, "left_semi"), words, key, weights)
    terms = len(set(stems_of(df.sparkSession, words).values()))
    ranks = rank_by_closeness(placed, key) if len(groups) == 1 and terms > 1 else rank_by_frequency(placed, terms, key)
    return matches.join(ranks, key, "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
