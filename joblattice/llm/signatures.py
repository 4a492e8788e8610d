"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in chunks of like size.  A chunk is a matrix of bits,
one row of bits per hash position (a slice) and one column per document; a
document sets the positions of each of its terms, once for every level of
frequency that the term reaches in it.  Slices of one term and level, joined by
AND, mark every document that reaches it, and some that do not.

A search adds up, per document, each term's weight at the greatest frequency
that the slices allow: an upper bound of the score.  The documents of the
highest bounds are scored exactly; the k-th of those scores excludes every
document whose bound is below it.  All others are scored exactly from their
texts.  The result is exact: marks can be wrong in one direction only.

Documents are read twice: whole when the index is made, and where they are not
excluded.  Queries go in blocks of bounded size against all chunks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblattice.llm.common import scratch, stored, table

#: Bits of a chunk, positions per document and term, hashes per term, widest signature.
CHUNK_BITS, PER_KEY, HASHES, WIDEST = 2**23, 16, 6, 2**22
#: Most documents of a chunk.
CHUNK_ROWS = 8192
#: Words that are worked on at once, and terms that a task counts before it hands its counts on.
WORDS, TERMS = 1_000_000, 300_000
#: Terms of a block of queries (a longer query is a block of its own), and queries of a block.
BLOCK_TERMS, BLOCK_QUERIES = 30_000, 256
#: So many documents for each one wanted are scored first; short ones may owe a high bound to false marks.
LIKELY = 4

#: Maximal runs of other than ASCII punctuation, space and control characters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))

INDEX = "kind int, width int, refs array<long>, lengths array<long>, bits binary, term binary, df long, documents long, words long"
CHUNK, DICTIONARY, TOTALS = 0, 1, 2


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def term_column(text: Column) -> Column:
    """The same in Spark."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(TERM), F.lit(0))


def levels() -> Iterator[int]:
    """Frequencies at which a term is entered again: 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    yield 1
    low = 2
    while True:
        yield low
        yield low * 3 // 2
        low *= 2


def level_table(most: int) -> np.ndarray:
    """The levels up to a frequency."""
    out = []
    for low in levels():
        if low > most:
            return np.array(out, np.int64)
        out.append(low)
    raise AssertionError


def _mixed(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Another 64-bit hash for each level of a term's hash."""
    with np.errstate(over="ignore"):
        h = h ^ (np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def positions(h: np.ndarray, width: int) -> np.ndarray:
    """The positions, one row per hash, in signatures of a width that is a power of two."""
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((first + step * np.uint64(i)) & np.uint64(width - 1)).astype(np.int64) for i in range(HASHES)], axis=1)


class _Terms(dict):
    """Numbers of the terms met, and their hashes."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(term))
        return n


class _Builder:
    """Gathers documents by signature width and gives chunks, counts of terms and totals."""

    def __init__(self):
        self.terms, self.df = _Terms(), np.zeros(0, np.int64)
        self.open: dict[int, list] = {}
        self.documents = self.words = 0

    def add(self, refs: np.ndarray, texts: list[bytes]) -> Iterator[dict]:
        found = [list(map(self.terms.__getitem__, terms_of(t))) for t in texts]
        lengths = np.array([len(f) for f in found], np.int64)
        flat = np.concatenate([np.array(f, np.int64) for f in found]) if found else np.zeros(0, np.int64)
        n = len(self.terms.hashes)
        pairs, tf = np.unique(np.repeat(np.arange(len(found)), lengths) * n + flat, return_counts=True)
        doc, term = pairs // max(n, 1), pairs % max(n, 1)
        self.df = np.pad(self.df, (0, n - len(self.df))) + np.bincount(term, minlength=n)
        self.documents += int((lengths > 0).sum())
        self.words += int(lengths.sum())
        # a row for each level that a term reaches in a document
        steps = level_table(int(tf.max(initial=1)))
        reached = np.searchsorted(steps, tf, "right")
        level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        keys = _mixed(np.repeat(np.array(self.terms.hashes, np.uint64)[term], reached), level)
        per_doc = np.bincount(doc, reached, len(found)).astype(np.int64)
        ends = np.cumsum(per_doc)
        for i in np.flatnonzero(lengths):
            width = min(WIDEST, max(64, 1 << int(per_doc[i] * PER_KEY - 1).bit_length()))
            waiting = self.open.setdefault(width, [])
            waiting.append((int(refs[i]), int(lengths[i]), keys[ends[i] - per_doc[i]:ends[i]].copy()))
            if len(waiting) >= min(CHUNK_ROWS, max(8, CHUNK_BITS // width)):
                yield self.chunk(width)
        if n > TERMS:
            yield from self.counts()

    def chunk(self, width: int) -> dict:
        rows = self.open.pop(width)
        bits = np.zeros((width, -(-len(rows) // 8) * 8), bool)
        for i, (_, _, keys) in enumerate(rows):
            bits[positions(keys, width).ravel(), i] = True
        return {"kind": CHUNK, "width": width, "refs": [r[0] for r in rows], "lengths": [r[1] for r in rows], "bits": np.packbits(bits, axis=1).tobytes()}

    def counts(self) -> Iterator[dict]:
        for term, n in self.terms.items():
            yield {"kind": DICTIONARY, "term": term, "df": int(self.df[n])}
        self.terms, self.df = _Terms(), np.zeros(0, np.int64)

    def rest(self) -> Iterator[dict]:
        for width in list(self.open):
            yield self.chunk(width)
        yield from self.counts()
        yield {"kind": TOTALS, "documents": self.documents, "words": self.words}


_ARROW = pa.schema([
    ("kind", pa.int32()), ("width", pa.int32()), ("refs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()),
    ("term", pa.binary()), ("df", pa.int64()), ("documents", pa.int64()), ("words", pa.int64())])


def _batches(rows: Iterator[dict], at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Chunks one by one, small rows together."""
    held: list[dict] = []
    for row in rows:
        if row["kind"] == CHUNK:
            yield pa.RecordBatch.from_pylist([row], _ARROW)
            continue
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Refs and texts of some rows at a time, so that long texts do not pile up."""
    refs, texts = batch.column(0).to_numpy(), batch.column(1)
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size > WORDS * 6:
            yield refs[start:i + 1], texts.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(refs):
        yield refs[start:], texts.slice(start).to_pylist()


def referred(key: str, text: str) -> tuple[Column, Column]:
    """(ref, text in UTF-8): a document is found again by a hash of its id and text, which only equal documents share."""
    return F.xxhash64(key, text).alias("ref"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")


@dataclass(frozen=True)
class Index:
    """The stored chunks and dictionary, and the totals."""

    path: str
    documents: int
    words: int

    def chunks(self, spark) -> DataFrame:
        return spark.read.schema(INDEX).parquet(f"{self.path}/index").where(F.col("kind") == CHUNK).select("width", "refs", "lengths", "bits")

    def dictionary(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/dictionary")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> Index:
    """Indexes every document with a term, in one pass; documents without one count nowhere.

    Ids and texts may be null or repeated; equal documents are documents each.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "signatures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            builder = _Builder()
            for batch in batches:
                for refs, texts in _portions(batch):
                    yield from builder.add(refs, texts)
            yield from builder.rest()

        yield from _batches(rows())

    docs.select(*referred(key, text)).mapInArrow(index, INDEX).write.parquet(f"{path}/index")
    rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    rows.where(F.col("kind") == DICTIONARY).groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{path}/dictionary")
    n, words = rows.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return Index(path, n, words)


class Block:
    """Some queries: their terms in one numbering, weights, and which query holds which term."""

    def __init__(self, rows: list, documents: int, words: int):
        """rows: (query, term, df), each query's terms once; queries are told apart by number."""
        self.documents, self.words = documents, words
        self.queries = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(self.queries)}
        found: dict[bytes, int] = {}
        # a term that no document holds adds nothing
        rows = [(q, bytes(t), n) for q, t, n in rows if n]
        for _, t, _ in rows:
            found.setdefault(t, len(found))
        self.terms = found
        self.weights = np.zeros(len(found), np.int64)
        self.holds = np.zeros((len(self.queries), len(found)), np.float64)
        for q, t, n in rows:
            self.weights[found[t]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
            self.holds[place[q], found[t]] = 1.0
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in found], np.uint64)

    def damping(self, lengths: np.ndarray) -> np.ndarray:
        """20 m of documents by their numbers of terms."""
        return 20 * (50 + (50 * lengths * self.documents) // max(self.words, 1))

    def bounds(self, width: int, lengths: np.ndarray, bits: bytes, at_once: int = 2**21) -> np.ndarray:
        """Upper bounds of the scores, one row per query and one column per document of a chunk."""
        n = len(lengths)
        slices = np.frombuffer(bits, np.uint8).reshape(width, -1)
        damp = self.damping(lengths)
        most = int(lengths.max(initial=1))
        steps = level_table(most)
        total = np.zeros((len(self.queries), n))
        group = max(1, at_once // max(n, 1))
        for start in range(0, len(self.hashes), group):
            mine = self.hashes[start:start + group]
            # the greatest frequency that the slices allow, per term and document
            tf = np.zeros((len(mine), n), np.int64)
            alive = np.arange(len(mine))
            for level in range(len(steps)):
                at = positions(_mixed(mine[alive], level), width)
                marks = np.bitwise_and.reduce(slices[at], axis=1)
                some = marks.any(axis=1)
                alive, marks = alive[some], np.unpackbits(marks[some], axis=1, count=n).astype(bool)
                if not len(alive):
                    break
                if level:
                    # marked here counts only if all lower levels are marked too
                    marks &= tf[alive] == steps[level] - 1
                ceiling = steps[level + 1] - 1 if level + 1 < len(steps) else most
                tf[alive] = np.where(marks, ceiling, tf[alive])
            tf = np.minimum(tf, lengths)
            gain = self.weights[start:start + group, None] * ((10**9 * tf) // (1000 * tf + damp))
            # sums stay below 2**53, so they are exact
            total += self.holds[:, start:start + group] @ gain.astype(np.float64)
        return total.astype(np.int64)

    def score(self, text: bytes, of: np.ndarray) -> np.ndarray:
        """Exact scores of one text for some of the queries, by place."""
        found = terms_of(text)
        tf = {self.terms[t]: n for t, n in Counter(found).items() if t in self.terms}
        if not tf:
            return np.zeros(len(of), np.int64)
        at, tf = np.array(list(tf), np.int64), np.array(list(tf.values()), np.int64)
        damp = 20 * (50 + (50 * len(found) * self.documents) // max(self.words, 1))
        gain = self.weights[at] * ((10**9 * tf) // (1000 * tf + damp))
        return np.array([int(gain[self.holds[q, at] > 0].sum()) for q in of], np.int64)


_BOUND = "query int, ref long, bound long"


def _bound_rows(index: Index, spark, block: Block, floor: np.ndarray | None, k: int) -> DataFrame:
    """(query, ref, bound): with a floor per query, all documents at or above it and above 0; else each task's k highest."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_refs = [np.zeros(0, np.int64) for _ in block.queries]
        best = [np.zeros(0, np.int64) for _ in block.queries]
        for batch in batches:
            for i in range(batch.num_rows):
                refs = batch["refs"][i].values.to_numpy(zero_copy_only=False)
                lengths = batch["lengths"][i].values.to_numpy(zero_copy_only=False)
                bound = block.bounds(batch["width"][i].as_py(), lengths, batch["bits"][i].as_py())
                if floor is not None:
                    q, d = np.nonzero((bound >= floor[:, None]) & (bound > 0))
                    if len(q):
                        yield pa.RecordBatch.from_pydict({"query": q.astype(np.int32), "ref": refs[d], "bound": bound[q, d]})
                    continue
                for q in range(len(block.queries)):
                    keep = np.flatnonzero(bound[q])
                    if len(best[q]) >= k:
                        keep = keep[bound[q, keep] > best[q].min()]
                    values, ids = np.concatenate([best[q], bound[q, keep]]), np.concatenate([best_refs[q], refs[keep]])
                    if len(values) > k:
                        first = np.argpartition(-values, k)[:k]
                        values, ids = values[first], ids[first]
                    best[q], best_refs[q] = values, ids
        if floor is None and any(len(b) for b in best):
            yield pa.RecordBatch.from_pydict({
                "query": np.repeat(np.arange(len(best)), [len(b) for b in best]).astype(np.int32),
                "ref": np.concatenate(best_refs), "bound": np.concatenate(best)})

    return index.chunks(spark).mapInArrow(look, _BOUND)


def _scored(docs: DataFrame, found: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """(query, key, ref, score) of the documents found for queries, from their whole texts."""
    asked = found.groupBy("ref").agg(F.collect_set("query").alias("queries"))
    rows = docs.select(*referred(key, text), F.col(key).cast("long").alias("id")).join(asked, "ref").select("id", "ref", "data", "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, refs, queries, out = batch["id"].to_pylist(), batch["ref"].to_pylist(), batch["queries"], []
            for i, data in enumerate(batch["data"]):
                of = queries[i].values.to_numpy(zero_copy_only=False)
                out += [(int(q), ids[i], refs[i], int(s)) for q, s in zip(of, block.score(data.as_py(), of)) if s > 0]
            q, i, r, s = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({
                "query": pa.array(q, pa.int32()), "id": pa.array(i, pa.int64()), "ref": pa.array(r, pa.int64()), "score": pa.array(s, pa.int64())})

    return rows.mapInArrow(score, "query int, id long, ref long, score long")


def _first(rows: DataFrame, k: int, order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def blocks(queries: DataFrame, index: Index, key: str, text: str) -> Iterator[Block]:
    """The queries in blocks; one block's terms are on the driver at a time."""
    spark = queries.sparkSession
    each = queries.select(F.col(key).alias("q"), F.array_distinct(term_column(F.col(text))).alias("terms"))
    each = each.where(F.size("terms") > 0)
    # queries that are equal in id are one query each
    sized = stored(each.select("q", "terms", F.size("terms").alias("n"), F.monotonically_increasing_id().alias("row")), "queries")
    known = index.dictionary(spark)
    start, held, weight = None, 0, 0
    cuts = []
    for r in sized.select("row", "n").orderBy("row").toLocalIterator():
        if start is not None and (held >= BLOCK_QUERIES or weight + r.n > BLOCK_TERMS):
            cuts.append((start, r.row))
            start = None
        if start is None:
            start, held, weight = r.row, 0, 0
        held, weight = held + 1, weight + r.n
    if start is not None:
        cuts.append((start, None))
    for low, high in cuts:
        mine = sized.where(F.col("row") >= low)
        mine = mine.where(F.col("row") < high) if high is not None else mine
        terms = mine.select("row", F.explode("terms").alias("t")).select("row", F.col("t").cast("binary").alias("term")).join(known, "term", "left")
        rows = [(r.row, r.term, r.df or 0) for r in terms.collect()]
        block = Block(rows, index.documents, index.words)
        block.ids = {r.row: r.q for r in mine.select("row", "q").collect()}
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 50, index: Index | None = None, key: str = "doc_id", text: str = "text",
           query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_key, rank from 1, key and score of each query's k highest-scoring documents with a score above 0.

    Equal scores go by key, rows without one last.  Queries without a term, and
    empty tables, give no rows.  `index` may be one that `build` made of the
    same documents.
    """
    spark = docs.sparkSession
    index = index or build(docs, key, text)
    out = scratch(spark, "ranked")
    n = 0
    for block in blocks(queries, index, query_key, query_text):
        if not len(block.hashes):
            continue
        some = k * LIKELY
        likely = stored(_first(_bound_rows(index, spark, block, None, some), some, [F.col("bound").desc(), "ref"]), "likely")
        scores = stored(_scored(docs, likely, block, key, text), "scored")
        # the k-th exact score; nothing is excluded where there are fewer
        kth = _first(scores, k, [F.col("score").desc()]).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s"))
        floor = np.ones(len(block.queries), np.int64)
        for r in kth.collect():
            if r.n == k:
                floor[r.query] = r.s
        open_ones = stored(_bound_rows(index, spark, block, floor, k).select("query", "ref"), "not-excluded")
        best = _first(_scored(docs, open_ones, block, key, text), k, [F.col("score").desc(), F.col("id").asc_nulls_last()])
        names = F.element_at(F.array(*[F.lit(block.ids[q]) for q in block.queries]), F.col("query") + 1)
        best.select(names.cast(queries.schema[query_key].dataType).alias(query_key), "rank", F.col("id").alias(key), "score").write.parquet(f"{out}/part={n}")
        n += 1
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, rank int, `{key}` long, score long"
    return spark.read.schema(schema).parquet(*[f"{out}/part={i}" for i in range(n)]) if n else spark.createDataFrame([], schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, {_SQL_TERMS} AS t FROM benchmark),
asked AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM items),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM docs),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n),
sizes AS (SELECT r, doc_id, 50 + (50 * len(t) * n) // l AS m FROM docs, totals WHERE len(t) > 0),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
