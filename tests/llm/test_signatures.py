"""Ranked search over bit-sliced signatures against a plain scan."""

import collections
import math
import random
import re

import numpy as np
import pytest

from joblattice.llm import queries as llm
from joblattice.llm import signatures
from tests.compare import checker, rows_of

SF = "/root/testdata/sf0.001"
PLAIN_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"


def plain_terms(text):
    return PLAIN_TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [(i, collections.Counter(plain_terms(t))) for i, t in docs]
    n_docs, words = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // words if words else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(plain_terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "été", "İx", "日本", "ÀB", "A-b", "x_y"]
    usual = [1 / (i + 1) for i in range(len(words))]
    docs = []
    for i in range(n):
        size = rng.choice((0, 1, 3, 20, 60, 200))
        docs.append((None if i % 37 == 0 else i, None if i % 23 == 0 else rng.choice((" ", ", ", "\n", "\x00")).join(rng.choices(words, usual, k=size))))
    docs += [docs[3], docs[3], (docs[5][0], "w1 w2 w2 other"), (9999, "w7 " * 5000 + "w8"), (9998, " ".join(f"u{i}" for i in range(9000)))]
    items = [(0, " ".join(rng.choices(words, k=12))), (1, None), (2, ""), (3, "nothing of this"), (4, "w7 W7 w8 u55"), (4, "w0 w1"), (5, "W0"), (None, "w3 STRASSE straße")]
    return docs, items


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equals_a_plain_scan(spark, k, monkeypatch):
    monkeypatch.setattr(signatures, "BLOCK_QUERIES", 3)
    docs, items = corpus(400)
    got = signatures.search(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k)
    assert rows(got) == plain(docs, items, k)


def test_terms_agree_in_both_engines(spark):
    texts = ["A-Z aZ09 _x", "\x7fa\x80b c", "É e", "日本 語", "\x00", "", "KK"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.t for r in df.select("doc_id", signatures.term_column(signatures.F.col("text")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_terms(t) == [x.decode() for x in signatures.terms_of(t.encode())]


def test_bounds_never_fall_below_scores_and_exclude(spark, monkeypatch):
    monkeypatch.setattr(signatures, "TERMS", 50)  # counts are handed on in parts
    docs, items = corpus(600, 8)
    index = signatures.build(spark.createDataFrame(docs, DOC).repartition(2))
    queries = spark.createDataFrame([i for i in items if i[1]], "item_id long, text string")
    (block,) = signatures.blocks(queries, index, "item_id", "text")
    texts = {r.ref: r.data for r in spark.createDataFrame(docs, DOC).select(*signatures.referred("doc_id", "text")).collect()}
    seen = 0
    for c in index.chunks(spark).collect():
        bound = block.bounds(c.width, np.array(c.lengths), bytes(c.bits))
        for j, ref in enumerate(c.refs):
            exact = block.score(bytes(texts[ref]), np.arange(len(block.queries)))
            assert (bound[:, j] >= exact).all()
            seen += int((bound[:, j] > 1.5 * exact + 1).sum())
    # few documents are far from their bounds
    assert seen < 0.2 * len(docs) * len(block.queries)
    assert sum(len(c.refs) for c in index.chunks(spark).collect()) == index.documents == sum(bool(plain_terms(t)) for _, t in docs)


def test_levels():
    assert signatures.level_table(25).tolist() == [1, 2, 3, 4, 6, 8, 12, 16, 24]
    assert signatures.level_table(1).tolist() == [1]


def test_empty_tables_extra_columns_and_a_given_index(spark):
    docs, items = corpus(60)
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS ref", "2 AS data", "3 AS query", "4 AS item_id", "5 AS score")
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS q", "2 AS terms", "3 AS row", "4 AS doc_id")
    assert rows(signatures.search(df, queries, 3, signatures.build(df))) == plain(docs, items, 3)
    assert rows(signatures.search(df.limit(0), queries, 3)) == rows(signatures.search(df, queries.limit(0), 3)) == []
    assert rows(signatures.search(df.where("doc_id = 0"), queries, 3)) == []


def test_the_query_equals_its_sql(spark):
    df = llm.QUERIES["op11_lexical_rank"](spark, SF)
    cur = checker(SF).execute(llm.ORACLE_SQL["op11_lexical_rank"])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())
