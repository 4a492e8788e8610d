"""Top-k search, near duplicates, secrets, mixing, and the pipeline."""

import collections
import random

import numpy as np
import pytest

from joblattice.llm import mixing, ngram_join, secret_scan, topk
from joblattice.llm import queries as llm
from tests.compare import checker, rows_of
from tests.llm import brute

SF = "/root/testdata/sf0.001"


# top-k

def test_winners_of_blocks_with_ties():
    rng = np.random.default_rng(1)
    for m, d, high in ((3, 4, 3), (40, 3, 3), (300, 8, 6), (900, 16, 1000), (200, 2, 2**40)):
        x = rng.integers(-high, high, (m, d))
        ids, q = rng.permutation(m * 3)[:m], x[:20]
        a, b, s = topk.winners(ids[:20], q, ids, x, 10)
        for i in range(len(q)):
            exact = sorted((-sum(int(u) * int(v) for u, v in zip(q[i], x[j])), ids[j]) for j in range(m) if ids[j] != ids[i])[:10]
            got = [(-int(s[k]), ids[b[k]]) for k in np.flatnonzero(a == i)]
            limit = 2**63
            assert got == [(max(-limit + 1, min(limit, v)), j) for v, j in exact] or high > 2**31 and [g[0] for g in got] == [max(-limit + 1, min(limit, v)) for v, _ in exact]


def test_search_of_odd_tables(spark):
    rows = [(0, [1.0, 0.5]), (1, [2.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]),
            (1, [2.0, 0.0]), (100, [-1.0, 0.25]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, topk.F.col("id") % 100 == 0).collect())
    usable = [(0, [1024, 512]), (1, [2048, 0]), (5, [1024, 0]), (6, [0, 0]), (100, [-1024, 256])]
    assert got == brute.top_k(usable)
    assert topk.search(df.limit(0), topk.F.col("id") % 100 == 0).count() == 0


# near duplicates

def near_docs():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three four five six"), (6, "a b c d e f g h i"), (7, "a b c d e f g h j")]
    for g in range(12):  # groups of edited copies of texts from short to long
        base = [rng.choice(words) for _ in range(rng.choice((8, 12, 30, 90, 300, 700, 2600)))]
        for _ in range(rng.randrange(2, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy + [rng.choice(words)] * rng.randrange(3))))
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(40):  # a passage in many documents, more than meet in pairs
        own = [rng.choice(words) for _ in range(rng.choice((4, 12, 30, 120)))]
        docs.append((len(docs), " ".join(own + passage)))
    base = [rng.choice(words) for _ in range(150)]
    for _ in range(40):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = rng.choice(words)
        docs.append((len(docs), " ".join(copy)))
    return docs


def test_near_duplicates_equal_all_pairs(spark):
    docs = near_docs()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, n string, set int").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute.near_components(docs)


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0
    text = "one two three four five six seven"
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text)], "doc_id long, text string")
    assert sorted((r.id or -1, r.component_id) for r in ngram_join.join(df).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 4)]


def test_sketches_never_miss_a_similar_set():
    rng = np.random.default_rng(2)
    for n in (3, 7, 40, 250, 256, 340, 520, 1023, 1400, 4200):
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            a = np.sort(rng.permutation(pool)[:n])
            lose = rng.integers(0, n // 7 + 1)
            b = np.sort(np.r_[rng.permutation(a)[lose:], rng.integers(0, 2**64, rng.integers(0, n // 7 + 1), dtype=np.uint64)])
            if not ngram_join.linked(len(a), len(b), len(np.intersect1d(a, b))):
                continue
            x, y = dict(ngram_join.keys(a)), dict(ngram_join.keys(b))
            assert any(len(np.intersect1d(x[k], y[k])) for k in x.keys() & y.keys())


# secrets

def test_dictionary_takes_all_usual_words_of_any_length(spark):
    names = ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) + "word" for i in range(25_000)]
    long = "internationalizationworkinggroup"
    counts = spark.createDataFrame([(w, 5) for w in names] + [(long, 4), ("rare", 2), ("über", 9), ("a1b2c3", 9)], "word string, n long")
    known = secret_scan.dictionary(counts)
    assert known.count() == 25_001
    got = secret_scan.coverage(spark.createDataFrame([(f"{names[-1]}-{long}_12",), ("1234567890123456",)], "candidate string"), known).collect()
    assert [(r.candidate[:4], round(r.dictionary_share * 44)) for r in got] == [(names[-1][:4], 40)]
    more = secret_scan.dictionary(spark.createDataFrame([("seldom", 50), ("usual", 5_000), ("others", 100_000_000)], "word string, n long"))
    assert sorted(r.word for r in more.collect()) == ["others", "usual"]


def test_unquoted_short_and_copied_secrets(spark):
    rng = random.Random(9)
    make = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ123456789"
    rows = []
    for i in range(60):  # no secret in quotes, all in copies
        line = (f"AWS_ACCESS_KEY=AKIA{make(16, upper)}", f"password: {make(9, mixed)}7{make(8, mixed)}", f"API_TOKEN={make(24, mixed)}==")[i % 3]
        rows += [(10 * i + k, "src/app", f"some plain words here\n{line}\nand some other plain words") for k in range(4)]
    rows += [(1000 + i, "docs/x", f"some plain words and the number {rng.randrange(10**15, 10**16)} here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counts = secret_scan.word_counts(docs).cache()
    found = secret_scan.candidates(docs, secret_scan.dictionary(counts), secret_scan.transitions(counts)).cache()
    labelled = secret_scan.weak_labels(found).cache()
    assert labelled.where("key < 1000 and label = 1").count() == 240 and labelled.where("key < 1000").count() == 240
    model = secret_scan.train(labelled)
    assert model is not None
    out = secret_scan.scan(labelled, model).collect()
    assert len(out) == 300 and sum(r.secret == (r.key < 1000) for r in out) >= 296
    assert not any(r.secret for r in secret_scan.scan(labelled.where("key >= 1000"), None).collect())  # no positive: numbers still go


def test_forest_on_held_out_findings(spark):
    rng = random.Random(7)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    plain = ["the value of something is here and nothing else matters", "another line of ordinary words about the value"]
    rows = [(i, "src/app", f'{rng.choice(plain)} token = "{h}" end of line') for i, h in enumerate(hexes)]
    rows += [(200 + i, "docs/x", f"{rng.choice(plain)} number {rng.randrange(10**15, 10**16)} paid") for i in range(120)]
    rows += [(400, None, None), (401, "p", ""), (402, "p", "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    counts = secret_scan.word_counts(docs).cache()
    found = secret_scan.candidates(docs, secret_scan.dictionary(counts), secret_scan.transitions(counts)).cache()
    labelled = secret_scan.weak_labels(found)
    model = secret_scan.train(labelled.where("key % 2 = 0"))
    out = secret_scan.scan(labelled.where("key % 2 = 1 and key < 400"), model).collect()
    assert len(out) == 120 and sum(r.secret == (r.key < 200) for r in out) >= 118
    assert secret_scan.train(labelled.where("label = 1")) is None
    assert secret_scan.scan(found.limit(0), None).count() == 0


# mixing

def test_targets_and_takings(spark):
    rng = random.Random(8)
    rows = [(i, f"s{i % 7}" if i % 9 else None, " ".join(["w"] * rng.choice((0, 1, 5, 40, 200)))) for i in range(1500)] + [(3000, "s1", None)]
    rows += [(4000 + i, "é", "only few words") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as c", "3 as s")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.size == len((r.text or "").split())
        size[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(size.values()), set()
    while True:
        level = left / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and 2 * size[s] < weight[s] * level}
        if not more:
            break
        full |= more
        left -= sum(2 * size[s] for s in more)
    for s in names:
        assert target[s] == pytest.approx(2 * size[s] if s in full else weight[s] * level)
        assert abs(taken[s] - target[s]) <= 100
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_mix_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, ""), (2, None, "")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.size, r.target) for r in mixing.mix(df).collect()) == [(1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0)]
    assert mixing.mix(df.limit(0)).count() == 0


# queries and pipeline

@pytest.mark.parametrize("name", list(llm.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = llm.QUERIES[name](spark, SF)
    cur = checker(SF).execute(llm.ORACLE_SQL[name])
    got, want = df.collect(), cur.fetchall()
    assert rows_of(df.columns, got) == rows_of([d[0] for d in cur.description], want)


def test_near_duplicate_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op7(spark, SF).collect()}
    assert got == brute.near_components(docs)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = set()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.withColumnRenamed("lang", "lang"), SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(out.columns) == set(docs.columns), name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "ngram_join":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(c == i for i, (_, c) in brute.near_components(kept).items())
            ids = {i for i, _ in kept}
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= ids
