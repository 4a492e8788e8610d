import random


from joblattice.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, n_words string, w int, __quality_f int"


def odd_texts():
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "x y z x y z", "a|b #*\t\x0b\x0c\r b", "é ü 日本", "l\nl\n\nl \n",
             "w " * 3000, " ".join(str(i % 700) for i in range(20000)), "UPPER! CASE! " * 30]
    return texts + [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]


def test_counts_of_odd_texts(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r[c] for c in quality.COUNTS) for r in quality.counts(df).collect()}
    assert got == {i: brute.quality(t) for i, t in enumerate(texts)}


def test_rules_are_learned_and_applied_in_order(spark):
    good = [(i, f"{' '.join(f'word{i}x{j}' for j in range(60))}", 1) for i in range(40)]
    junk = [(100 + i, " ".join(f"w{i}x{j} |" for j in range(40)), 0) for i in range(40)]
    short = [(200, "too short", 1), (201, None, None)]
    docs = spark.createDataFrame([r[:2] for r in good + junk + short], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good + junk + short] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    rules = quality.learn(quality.sample(docs, labels, 1000))
    assert rules
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, labels).collect()}
    assert all(kept[r[0]] == (False, True) for r in good)
    assert all(kept[r[0]] == (False, False) for r in junk)
    assert kept[200] == (True, False) and kept[201] == (True, False)


def test_without_labels_the_base_rule_is_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, " ".join(map(str, range(60))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality.judge(docs, none).collect()} == {1: False, 2: True}
    assert quality.judge(docs.limit(0), none).count() == 0


def test_learned_list_on_held_out_rows():
    rng = random.Random(1)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.2
        f = [100.0, 5.0, rng.uniform(0.4, 3) if bad else rng.uniform(0, 0.05), 0.0, rng.random() * 0.3, 0.02, 0.0]
        rows.append((i, *f, 0 if bad else 1))
    rules = quality.learn(rows[:600])
    names = quality.FEATURES
    wrong = 0
    for r in rows[600:]:
        hit = any(all((r[1 + names.index(c.feature)] > c.threshold) == c.above for c in x.conditions) for x in rules)
        wrong += hit == bool(r[-1])
    assert wrong <= 3


def test_query_counts_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in quality.op10(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        b = brute.quality(r.text)
        assert tuple(got[r.doc_id][c] for c in quality.COUNTS) == b
        assert got[r.doc_id].base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
