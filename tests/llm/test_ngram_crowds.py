"""Crowded keys of the n-gram join: groups of copies that drift apart, on every level of set sizes."""

import random

import pytest

from joblattice.llm import ngram_join
from tests.llm.brute import near_components


def drifted(rng, n_words, copies, most):
    """Copies of one text in which up to a share of the words has been replaced, so that some link and others do not."""
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n_words)]
    for _ in range(copies):
        words = list(base)
        for at in rng.sample(range(n_words), int(n_words * rng.uniform(0, most))):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(words)


@pytest.mark.parametrize("n_words, copies, most", [(60, 120, 0.06), (500, 80, 0.05), (1800, 60, 0.04)])
def test_drifted_copies_equal_all_pairs(spark, n_words, copies, most):
    rng = random.Random(n_words)
    docs = list(enumerate(drifted(rng, n_words, copies, most)))
    docs += [(1000 + i, t + " tail of its own") for i, t in enumerate(drifted(rng, n_words, 40, most))] + [(2000, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    want = near_components(docs)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(docs)


def test_parities_never_exceed_the_difference(spark):
    """Bits in which two rows differ are no more than the hashes that only one set has, on each width."""
    rng = random.Random(5)
    sets = {1: [rng.getrandbits(48) for _ in range(700)]}
    sets[2] = sets[1][:600] + [rng.getrandbits(48) for _ in range(80)]
    sets[3] = []
    held = spark.createDataFrame(
        [(i, b"".join(x.to_bytes(6, "little") for x in sorted(s))) for i, s in sets.items()], "set long, shingles binary")
    asked = spark.createDataFrame([(i, lev) for i in sets for lev in (0, 1, 2, 40)], "a long, level int")
    rows = {(r.a, r.level): [x & (1 << 64) - 1 for x in r[2:]] for r in ngram_join.parities(held, asked).collect()}
    assert len(rows) == 12
    for lev in (0, 1, 2, 40):
        for a, b in ((1, 2), (1, 3), (2, 3)):
            bits = sum((x ^ y).bit_count() for x, y in zip(rows[a, lev], rows[b, lev]))
            apart = len(set(sets[a]) ^ set(sets[b]))
            assert bits <= apart and bits % 2 == apart % 2 and bits > 0
