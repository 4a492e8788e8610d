"""Presets as a table give what one expression per preset gives."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from joblattice.operators import filters, subscriptions

NOW = datetime(2026, 6, 1)
WORDS = ["c++", "c", "++", "supply chain", "chain", "Freight", "data\\E", "r&d", "o'neil", "ÉTÉ", "a.b", "axb", "yard", "", "(x"]
PLACES = ["Reno, NV", "Austin, TX", "", "Paris", None]


def postings(spark, rng, n):
    def text():
        return rng.choice(["", " ", "/"]).join(rng.choice(WORDS + ["c++d", "été", "supply  chain"]) for _ in range(rng.randrange(5)))

    rows = [(str(i), rng.choice(["Acme", "Best", "", None]), rng.choice([None, text()]), text(), rng.choice(PLACES),
             rng.choice([None, datetime(2026, 5, 30), datetime(2020, 1, 1)]), datetime(2026, 5, 1)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "id string, company string, title string, description_snippet string, location string, "
                                 "posted_at_ts timestamp, first_seen timestamp")


def spec(rng):
    def some(of, most):
        return [rng.choice(of) for _ in range(rng.randrange(most))]

    return filters.FilterSpec(some(WORDS, 4), some(WORDS, 2), some(["Acme", "Best", ""], 2), some(["NV", "tx", "paris"], 2),
                              some(["nv", "paris"], 2), rng.choice([None, 0, 60]))


def test_equal_to_one_expression_per_preset(spark):
    rng = random.Random(7)
    df = postings(spark, rng, 300)
    presets = {f"p{i}": spec(rng) for i in range(60)}
    want = sorted((r.id, r.preset) for r in filters.apply_presets(df, presets, F.lit(NOW)).select("id", "preset").collect())
    got = sorted((r.id, r.preset) for r in subscriptions.apply_subscriptions(
        df, subscriptions.preset_rows(spark, presets), F.lit(NOW)).select("id", "preset").collect())
    assert len(want) > 300 and got == want


def test_ten_thousand_presets_and_empty_tables(spark):
    df = postings(spark, random.Random(3), 50)
    many = {f"p{i}": filters.FilterSpec(keywords_any=[f"word{i}", "r&d" if i % 1000 == 0 else f"x {i}"]) for i in range(10_000)}
    rows = subscriptions.preset_rows(spark, many)
    got = subscriptions.apply_subscriptions(df, rows, F.lit(NOW))
    one = df.filter(filters.passes(filters.FilterSpec(keywords_any=["r&d"]), F.lit(NOW))).count()
    assert one > 0 and got.count() == 10 * one and got.columns == [*df.columns, "preset"]
    assert subscriptions.apply_subscriptions(df.limit(0), rows, F.lit(NOW)).count() == 0
    assert subscriptions.apply_subscriptions(df, rows.limit(0), F.lit(NOW)).count() == 0
