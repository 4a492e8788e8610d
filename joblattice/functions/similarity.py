"""How alike two short texts are, by their common blocks."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this length on frequent characters no longer start a block, which only the Arrow form does.
LONG = 200


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value named once and used often inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _longest(a: Column, b: Column, t: Column) -> Column:
    """(size, i, j) of the longest common block of a[alo:ahi] and b[blo:bhi], the first in a, then in b.

    A row of lengths of common blocks that end at each place of b is carried over the places of a.
    """
    def row(best: Column, i: Column) -> Column:
        def cell(j: Column) -> Column:
            before = F.when(j > t["blo"], F.element_at(best["row"], j - t["blo"])).otherwise(0)
            return F.when(F.get(a, i) == F.get(b, j), before + 1).otherwise(0)

        def better(ends: Column) -> Column:
            def take(top: Column) -> Column:
                more = top > best["size"]
                j = t["blo"] + F.array_position(ends, top).cast("int") - top
                return F.struct(
                    ends.alias("row"), F.when(more, top).otherwise(best["size"]).alias("size"),
                    F.when(more, i - top + 1).otherwise(best["i"]).alias("i"), F.when(more, j).otherwise(best["j"]).alias("j"))

            return _let(F.array_max(ends), take)

        return _let(F.transform(F.sequence(t["blo"], t["bhi"] - 1), cell), better)

    none = F.struct(F.array_repeat(F.lit(0), t["bhi"] - t["blo"]).alias("row"), *[F.lit(0).alias(c) for c in ("size", "i", "j")])
    return F.aggregate(F.sequence(t["alo"], t["ahi"] - 1), none, row)


def _span(alo, ahi, blo, bhi) -> Column:
    return F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))


def matched(a: Column, b: Column) -> Column:
    """How many elements of two arrays, neither empty, lie in common blocks.

    The longest common block is taken, then those of what lies left and right
    of it, and so on.  Spans still to be looked at are a stack that a fold
    carries; each span but the first follows from a block, so there are at most
    twice as many as elements.
    """
    def step(state: Column, _: Column) -> Column:
        def look(t: Column) -> Column:
            def found(m: Column) -> Column:
                ai, bj = m["i"] + m["size"], m["j"] + m["size"]
                left = F.when((m["size"] > 0) & (t["alo"] < m["i"]) & (t["blo"] < m["j"]), _span(t["alo"], m["i"], t["blo"], m["j"]))
                right = F.when((m["size"] > 0) & (ai < t["ahi"]) & (bj < t["bhi"]), _span(ai, t["ahi"], bj, t["bhi"]))
                rest = F.slice(state["spans"], F.lit(1), F.size(state["spans"]) - 1)
                return F.struct(F.concat(rest, F.array_compact(F.array(left, right))).alias("spans"), (state["n"] + m["size"]).alias("n"))

            return _let(_longest(a, b, t), found)

        return F.when(F.size(state["spans"]) == 0, state).otherwise(_let(F.element_at(state["spans"], -1), look))

    start = F.struct(F.array(_span(F.lit(0), F.size(a), F.lit(0), F.size(b))).alias("spans"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.size(a), F.size(b))), start, step)["n"]


@F.pandas_udf(T.DoubleType())
def _long_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def with_ratio(df: DataFrame, a: str = "a", b: str = "b", into: str = "ratio") -> DataFrame:
    """Adds twice the matched characters over all characters of two texts of one-unit characters, 1 for two empty ones.

    Texts are compared by built-in functions; those whose second is of LONG
    characters or more by an Arrow function, as other rules hold for them.
    """
    sizes, long = F.length(a) + F.length(b), F.length(b) >= LONG
    short = ~long & (F.length(a) > 0) & (F.length(b) > 0)
    # characters are split once, not per step
    wide = df.withColumns({"_a": F.when(short, F.split(a, "")), "_b": F.when(short, F.split(b, ""))})
    ratio = (
        F.when(sizes == 0, 1.0).when(F.col(a) == F.col(b), 1.0).when(short, 2.0 * matched(F.col("_a"), F.col("_b")) / sizes)
        .when(long, _long_ratio(F.when(long, F.col(a)), F.when(long, F.col(b)))).otherwise(0.0)
    )
    return wide.withColumn(into, ratio).drop("_a", "_b")
