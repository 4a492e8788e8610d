"""Mixing sources to target weights by Pareto order sampling.

Targets come from the sources' sizes.  Within a source a document's expected
copies are in proportion to its preference, at most two; whole copies are
certain, and for what is left documents are ranked by random odds divided by
inclusion odds and taken in that order until the source's words reach its
target.  The cut in the ranking is found from histograms of ranking values that
are combined before the shuffle, so a source of any size is never in one task,
and a document's own copies follow from its source's few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblattice.llm.common import n_words, stored, whole_text

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, 20
#: Bins of a histogram; the bin that holds the cut is divided again as often.
BINS = 2048


def preference(size: Column) -> Column:
    """The larger a document, the more copies: 1 for an empty one, up by a fifth with each doubling, to 5 at most."""
    return F.least(F.lit(1.0) + F.length(F.bin(size)) / 5.0, F.lit(5.0))


def sizes(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """`docs` with `__mx_*` columns: source, size in words, preference, and a random number from key and text."""
    h = F.xxhash64(F.col(key), F.col(text), F.lit(seed))
    return docs.withColumns({
        "__mx_source": F.col(source),
        "__mx_size": n_words(whole_text(text)),
        "__mx_hash": h,
    }).withColumns({
        "__mx_pref": preference(F.col("__mx_size")),
        "__mx_u": (h.bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52),
    })


def _ranked(names: DataFrame) -> DataFrame:
    """Sources with their 0-based place by code point, null last, without one task seeing all.

    Range partitions are numbered inside; a table of one row per partition says
    how many come before.
    """
    spread = stored(names.repartitionByRange(F.col("s").asc_nulls_last()).sortWithinPartitions(F.col("s").asc_nulls_last())
                    .withColumn("part", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("part").orderBy(F.col("s").asc_nulls_last())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spread.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return spread.join(parts.select("part", "before"), "part").withColumn(
        "place", F.row_number().over(inside) - 1 + F.col("before")).drop("part", "before")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (s, source_size): `target`.

    The sources' places deal out the weights in turn.  A source whose part is
    above `most` times its size gets just that; the rest is shared again until
    no source is above.
    """
    table = _ranked(per_source.select("s", "source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(table.withColumn("w", weight), "weights").withColumn("full", most * F.col("source_size").cast("double"))
    mass = table.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = 0.0, -1
    while True:  # the level only rises, and each round fills one source at least
        full = F.col("full") <= F.col("w") * level
        now = table.agg(F.count_if(full), F.sum(F.when(full, F.col("full"))), F.sum(F.when(~full, F.col("w")))).first()
        if now[0] == n_full or not now[2]:
            break
        n_full, level = now[0], (share * mass - (now[1] or 0.0)) / now[2]
    return table.withColumn("target", F.least(F.col("full"), F.col("w") * level)).select("s", "source_size", "target")


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: `target`, the copies per preference `c`, and the last document taken once more, as `cut_y`, `cut_hash`."""
    x, p = F.col("__mx_size"), F.col("__mx_pref")
    # Preferences have few values: copies per preference solve sum(min(most, c * p) * x) = target over them.
    groups = stored(sized.groupBy(F.col("__mx_source").alias("s"), p.alias("p")).agg(F.sum(x).alias("x")), "preferences")
    goal = stored(targets(groups.groupBy("s").agg(F.sum("x").alias("source_size")), weights, share, most), "targets")
    same = F.expr("g.s <=> t.s")
    high = Window.partitionBy("g.s").orderBy(F.col("p").desc())
    above = high.rowsBetween(Window.unboundedPreceding, -1)
    solved = groups.alias("g").join(goal.alias("t"), same).select(
        F.col("g.s").alias("s"), "source_size", "target", "p",
        (F.col("target") - most * F.coalesce(F.sum("x").over(above), F.lit(0))).alias("left"),
        F.sum(F.col("p") * F.col("x")).over(Window.partitionBy("g.s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)).alias("mass"))
    # With all higher preferences at `most`, the rest share `left`; the first preference that then stays within it settles c.
    rate = F.when(F.col("mass") > 0, F.col("left") / F.col("mass")).otherwise(0.0)
    solved = solved.withColumn("c", rate).groupBy("s").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.max_by("c", F.when(F.col("c") * F.col("p") <= most, F.col("p"))).alias("c"))
    solved = stored(solved.withColumn("c", F.coalesce("c", F.lit(float(most)))), "rates")

    d = sized.join(solved.withColumnRenamed("s", "t_s"), F.expr("__mx_source <=> t_s"))
    d = _drawn(d, F.col("c"), most).where(F.col("__mx_size") > 0).select(
        F.col("t_s").alias("s"), "target", x.alias("x"), F.col("__mx_hash").alias("h"), F.col("__mx_whole").alias("whole"), F.col("__mx_y").alias("y"))
    level = stored(d.withColumns({b: F.floor(F.col("y") * n).cast("long") for b, n in (("b1", BINS), ("b2", BINS * BINS))}), "drawn")
    sure = level.groupBy("s").agg(F.sum(F.col("whole") * F.col("x")).alias("sure"), F.first("target").alias("target"))
    need = stored(sure.select("s", (F.col("target") - F.col("sure")).alias("need")), "needs")
    for b in ("b1", "b2"):
        need = stored(_bin_of_cut(level, need, b), "cuts")
        level = level.alias("l").join(need.alias("n"), F.expr(f"l.s <=> n.s and l.{b} = n.bin"), "leftsemi")
    rank = Window.partitionBy("l.s").orderBy("y", "h").rowsBetween(Window.unboundedPreceding, 0)
    last = level.where("y < 1").alias("l").join(need.alias("n"), F.expr("l.s <=> n.s")).select(
        F.col("l.s").alias("s"), "y", "h", "x", F.sum("x").over(rank).alias("upto"), "need")
    last = last.where(F.col("upto") - F.col("x") / 2 <= F.col("need")).groupBy("s").agg(F.max(F.struct("y", "h")).alias("cut"))
    low = need.select("s", (F.col("bin") / float(BINS * BINS)).alias("low"))
    return solved.alias("a").join(low.alias("b"), F.expr("a.s <=> b.s"), "left").join(
        last.alias("k"), F.expr("a.s <=> k.s"), "left").select(
        F.col("a.s").alias("s"), "source_size", "target", "a.c",
        F.coalesce("cut.y", "low", F.lit(-1.0)).alias("cut_y"),
        F.coalesce("cut.h", F.lit(-(1 << 63))).alias("cut_hash"))


def _drawn(df: DataFrame, c: Column, most: int) -> DataFrame:
    """Adds the certain copies and the ranking value: random odds over inclusion odds, brought into 0..1 (1: not in the draw)."""
    e = F.least(c * F.col("__mx_pref"), F.lit(float(most)))
    df = df.withColumn("__mx_e", e).withColumn("__mx_whole", F.floor("__mx_e"))
    u, f = F.col("__mx_u"), F.col("__mx_e") - F.col("__mx_whole")
    q = (u * (1 - f)) / ((1 - u) * f)
    return df.withColumn("__mx_y", F.when(f > 0, F.least(q / (1 + q), F.lit(1.0))).otherwise(F.lit(1.0)))


def _bin_of_cut(level: DataFrame, need: DataFrame, b: str) -> DataFrame:
    """The bin in which the running sum of words reaches the need, and what is needed inside it."""
    sums = level.where("y < 1").groupBy("s", b).agg(F.sum("x").alias("x"))
    upto = F.sum("x").over(Window.partitionBy("l.s").orderBy(b).rowsBetween(Window.unboundedPreceding, 0))
    run = sums.alias("l").join(need.alias("n"), F.expr("l.s <=> n.s")).select(
        F.col("l.s").alias("s"), F.col(b).alias("bin"), "x", upto.alias("upto"), "need")
    # the last bin that begins before the need is met
    hit = run.where(F.col("upto") - F.col("x") < F.col("need")).groupBy("s").agg(F.max_by(
        F.struct("bin", (F.col("need") - F.col("upto") + F.col("x")).alias("need")), "bin").alias("k"))
    return hit.select("s", F.col("k.bin").cast("long").alias("bin"), F.col("k.need").alias("need"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights=WEIGHTS,
        share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` of the source, and `copies` (0 to `most`) that the mix takes.

    Columns of those names are replaced.  Null and empty texts have size 0 and
    no copies matter.  Equal keys with equal texts are drawn together; ties in
    rank go by hash.  Sources may be null: they are one source, placed last.
    An empty table gives an empty mix.  Results depend on rows and seed alone.
    """
    sized = sizes(docs, source, text, key, seed)
    small = stored(sized.select("__mx_source", "__mx_size", "__mx_hash", "__mx_pref", "__mx_u"), "sizes")
    per_source = stored(plan(small, weights, share, most), "plan")
    per_source = per_source.select(*(F.col(c).alias(f"__mx_p_{c}") for c in per_source.columns))
    out = sized.join(per_source, F.expr("__mx_source <=> __mx_p_s"), "left")
    out = _drawn(out, F.col("__mx_p_c"), most)
    y, h, cut = F.col("__mx_y"), F.col("__mx_hash"), F.col("__mx_p_cut_y")
    drawn = (y < 1) & ((y < cut) | ((y == cut) & (h <= F.col("__mx_p_cut_hash"))))
    out = out.withColumns({
        "size": F.col("__mx_size"), "source_size": F.col("__mx_p_source_size"), "target": F.col("__mx_p_target"),
        "copies": (F.col("__mx_whole") + F.when(drawn, 1).otherwise(0)).cast("int"),
    })
    return out.drop(*(c for c in out.columns if c.startswith("__mx_")))


def op9(spark, sf_dir: str) -> DataFrame:
    from joblattice.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
