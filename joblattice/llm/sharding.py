"""Proportional stratified interleaving of documents into shards.

Rows of each source are ordered by a seeded hash; a row's fractional rank is
its place among its source's rows over their number, moved by an offset of the
source's own so that small sources do not all meet at one place.  Sorting by
fractional rank deals every source evenly over the whole order, and cutting
that order into equal runs gives shards of equal counts that each hold every
source's share, to within one row and a fraction.

No window spans a source or the whole order.  Both orders are by values spread
evenly over [0, 1), so rows are numbered within buckets of bounded size, and a
bucket starts where the counts of the buckets before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblattice.llm.common import stored, table, whole_text

#: Rows of a bucket, about.
BUCKET = 20_000
#: Bits of a hash that order rows.
BITS = 52


def _unit(text: Column) -> Column:
    """A number of [0, 1) from a text: the first 13 hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(2**BITS))


def _numbered(df: DataFrame, at: str, order: list, n_buckets: int, by: str | None = None, total: str | None = None) -> DataFrame:
    """`df` with `_place`, each row's number from 0 in the order of `at` (in [0, 1)), per `by` if given.

    `total` names a column for the number of rows.  `df` is read twice.
    """
    keys = ["_bucket"] if by is None else [by, "_bucket"]
    dealt = df.withColumn("_bucket", F.floor(F.col(at) * n_buckets).cast("long"))
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    # one row per bucket, not per document
    before = Window.partitionBy(F.col(by) if by else F.lit(1))
    starts = counts.select(*keys, (F.sum("_n").over(before.orderBy("_bucket")) - F.col("_n")).alias("_start"), F.sum("_n").over(before).alias("_all"))
    mine = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = dealt.withColumn("_mine", mine).join(starts, keys)
    return out.select(*df.columns, (F.col("_start") + F.col("_mine")).alias("_place"), *([F.col("_all").alias(total)] if total else []))


def interleave(docs: DataFrame, shards: int = 24, seed: int = 13, key: str = "doc_id", text: str = "text", source: str = "source",
               keep: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """key, source, `keep`, shard and slot (from 0, gapless) of every row.

    Counts of shards differ by at most one, and the shards of a source's rows
    by at most two.  Rows without a source are a source of their own.  Equal
    rows are dealt like others; rows of one key and text are interchangeable,
    so reruns agree.  Equal texts are not kept together.  An empty table gives
    no rows.
    """
    names = [key, source, *keep]
    if {"_source", "_at", "_tie"} & set(names):
        raise ValueError("columns _source, _at and _tie are taken")
    tie = F.md5(whole_text(text))
    row = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), tie)
    narrow = docs.select(
        *names, F.concat(F.when(F.col(source).isNull(), "").otherwise("="), F.coalesce(F.col(source), F.lit(""))).alias("_source"),
        _unit(row).alias("_at"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("_tie"))
    narrow = stored(narrow, "shard-rows")
    rows = narrow.count()
    n_buckets = max(1, -(-rows // bucket))

    ranked = _numbered(narrow, "_at", ["_at", "_tie"], n_buckets, "_source", "_all")
    offset = _unit(F.concat(F.lit(f"{seed}:"), F.col("_source")))
    # below 1, however the division rounds
    spread = ranked.withColumn("_at", F.least((F.col("_place") + offset) / F.col("_all"), F.lit(1 - 2.0**-53))).drop("_place", "_all")
    spread = stored(spread, "shard-ranks")
    placed = _numbered(spread, "_at", ["_at", "_source", "_tie"], n_buckets)
    return placed.withColumn("shard", _run(F.col("_place"), rows, shards).cast("int")).select(
        *names, "shard", (F.col("_place") - _start(F.col("shard"), rows, shards)).cast("long").alias("slot"))


def _start(shard: Column, rows: int, shards: int) -> Column:
    """The place at which a shard starts: the first shards have one row more if the rows do not divide."""
    small, more = divmod(rows, shards)
    return shard.cast("long") * small + F.least(shard.cast("long"), F.lit(more))


def _run(place: Column, rows: int, shards: int) -> Column:
    small, more = divmod(rows, shards)
    long = more * (small + 1)
    tail = F.lit(more) + F.floor((place - long) / F.lit(max(small, 1)))
    return F.when(place < long, F.floor(place / F.lit(small + 1))).otherwise(tail)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 13, key: str = "doc_id", text: str = "text", source: str = "source",
                 rows_per_file: int = 200_000) -> None:
    """All columns of `docs` under `path`/shard=N, in slot order within and across a shard's files.

    Rows meet their places by key, text and source; equal rows take any of theirs.
    """
    places = interleave(docs.withColumn("_text_key", F.xxhash64(key, text, source)), shards, seed, key, text, source, ("_text_key",))
    again = Window.partitionBy("_text_key").orderBy("shard", "slot")
    # these hashes repeat only where rows do
    numbered = places.select("_text_key", "shard", "slot", F.row_number().over(again).alias("_copy"))
    mine = docs.withColumn("_text_key", F.xxhash64(key, text, source))
    mine = mine.withColumn("_copy", F.row_number().over(Window.partitionBy("_text_key").orderBy("_text_key")))
    out = mine.join(numbered, ["_text_key", "_copy"]).drop("_text_key", "_copy")
    files = max(shards, -(-docs.count() // rows_per_file))
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    data = F.encode(whole_text("text"), "UTF-8")
    sized = docs.withColumns({"size": (F.octet_length(data) + 8).cast("long"), "text_crc32": F.crc32(data)})
    out = interleave(sized, keep=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = """
WITH tab AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS v FROM range(256) r(n))),
docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
keyed AS (SELECT doc_id, source, text, CAST('0x' || substr(md5(concat_ws(':', '13', doc_id, md5(text))), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS at_row,
    CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY at_row, coalesce(doc_id, -1)) - 1 AS r, count(*) OVER (PARTITION BY s) AS n,
    CAST('0x' || substr(md5('13:' || s), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS moved FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY least((r + moved) / n, 1 - pow(2.0, -53)), s, coalesce(doc_id, -1)) - 1 AS p, count(*) OVER () AS rows FROM ranked),
cut AS (SELECT *, rows // 24 AS small, rows % 24 AS more FROM placed),
dealt AS (SELECT *, CASE WHEN p < more * (small + 1) THEN p // (small + 1) ELSE more + (p - more * (small + 1)) // greatest(small, 1) END AS shard FROM cut)
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
    CAST(xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295), 4294967295) AS BIGINT) AS text_crc32,
    'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(p - (shard * small + least(shard, more)) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, tab
"""
