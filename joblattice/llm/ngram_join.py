"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles.  The space of shingle
hashes is cut into as many buckets as the largest set of a size band; a
bucket's parity is the XOR of the hashes in it, and the parities are the
document's sketch.  Every shingle that only one of two sets has changes one
bucket, so the number of buckets that differ bounds the symmetric difference
from below: with a Jaccard similarity of 0.75 it is at most a seventh of both
sizes together, and by the pigeonhole principle the other filled buckets agree.
Documents meet where a bucket and its parity agree, and are then verified on
whole sets.

Sketches travel packed, a row per batch of documents and range of keys.  Where
up to `GROUP` sets meet, all their pairs are candidates.  Where more meet (large
groups of copies, passages that many documents share), each is compared with
the smallest and the middle set only, and two sets are let off if their other keys must bring
them together should they be similar: a set of which too many keys are common
takes part in a second round, in which what the links so far have not put into
one component is compared.  There, keys with the same members are one key, and
each set brings the parities of its shingles as a row of bits: the bits in which
two such rows differ bound the symmetric difference from below, so that of the
many pairs at a crowded key only those that may be similar become rows.  Equal
sets are one set throughout.

Exact up to coincidences of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joblattice.llm.common import in_small_batches, release, stored, table

WORDS = 5
#: Sets below this size have a bucket for each shingle; above, bands grow by a factor of four.
SMALL = 256
#: Sets that may meet at a key to be paired with each other.
GROUP = 16
#: Keys in a range, and documents in a packed row.
RANGE, PACK = 1_000_000, 8192
#: Most bits of a set's row of parities in the second round.
BITS = 2048
#: Keys before each that a set brings along there, so that a pair that met just before is no row again.
BEFORE = 8
_U64 = np.uint64
_KEY = _U64((1 << 40) - 1)
_STEP = _U64(0x9E3779B97F4A7C15)
#: Texts that are cut into shingles at once.
AT_ONCE = 256


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes spread again (the finaliser of a common 64-bit mixer)."""
    with np.errstate(over="ignore"):
        x = x + _U64(salt) * _STEP
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; remembers words' hashes, up to a bound."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self._words: dict[bytes, int] = {}  # a word's place among the hashes
        self._hashes = np.zeros(0, _U64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """A-Z in lower case, words between ASCII white space; fewer words than n make one shingle.

        Word hashes of all texts lie in one array and are combined at once; windows that reach into the next text go.
        """
        words = [t.lower().split() for t in texts]
        known = self._words
        if len(known) > 300_000:
            known.clear()
            self._hashes = self._hashes[:0]
        new = list({w for text in words for w in text if w not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._hashes = np.r_[self._hashes, np.array(list(map(xxhash.xxh3_64_intdigest, new)), _U64)]
        count = np.array([len(w) for w in words], np.int64)
        h = self._hashes[np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))]
        end = np.cumsum(count)
        size = np.minimum(count, self.n)
        h = np.r_[h, np.zeros(self.n, _U64)]
        with np.errstate(over="ignore"):
            full = h[:len(h) - self.n + 1]
            for d in range(1, self.n):
                full = full * _STEP + h[d:len(h) - self.n + 1 + d]
        full = mixed(full, self.n)
        out = []
        for a, b, n in zip((end - count).tolist(), end.tolist(), size.tolist()):
            if n == self.n:
                out.append(np.unique(full[a:b - n + 1]))
            else:  # the whole sequence as one, told apart by its length
                out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), n + 1)] if n else [], _U64))
        return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each whole set."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = mixed(np.concatenate([*sets, np.zeros(1, _U64)]), 101)
    sums = np.r_[_U64(0), np.cumsum(flat, dtype=_U64)]
    end = np.cumsum(size)
    with np.errstate(over="ignore"):
        return mixed(sums[end] - sums[end - size] + size.astype(_U64), 7).astype(np.int64)


def linked(a: int, b: int, common: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def differing(n: int) -> int:
    """The largest symmetric difference of a set of n with any similar set."""
    return (n + 4 * n // 3) // 7


def spare(n: int) -> int:
    """Keys taken beyond those that may all differ; similar sets agree on as many at least. Never falls as n grows."""
    return max(1, n // 8 if n < 512 else max(64, n // 16))


def level(n: int) -> int:
    """0 below SMALL, then one more for each factor of four."""
    out = 0
    while n >= SMALL << 2 * out:
        out += 1
    return out


def keys(shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The set's keys on each level on which it may meet similar sets: its own, and the one below if such a set may be there.

    On level 0 each shingle is a bucket, and all are keys.  Above, as many keys
    as may all differ and some to spare are taken in an order that all share.
    """
    n = len(shingles)
    out = []
    for lev in {level(n), level(-(-3 * n // 4))}:
        if lev == 0:
            out.append((0, mixed(shingles, 11)))
            continue
        bits = (SMALL.bit_length() - 1) + 2 * lev
        bucket = shingles >> _U64(64 - bits)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        parity = np.bitwise_xor.reduceat(mixed(shingles, 13), first)
        k = np.sort(mixed(parity ^ mixed(bucket[first], 17 + lev), 19))
        out.append((lev, mixed(k[:differing(n) + spare(n)], 23)))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts in portions, with the place where each begins."""
    for lo in range(0, len(column), AT_ONCE):
        yield lo, [t or b"" for t in column.slice(lo, AT_ONCE).cast(pa.binary()).to_pylist()]


def sets(docs: DataFrame, key: str, text: str, blob: bool = False) -> DataFrame:
    """(id, n, set) and with `blob` the sorted shingle hashes, packed."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            for lo, texts in _texts(b.column(1)):
                found = shingle(texts)
                out = [b.column(0).slice(lo, len(texts)), pa.array([len(s) for s in found], pa.int64()), pa.array(set_ids(found))]
                if blob:
                    out.append(pa.array([s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["id", "n", "set", "shingles"][:len(out)])
        del shingle
        release()

    return rows.mapInArrow(run, "id long, n long, set long" + ", shingles binary" * blob)


def packed_keys(docs: DataFrame, text: str, ranges: int) -> DataFrame:
    """Per range of keys and batch of documents: the sets (ids, sizes), and keys of 40 bits with level and place of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        ids: list[int] = []
        sizes: list[int] = []
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, int, int]] = []

        def packed() -> pa.RecordBatch:
            k = np.concatenate([p[0] for p in parts])
            each = [len(p[0]) for p in parts]
            owner = np.repeat(np.array([p[2] for p in parts], np.uint16), each)
            lev = np.repeat(np.array([p[1] for p in parts], np.uint8), each)
            parts.clear()
            r = ((k >> _U64(40)) % _U64(ranges)).astype(np.uint32)
            order = np.argsort(r, kind="stable")
            k, owner, lev, r = k[order] & _KEY, owner[order], lev[order], r[order]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            rows = []
            all_ids, all_sizes = np.array(ids, np.int64), np.array(sizes, np.int32)
            for a, b in zip(cut, np.r_[cut[1:], len(r)]):
                used, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(r[a]), all_ids[used].tobytes(), all_sizes[used].tobytes(),
                             k[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), lev[a:b].tobytes() if lev[a:b].any() else b"",
                             local.astype(np.uint16).tobytes()))
            ids.clear(), sizes.clear(), seen.clear()
            kinds = (pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["r", "ids", "sizes", "keys", "levels", "owners"])

        n = 0
        for b in batches:
            for _, texts in _texts(b.column(0)):
                found = shingle(texts)
                for s, i in zip(found, set_ids(found).tolist()):
                    if not len(s) or i in seen:
                        continue
                    seen.add(i)
                    for lev, k in keys(s):
                        parts.append((k, lev, len(ids)))
                        n += len(k)
                    ids.append(i)
                    sizes.append(len(s))
                    if len(ids) == PACK or n >= 2 * RANGE:
                        yield packed()
                        n = 0
        if parts:
            yield packed()
        del shingle
        release()

    return docs.select(text).mapInArrow(run, "r int, ids binary, sizes binary, keys binary, levels binary, owners binary")


#: `c`: keys at which a pair met, but for common ones.
MEETINGS = "kind int, a long, b long, na int, nb int, level int, c int"
#: Kinds of rows: a candidate pair; a set (a) at a common key (b).
PAIR, COMMON = 0, 1


def meetings(packed: DataFrame) -> DataFrame:
    """Candidate pairs where few sets meet, pairs with the smallest set where many do, and who met there."""

    def meet(rows: pa.Table) -> pa.Table:
        release()  # of the group before
        n_in = [len(x) // 2 for x in rows["owners"].to_pylist()]
        key = np.zeros((sum(n_in), 8), np.uint8)
        key[:, :5] = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint8).reshape(-1, 5)
        k = key.view("<u8").ravel()
        lev = np.concatenate([np.frombuffer(x, np.uint8) if x else np.zeros(n, np.uint8) for x, n in zip(rows["levels"].to_pylist(), n_in)])
        ids = [np.frombuffer(x, "<i8") for x in rows["ids"].to_pylist()]
        sizes = [np.frombuffer(x, "<i4") for x in rows["sizes"].to_pylist()]
        owners = [np.frombuffer(x, "<u2") for x in rows["owners"].to_pylist()]
        sid = np.concatenate([i[o] for i, o in zip(ids, owners)])
        size = np.concatenate([s[o] for s, o in zip(sizes, owners)])
        k = k | lev.astype(_U64) << _U64(40)
        # what stands alone goes before the sort by more than the key
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        k, sid, size = k[order], sid[order], size[order]
        order = np.lexsort((sid, size, k))
        k, sid, size = k[order], sid[order], size[order]
        once = np.r_[True, (k[1:] != k[:-1]) | (sid[1:] != sid[:-1])] if len(k) else np.zeros(0, bool)
        k, sid, size = k[once], sid[once], size[once]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        count = np.diff(np.r_[start, len(k)])
        found: list[np.ndarray] = []
        for g in range(2, GROUP + 1):
            at = start[count == g]
            for i, j in combinations(range(g), 2) if len(at) else ():
                found.append(np.stack([at + i, at + j], 1))
        many = count > GROUP
        hub, members = np.repeat(start[many], count[many]), _spans(start[many], count[many])
        n_few = sum(map(len, found))
        found.append(np.stack([hub, members], 1)[hub != members])
        middle = np.repeat((start + count // 2)[many], count[many])
        found.append(np.stack([np.minimum(middle, members), np.maximum(middle, members)], 1)[(middle != members) & (hub != members)])
        pair = np.concatenate(found)
        c = (np.arange(len(pair)) < n_few).astype(np.int32)
        na, nb = size[pair[:, 0]].astype(np.int64), size[pair[:, 1]].astype(np.int64)
        near = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
        pair, c = pair[near], c[near]
        level_of = (k >> _U64(40)).astype(np.int32)
        order = np.lexsort((level_of[pair[:, 0]], sid[pair[:, 1]], sid[pair[:, 0]]))  # the first is the smaller by size, then id
        pair, c = pair[order], c[order]
        a, b, at = sid[pair[:, 0]], sid[pair[:, 1]], level_of[pair[:, 0]]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (at[1:] != at[:-1])]) if len(a) else np.zeros(0, int)
        c = np.add.reduceat(c, first) if len(first) else c
        pair = pair[first]
        r = int(rows["r"][0].as_py()) if len(rows) else 0
        common = (k[members] | _U64(r) << _U64(44)).astype(np.int64)
        none = np.zeros(len(members), np.int32)
        return pa.table({
            "kind": np.r_[np.full(len(pair), PAIR, np.int32), np.full(len(members), COMMON, np.int32)],
            "a": np.r_[sid[pair[:, 0]], sid[members]], "b": np.r_[sid[pair[:, 1]], common],
            "na": np.r_[size[pair[:, 0]], size[members]].astype(np.int32), "nb": np.r_[size[pair[:, 1]], none].astype(np.int32),
            "level": np.r_[level_of[pair[:, 0]], level_of[members]].astype(np.int32), "c": np.r_[c, none].astype(np.int32)})

    return packed.groupBy("r").applyInArrow(meet, MEETINGS)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def possible(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, c) that meet at enough keys to be similar, if all common keys of the poorer one count as shared."""
    pairs = met.where(F.col("kind") == PAIR).groupBy("a", "b", "na", "nb", "level").agg(F.sum("c").alias("c"))
    common = met.where(F.col("kind") == COMMON).groupBy("a", "level").agg(F.count(F.lit(1)).alias("k"))
    common = stored(common, "common")
    pairs = pairs.join(common.withColumnRenamed("k", "ka"), ["a", "level"], "left").join(
        common.select(F.col("a").alias("b"), "level", F.col("k").alias("kb")), ["b", "level"], "left")
    shared = F.col("c") + F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    return pairs.where(shared >= _needed("level", F.col("na"), F.col("nb"))).groupBy("a", "b").agg(F.max("c").alias("c"))


def _needed(level: str, na, nb):
    """Keys that similar sets of these sizes share at least."""
    return F.when(F.col(level) == 0, F.ceil((na + nb) * 3 / 7)).otherwise(_spare(F.least(na, nb)))


def shingle_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """(set, shingles) of the sets wanted, 48 bits of each hash; each text is read once, from its first document."""
    first = wanted.distinct().join(reps, "set").select(F.col("rep").alias("__nj_rep"))
    texts = docs.select(key, text).join(first, F.col(key) == F.col("__nj_rep"), "leftsemi")
    return stored(sets(texts, key, text, blob=True).select("set", "shingles").dropDuplicates(["set"]), "shingles")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of distinct (a, b) those that are similar, by their whole sets."""
    both = pairs.select("a", "b").join(held.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(
        held.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                z = np.sort(np.concatenate([x, y]))
                keep.append(linked(len(x), len(y), int((z[1:] == z[:-1]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(set, component) of all sets in links (a, b): the smallest set id that links reach.

    Alternates between hanging larger neighbours and smaller ones on each set's
    smallest neighbour until nothing moves; each step is an aggregation and a
    join, which adaptive execution splits where a set has very many links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        way = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = way.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = way.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("set"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("set"), F.col("v").alias("component"))).distinct()
        before = now


def mostly_common(met: DataFrame) -> DataFrame:
    """(b: key, a: set, na, level, k: the set's common keys, before) of sets whose other keys need not bring similar sets to them.

    As such sets must share many of their common keys, the rarest few of each
    are enough for two of them to meet, in an order that all follow.  Keys with
    the same members stand together in that order and come out as one, a hash of
    the members; should two lists of members share a hash, more sets meet.
    `before` holds the set's keys that come just before this one: two sets that
    have one of them in common meet there already.
    """
    common = met.where(F.col("kind") == COMMON).select("a", "b", "na", "level")
    members = F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "level")), F.bit_xor(F.xxhash64("level", "a")))
    common = common.join(common.groupBy("b").agg(F.count(F.lit(1)).alias("size"), members.alias("members")), "b")
    mine = Window.partitionBy("a", "level")
    ordered = mine.orderBy("size", "members", "b")
    least = F.ceil(F.col("na") * 0.75)
    least = F.when(F.col("level") == 0, least).otherwise(_spare(least))
    first = common.withColumns({
        "k": F.count(F.lit(1)).over(mine), "at": F.row_number().over(ordered), "last": F.lag("members").over(ordered),
    }).where((F.col("k") >= least) & (F.col("at") <= F.col("k") - least + 1) & ~F.col("members").eqNullSafe(F.col("last")))
    before = F.collect_list("members").over(mine.orderBy("size", "members").rowsBetween(-BEFORE, -1))
    return first.select(F.col("members").alias("b"), "a", "na", "level", "k", before.alias("before"))


def parities(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, level, p0 .. ): per set and level asked for a row of bits; each hash of the set turns one of them.

    A hash that only one of two sets has turns one bit of the difference, so as
    many bits as differ, hashes differ at least.  Rows are longer on higher
    levels, up to `BITS`; unused bits are 0.  Sets much larger than that differ
    in too few bits to be told apart, which only makes more rows.
    """
    names = [f"p{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpacked(x.as_py()) for x in batch.column(2)]
            width = np.minimum(BITS, 512 << np.minimum(batch.column(1).to_numpy(), 16).astype(np.int64)).astype(_U64)
            each = [len(s) for s in found]
            bit = (np.concatenate([*found, np.zeros(0, _U64)]) % np.repeat(width, each)).astype(np.int64)
            owner = np.repeat(np.arange(len(found)), each)
            odd = (np.bincount(owner * BITS + bit, minlength=len(found) * BITS) & 1).astype(np.uint8)
            rows = np.packbits(odd).view("<i8").reshape(len(found), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in rows.T.copy()]], ["a", "level", *names])
        release()

    texts = asked.join(held.withColumnRenamed("set", "a"), "a").select("a", "level", "shingles")
    return texts.mapInArrow(run, "a long, level int, " + ", ".join(f"{n} long" for n in names))


def _unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def second_round(common: DataFrame, so_far: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) that only common keys could bring together and that are not in one component yet.

    Of the sets at a common key those of its largest component are compared with
    the others, not with each other, and only pairs whose parities differ in no
    more bits than similar sets have different hashes become rows, at the first
    of each run of keys that they share.
    """
    left = stored(common.join(so_far.select(F.col("set").alias("a"), "component"), "a", "left").select(
        "b", "a", "na", "k", "level", "before", F.coalesce("component", "a").alias("c")), "common")
    sizes = left.groupBy("b", "c").count()
    main = sizes.groupBy("b").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    left = left.join(main, "b")
    bits = [f"p{i}" for i in range(BITS // 64)]
    rows = stored(parities(held, common.select("a", "level").distinct()), "parities")
    left = stored(left.join(rows, ["a", "level"]), "common")
    x, y = left.where("c <> main").alias("x"), left.alias("y")
    met = x.join(y, F.expr("x.b = y.b and x.c <> y.c and (y.c = y.main or x.a < y.a)"))
    enough = F.least("x.k", "y.k") >= _needed("x.level", F.col("x.na"), F.col("y.na"))
    near = 4 * F.least("x.na", "y.na") >= 3 * F.greatest("x.na", "y.na")
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in bits])
    alike = 7 * differ <= F.col("x.na") + F.col("y.na")
    # a lambda keeps the condition out of the join's one long method, which would be too long to be compiled
    first = ~F.exists("x.before", lambda k: F.array_contains("y.before", k))
    return met.where(enough & near & alike & first).select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def _spare(n):
    return F.greatest(F.lit(1), F.when(n < 512, F.floor(n / 8)).otherwise(F.greatest(F.lit(64), F.floor(n / 16))))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): per row of docs the size of its set and the smallest id that links reach.

    Null and empty texts, and texts without words, have an empty set, link with
    nothing and are their own component.  Null ids are rows with a null
    component unless a document with an id has the same or a similar set.
    Repeated rows stay.
    """
    docs = in_small_batches(docs)
    all_sets = stored(sets(docs, key, text), "sets")
    total = all_sets.agg(F.sum("n")).first()[0] or 0
    reps = stored(all_sets.where("n > 0").groupBy("set").agg(F.min("id").alias("rep")), "first")
    met = stored(meetings(packed_keys(docs, text, max(8, -(-total // RANGE)))), "meetings")
    pairs = stored(possible(met), "pairs")
    common = stored(mostly_common(met), "common")
    held = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("set")).union(common.select("a")), docs, reps, key, text)
    links = stored(verified(pairs, held), "links")
    so_far = stored(components(links), "components")
    more = second_round(common, so_far, held).join(pairs, ["a", "b"], "leftanti")
    more = stored(verified(stored(more, "pairs"), held), "links")
    if more.limit(1).count():
        so_far = stored(components(links.union(more)), "components")
    named = reps.join(so_far, "set", "left").withColumn("component", F.coalesce("component", "set"))
    first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = named.join(first, "component").select("set", "component_id")
    out = all_sets.where("n > 0").join(by_set, "set").select("id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(all_sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join(docs).withColumnRenamed("id", "doc_id")
