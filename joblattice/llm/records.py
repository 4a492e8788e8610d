"""Token ids in length-delimited binary records, with an offset index beside them.

A shard is a sequence of records: length (8 bytes, little-endian), masked
CRC-32C of those bytes (4), payload, masked CRC-32C of the payload (4), the
framing that TFRecord readers know.  A payload is a flag byte and the 8-byte
document id (flag 0: no id), then the ids as unsigned integers of 2 or 4 bytes,
the width that the vocabulary needs (flag bit 1: 4 bytes).  The index, a Parquet
table with a row per record, tells shard, offset, length and tokens, so records
can be read in any order.

Shards hold document ids in ascending order, null first, and so do shards in
turn.  Each task writes its shard under a name of its own attempt and moves it
into place whole, so a task that runs again leaves the same bytes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from joblattice.llm.stretches import Stretches

#: Fixed values of the record format: the reflected CRC-32C polynomial and the constant of the mask.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
END_ID = 0
_LANE = 256
_READ = 8 << 20


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after two bytes, by the state's low 16 bits; and what a lane of zeros makes of each byte of a state."""
    state = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(POLYNOMIAL), state >> 1).astype(np.uint32)
    shift = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_LANE // 2):
        shift = state[shift & 0xFFFF] ^ (shift >> 16)
    return state, shift


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer; all lanes of all buffers advance together, then lanes join from left to right.

    Zeros before a message do not change a CRC that starts from zero, so buffers
    are filled up in front; starting from ones instead inverts the first four bytes.
    """
    pairs, shift = _crc_tables()
    sizes = np.array([max(4, len(b)) for b in buffers], dtype=np.int64)
    lanes = -(-sizes // _LANE)
    ends = np.cumsum(lanes * _LANE)
    flat = np.frombuffer(bytearray(b"".join(x for b, n, k in zip(buffers, sizes, lanes) for x in (bytes(k * _LANE - len(b)), b))), np.uint8)
    first = ends - sizes
    short = [i for i, b in enumerate(buffers) if len(b) < 4]
    for d in range(4):
        flat[first + d] ^= 0xFF
    words = flat.view("<u2").reshape(-1, _LANE // 2)
    state = np.zeros(len(words), np.uint32)
    for column in np.ascontiguousarray(words.T):
        state = pairs[(state ^ column) & 0xFFFF] ^ (state >> 16)
    order = np.argsort(-lanes, kind="stable")
    start, left = (np.cumsum(lanes) - lanes)[order], lanes[order]
    out = np.zeros(len(buffers), np.uint32)
    for k in range(int(lanes.max(initial=0))):
        n = int(np.searchsorted(-left, -k))  # buffers with more than k lanes
        x = out[:n]
        out[:n] = shift[0][x & 255] ^ shift[1][(x >> 8) & 255] ^ shift[2][(x >> 16) & 255] ^ shift[3][x >> 24] ^ state[start[:n] + k]
    back = np.empty_like(out)
    back[order] = ~out
    for i in short:
        back[i] = _crc_of_few(buffers[i])
    return back


def _crc_of_few(b: bytes) -> int:
    state = 0xFFFFFFFF
    for byte in b:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + x.tobytes() + p + y.tobytes() for n, x, p, y in zip(lengths, a, payloads, b)]


def unframe(data: bytes, lengths: list[int]) -> list[bytes]:
    """Payloads of records of the given whole lengths, one after the other; raises if a checksum or length is wrong."""
    heads, payloads, sums, at = [], [], [], 0
    for n in lengths:
        heads.append(data[at:at + 8])
        payloads.append(data[at + 12:at + n - 4])
        sums.append(data[at + 8:at + 12] + data[at + n - 4:at + n])
        at += n
    found = np.frombuffer(b"".join(sums), "<u4").reshape(-1, 2)
    wrong = (masked(crc32c(heads)) != found[:, 0]) | (masked(crc32c(payloads)) != found[:, 1])
    wrong |= np.frombuffer(b"".join(heads), "<u8") != np.array([len(p) for p in payloads], dtype=np.uint64)
    if wrong.any():
        raise ValueError(f"record {int(wrong.argmax())} of {len(lengths)} is damaged")
    return payloads


@lru_cache(maxsize=2)
def _tokenizer(path: str, dtype: str) -> Stretches:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = None  # it only mends offsets, which nobody asks for
    tokenizer.model._resize_cache(0)  # each stretch comes once; those that come again are kept here

    def encode(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Stretches(encode, 700_000)


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


#: `before`: tokens of the shard's records before this one.
INDEX = "shard string, offset long, length long, before long, n_tokens long, doc_id long"


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes whole texts, appends `end_id` to each, writes shards and their index; returns the index.

    Null and empty texts have just the end id.  Null keys come first; equal keys
    are in the order of a hash of their texts; repeated rows are records each.  An empty
    table writes an empty index.  The folder must be new and shared by all
    executors, and the tokenizer's path readable on each of them.
    """
    dtype = _width(tokenizer)
    wide = 2 * (dtype == "<u4")
    end = np.array([end_id], dtype).tobytes()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    place = [F.col("k").asc_nulls_first(), F.xxhash64("t")]  # the hash parts equal keys, and keeps texts out of the sample
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}.rec"
        store, base = pafs.FileSystem.from_uri(f"{folder}/shards")
        encode = _tokenizer(tokenizer, dtype)
        out, at, n, mine = None, 0, 0, f"{base}/_{name}.{task.taskAttemptId()}"
        for b in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(mine)
            for lo, hi in _portions(b.column(1)):
                keys = b.column(0).slice(lo, hi - lo).to_pylist()
                ids = [x + end for x in encode(b.column(1).slice(lo, hi - lo))]
                records = frame([struct.pack("<Bq", wide | (k is not None), k or 0) + x for k, x in zip(keys, ids)])
                lengths = np.array([len(r) for r in records], np.int64)
                out.write(b"".join(records))
                offsets = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                counts = np.array([len(x) for x in ids], np.int64) // len(end)
                before = n + np.cumsum(counts) - counts
                n += int(counts.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(keys), pa.string()), pa.array(offsets), pa.array(lengths), pa.array(before), pa.array(counts),
                    pa.array(keys, pa.int64())], ["shard", "offset", "length", "before", "n_tokens", "doc_id"])
        if out is not None:
            out.close()
            if store.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
                store.delete_file(f"{base}/{name}")  # of an attempt that was lost after its end; the same bytes
            store.move(mine, f"{base}/{name}")

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return index(docs.sparkSession, folder)


def _portions(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about `most` bytes of text."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index_rows: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name, in the order given: doc_id and packed 32-bit ids, checked.

    Also passes on shard, offset and before.  Neighbouring records are read together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(f"{folder}/shards")
        shard, file = None, None
        for b in batches:
            names, offsets, lengths = (b.column(k).to_pylist() for k in range(3))
            for lo, hi in _runs(names, offsets, lengths):
                if names[lo] != shard:
                    shard, file = names[lo], store.open_input_file(f"{base}/{names[lo]}")
                data = file.read_at(offsets[hi - 1] + lengths[hi - 1] - offsets[lo], offsets[lo])
                keys, ids = [], []
                for p in unframe(data, lengths[lo:hi]):
                    flag, key = struct.unpack_from("<Bq", p)
                    keys.append(key if flag & 1 else None)
                    ids.append(p[9:] if flag & 2 else np.frombuffer(p, "<u2", offset=9).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([
                    *(b.column(k).slice(lo, hi - lo) for k in (0, 1, 3)), pa.array(keys, pa.int64()), pa.array(ids, pa.binary()),
                ], ["shard", "offset", "before", "doc_id", "ids"])

    return index_rows.select("shard", "offset", "length", "before").mapInArrow(
        run, "shard string, offset long, before long, doc_id long, ids binary")


def _runs(names: list, offsets: list, lengths: list) -> Iterator[tuple[int, int]]:
    """Stretches of rows that lie one after the other in one shard, of `_READ` bytes at most (but one record)."""
    lo = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[lo] or offsets[i] != offsets[i - 1] + lengths[i - 1] or offsets[i] + lengths[i] - offsets[lo] > _READ:
            yield lo, i
            lo = i


def bases(index_rows: DataFrame) -> DataFrame:
    """Per shard: `base`, the tokens of all shards before it.  The running sum is over one row per shard."""
    totals = index_rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "base")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from joblattice.llm.common import scratch, stored, table

    folder = scratch(spark, "records")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    digests = read(rows, folder).select(
        "shard", "before", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return digests.join(stored(bases(rows), "bases"), "shard").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
