"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that can be the last
of the prefix's encoding: the one that stays apart from the last token before
it.  Storing that token per prefix makes appending exact (the table only grows)
and lets an edit be encoded again from the piece it touches to the first piece
boundary that is as before.  Whether two tokens stay apart follows from the
order in which merges happen along their touching edges.

Vocabulary files are read where a task runs; their path is a parameter and must
be readable on all executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.llm.common import in_small_batches, release
from joblattice.llm.stretches import KEPT, Recent, Stretches

_NEVER = 1 << 40


class Vocabulary:
    """Tokens by rank, and which tokens stay apart when one follows the other."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self._lengths = sorted(set(map(len, self.ranks)), key=lambda n: (abs(n - 3.4), n))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict[int, tuple[int, ...]], ...] = ({}, {})
        self._apart: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or for a token that merging never reaches."""
        if token not in self._parts:
            row = [self.ranks.get(bytes([b]), _NEVER) for b in self.tokens[token]]
            while len(row) > 2:
                merged = [self._merged(a, b) for a, b in zip(row, row[1:])]
                k = min(range(len(merged)), key=merged.__getitem__)
                if merged[k] >= token:
                    break
                row[k:k + 2] = [merged[k]]
            made = len(row) == 2 and self._merged(*row) == token
            self._parts[token] = (row[0], row[1]) if made else None
        return self._parts[token]

    def _merged(self, a: int, b: int) -> int:
        return _NEVER if _NEVER in (a, b) else self.ranks.get(self.tokens[a] + self.tokens[b], _NEVER)

    def reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.parts(token) is not None

    def _edge(self, token: int, side: int) -> tuple[int, ...]:
        """The tokens that stand at the token's left (0) or right (1) edge while it is made, first to last."""
        known = self._edges[side]
        if token not in known:
            pair = self.parts(token)
            known[token] = (*self._edge(pair[side], side), token) if pair else (token,)
        return known[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a, then b, gives just [a, b]."""
        key = a << 24 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > KEPT:
                self._apart.clear()
            known = self._apart[key] = self.reached(b) and self._stay_apart(self._edge(a, 1), self._edge(b, 0))
        return known

    def _stay_apart(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self._merged(left[i], right[j])
            # of equal merges the leftmost goes first: the left token's own, then the one across
            if across < next_left and across <= next_right:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix of the piece, the last token of its encoding; `known` holds those of the first prefixes."""
        last = known or []
        get, apart = self.ranks.get, self._apart.get
        for end in range(len(last) + 1, len(piece) + 1):
            for length in self._lengths:  # one token only passes, so usual lengths go first
                start = end - length
                if start < 0 or (token := get(piece[start:end])) is None:
                    continue
                if start:
                    ok = apart(last[start - 1] << 24 | token)
                    if ok is None:
                        ok = self.apart(last[start - 1], token)
                else:
                    ok = self.reached(token)
                if ok:
                    last.append(token)
                    break
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece from its table of last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None and self.reached(whole) else self.read_back(self.last_tokens(piece))


class Incremental:
    """A text with its encoding, kept exact under appends and edits.

    Holds the pieces and each piece's table of last tokens.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, splitter(pattern)
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.vocabulary.read_back(t)]

    def append(self, more: str) -> None:
        n = sum(map(len, self.pieces))
        self.replace(n, n, more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts `new` for the characters from start to end; returns how many pieces were split or encoded again.

        Starts two pieces before the edit, as a piece's end depends on what
        follows its white space, and stops at the first old boundary behind the
        edit from which two pieces come out as they were.
        """
        at, first = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) <= start:
            at += len(self.pieces[first])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                at -= len(self.pieces[first])
        text = self.text
        tail = text[end:]
        text = text[at:start] + new + tail
        settled = len(text) - len(tail)
        old: dict[int, int] = {}  # distance from the text's end to the index of the piece that begins there
        left = 0
        for k in range(len(self.pieces) - 1, first - 1, -1):
            left += len(self.pieces[k])
            old[left] = k
        pieces: list[str] = []
        keep = len(self.pieces)
        same = 0
        for m in self.pattern.finditer(text):
            k = old.get(len(text) - m.start()) if m.start() >= settled else None
            same = same + 1 if k is not None and self.pieces[k] == m[0] else 0
            pieces.append(m[0])
            if same == 2:
                keep = k + 1
                break
        before = self.tables[first:first + 1]
        tables = []
        for n, p in enumerate(pieces):
            raw, known = p.encode(), None
            if n == 0 and before and raw.startswith(was := self.pieces[first].encode()):
                known = list(before[0][:len(was)])  # grown only: its prefixes keep their tokens
            tables.append(self.vocabulary.last_tokens(raw, known))
        self.pieces[first:keep], self.tables[first:keep] = pieces, tables
        return len(pieces)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = vocabulary(path), splitter(pattern)
        self._pack = [i.to_bytes(4, "little") for i in range(len(self.vocabulary.tokens))]
        self._pieces = Recent(self._encode_pieces, KEPT // 3)  # most are stretches, which are kept as such
        self.encode = Stretches(self._stretches)

    def _stretches(self, texts: list[str]) -> list[bytes]:
        return self._pieces.joined([self.split.findall(t) for t in texts])

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """In byte order, as each piece's table begins with that of the bytes it shares with the one before."""
        vocab, pack = self.vocabulary, self._pack
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        before, table = b"", []
        for k in sorted(range(len(raw)), key=raw.__getitem__):
            piece = raw[k]
            shared = next((i for i, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))
            before, table = piece, vocab.last_tokens(piece, table[:shared])
            out[k] = b"".join(map(pack.__getitem__, vocab.read_back(table)))
        return out

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


def portions(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that what is made of it is never held whole."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None,
           round_trip: str | None = None) -> DataFrame:
    """The columns `keep` (default: all) and the ids of each whole text, as packed 32-bit integers, in `out`.

    `round_trip` names a further column that tells whether decoding the ids gives the text's bytes back.

    Null and empty texts give no ids; a column named like `out` is replaced.
    Repeated rows stay; an empty table gives an empty one.  No special tokens.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in (out, round_trip)]
    fields = [df.schema[c] for c in names]
    source = in_small_batches(df).select(*names, F.col(text).alias("__bpe_text"))
    made = [T.StructField(out, T.BinaryType())] + [T.StructField(c, T.BooleanType()) for c in (round_trip,) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern)
        for whole in batches:
            for b in portions(whole):
                texts = b.column(len(names)).fill_null("")
                ids = one.encode(texts)
                columns = [pa.array(ids, pa.binary())]
                if round_trip:
                    raw = texts.cast(pa.binary())
                    columns.append(pa.array([decoded(one.vocabulary.tokens, x) == t.as_py() for x, t in zip(ids, raw)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*names, *(f.name for f in made)])
        release()

    return source.mapInArrow(run, T.StructType([*fields, *made]))


def decoded(tokens: list[bytes], packed: bytes | None) -> bytes | None:
    """The bytes that packed ids stand for; None for null, or ids outside the vocabulary."""
    if packed is None:
        return None
    try:
        return b"".join(map(tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
    except (IndexError, ValueError):
        return None


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) and the bytes that packed ids stand for, in `out`.

    Null ids give null; ids outside the vocabulary too.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    fields = [df.schema[c] for c in names]
    source = df.select(*names, F.col(ids).alias("__bpe_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(path).tokens
        for whole in batches:
            for b in portions(whole):
                raw = pa.array((decoded(tokens, x.as_py()) for x in b.column(len(names))), pa.binary(), size=b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], raw], [*names, out])

    return source.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: tokens, and digests of ids and of the decoded bytes."""
    ids = encode(docs, path, pattern, keep=["doc_id"])
    both = decode(ids.withColumns({"n_tokens": (F.length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)}), path,
                  keep=["doc_id", "n_tokens", "ids_sha256"])
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from joblattice.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
