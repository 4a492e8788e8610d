"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds follow fixed patterns, each leftmost and without overlap within
its kind; they stay whatever the score.  The method adds spans of more kinds
(and telephone numbers in national form) if their score reaches the threshold:
a format with a valid checksum scores high at once, one without needs a word
that speaks for it close by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.llm.common import table

#: Kinds in the order that breaks ties between spans of one start; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing", "mac", "birth_date")
BASE = KINDS[:4]
THRESHOLD = 0.6
#: Characters before and after a span in which words count as near.
NEAR = 60

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
# A match ends where its last digits end, so the next begins at a digit that follows none.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Further formats and what each is worth by itself, after its checksum if it has one.
_MORE = (
    ("iban", 0.8, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", 0.3, re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")),
    ("routing", 0.2, re.compile(r"(?<![0-9A-Za-z-])[0-9]{9}(?![0-9A-Za-z-])")),
    ("mac", 0.7, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")),
    ("birth_date", 0.2, re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])")),
    ("phone", 0.3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")),
)
#: Words near a span that speak for its kind, in lower case.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "móvil"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "routing": ("routing", "aba", "bank", "transit"),
    "mac": ("mac", "device", "ethernet"),
    "birth_date": ("born", "birth", "dob", "geboren", "nacido", "né"),
}
#: Words that speak against any kind: numbers of things, not of people.
AGAINST = ("version", "build", "isbn", "order", "example", "sample")
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7}
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's country-first form leaves 1, taken in portions so that its length doesn't matter."""
    left = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        left = (left * (100 if v > 9 else 10) + v) % 97
    return left == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match's first part ends at an @ and begins where its characters do, but not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = at
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """The base kinds' matches that pass their checks; one that fails is dropped whole."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _confirmed(kind: str, found: str) -> bool:
    if kind == "iban":
        return mod97(found.replace(" ", ""))
    if kind == "routing":
        return sum(int(d) * w for d, w in zip(found, (3, 7, 1) * 3)) % 10 == 0
    return True


def _context(text: str, kind: str, start: int, end: int) -> float:
    """What the words near a span add to its score."""
    near = {w.lower() for part in (text[max(0, start - NEAR):start], text[end:end + NEAR]) for w in _WORD.findall(part)}
    return 0.4 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in near for w in AGAINST)


def spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind."""
    out = [Span(k, a, b, round(min(1.0, max(0.0, _SCORES[k] + _context(text, k, a, b))), 2), True) for k, a, b in base_spans(text)]
    taken = [(s.start, s.end) for s in out]
    if _DIGIT.search(text):
        for kind, worth, pattern in _MORE:
            for m in pattern.finditer(text):
                score = worth + _context(text, kind, m.start(), m.end())
                if score >= threshold and _confirmed(kind, m[0]) and not any(a < m.end() and m.start() < b for a, b in taken):
                    out.append(Span(kind, m.start(), m.end(), round(min(1.0, score), 2), False))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())]))


def find(df: DataFrame, text: str = "text", out: str = "spans", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` (default: all) and in `out` the spans of each whole text, in code points, ends exclusive.

    Null and empty texts have none; a column named like `out` is replaced;
    repeated rows stay.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    source = df.select(*names, F.col(text).alias("__pii_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([[s._asdict() for s in spans(t.as_py() or "", threshold)] for t in b.column(len(names))], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*names, out])

    return source.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), T.StructField(out, SPANS)]))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Texts with each span replaced by its kind in brackets; overlapping spans by that of the first.

    Null texts stay null.
    """
    step = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done")),
        lambda acc, s: F.when(s["start"] < acc["done"], F.struct(acc["out"].alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(F.col(text), (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")),
                              F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("done"))))
    return df.withColumn("__pii_r", step).withColumn(text, F.when(F.col(text).isNotNull(), F.concat(
        F.col("__pii_r.out"), F.substring(F.col(text), (F.col("__pii_r.done") + 1).cast("int"), F.length(text))))).drop("__pii_r")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return find(docs, keep=["doc_id"]).select(
        "doc_id", *(n_of(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
