"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

Statistics of each text are native expressions.  Rules are conjunctions of
thresholds on them, grown and pruned on a bounded sample of labelled rows and
emitted as one ordered CASE expression, so judging a document is a projection
of the scan: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share")
SYMBOLS = "#*$%&|<>"
_T = "__quality_"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once and names it in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _counted(text: str) -> str:
    """SQL for a struct of all counts of a text."""

    def at(x: str) -> str:
        return f"cast({x} & (shiftleft(1L, b) - 1L) as int)"

    def found(what: str) -> str:
        return f"cast(regexp_count(t, '{what}') as bigint)"

    blanks = "t"
    for other in (r"\t", r"\n", r"\u000b", r"\u000c", r"\r"):
        blanks = f"replace({blanks}, '{other}', ' ')"
    hashes = ("case when n > 3 then sort_array(transform(sequence(0, n - 3),"
              " i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | i))"
              " else cast(array() as array<bigint>) end")
    # neighbours with equal hashes, as their positions; then those whose words are equal
    near = (f"filter(zip_with(h, slice(h, 2, size(h)), (x, y) -> case when shiftright(x, b) = shiftright(y, b)"
            f" then named_struct('i', {at('x')}, 'j', {at('y')}) end), p -> p is not null)")
    equal = " and ".join(f"w[p.i + {d}] = w[p.j + {d}]" for d in range(3))
    out = ("named_struct('n_words', cast(n as bigint),"
           " 'word_chars', cast(length(array_join(w, '')) as bigint),"
           f" 'n_symbols', {found('[' + SYMBOLS + ']')},"
           " 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),"
           f" 'n_repeat_words', cast(size(array_distinct(flatten(transform(filter(r, p -> {equal}), p ->"
           " array(p.i, p.i + 1, p.i + 2, p.j, p.j + 1, p.j + 2))))) as bigint),"
           f" 'lines', size(l), 'upper', {found('[A-Z]')}, 'exclaim', length(t) - length(replace(t, '!', '')))")
    for name, value in reversed((
        ("t", f"coalesce({text}, '')"),
        ("w", f"array_remove(split({blanks}, ' '), '')"),
        ("l", r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        ("n", "size(w)"),
        ("b", "length(bin(n))"),
        ("h", hashes),
        ("r", near),
    )):
        out = _let(name, value, out)
    return out


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `COUNTS` and, as struct `__quality_f`, `FEATURES`; columns of these names are replaced.

    Null and empty texts have zero of everything.  Three-word windows are found
    again by sorting their hashes within the row, each with its position in the
    low bits, and comparing the words of neighbours with equal hashes: n log n
    for a text of any length, and no rows leave their place.  One generated row
    per row keeps the planner from evaluating the counts more than once.
    """
    c = f"{_T}c"
    df = df.withColumn(f"{_T}t", F.col(text))
    df = df.select(*df.columns, F.explode(F.array(F.expr(_counted(f"{_T}t")))).alias(c))
    df = df.withColumns({x: F.col(f"{c}.{x}") for x in COUNTS})

    def share(part: str, whole: str) -> Column:
        return F.col(f"{c}.{part}") / F.greatest(F.col(f"{c}.{whole}"), F.lit(1))

    df = df.withColumn(f"{_T}f", F.struct(
        F.col("n_words").cast("double").alias("words"),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("upper", "word_chars").alias("upper_share"),
        share("exclaim", "n_words").alias("exclaim_share"),
    ))
    return df.drop(c, f"{_T}t")


def base_failed() -> Column:
    """Too few words, or more than half of them in windows found again."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = F.col(f"{_T}f.{self.feature}")
        return f > self.threshold if self.above else f <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the first rule that holds decides, else the document is kept."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def sample(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple]:
    """Features and labels of about `most` labelled documents, chosen by hash of their id.

    Those that the base rule rejects are left out: rules are for the rest.  At most twice `most` labels are picked, so they may be broadcast.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y")).where(
        "__id is not null and __y is not null")
    total = known.count()
    picked = known if total <= most else known.where(F.expr(f"pmod(xxhash64(__id, 17), {total})") < most)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.limit(2 * most)), F.col("doc_id") == F.col("__id"))
    rows = counts(texts.select("text", "__id", "__y")).where(~base_failed())
    return rows.select("__id", *(F.col(f"{_T}f.{f}") for f in FEATURES), "__y").collect()


def learn(rows: list[tuple], max_conditions: int = 4, min_precision: float = 0.95, min_cover: int = 3) -> list[Rule]:
    """Sequential covering over rows (id, features..., quality).

    Each rule grows on two thirds of the rows by the condition of highest
    information gain, loses final conditions while that raises its worth on the
    other third, and is taken if it is precise there; covered rows go, and the
    search repeats.  No labels, or labels of one kind, give no rules.
    """
    if not rows:
        return []
    data = np.array([[float(v) for v in r] for r in sorted(rows)])
    x, bad = data[:, 1:-1], data[:, -1] == 0
    prune = np.arange(len(data)) % 3 == 2
    left = np.ones(len(data), bool)
    rules: list[Rule] = []
    while (bad & left & ~prune).sum() >= min_cover:
        grown = _grow(x[left & ~prune], bad[left & ~prune], max_conditions)
        best, worth = [], -1.0
        for k in range(len(grown), 0, -1):
            hit = _covers(grown[:k], x) & left & prune
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            if p + n and (v := (p - n) / (p + n)) >= worth:
                best, worth = grown[:k], v
        hit = _covers(best, x) & left if best else np.zeros(len(x), bool)
        if not best or (bad & hit).sum() < max(min_cover, min_precision * hit.sum()) or worth < 2 * min_precision - 1:
            break
        rules.append(Rule(tuple(Condition(FEATURES[f], a, float(t)) for f, a, t in best)))
        left &= ~hit
    return rules


def _covers(conditions: list, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, t in conditions:
        hit &= x[:, f] > t if above else x[:, f] <= t
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[tuple[int, bool, float]]:
    """Conditions in the order of their choice; each maximises gain in bits over the rows that the former leave."""
    out: list[tuple[int, bool, float]] = []
    hit = np.ones(len(x), bool)
    while len(out) < most and (~bad & hit).any():
        p0, n0 = (bad & hit).sum(), (~bad & hit).sum()
        best = (1e-9, None)
        for f in range(x.shape[1]):
            v, y = x[hit, f], bad[hit]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])  # the last row of each distinct value but the largest
            low = np.cumsum(y)[cuts]
            for above, p, total in ((False, low, cuts + 1), (True, p0 - low, len(v) - cuts - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / total) - np.log2(p0 / (p0 + n0))), 0.0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, above, float(v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best[1] is None:
            break
        out.append(best[1])
        hit &= _covers(out[-1:], x)
    return out


def judge(docs: DataFrame, labels: DataFrame, most: int = 8000, text: str = "text") -> DataFrame:
    """`docs` with `COUNTS`, `base_failed` and `kept`.

    `most` bounds the labelled sample that rules are learned from.  Labels that
    are null or of unknown documents are ignored, repeated ones count each
    time; an empty labels table leaves the base rule alone.  Repeated rows stay.
    """
    rules = learn(sample(docs, labels, most))
    out = counts(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(f"{_T}f")


def op10(spark, sf_dir: str) -> DataFrame:
    from joblattice.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept")
