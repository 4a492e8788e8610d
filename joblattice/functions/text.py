"""Text matching and clean-up as native column expressions.

Word boundaries are spelled out as Unicode classes rather than ``\\b``, whose
meaning differs between Java releases.
"""

from __future__ import annotations

import html
import re
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice import vocab

WORD = r"\p{L}\p{N}_"
NOT_BEFORE = rf"(?<![{WORD}])"
NOT_AFTER = rf"(?![{WORD}])"
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c) -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(as_col(c), F.lit(""))


def strip(c) -> Column:
    """No whitespace of any kind at the ends."""
    return F.trim(as_col(c), F.lit(_BLANKS))


def squeeze(c) -> Column:
    """Whitespace runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(as_col(c), rf"{SPACE}+", " "))


def blank_to_null(c) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def keyword_pattern(keyword: str) -> str:
    """Lower-cased, escaped, bounded on both sides the way ``\\b`` bounds it.

    Next to a word character the neighbour must not be one; next to anything
    else (the ``+`` of ``c++``) the neighbour must be one.
    """
    kw = keyword.lower()
    before = NOT_BEFORE if _is_word(kw[0]) else rf"(?<=[{WORD}])"
    after = NOT_AFTER if _is_word(kw[-1]) else rf"(?=[{WORD}])"
    return before + re.escape(kw) + after


def begins_with(phrases) -> str:
    """A test of one character, ahead of a bound that takes longer: what any of the phrases begins with."""
    firsts = sorted({re.escape(p[0]) if p and not p.startswith(".") else "" for p in phrases})
    return f"(?=[{''.join(firsts)}])" if firsts and all(firsts) else ""


def phrases_pattern(phrases) -> str:
    """One bounded alternation over plain phrases; ``a ... b`` allows anything between."""
    phrases = list(phrases)
    body = "|".join(".*".join(re.escape(part) for part in re.split(r"\s*\.\.\.\s*", p)) for p in phrases)
    return f"{begins_with(phrases)}{NOT_BEFORE}(?:{body}){NOT_AFTER}"


def has_phrase(lowered: Column, phrases) -> Column:
    return lowered.rlike(phrases_pattern(phrases))


def matches_any(text, keywords) -> Column:
    """True where any keyword occurs as a whole word, in any case, unstemmed."""
    keywords = [k for k in keywords if k]
    if not keywords:
        return F.lit(False)
    plain = [k.lower() for k in keywords if _is_word(k.lower()[0]) and _is_word(k.lower()[-1])]
    rest = [keyword_pattern(k) for k in keywords if k.lower() not in plain]
    # words bounded alike share their bounds
    return F.lower(text_of(text)).rlike("|".join(([f"{begins_with(plain)}{NOT_BEFORE}(?:{'|'.join(map(re.escape, plain))}){NOT_AFTER}"] if plain else []) + rest))


def is_internship(title, words=vocab.INTERN_WORDS) -> Column:
    return matches_any(title, words)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def title_case(c) -> Column:
    """Every run of letters gets a capital first letter, the rest is lowered."""
    runs = F.regexp_extract_all(as_col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


# --- markup -----------------------------------------------------------------

#: Characters of a description in snippet columns; descriptions themselves are stored whole.
SNIPPET = 600


@F.pandas_udf(T.StringType())
def _unescape(raw: pd.Series) -> pd.Series:
    def one(text):
        if text is None or "&" not in text:
            return text
        for _ in range(3):
            plain = html.unescape(text)
            if plain == text:
                break
            text = plain
        return text

    return raw.map(one, na_action="ignore")


# fixed values: the references that nearly all markup uses, and what they stand for
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "amp": "&"}
#: A reference outside the common ones, as it stands or after what ampersands written as references hide; others stand for themselves.
_UNCOMMON = r"&(?:amp;)*(?!(?:" + "|".join(_COMMON) + r");|[\t\n\f <&;]|\z)"


#: Whether texts may hold uncommon references; a caller that has tested them all says no while it makes its columns.
UNCOMMON_REFERENCES: ContextVar[bool] = ContextVar("uncommon_references", default=True)


def has_uncommon_references(text: Column) -> Column:
    return text.contains("&") & text.rlike(_UNCOMMON)


def unescape_html(c) -> Column:
    """Entities replaced until stable, three passes at most.

    Common references are replaced by built-in functions.  The full table has
    no built-in counterpart, so only texts with others go through an Arrow UDF.
    The test is of the text as given, so nothing is evaluated for it but one pattern.
    """
    t = text_of(c)
    plain = t
    for _ in range(3):
        # the ampersand goes last, so that one pass replaces each reference once
        for name, sign in _COMMON.items():
            plain = F.replace(plain, F.lit(f"&{name};"), F.lit(sign))
    if not UNCOMMON_REFERENCES.get():
        return plain
    other = t.rlike(_UNCOMMON)
    return F.when(other, _unescape(F.when(other, t))).otherwise(plain)


def strip_tags(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def strip_html(raw, max_len: int | None = None) -> Column:
    """Flat text for matching: all of it, or its first ``max_len`` characters."""
    t = strip_tags(unescape_html(raw))
    return t if max_len is None else F.substring(t, 1, max_len)


def display_text(raw, max_len: int | None = None) -> Column:
    """Text for reading, whole unless ``max_len`` is given: list items become bullets, blocks become lines."""
    t = unescape_html(raw)
    for pattern, to in (
        (r"(?i)<li(?![\p{L}\p{N}_])[^>]*>", "\n• "),
        (r"(?i)</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)\s*>|<br\s*/?>", "\n"),
        (r"<[^>]+>", ""),
        (rf"(?:(?!\n){SPACE})+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return strip(t) if max_len is None else F.substring(strip(t), 1, max_len)


def xml_escape(c) -> Column:
    t = text_of(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def xml_attribute(c) -> Column:
    """Escaped and quoted; single quotes are used when the value holds double ones only."""
    t = xml_escape(c)
    for raw, safe in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    double, single = t.contains('"'), t.contains("'")
    return (
        F.when(~double, F.concat(F.lit('"'), t, F.lit('"')))
        .when(~single, F.concat(F.lit("'"), t, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit('"')))
    )


# --- names ------------------------------------------------------------------


def slug(c) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9]", "")


def clean_legal_name(c, suffixes=vocab.REGISTERED_SUFFIXES) -> Column:
    """Trailing registered-company suffixes removed, however many there are."""
    body = "|".join(s.replace(".", r"\.?") for s in suffixes)
    return strip(F.regexp_replace(strip(text_of(c)), rf"(?i)(?:,?{SPACE}+(?:{body})\.?\.?)+$", ""))


def drop_ledger_code(c) -> Column:
    return strip(F.regexp_replace(text_of(c), rf"^{SPACE}*\d{{2,6}}(?:{SPACE}|[:-])+", ""))


def is_gone_page(body, phrases=vocab.GONE_PHRASES) -> Column:
    return F.lower(text_of(body)).rlike("|".join(re.escape(p) for p in phrases))


def json_field(c, path: str) -> Column:
    return F.get_json_object(as_col(c), path)
