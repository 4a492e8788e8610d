"""Encoding whole texts by stretches between spaces, which repeat a lot.

A space before a character that isn't white space begins a piece in the
patterns of byte-level vocabularies, so what lies between two such spaces is
encoded the same wherever it stands.  A worker keeps the results of recent
stretches in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: White space as the patterns understand it (Unicode White_Space), for a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of a table that a worker keeps, twice over; longer keys are never kept.
KEPT, KEPT_KEY = 150_000, 48
#: Characters of text that are cut up at once.
AT_ONCE = 2_000_000

_MARKS = ",.!?;:"
_BREAK = re.compile(f" (?=[^{WHITE}])")
_OTHER_SPACE = re.compile(rf" (?:[{WHITE}]|\Z)")


def cut(text: str) -> list[str]:
    """The text cut before each space that begins a piece, without that space."""
    return _BREAK.split(text) if _OTHER_SPACE.search(text) else text.split(" ")


class Recent:
    """Results by key, bounded: when full, what has not been asked for since the last time goes."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self._make, self._kept = make, kept
        self._now: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        v = self._now.get(key)
        return self._before.get(key) if v is None else v

    def joined(self, rows: list[list[str]]) -> list[bytes]:
        """The results of each row's keys, one after the other."""
        if len(self._now) > self._kept:
            self._before, self._now = self._now, {}
        get = self._now.get
        found = [list(map(get, row)) for row in rows]
        gaps: list[tuple[int, int]] = []
        missing: set[str] = set()
        for n, (row, f) in enumerate(zip(rows, found)):
            i = -1
            for _ in range(f.count(None)):
                i = f.index(None, i + 1)
                gaps.append((n, i))
                missing.add(row[i])
        if missing:
            new: dict[str, bytes] = {}
            old = self._before
            wanted = []
            for k in missing:
                v = old.get(k)
                if v is None:
                    wanted.append(k)
                else:
                    new[k] = v
            new.update(zip(wanted, self._make(wanted), strict=True))
            for n, i in gaps:
                found[n][i] = new[rows[n][i]]
            self._now.update((k, v) for k, v in new.items() if len(k) <= KEPT_KEY)
        return [b"".join(f) for f in found]


class Stretches:
    """Encodes lists of texts; `make` encodes a list of stretches, each without regard to the others.

    A mark after letters is a piece of its own, so a word with one is put together from both.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self._make = make
        self._heads = Recent(make, kept // 10)
        self._rest = Recent(self._after_space, kept)
        self._marks = dict(zip(_MARKS, make(list(_MARKS)), strict=True))

    def _after_space(self, keys: list[str]) -> list[bytes]:
        bare = {k: k[:-1] for k in keys if k[-1:] in self._marks and k[:-1].isalpha()}
        known = {w: self._rest.get(w) for w in bare.values()}
        todo = list({k for k in keys if k not in bare}.union(w for w, v in known.items() if v is None))
        known.update(zip(todo, self._make([" " + k for k in todo]), strict=True))
        return [known[bare[k]] + self._marks[k[-1]] if k in bare else known[k] for k in keys]

    def __call__(self, texts: Iterable) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        n = 0
        for t in texts:
            t = t if isinstance(t, str) else t.as_py()
            held.append(cut(t))
            n += len(t)
            if n >= AT_ONCE:
                out += self._encode(held)
                held, n = [], 0
        return out + self._encode(held)

    def _encode(self, parts: list[list[str]]) -> list[bytes]:
        heads = self._heads.joined([p[:1] for p in parts])
        for p in parts:
            del p[0]
        return [h + r for h, r in zip(heads, self._rest.joined(parts))]
