"""Pieces of checking SQL.

These restate the column functions in the checking engine's own terms; its
regular expressions have no lookaround, so boundaries are matched characters.
"""

from __future__ import annotations

import re

from joblattice import vocab

W = r"\p{L}\p{N}_"
L, R = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def esc(s: str) -> str:
    return re.sub(r"([.+*?()|\[\]{}^$\\])", r"\\\1", s)


def rx(expr: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({expr}, {lit(pattern)}{', ' + lit(flags) if flags else ''})"


def sub(expr: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, {lit(flags)})"


def ext(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, {group})"


def text(expr: str) -> str:
    return f"coalesce({expr}, '')"


def has(lowered: str, phrases) -> str:
    body = "|".join(".*".join(esc(p) for p in re.split(r"\s*\.\.\.\s*", ph.lower())) for ph in phrases)
    return rx(lowered, f"{L}(?:{body}){R}")


def ladder(lowered: str, rules: dict) -> str:
    return "CASE " + " ".join(f"WHEN {has(lowered, p)} THEN {lit(k)}" for k, p in rules.items()) + " END"


def mapped(expr: str, mapping: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + " END"


def among(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(lit(v) if isinstance(v, str) else str(v) for v in values)})"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def strip(expr: str) -> str:
    return sub(expr, r"^[\s\p{Z}]+|[\s\p{Z}]+$")


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, r'[\s\p{Z}]+', ' ')})"


def title_case(expr: str) -> str:
    runs = f"regexp_extract_all({expr}, '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


def job_function(title="title", snippet="description_snippet", current="job_function") -> str:
    rules = vocab.JOB_FUNCTION_PHRASES
    given = mapped(f"lower({strip(text(current))})", vocab.JOB_FUNCTION_LABELS)
    opening = f"lower(substring({text(snippet)}, 1, 300))"
    return f"coalesce({ladder(f'lower({text(title)})', rules)}, {given}, {ladder(opening, rules)}, 'Other')"


def arrangement(lowered: str, more=()) -> str:
    far = ["remote", "telework", r"work\s?from\s?home", "wfh", "virtual", *more]
    return (
        f"CASE WHEN {has(lowered, ['hybrid'])} THEN 'hybrid' "
        f"WHEN {rx(lowered, f'{L}(?:{"|".join(far)}){R}')} THEN 'remote' "
        f"WHEN {rx(lowered, rf'{L}(?:on[-\s]?site|in[-\s]?office|in[-\s]?person){R}')} THEN 'onsite' ELSE '' END"
    )


def from_location(location="location") -> str:
    return arrangement(f"lower({text(location)})")


def standard_arrangement(title="title", location="location", current="work_arrangement") -> str:
    given = f"lower({strip(text(current))})"
    both = f"lower({text(title)} || ' | ' || {text(location)})"
    return f"CASE WHEN {given} IN ('remote','hybrid','onsite') THEN {given} ELSE {arrangement(both, ['telecommute', r'flexible\s*/\s*remote'])} END"


def normalised_arrangement(value: str) -> str:
    squashed = f"translate(lower({strip(text(value))}), '_- ', '')"
    return f"coalesce({mapped(squashed, vocab.ARRANGEMENT_SPELLINGS)}, '')"


def season(title="title") -> str:
    found = ext(f"lower({text(title)})", f"{L}(summer|fall|autumn|winter|spring){R}")
    return f"CASE {found} WHEN 'autumn' THEN 'fall' ELSE {found} END"


def _num(expr: str, pattern: str) -> str:
    return f"CAST(nullif({ext(expr, pattern)}, '') AS INTEGER)"


def year(title="title") -> str:
    t = text(title)
    return (
        f"coalesce({_num(t, f'{L}(20[23][0-9]){R}')}, "
        f"{_num(t, rf"{L}(?:(?:FY|fy)\s*'?|')([23][0-9]){R}")} + 2000)"
    )


def standard_season(title="title", snippet="description_snippet", given="cycle_season") -> str:
    rules = vocab.SEASON_WORDS
    return (
        f"coalesce(nullif({given}, ''), {ladder(f'lower({text(title)})', rules)}, "
        f"{ladder(f'lower(substring({text(snippet)}, 1, 150))', rules)}, '')"
    )


def standard_year(title="title", snippet="description_snippet", given="cycle_year") -> str:
    def in_(t):
        return (
            f"coalesce({_num(t, f'{L}(202[4-9]|203[0-5]){R}')}, {_num(t, rf"{L}(?:FY|fy)\s*'?([23][0-9]){R}")} + 2000, "
            f"{_num(t, rf"{L}'([23][0-9]){R}")} + 2000)"
        )

    return f"coalesce({given}, {in_(text(title))}, {in_(f'substring({text(snippet)}, 1, 150)')})"


def plain(expr: str) -> str:
    return squeeze(sub(f"lower({text(expr)})", rf"[^{W}\s]", " "))


def company_key(c="company") -> str:
    legal = sub(f"lower({text(c)})", rf"\b(?:{'|'.join(vocab.LEGAL_WORDS)})\b\.?")
    return f"nullif({sub(sub(legal, rf'[^{W}\s]', ' '), r'[\s\p{Z}]+')}, '')"


def dedup_key(c="company", t="title", p="location") -> str:
    return f"({company_key(c)} || '|' || nullif({plain(t)}, '') || '|' || {plain(p)})"


def precedence(ats="ats") -> str:
    return f"CASE WHEN {among(ats, vocab.DIRECT_PLATFORMS)} THEN 0 ELSE 1 END"


def company_name(c="company") -> str:
    name = strip(text(c))
    numbered = " ".join(
        f"WHEN {rx(name, rf'^\d{{4,5}}\s+{b}{R}', 'i')} THEN {lit(s)}" for b, s in vocab.NUMBERED_SUBSIDIARIES.items())
    cleaned = sub(name, r"([a-zA-Z])\d+$", r"\1")
    for joined, spaced in vocab.JOINED_NAMES.items():
        cleaned = sub(cleaned, rf"\b{joined}\b", spaced, "gi")
    suffixes = "|".join(esc(s) for s in vocab.NAME_SUFFIXES)
    short = sub(cleaned, rf"[,\s]+(?:{suffixes})\.?\s*$", "", "i")
    shown = f"CASE WHEN {among(cleaned, vocab.NAMES_KEEPING_SUFFIX)} THEN {cleaned} ELSE {short} END"
    return (
        f"CASE WHEN {text(c)} = '' THEN 'Unknown Company' ELSE coalesce({mapped(f'lower({name})', vocab.COMPANY_NAMES)}, "
        f"CASE {numbered} END, CASE WHEN ({shown}) = lower({shown}) AND NOT contains({shown}, ' ') AND length({shown}) > 2 "
        f"THEN {title_case(f'({shown})')} ELSE {strip(f'({shown})')} END) END"
    )


def industry(company="company", function="job_function", current="category") -> str:
    given = strip(text(current))
    return (
        f"CASE WHEN {given} <> '' AND {text(current)} <> 'Uncategorized' THEN {given} ELSE coalesce("
        f"{mapped(text(company), vocab.COMPANY_INDUSTRY)}, {ladder(f'lower({text(company)})', vocab.INDUSTRY_WORDS)}, "
        f"{mapped(text(function), vocab.FUNCTION_INDUSTRY)}, nullif({current}, ''), 'Uncategorized') END"
    )


def title(c="title") -> str:
    """A cleaned title; nested expressions only, so it can stand anywhere."""
    plain_ = strip(f"replace({text(c)}, chr(160), ' ')")
    body = r"(?:req(?:uisition)?|job\s*id|ref(?:erence)?|req\s*#|req\s*no\.?)"
    t = sub(plain_, rf"\s*[\[(]?\b{body}(?:\s*[:#-]\s*|\s+|([0-9_]))[a-z0-9_-]*[\])]?", "", "gi")
    t = sub(t, r"\s*\b(?:JR\d{4,}|R-\d{4,})\b", "", "gi")
    t = f"CASE WHEN contains({t}, ' / Intern') OR contains({t}, ' | Intern') THEN {strip(sub(t, r'^.*[/|]\s*(Intern)', r'\1', 'i'))} ELSE {t} END"
    words = f"string_split_regex(({t}), '\\s+')"
    cased = (
        f"array_to_string(list_transform(list_filter({words}, lambda w: w <> ''), lambda w: CASE WHEN "
        f"{among('upper(w)', vocab.TITLE_ACRONYMS)} THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
    )
    shout = f"CASE WHEN upper({t}) = ({t}) AND lower({t}) <> ({t}) AND length({t}) > 4 THEN {cased} ELSE ({t}) END"
    return squeeze(sub(f"({shout})", r"^[\s\-|:/]+|[\s\-|:/]+$"))


def location_steps(table: str, column: str = "location", keep: str = "*") -> str:
    """WITH items ending in ``placed``, which has ``place`` for every row of ``table``."""
    streets = "|".join(vocab.STREET_WORDS)
    affix = strip(f"replace({text(column)}, chr(160), ' ')")
    loc = sub(sub(sub("_raw", r"^(?:remote|virtual|hybrid|flexible\s*/\s*remote)\s*-\s*", "", "i"),
                  r"\s*\((?:remote|hybrid|onsite|virtual)\)$", "", "i"), r"[,\s]+(?:remote|virtual|hybrid)$", "", "i")
    bare = f"lower({strip(sub('_raw', r'^[\s\-|:/]+|[\s\-|:/]+$'))})"
    site = r"^(?:CA|US|USA)-([A-Z]{2})-([A-Z\s]+)(?:-\w+)?$"
    home = r"^(?:USA?|United States)\s*-\s*([A-Za-z\s]+)\s*-\s*(.+)$"
    cut = sub(sub(sub("_loc", rf"^\d+\s+[A-Za-z0-9.\s]+(?:{streets})\s*,\s*", "", "i"),
                  r"[,\s]+\d{5}(?:-\d{4})?\s*$"), r"[,\s]+(?:USA|United States of America|United States|US)\s*$", "", "i")

    def parts(expr, sep):
        return f"list_filter(list_transform(string_split_regex({expr}, {lit(sep)}), lambda p: trim(p)), lambda p: p <> '')"

    state = strip(ext("_loc", "(?i)" + home, 1))
    st = f"coalesce({mapped(f'lower({state})', vocab.US_STATES)}, CASE WHEN length({state}) = 2 THEN upper({state}) ELSE {state} END)"
    second = f"trim({sub('_comma[2]', r'\s*\d{5}(?:-\d{4})?$')})"
    country = mapped("lower(_dash[1])", vocab.COUNTRY_CODES)
    codes = sorted(set(vocab.US_STATES.values()))
    return f"""
    loc1 AS (SELECT {keep}, {affix} AS _raw FROM {table}),
    loc2 AS (SELECT *, {loc} AS _l FROM loc1),
    loc3 AS (SELECT *, CASE WHEN contains(_l, '~') THEN trim(split_part(_l, '~', 1)) END AS _code,
             CASE WHEN contains(_l, '~') THEN trim(split_part(_l, '~', 1)) ELSE _l END AS _loc FROM loc2),
    loc4 AS (SELECT *, {parts('_loc', '-')} AS _dash, {cut} AS _cut FROM loc3),
    loc5 AS (SELECT *, lower(trim(_cut)) AS _key, {parts('_cut', ',')} AS _comma,
             CASE WHEN len(_dash) >= 2 THEN {country} END AS _country FROM loc4),
    placed AS (SELECT *, CASE
        WHEN _raw = '' OR {among('lower(_raw)', vocab.NOT_A_PLACE)} THEN 'Not Specified'
        WHEN {rx('_raw', r'\b(?:\d+|multiple)\s+locations?\b', 'i')} OR ((contains(_raw, ';') OR contains(_raw, ' | '))
             AND len({parts('_raw', '[;|]')}) >= 2) THEN 'Multiple Locations'
        WHEN {rx(bare, r'^(?:remote|virtual|flexible\s*/\s*remote)(?:\s*-\s*(?:us|usa|united states|united states of america))?$')}
             OR {rx(bare, r'^(?:us|usa|united states)\s*-\s*remote$')} THEN 'Remote, United States'
        WHEN {rx('_code', site)} THEN {title_case(ext('_code', site, 2))} || ', ' || {ext('_code', site, 1)}
        WHEN _country = 'Singapore' THEN _country
        WHEN _country IS NOT NULL THEN {title_case('_dash[-1]')} || ', ' || _country
        WHEN {rx('_loc', home, 'i')} THEN {strip(ext('_loc', '(?i)' + home, 2))} || ', ' || {st}
        ELSE coalesce({mapped('_key', vocab.US_METROS)}, {mapped('_key', vocab.WORLD_CITIES)},
             CASE WHEN len(_comma) = 2 THEN _comma[1] || ', ' || coalesce({mapped(f'lower({second})', vocab.US_STATES)},
             CASE WHEN {among(f'upper({second})', codes)} THEN upper({second}) END) END, {squeeze('_cut')}) END AS place FROM loc5)"""


def posted_ts(raw="posted_at", seen="first_seen") -> str:
    """For the formats the bound postings hold."""
    low = f"lower({raw})"
    n = f"CAST(nullif({ext(low, r'posted\s+(\d+)\+?\s*days?\s+ago')}, '') AS INTEGER)"
    ms = f"CAST({raw} AS BIGINT)"
    return (
        f"CASE WHEN {rx(raw, r'^-?\d{9,}$')} THEN epoch_ms(CASE WHEN abs({ms}) >= 100000000000 THEN {ms} ELSE {ms} * 1000 END) "
        f"WHEN contains({low}, 'posted') THEN CASE WHEN {n} IS NOT NULL THEN {seen} - to_days({n}) "
        f"WHEN {rx(low, r'posted\s+today')} THEN {seen} WHEN {rx(low, r'posted\s+yesterday')} THEN {seen} - to_days(1) END "
        f"WHEN {rx(raw, r'^\d{4}-\d{2}-\d{2}')} THEN CASE WHEN {rx(raw, r'[+-]\d{2}:\d{2}$')} THEN "
        f"CAST(substring({raw}, 1, 19) AS TIMESTAMP) - to_hours(CAST(substring({raw}, 20, 3) AS INTEGER)) "
        f"ELSE CAST(replace(replace({raw}, 'T', ' '), 'Z', '') AS TIMESTAMP) END END"
    )


def posted_approx(raw="posted_at", seen="first_seen") -> str:
    return f"coalesce(({posted_ts(raw, seen)}) IS NOT NULL AND NOT {rx(raw, r'^-?\d{9,}$')} AND (contains(lower({raw}), 'posted') OR length({raw}) <= 10), false)"


def backoff(attempts: str, hours, as_of: str) -> str:
    return f"({as_of} + to_hours([{', '.join(map(str, hours))}][CAST(least({attempts} + 1, {len(hours)}) AS INT)]))"


def matched_blocks(pairs: str) -> str:
    """WITH items (for WITH RECURSIVE): `matched`(a, b, m), the characters of each pair of `pairs`(a, b) that lie in common blocks.

    A round takes the longest common block of each open span and opens what
    lies left and right of it.
    """
    size = "len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: a[i + 1:i + n] = b[j + 1:j + n]))"
    # the first block of the greatest size: size, then the smallest i, then the smallest j, as one number
    best = f"list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {size} * 1000000 + (999 - i) * 1000 + (999 - j)))))"
    look = f"SELECT a, b, alo, ahi, blo, bhi, {best} AS v FROM"
    child = """SELECT a, b, unnest([{'alo': alo, 'ahi': 999 - v // 1000 % 1000, 'blo': blo, 'bhi': 999 - v % 1000},
        {'alo': 999 - v // 1000 % 1000 + v // 1000000, 'ahi': ahi, 'blo': 999 - v % 1000 + v // 1000000, 'bhi': bhi}], recursive := true) FROM spans WHERE v >= 1000000"""
    return f"""spans AS ({look} (SELECT a, b, 0 AS alo, length(a) AS ahi, 0 AS blo, length(b) AS bhi FROM {pairs} WHERE a <> '' AND b <> '')
    UNION ALL {look} ({child}) c WHERE alo < ahi AND blo < bhi),
    matched AS (SELECT p.a, p.b, coalesce(sum(v // 1000000), 0) AS m FROM {pairs} p LEFT JOIN spans s ON s.a = p.a AND s.b = p.b GROUP BY ALL)"""


RATIO = "CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * CAST(m AS DOUBLE) / (length(a) + length(b)) END"


def stems(words: str) -> str:
    """WITH items: `stems`(word, term) of the words of `words`(word), the English suffix steps one after the other."""
    from joblattice.functions import stem

    def end(options) -> str:
        return "'(" + "|".join(sorted(options, key=len, reverse=True)) + ")$'"

    def cut(n: str, w: str = "w") -> str:
        return f"left({w}, length({w}) - {n})"

    def swaps(table: dict) -> str:
        return "CASE s " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in table.items()) + " END"

    r1, r2 = "s <> '' AND length(w) - length(s) >= p1", "s <> '' AND length(w) - length(s) >= p2"
    short = f"'{stem.SHORT}'"
    region = f"'{stem.REGION}'"
    own = "CASE word " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in stem.IRREGULAR.items()) + " END"

    def found(options) -> str:
        return f"regexp_extract(w, {end(options)}, 1) AS s"

    return f"""t0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}),
    t1 AS (SELECT *, CASE WHEN regexp_matches(w, '^({"|".join(stem.PREFIXES)})') THEN length(regexp_extract(w, '^({"|".join(stem.PREFIXES)})'))
        WHEN regexp_matches(w, {region}) THEN length(regexp_extract(w, {region})) ELSE length(w) END AS p1 FROM t0),
    t2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, p1 + 1), {region}) THEN p1 + length(regexp_extract(substr(w, p1 + 1), {region})) ELSE length(w) END AS p2,
        {found(["sses", "ied", "ies", "us", "ss", "s"])} FROM t1),
    t3 AS (SELECT word, p1, p2, CASE WHEN s = 'sses' THEN {cut("2")} WHEN s IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {cut("2")} ELSE {cut("1")} END
        WHEN s = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN {cut("1")} ELSE w END AS w FROM t2),
    t4 AS (SELECT *, {among("w", stem.KEPT)} AS kept, {found(["eedly", "ingly", "edly", "eed", "ing", "ed"])} FROM t3),
    t5 AS (SELECT *, CASE WHEN s <> '' AND s NOT IN ('eed', 'eedly') AND regexp_matches({cut("length(s)")}, '[aeiouy]') THEN {cut("length(s)")} END AS b FROM t4),
    t6 AS (SELECT word, p1, p2, kept, w AS w_kept, CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {r1} THEN {cut("length(s)")} || 'ee' ELSE w END WHEN b IS NULL THEN w
        WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {cut("1", "b")}
        WHEN length(b) = p1 AND regexp_matches(b, {short}) THEN b || 'e' ELSE b END AS w FROM t5),
    t7 AS (SELECT * EXCLUDE (w), CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN {cut("1")} || 'i' ELSE w END AS w FROM t6),
    t8 AS (SELECT *, {found(stem.STEP2)} FROM t7),
    t9 AS (SELECT * EXCLUDE (w, s), CASE WHEN {r1} AND (s <> 'ogi' OR w LIKE '%logi') AND (s <> 'li' OR regexp_matches(w, '[cdeghkmnrt]li$')) THEN {cut("length(s)")} || {swaps(stem.STEP2)} ELSE w END AS w FROM t8),
    t10 AS (SELECT *, {found(stem.STEP3)} FROM t9),
    t11 AS (SELECT * EXCLUDE (w, s), CASE WHEN {r1} AND (s <> 'ative' OR {r2}) THEN {cut("length(s)")} || {swaps(stem.STEP3)} ELSE w END AS w FROM t10),
    t12 AS (SELECT *, {found(stem.STEP4)} FROM t11),
    t13 AS (SELECT * EXCLUDE (w, s), CASE WHEN {r2} AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {cut("length(s)")} ELSE w END AS w FROM t12),
    t14 AS (SELECT * EXCLUDE (w), CASE WHEN w LIKE '%e' AND (length(w) > p2 OR (length(w) > p1 AND NOT regexp_matches({cut("1")}, {short}))) OR w LIKE '%ll' AND length(w) > p2 THEN {cut("1")} ELSE w END AS w FROM t13),
    stems AS (SELECT word, coalesce({own}, CASE WHEN length(word) <= 2 THEN word END, replace(CASE WHEN kept THEN w_kept ELSE w END, 'Y', 'y')) AS term FROM t14)"""
