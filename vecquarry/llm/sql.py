"""SQL twins of training-data queries, for an engine with ``nfc_normalize`` and RE2 patterns.

The tables here are made anew from Unicode's data and a list of their own, so a fault of the operators' table shows.
"""

from __future__ import annotations

import unicodedata

VS15, VS16, ZWJ = "\ufe0e", "\ufe0f", "\u200d"
# Letters of other scripts over the Latin letters that they look like.
_CYRILLIC = ("АВЕКМНОРСТУХЅІЈԚԜҮҺаеорсухѕіјԁԛԝһүӏ", "ABEKMHOPCTYXSIJQWYHaeopcyxsijdqwhyl")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρϲϳ", "ABEZHIKMNOPTYXoviapcj")
_LATIN = ("ıɑɡ", "iag")
_ALIKE = {x: y for src, dst in (_CYRILLIC, _GREEK, _LATIN) for x, y in zip(src, dst, strict=True)}
_UNSEEN = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]


def mapping() -> dict[str, str]:
    """Characters that change and what they become, from normal forms: tagged forms that look like the plain ones by
    compatibility, others by canonical decomposition."""
    out = {}
    for cp in (*range(0x80, 0xAC00), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA1E)):
        c = chr(cp)
        kind = unicodedata.decomposition(c).split(" ")[0]
        plain = kind in ("<wide>", "<narrow>", "<noBreak>", "<font>") or 0xFB00 <= cp <= 0xFB06
        if cp in _UNSEEN:
            to = ""
        elif unicodedata.category(c) == "Zs":
            to = " "
        elif cp in (0x2010, 0x2011):
            to = "-"
        else:
            to = "".join(_ALIKE.get(x, x) for x in unicodedata.normalize("NFKD" if plain else "NFD", c))
        if to != c:
            out[c] = to
    return out


def _closure() -> tuple[str, str]:
    pairs = {x.lower(): y.lower() for x, y in _ALIKE.items() if x.isupper()} | {x: y for x, y in _ALIKE.items() if x.islower()}
    return "".join(pairs), "".join(pairs.values())


PICT = "[\\x{1F000}-\\x{10FFFF}\\x{2190}-\\x{21FF}\\x{2300}-\\x{23FF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical(x: str) -> str:
    """The canonical look-alike form: joiners and selectors after pictographs are kept under other characters meanwhile."""
    one = {k: v for k, v in mapping().items() if len(v) == 1}
    none = [k for k, v in mapping().items() if not v] + [ZWJ, VS15, VS16]
    # Canonical decompositions need no table: normalisation composes what the mapping takes apart.
    more = {k: v for k, v in mapping().items() if len(v) > 1 and all(c.isascii() for c in v)}
    out = f"regexp_replace({x}, '({PICT}){VS16}', '\\1\x01', 'g')"
    for _ in range(2):  # neighbouring joiners share a pictograph
        out = f"regexp_replace({out}, '({PICT}\x01?){ZWJ}({PICT})', '\\1\x02\\2', 'g')"
    out = f"translate({out}, {quoted(''.join(one) + ''.join(none))}, {quoted(''.join(one.values()))})"
    for k, v in more.items():
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return f"nfc_normalize(translate({out}, '\x01\x02', '{VS16}{ZWJ}'))"


def folded(x: str) -> str:
    src, dst = _closure()
    return f"translate(lower({x}), {quoted(src)}, {quoted(dst)})"


WORD = "[\\p{L}\\p{N}]+"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


LOOKALIKE_PAIRS = f"""
WITH t AS (SELECT row_id, text, {canonical('text')} c FROM datacomp_pool WHERE text IS NOT NULL),
w AS (SELECT * FROM t WHERE len({words('c')}) >= 6)
SELECT a.row_id row_id_a, b.row_id row_id_b FROM w a JOIN w b ON a.c = b.c AND a.row_id < b.row_id AND a.text <> b.text
"""

FIELD = "([\\p{L}\\p{N}]+)\\s*[:=]"

COPIES = f"""
WITH d AS (SELECT text, min(row_id) first FROM datacomp_pool WHERE text IS NOT NULL GROUP BY text),
f AS (SELECT text, first, {folded(canonical('text'))} f FROM d),
g AS (SELECT text, first, {words('f')} w, regexp_extract_all(f, '{FIELD}', 1) names, regexp_split_to_array(f, '{FIELD}') parts FROM f),
h AS (SELECT text, first, w, array_to_string(w, ' ') seq, names, list_transform(parts[2:], lambda p: array_to_string({words('p')}, ' ')) vals, parts[1] head FROM g),
k AS (SELECT text, first, w, seq, CASE WHEN len(names) >= 2 AND len({words('head')}) = 0 AND NOT list_contains(vals, '')
      THEN array_to_string(list_sort(list_transform(list_zip(names, vals), lambda z: z[1] || '=' || z[2])), ';') END fields FROM h),
m AS (SELECT *, max(fields) OVER (PARTITION BY seq) mf FROM k),
n AS (SELECT text, w, min(first) OVER (PARTITION BY coalesce('\x01' || mf, seq)) keep FROM m)
"""
COLLAPSED = f"{COPIES} SELECT keep keep_row_id, count(*) n_copies, count(DISTINCT text) n_texts FROM datacomp_pool JOIN n USING (text) GROUP BY keep"
COPIES += "SELECT keep keep_row_id, row_id FROM datacomp_pool JOIN n USING (text) WHERE len(w) >= 6 AND row_id <> keep"

CANONICAL = f"SELECT row_id, {canonical('text')} canon FROM datacomp_pool WHERE text IS NOT NULL"

LEAKS = f"""
WITH i AS (SELECT item_id, {words(folded(canonical('text')))} w FROM eval_passages WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) p FROM i WHERE len(w) >= 12)),
d AS (SELECT doc_id, {words(folded(canonical('text')))} w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) p FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (g)
"""
