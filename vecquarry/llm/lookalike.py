"""Visually identical text (problem 2): one canonical form for all spellings that look alike.

Method: the non-ASCII tokens of all distinct texts are exploded into positioned code points, a broadcast join with
the mapping table (decompositions, full-width and ligature forms, unusual spaces, look-alike letters, invisible
characters) replaces each code point, combining marks are ordered by class, recomposed, and the strings are rebuilt.

The mapping table comes from the Unicode rules below, so its size is bounded by Unicode and not by the data.

Defined results: a null text stays null; a row without a key is in no pair; an empty text stays empty; ASCII text is returned unchanged; a text of any
length is processed whole; ZERO WIDTH JOINER stays between pictographs, where it changes what is shown.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import cut

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ү": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Invisible characters other than the zero-width joiner.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
ZWJ, VS15, VS16 = "‍", "︎", "️"
#: Compatibility forms that look like their plain ones; superscripts, fractions and circled forms don't.
ALIKE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
WORD = r"[\p{L}\p{N}]+"


def pictograph(cp: int) -> bool:
    return cp >= 0x1F000 or 0x2190 <= cp <= 0x21FF or 0x2300 <= cp <= 0x23FF or 0x2600 <= cp <= 0x27BF or 0x2B00 <= cp <= 0x2BFF


def _map_char(ch: str) -> str:
    """What one character becomes, marks apart; the rule from which the mapping table is built."""
    if ch in INVISIBLE:
        return ""
    if ch not in " \t\n\r" and unicodedata.category(ch) == "Zs":
        return " "
    if ch in "‐‑":
        return "-"
    tag, _, rest = (d := unicodedata.decomposition(ch)).partition(" ")
    if d and (not tag.startswith("<") or tag in ALIKE_TAGS or "ﬀ" <= ch <= "ﬆ"):
        parts = (rest if tag.startswith("<") else d).split()
        return "".join(_map_char(chr(int(x, 16))) for x in parts)
    return LOOKALIKES.get(ch, ch)


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Characters that change, and what they become. Hangul syllables are left whole."""
    out = {}
    for cp in (*range(0x80, 0x20000), *range(0x2F800, 0x2FA1E)):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        if (to := _map_char(chr(cp))) != chr(cp):
            out[chr(cp)] = to
    return out


def _compose(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def canonical(text: str) -> str:
    """The canonical form of one string: the same rule as ``canonical_texts``, for small tables and tests."""
    if text.isascii():
        return text
    m, out = mapping(), []
    for i, ch in enumerate(text):
        if ch in (ZWJ, VS15, VS16):
            before = next((c for c in reversed(text[:i]) if c not in (VS15, VS16)), "")
            after = text[i + 1 : i + 2]
            if not before or not pictograph(ord(before)) or (ch == ZWJ and not (after and pictograph(ord(after)))):
                continue
        out.append(m.get(ch, ch))
    return _compose("".join(out))


def mapping_table(spark) -> DataFrame:
    rows = [(k, v) for k, v in mapping().items()]
    return spark.createDataFrame(rows, "ch string, becomes string")


@F.pandas_udf(T.StringType())
def _recompose(s):
    return s.map(_compose, na_action="ignore")


def _kept(prev: Column, ch: Column, nxt: Column) -> Column:
    def pict(c: Column) -> Column:
        cp = F.coalesce(F.ascii(c), F.lit(0))
        return (cp >= 0x1F000) | cp.between(0x2190, 0x21FF) | cp.between(0x2300, 0x23FF) | cp.between(0x2600, 0x27BF) | cp.between(0x2B00, 0x2BFF)

    return F.when(ch == ZWJ, pict(prev) & pict(nxt)).when(ch.isin(VS15, VS16), pict(prev)).otherwise(F.lit(True))


def canonical_tokens(tokens: DataFrame) -> DataFrame:
    """``token`` (distinct, not ASCII) -> ``token, canon``."""
    spark = tokens.sparkSession
    chars = tokens.select("token", F.posexplode(F.split("token", "")).alias("pos", "ch")).filter("ch != ''")
    w = Window.partitionBy("token").orderBy("pos")
    # The last character before this one that is no variation selector.
    base = F.last(F.when(~F.col("ch").isin(VS15, VS16), F.col("ch")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    chars = chars.withColumn("keep", _kept(base, F.col("ch"), F.lead("ch").over(w))).filter("keep").drop("keep")
    mapped = chars.join(F.broadcast(mapping_table(spark)), "ch", "left").select("token", "pos", F.coalesce("becomes", "ch").alias("ch"))
    rebuilt = mapped.groupBy("token").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("raw")
    )
    # Canonical ordering of marks by class and recomposition, only on strings that still hold a character above ASCII.
    return tokens.join(
        rebuilt.select("token", F.when(F.col("raw").rlike("[^\\x00-\\x7f]"), _recompose("raw")).otherwise(F.col("raw")).alias("canon")), "token", "left"
    ).select("token", F.coalesce("canon", F.lit("")).alias("canon"))


def canonical_texts(df: DataFrame, text: str = "text", out: str = "canon") -> DataFrame:
    """Distinct non-null texts of ``df`` with their canonical form, as columns ``text`` and ``canon``."""
    texts = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    plain = F.col("_t").rlike("\\A[\\x00-\\x7f]*\\z")
    parts = texts.filter(~plain).select("_t", F.regexp_extract_all("_t", F.lit("([ \\t\\n\\r]+|[^ \\t\\n\\r]+)"), 1).alias("_p"))
    odd = parts.select("_t", F.explode(F.array_distinct(F.filter("_p", lambda x: x.rlike("[^\\x00-\\x7f]")))).alias("token"))
    canon = canonical_tokens(odd.select("token").distinct())
    maps = odd.join(canon, "token").groupBy("_t").agg(F.map_from_entries(F.collect_list(F.struct("token", "canon"))).alias("_m"))
    done = parts.join(maps, "_t").select("_t", F.array_join(F.transform("_p", lambda x: F.coalesce(F.col("_m")[x], x)), "").alias(out))
    return texts.filter(plain).select("_t", F.col("_t").alias(out)).unionByName(done).withColumnRenamed("_t", text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def canonical_rows(df: DataFrame, key: str, text: str = "text", out: str = "canon") -> DataFrame:
    """``key, text, canon`` of every row with a text; a repeated text is mapped once."""
    rows = df.select(key, text).filter(F.col(text).isNotNull())
    return rows.join(canonical_texts(rows, text, out), text).select(key, text, out)


def text_id(text: Column) -> list[Column]:
    """128 bits for a text, as two columns."""
    return [F.xxhash64(text), F.xxhash64(F.lit("t"), text)]


def lookalike_pairs(df: DataFrame, key: str = "row_id", text: str = "text", min_words: int = 6) -> DataFrame:
    """Pairs of rows whose texts are different strings but look the same.

    Different strings of one canonical form are paired first, and rows are listed for these pairs only, so a group of identical
    copies costs no pair of its own. Ties and repeated rows give one pair for each two rows.
    """
    df = df.filter(F.col(key).isNotNull())
    h1, h2 = text_id(F.col(text))
    texts = canonical_texts(df, text).filter(word_count(F.col("canon")) >= min_words)
    c1, c2 = text_id(F.col("canon"))
    texts = texts.select(h1.alias("h1"), h2.alias("h2"), c1.alias("c1"), c2.alias("c2"))
    several = texts.groupBy("c1", "c2").agg(F.count("*").alias("n")).filter("n > 1").select("c1", "c2")
    texts = cut(texts.join(several, ["c1", "c2"]))
    a, b = (texts.select("c1", "c2", F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2")) for s in "ab")
    pairs = a.join(b, ["c1", "c2"]).filter("a1 < b1 or (a1 = b1 and a2 < b2)")
    rows = df.select(F.col(key).alias("id"), h1.alias("h1"), h2.alias("h2")).join(texts.select("h1", "h2"), ["h1", "h2"])
    ra, rb = (rows.select(F.col("id").alias(f"id_{s}"), F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2")) for s in "ab")
    found = pairs.join(ra, ["a1", "a2"]).join(rb, ["b1", "b2"])
    return found.select(F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b"))
