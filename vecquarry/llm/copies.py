"""Duplicates hidden by formatting (problem 1): progressive partition refinement.

Distinct texts are first grouped by cheap invariants (stripped length, letter histogram) that no difference of case,
white space, punctuation, field order or look-alike characters can change. Only classes with several members pay for
the costlier keys: the canonical look-alike form, the folded word sequence, and for lists of named fields the sorted
``name=value`` pairs.

Defined results: null texts and rows without a key never count; empty texts form no class of copies under ``min_words`` > 0; identical rows
are copies; ties go to the smallest id; texts of any length are keyed whole; other columns are left alone.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecquarry.llm.lookalike import LOOKALIKES, WORD, canonical_texts, mapping, text_id
from vecquarry.session import cut

FIELD = r"([\p{L}\p{N}]+)\s*[:=]"


def _closure() -> tuple[str, str]:
    """Lower-case letters whose capital looks like a Latin capital, so that case and look-alikes may differ together."""
    to = {k.lower(): v.lower() for k, v in LOOKALIKES.items() if len(k.lower()) == 1 and k.isupper()}
    to |= {k: v for k, v in LOOKALIKES.items() if k.islower()}
    return "".join(to), "".join(to.values())


def fold(canon: Column) -> Column:
    """Lower case, with look-alikes of either case made Latin."""
    return F.translate(F.lower(canon), *_closure())


def _cheap_map() -> tuple[str, str, list[tuple[str, str]]]:
    """One-to-one part of the look-alike mapping on base letters only, and the ligatures."""
    one, more = dict(zip(*_closure(), strict=True)) | {"ς": "σ"}, []
    for k, v in mapping().items():
        base = "".join(c for c in v if unicodedata.category(c)[0] in "LN")
        if len(base) == 1 and base != k:
            one[k] = _closed(base)
        elif len(base) > 1 and "ﬀ" <= k <= "ﬆ":
            more.append((k, base))
    return "".join(one), "".join(one.values()), more


def _closed(c: str) -> str:
    src, dst = _closure()
    low = c.lower() if len(c.lower()) == 1 else c
    return low.translate(str.maketrans(src, dst)) if low in src else c


#: Marks stand apart in one spelling and within letters in another; so do the parts of Hangul syllables, whose letters don't count here.
NO_LETTER = "[^\\p{L}\\p{N}]|[\\u1100-\\u11ff\\u3130-\\u318f\\ua960-\\ua97f\\uac00-\\ud7ff\\uffa0-\\uffdc]"


def invariants(text: Column) -> list[Column]:
    """Stripped length and letter histogram over the letters and digits of all scripts, after the cheap part of the mapping."""
    src, dst, more = _cheap_map()
    s = F.translate(text, src, dst)
    for k, v in more:
        s = F.replace(s, F.lit(k), F.lit(v))
    s = F.regexp_replace(F.translate(F.lower(F.translate(F.lower(s), src, dst)), *_closure()), NO_LETTER, "")
    return [F.length(s).alias("inv_len"), F.xxhash64(F.array_sort(F.split(s, ""))).alias("inv_hist")]


def words(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"({WORD})"), 1)


def field_key(folded: Column) -> Column:
    """Sorted ``name=value`` pairs of a text made only of named fields, else null."""
    names = F.regexp_extract_all(folded, F.lit(FIELD), 1)
    parts = F.split(folded, FIELD)
    values = F.transform(F.slice(parts, 2, F.greatest(F.size(names), F.lit(1))), lambda v: F.array_join(words(v), " "))
    pairs = F.array_sort(F.zip_with(names, values, lambda n, v: F.concat_ws("=", n, v)))
    only = (F.size(names) >= 2) & (F.regexp_count(parts[0], F.lit(WORD)) == 0) & ~F.exists(values, lambda v: v == "")
    return F.when(only, F.array_join(pairs, ";"))


def normal_forms(df: DataFrame, text: str = "text", seq: bool = False) -> DataFrame:
    """``h1, h2, n_words, k1, k2, listed`` of the distinct texts (128 bits each for the text and its normal form): the
    costly keys, and whether the text itself is a field list; with ``seq`` also the words, joined by blanks, and 128 bits of them (``s1, s2``).

    The normal form is the sorted field list where the text, or another text with the same words in the same order, is a
    list of named fields; else the word sequence.
    """
    canon = canonical_texts(df, text).withColumn("f", fold(F.col("canon")))
    keyed = canon.select(*(c.alias(n) for c, n in zip(text_id(F.col(text)), ("h1", "h2"), strict=True)), words(F.col("f")).alias("w"), field_key(F.col("f")).alias("fields"))
    s1, s2 = text_id(F.array_join("w", " "))
    f1, f2 = text_id(F.concat(F.lit("\x01"), "fields"))
    keyed = cut(keyed.select("h1", "h2", F.size("w").alias("n_words"), *([F.array_join("w", " ").alias("seq")] if seq else []), s1.alias("s1"), s2.alias("s2"), F.when(F.col("fields").isNotNull(), F.struct(f1.alias("f1"), f2.alias("f2"))).alias("fields")))
    # Where some text of a word sequence is a list of fields, all of them are.
    listed = keyed.filter("fields is not null").groupBy("s1", "s2").agg(F.max("fields").alias("of"))
    named = keyed.join(listed, ["s1", "s2"], "left")
    return named.select("h1", "h2", "n_words", F.coalesce("of.f1", "s1").alias("k1"), F.coalesce("of.f2", "s2").alias("k2"), F.col("fields").isNotNull().alias("listed"), *(["seq", "s1", "s2"] if seq else []))


def copy_classes(df: DataFrame, key: str = "row_id", text: str = "text", min_words: int = 0) -> DataFrame:
    """One row for each distinct text: ``h1, h2`` (128 bits of it), ``keep_<key>, n_copies`` of its class, and ``n_rows`` of its
    own copies. Classes are aggregates that are joined back, so no task holds one."""
    h1, h2 = text_id(F.col(text))
    texts = df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).groupBy(text).agg(F.min(key).alias("first"), F.count("*").alias("n_rows"))
    inv = cut(texts.select(text, h1.alias("h1"), h2.alias("h2"), "first", "n_rows", *invariants(F.col(text))))
    several = inv.groupBy("inv_len", "inv_hist").agg(F.count("*").alias("n")).filter("n > 1").select("inv_len", "inv_hist")
    marked = inv.join(several.withColumn("several", F.lit(True)), ["inv_len", "inv_hist"], "left")
    many, single = marked.filter("several"), marked.filter("several is null")
    light = cut(many.select("h1", "h2", "first", "n_rows").join(normal_forms(many, text), ["h1", "h2"]))
    classes = light.groupBy("k1", "k2").agg(F.min("first").alias(f"keep_{key}"), F.sum("n_rows").alias("n_copies"))
    refined = light.join(classes, ["k1", "k2"]).select("h1", "h2", "n_rows", f"keep_{key}", "n_copies", "n_words")
    if min_words:
        # A class of one text matters only where the text itself repeats; its words are counted on its canonical form.
        single = single.filter("n_rows > 1")
        counted = canonical_texts(single, text).select(*(c.alias(n) for c, n in zip(text_id(F.col(text)), ("h1", "h2"), strict=True)), F.regexp_count("canon", F.lit(WORD)).alias("n_words"))
        single = single.join(counted, ["h1", "h2"])
    else:
        single = single.withColumn("n_words", F.lit(0))
    single = single.select("h1", "h2", "n_rows", F.col("first").alias(f"keep_{key}"), F.col("n_rows").alias("n_copies"), "n_words")
    return refined.unionByName(single).filter(F.col("n_words") >= min_words).drop("n_words")


def copies_found(df: DataFrame, key: str = "row_id", text: str = "text", min_words: int = 6) -> DataFrame:
    """``keep_<key>, <key>``: each row that is a copy of an earlier one, with the smallest id of its class."""
    classes = copy_classes(df, key, text, min_words).filter("n_copies > 1").select("h1", "h2", f"keep_{key}")
    h1, h2 = text_id(F.col(text))
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias(key), h1.alias("h1"), h2.alias("h2")).join(classes, ["h1", "h2"])
    return rows.filter(F.col(key) != F.col(f"keep_{key}")).select(f"keep_{key}", key)


def collapse(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """One row for each record: ``keep_<key>, n_copies, n_texts`` (different spellings of it)."""
    classes = copy_classes(df, key, text)
    return classes.groupBy(f"keep_{key}").agg(F.max("n_copies").alias("n_copies"), F.count("*").alias("n_texts"))
