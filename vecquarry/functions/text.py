"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and stripped punctuation of the keyword tokenizer.
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "with", "for", "at", "by", "is", "are", "be", "this", "that", "these", "those", "from", "as", "it")
STRIP = ".,!?;:\"'()[]{}"


def keywords(text: Column, most: int = 5) -> Column:
    """The first ``most`` different lower-case words of letters only that are no stop words."""
    raw = F.split(F.lower(F.regexp_replace(text, "\\s+", " ")), " ")
    bare = F.transform(raw, lambda t: F.btrim(t, F.lit(STRIP)))
    kept = F.filter(bare, lambda t: t.rlike("^\\p{L}+$") & ~t.isin(*STOP))
    return F.slice(F.array_distinct(kept), 1, most)


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parse_k_list(text: Column, default: int = 10) -> Column:
    """Positive integers of a list separated by commas or blanks, sorted and distinct; ``[default]`` if there are none."""
    parts = F.transform(F.split(F.trim(text), "[,\\s]+"), lambda t: t.try_cast("int"))
    got = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x > 0)))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(default)))


def image_path(uid: Column, listing: Column, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")) -> Column:
    """The first existing of ``uid`` with each extension among the file names of ``listing``, else the first extension."""
    options = F.array(*(F.concat(uid, F.lit(e)) for e in extensions))
    there = F.filter(options, lambda p: F.array_contains(listing, p))
    return F.coalesce(F.try_element_at(there, F.lit(1)), F.concat(uid, F.lit(extensions[0])))


def parse_overrides(text: Column) -> Column:
    """``"name=3, other:5"`` as a map of positive numbers; parts that don't fit are left out, of a repeated name the last counts."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][\w.-]*)\s*[=:]\s*(\d+)"), 0)
    pairs = F.transform(found, lambda p: F.split(F.regexp_replace(p, r"\s", ""), "[=:]"))
    entries = F.transform(pairs, lambda p: F.struct(p[0].alias("k"), p[1].cast("int").alias("v")))
    good = F.filter(entries, lambda e: e["v"] > 0)
    last = F.aggregate(good, F.array().cast("array<struct<k:string,v:int>>"), lambda acc, e: F.concat(F.filter(acc, lambda o: o["k"] != e["k"]), F.array(e)))
    return F.map_from_entries(last)
