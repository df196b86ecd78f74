"""Garbled text from wrong decoding (problem 4).

Every distinct clean word of the corpus is put through all encoding chains, and so is every clean part of a word (a run of
characters above ASCII with its neighbours) and every clean character. The words of the corpus are hash-joined with
the forms that come out: words first, then the parts of words that no clean word explains (names never occur clean), then
their character sequences. What is put in a word's place is verified: a chain must make the word of it.

A match says only that one of two words may be the garbled form of the other. The garbled one has more characters where
no writing has them (``odd``: signs within letters, capitals after small letters, letters of two scripts, controls); if
both have as many, it is the one whose rarest part stands in far fewer different texts and is itself rare. Replacement characters
and C1 controls are never correct.

Words are runs of ASCII letters and digits and of any characters above ASCII. Counts are over different texts (copies count
once) of all tables together, made per partition before the shuffle. Rare but correct characters don't count.

Defined results: null texts and rows without a key never count, empty and ASCII texts hold nothing; a text with several garbled words gives one
row; lost characters (U+FFFD) are found but stay as they are where no clean word explains them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vecquarry.llm.lookalike import INVISIBLE, LOOKALIKES, VS15, VS16, ZWJ, mapping
from vecquarry.session import cut, spread

# How a text was written, and as what it was read.
READ_UTF8_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254", "cp866", "koi8-r", "iso8859-2", "iso8859-15")
WRITTEN_AS = ("cp1252", "mac_roman", "cp437", "cp850")
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866", "koi8-r", "cp1253", "iso8859-2", "iso8859-5", "iso8859-7")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
LOST = "�"


def _read(data: bytes, codec: str) -> str | None:
    """Bytes that the code page leaves undefined come out as C1 controls, as common readers do it."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)


def _write(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


@lru_cache(200_000)
def garbled(word: str) -> tuple[str, ...]:
    """All forms that the encoding chains make of a word, without the word itself."""
    forms = set()
    data = word.encode("utf-8", "replace")
    for codec in READ_UTF8_AS:
        once = _read(data, codec)
        forms.add(once)
        twice = once.encode("utf-8", "replace")
        for second in ("latin-1", "cp1252", codec):
            forms.add(_read(twice, second))
    for w in WRITTEN_AS:
        if (b := _write(word, w)) is not None:
            forms.update(_read(b, r) for r in READ_AS if r != w)
    # Lost characters: one replacement for each character, or for each of its bytes.
    forms.add("".join(c if c.isascii() else LOST for c in word))
    forms.add("".join(c if c.isascii() else LOST * len(c.encode("utf-8")) for c in word))
    forms.discard(word)
    return tuple(forms)


def _bytes(text: str, codec: str) -> bytes | None:
    """The bytes that ``_read`` made the text of."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    out = []
    for c in text:
        try:
            out.append(c.encode(codec))
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(bytes([ord(c)]))
    return b"".join(out)


def originals(word: str) -> set[str]:
    """All strings of which a chain that loses nothing makes this word."""

    def unread(text: str, codec: str) -> str | None:
        data = _bytes(text, codec)
        try:
            return data.decode("utf-8") if data is not None else None
        except UnicodeDecodeError:
            return None

    found = set()
    for codec in READ_UTF8_AS:
        found.add(unread(word, codec))
        for second in ("latin-1", "cp1252", codec):
            once = unread(word, second)
            found.add(once and unread(once, codec))
    for r in READ_AS:
        if (data := _bytes(word, r)) is not None:
            found.update(_read(data, w) for w in WRITTEN_AS if w != r)
    found -= {None, "", word}
    return {o for o in found if word in garbled(o)}


#: Quotes, dashes and dots that stand within words.
_WITHIN = "·’‘´`-‐‑–—…ʼ"


@lru_cache(50_000)
def _class(c: str) -> str:
    """L and l: Latin letters, capital and small; x: letters of other scripts; s: signs; !: lost, controls and the like."""
    if c.isascii():
        return "L" if c.isupper() else "l" if c.isalpha() else " "
    kind = unicodedata.category(c)
    if c == LOST or kind in ("Cc", "Co", "Cn"):
        return "!"
    if c in LOOKALIKES or (c in mapping() and mapping()[c].isascii()):
        return " "  # spellings of problem 2
    if kind[0] == "L":
        if unicodedata.name(c, "").startswith(("LATIN", "FEMININE", "MASCULINE")) or c == "µ":
            return "L" if c.isupper() else "l"
        return "x"
    return "s" if kind[0] in "SPN" and c not in _WITHIN else " "


#: Mathematical and technical signs, boxes and blocks.
_SIGNS = re.compile("[\u2200-\u25ff]")
#: Signs that may end a word.
_ENDS = "®™"


def odd(word: str) -> int:
    """Characters above ASCII where no writing has them: lost ones and controls; signs within letters, next to a boxed or
    mathematical one, or after an accented letter; capitals between small letters; letters of two scripts side by side."""
    k, n = [_class(c) for c in word], 0
    for i, c in enumerate(word):
        if c.isascii():
            continue
        before, after = k[i - 1] if i else " ", k[i + 1] if i + 1 < len(word) else " "
        letter = before in ("L", "l", "x")
        accented = letter and not word[i - 1].isascii()
        if k[i] == "!":
            n += 1
        elif accented and before == "L" and "\x80" <= c <= "\xbf":
            n += 1
        elif k[i] == "s":
            symbol = unicodedata.category(c)[0] == "S" and c not in _ENDS
            n += (letter and after in ("L", "l")) or (_SIGNS.match(c) is not None and (letter or after in ("L", "l"))) or (accented and symbol)
        elif k[i] == "x":
            n += before in ("L", "l") or after in ("L", "l")
        elif k[i] == "L":
            n += before == "l" and not (after == "L" and word[i + 1].isascii())
    return n


_RUN, _LOSTS = re.compile("[\x80-\U0010ffff]+"), re.compile(LOST + "+")


def parts(word: str) -> list[tuple[str, str, str]]:
    """Runs of characters above ASCII, each with the character before and after it; a run of lost ones counts as one."""
    found = []
    for m in _RUN.finditer(word):
        i, j = m.span()
        found.append((word[i - 1].lower() if i else "^", _LOSTS.sub(LOST, m.group()), word[j].lower() if j < len(word) else "$"))
    return found


def sequences(word: str, most: int = 6) -> set[str]:
    """What one garbled character may be: up to ``most`` characters of a run above ASCII."""
    return {run[i : i + n] for run in _RUN.findall(word) for i in range(len(run)) for n in range(1, min(most, len(run) - i) + 1)}


def words_of(data: bytes, cache: dict[bytes, tuple[str, ...]]) -> set[str]:
    """Words with a character above ASCII."""
    out: set[str] = set()
    for token in {w for w in data.split() if not w.isascii()}:
        words = cache.get(token)
        if words is None:
            if len(cache) > 300_000:
                cache.clear()
            words = cache[token] = tuple(w for w in WORD.findall(token.decode("utf-8", "replace")) if not w.isascii())
        out.update(words)
    return out


COUNTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])
#: Kinds of counted items.
WHOLE, PART, SIGN = "word", "part", "char"


def vocabulary(texts: DataFrame) -> DataFrame:
    """``kind, item, n``: in how many different texts each word with a character above ASCII, each part of one, and each such
    character stands."""

    def run(batches):
        counts: dict[tuple[str, str], int] = {}
        cache: dict[bytes, tuple[str, ...]] = {}
        items: dict[str, tuple[tuple[str, str], ...]] = {}

        def flush():
            batch = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)), pa.array(list(counts.values()), pa.int64())], names=COUNTS.names)
            counts.clear()
            return batch

        for b in batches:
            for data in b.column("data").to_pylist():
                seen = set()
                for w in words_of(data, cache):
                    if w not in items:
                        if len(items) > 200_000:
                            items.clear()
                        items[w] = ((WHOLE, w), *((PART, "".join(p)) for p in parts(w)), *((SIGN, c) for c in set(w) if not c.isascii()))
                    seen.update(items[w])
                for key in seen:
                    counts[key] = counts.get(key, 0) + 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    different = texts.filter(F.col("data").cast("string").rlike("[^\\x00-\\x7f]")).groupBy("data").agg(F.count("*").alias("rows"))
    return different.select("data").mapInArrow(run, COUNTS).groupBy("kind", "item").agg(F.sum("n").alias("n"))


FORMS = T.StructType([T.StructField("form", T.StringType()), T.StructField("original", T.StringType()), T.StructField("n_original", T.LongType()), T.StructField("odd_original", T.IntegerType())])


def _forms(clean: DataFrame, garble) -> DataFrame:
    """``form, original, n_original, odd_original`` of ``item, n``; ``garble``: item -> its forms."""

    def run(batches):
        for b in batches:
            out = [(f, w, n, odd(w)) for w, n in zip(b.column("item").to_pylist(), b.column("n").to_pylist(), strict=True) for f in garble(w)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=FORMS.names)

    return spread(clean.select("item", "n")).mapInArrow(run, FORMS)


def _word_forms(word: str) -> list[str]:
    return [_LOSTS.sub(LOST, f) for f in garbled(word)]


def _part_forms(part: str) -> list[str]:
    return [part[0] + f + part[-1] for f in _word_forms(part[1:-1]) if not any(c.isascii() for c in f)]


def _looked_at(items: DataFrame, schema: str, columns) -> DataFrame:
    """Rows of ``columns(word, n)`` for every ``item, n``."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    types = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        for b in batches:
            out = [row for w, n in zip(b.column("item").to_pylist(), b.column("n").to_pylist(), strict=True) for row in columns(w, n)]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return spread(items.select("item", "n")).mapInArrow(run, schema)


def affected_words(texts: DataFrame, rare: float = 0.001, lead: int = 4) -> tuple[DataFrame, set[str]]:
    """``word, restored`` of every word that wrong decoding produced, and the words that stand in more than ``rare`` of all
    different texts and aren't affected (at most 1 / ``rare`` times the mean number of such words in a text).

    Of two words with as many odd characters the garbled one's rarest part stands in at most one ``lead``-th of the different texts of the other's, and
    in less than ``rare`` of all.
    """
    counted = cut(vocabulary(texts))
    n_texts = texts.select(F.xxhash64("data").alias("h")).distinct().count()
    bar = max(3, rare * n_texts)
    words, all_parts, chars = (counted.filter(F.col("kind") == k).select("item", "n") for k in (WHOLE, PART, SIGN))
    # How odd a word is, and how many texts hold its rarest part.
    seen = _looked_at(words, "word string, form string, n bigint, odd int, part string", lambda w, n: [(w, _LOSTS.sub(LOST, w), n, odd(w), "".join(p)) for p in parts(w)])
    rated = seen.join(all_parts.select(F.col("item").alias("part"), F.col("n").alias("n_part")), "part")
    rated = cut(rated.groupBy("word").agg(*(F.first(c).alias(c) for c in ("form", "n", "odd")), F.min("n_part").alias("support")))

    # Whole words.
    clean = rated.filter("odd = 0").select(F.col("word").alias("item"), "n")
    table = _forms(clean, _word_forms).join(rated.select(F.col("word").alias("original"), F.col("support").alias("support_original")), "original")
    met = rated.join(table, "form").filter(F.col("word") != F.col("original"))
    sign = (F.length("word") > 1) | ~F.col("word").rlike("\\p{L}")  # a single letter is a word of many languages
    garbled_one = (F.col("odd") > F.col("odd_original")) | sign & ((F.col("odd") == F.col("odd_original")) & (F.col("support") < bar) & (F.col("support") * lead <= F.col("support_original")) & (F.col("n") <= F.col("n_original")))
    whole = met.filter(garbled_one).groupBy("word").agg(F.max(F.struct("n_original", "original"))["original"].alias("restored"))
    whole = cut(whole)

    # Parts of odd words that no clean word explains, in their surroundings.
    left = cut(rated.filter("odd > 0").join(whole, "word", "left_anti").select(F.col("word").alias("item"), "n"))
    clean_parts = cut(_looked_at(clean, "item string, n bigint", lambda w, n: [("".join(p), n) for p in parts(w)]).select("item").distinct().join(all_parts, "item"))
    pieces = _looked_at(left, "word string, place int, form string, odd int", lambda w, n: [(w, i, "".join(p), odd("".join(p).strip("^$"))) for i, p in enumerate(parts(w))])
    met = pieces.join(_forms(clean_parts, _part_forms), "form").filter(F.col("n_original") >= lead)
    best = met.groupBy("word", "place").agg(F.max(F.struct("n_original", "original"))["original"].alias("original"))
    in_parts = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("place", "original"))).alias("by_place"))

    # Character sequences of what is left, for instance words of another script. A single character proves nothing without
    # its surroundings, unless it is a lost one or a control.
    known = _looked_at(clean, "item string, n bigint", lambda w, n: [(c, n) for c in set(w) if not c.isascii()]).select("item").distinct()
    known = known.join(chars, "item").filter(F.col("n") >= lead)
    found = _looked_at(left, "word string, form string", lambda w, n: [(w, _LOSTS.sub(LOST, x)) for x in sequences(w) if len(x) > 1 or _class(x) == "!"]).join(_forms(known, _word_forms), "form")
    in_chars = found.groupBy("word").agg(F.collect_set("original").alias("chars"))
    rest = in_parts.join(in_chars, "word", "full").select("word", "by_place", "chars")
    checked = rest.mapInArrow(_verified, "word string, restored string").filter("restored is not null")
    bad = cut(whole.unionByName(checked))
    usual = words.filter(F.col("n") > rare * n_texts).select(F.col("item").alias("word")).join(bad, "word", "left_anti")
    return bad, {r.word for r in usual.collect()}


def _verified(batches):
    """The word with its parts' originals if a chain makes the word of it; else what a chain makes the word of and holds
    only characters that were found; the word itself if it is affected but can't be restored."""
    for b in batches:
        out = []
        for row in b.to_pylist():
            w, by_place, chars = row["word"], dict(row["by_place"] or ()), set(row["chars"] or ())
            restored = None
            if by_place:
                text, at = [], 0
                for i, m in enumerate(_RUN.finditer(w)):
                    original = by_place.get(i)
                    text += [w[at : m.start()], original[1:-1] if original else m.group()]
                    at = m.end()
                o = "".join([*text, w[at:]])
                # Each part is a form that a chain makes of its original.
                restored = o if odd(o) < odd(w) else None
            if restored is None and chars:
                fit = [o for o in originals(w) if odd(o) < odd(w) and all(c.isascii() or c in chars for c in o)]
                restored = min(fit, key=lambda o: (odd(o), len(o), o)) if fit else None
            if restored is None and any(_class(c) == "!" for c in w if not c.isascii()):
                restored = w
            out.append((w, restored))
        columns = list(zip(*out, strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["word", "restored"])


WORDS = T.StructType([
    T.StructField("tab", T.StringType()), T.StructField("row_key", T.LongType()), T.StructField("word", T.StringType()),
])
RESTORED = T.StructType([T.StructField("tab", T.StringType()), T.StructField("row_key", T.LongType()), T.StructField("restored", T.StringType()), T.StructField("n_words", T.IntegerType())])


def garbled_rows(texts: DataFrame, restore: bool = False) -> DataFrame:
    """``tab, row_key`` of every affected text of ``tab, row_key, data`` (bytes); with ``restore`` also the restored text
    and the number of its affected words. Words are hash-joined with the affected ones; nothing is collected."""
    bad, usual = affected_words(texts)
    shared = texts.sparkSession.sparkContext.broadcast(usual)
    # Words that many texts hold stay in their tasks, so the join has no hot key but garbled ones.
    hits = texts.filter("length(data) > 0").mapInArrow(lambda it: _tokens(it, shared.value), WORDS).join(bad, "word")
    if not restore:
        return hits.select("tab", "row_key").distinct()
    maps = hits.groupBy("tab", "row_key").agg(F.collect_list("word").alias("words"), F.collect_list("restored").alias("to"))

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                words = dict(zip(r["words"], r["to"], strict=True))
                text = WORD.sub(lambda m, words=words: words.get(m.group(), m.group()), r["data"].decode("utf-8", "replace"))
                rows.append((r["tab"], r["row_key"], text, len(words)))
            t, k, x, n = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(k, pa.int64()), pa.array(x, pa.string()), pa.array(n, pa.int32())], names=RESTORED.names)

    # A row key that repeats has one list of words for all its texts.
    return texts.join(maps, ["tab", "row_key"]).mapInArrow(run, RESTORED)


def _tokens(batches, without: set[str]):
    cache: dict[bytes, tuple[str, ...]] = {}
    for b in batches:
        rows = [(t, k, w) for t, k, d in zip(b.column("tab").to_pylist(), b.column("row_key").to_pylist(), b.column("data").to_pylist(), strict=True) if not d.isascii() for w in words_of(d, cache) - without]
        t, k, w = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(k, pa.int64()), pa.array(w, pa.string())], names=WORDS.names)


def as_texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``name: (df, key, text)`` -> ``tab, row_key, data``."""
    out = None
    for name, (df, key, text) in tables.items():
        part = df.filter(F.col(key).isNotNull()).select(F.lit(name).alias("tab"), F.col(key).alias("row_key"), F.col(text).cast("binary").alias("data"))
        out = part if out is None else out.unionByName(part)
    return out
