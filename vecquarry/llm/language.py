"""Language of each document and of each of its lines (problem 3): prediction by partial matching.

For each language a variable-order context tree over UTF-8 bytes (case folded, up to three bytes of context, escape
method C) is counted on labelled documents; its statistics are then frozen. The code length of a line under each
language decides; all languages' costs of a four-byte sequence stand in one dense table, so scoring is array work on
Arrow's string buffers. A first model relabels the lines of its own training sample, so wrong labels don't stay in it.

The trees are fitted on at most ``sample`` labelled documents (lowest hash of the id); everything else covers all
documents and whole texts.

Defined results: rows without a key, null and empty texts, and texts without a line of prose, give no rows; a line of fewer than
``min_words`` words, a title (the first of several lines, unless it ends as a sentence) or formula (fewer letters than other signs) is not scored; a line whose best language is not clearly better than
the document's main one counts as the main one; equal code lengths go to the language first in ``LANGS``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGS = ("en", "de", "fr", "es", "pt")
# Three-letter codes of the same languages.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt"}
#: Bytes after 0xC3 that stand for letters of these languages, lower case.
_TAILS = bytes([0xA0, 0xA1, 0xA2, 0xA3, 0xA4, 0xA7, 0xA8, 0xA9, 0xAA, 0xAD, 0xB1, 0xB3, 0xB4, 0xB5, 0xB6, 0xBA, 0xBC, 0x9F])
SYMBOLS = 1 + 26 + 1 + len(_TAILS)


def _lut() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for i in range(26):
        lut[65 + i] = lut[97 + i] = 1 + i
    lut[0xC3] = 27
    for i, b in enumerate(_TAILS):
        lut[b] = 28 + i
        if b >= 0xA0:
            lut[b - 0x20] = 28 + i
    return lut


LUT = _lut()


def normal_label(label: Column) -> Column:
    """``en``, ``de``... for a label in any case, with a region or in three letters; null if it names none of them."""
    base = F.lower(F.trim(F.split(F.coalesce(label, F.lit("")), "[-_]")[0]))
    out = F.when(base.isin(*LANGS), base)
    for code, lang in CODES.items():
        out = out.when(base == code, F.lit(lang))
    return out


class Texts:
    """The lines of a batch of texts, as arrays over one byte buffer."""

    def __init__(self, column: pa.Array, min_words: int = 4):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        large = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)
        data = large.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        n = len(self.raw)
        self.sym = LUT[self.raw]
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.prose = np.zeros(0, bool)
            return
        breaks = np.flatnonzero(self.raw == 10)
        self.start = np.unique(np.r_[self.offsets[:-1][np.diff(self.offsets) > 0], breaks + 1])
        self.start = self.start[self.start < n]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.end = np.minimum(np.r_[self.start[1:], n], self.offsets[self.doc + 1])
        letter, plain = self.sym > 0, (self.sym > 0) & (self.raw < 128)
        # Words begin with three ASCII letters after a blank or sign; pieces of garbled characters are none.
        word = np.zeros(n, bool)
        if n > 2:
            word[:-2] = plain[:-2] & plain[1:-1] & plain[2:]
            word[1:] &= ~letter[:-1] & (self.raw[:-1] < 128)
        words = np.add.reduceat(word.astype(np.int32), self.start)
        last = self.end - 1
        for _ in range(4):  # line ends and blanks at the end
            blank = (last > self.start) & np.isin(self.raw[last], (10, 13, 32, 9))
            last = last - blank
        letters, inked = (np.add.reduceat(x.astype(np.int32), self.start) for x in (letter, ~np.isin(self.raw, (9, 10, 13, 32))))
        # The first of several lines is a title unless it ends as a sentence; formulas are mostly no letters.
        several = np.bincount(self.doc, minlength=len(self.offsets) - 1)[self.doc] > 1
        title = several & np.r_[True, self.doc[1:] != self.doc[:-1]] & ~np.isin(self.raw[last], (46, 33, 63))
        self.prose = (words >= min_words) & (2 * letters >= inked) & ~title

    def grams(self, order: int) -> np.ndarray:
        """The number of the ``order`` symbols that end at each byte; before a line stands nothing."""
        out = np.zeros(len(self.sym), np.int32)
        for i in range(order - 1, -1, -1):
            shifted = np.zeros(len(self.sym), np.uint8)
            shifted[i:] = self.sym[: len(self.sym) - i]
            for j in range(i):
                at = self.start + j
                shifted[at[at < self.end]] = 0
            out = out * np.int32(SYMBOLS) + shifted
        return out

    def bits(self, cost: np.ndarray) -> np.ndarray:
        """Code length of each line under each language."""
        out = np.zeros((len(self.start), cost.shape[1]), np.float64)
        g = self.grams(4)
        block = max(1, 2_000_000)
        at = 0
        while at < len(self.start):
            to = int(np.searchsorted(self.start, self.start[at] + block, side="left"))
            to = max(to, at + 1)
            lo, hi = self.start[at], self.end[to - 1] if to == len(self.start) else self.start[to]
            c = cost[g[lo:hi]]
            out[at:to] = np.add.reduceat(c, self.start[at:to] - lo, axis=0, dtype=np.float32)
            at = to
        return out


def fit(texts: Texts, label: np.ndarray) -> np.ndarray:
    """Costs in bits of every four-symbol sequence under each language; ``label``: language number of each line, or -1."""
    prose = np.repeat(np.where(texts.prose, label, -1), texts.end - texts.start)
    full = np.full(len(texts.sym), -1)
    spans = np.concatenate([np.arange(s, e) for s, e in zip(texts.start, texts.end, strict=True)]) if len(texts.start) else np.zeros(0, int)
    full[spans] = prose
    costs = []
    for lang in range(len(LANGS)):
        at = full == lang
        below = np.full(1, np.log2(SYMBOLS), np.float32)
        for order in range(1, 5):
            count = np.bincount(texts.grams(order)[at], minlength=SYMBOLS**order).astype(np.float32).reshape(-1, SYMBOLS)
            n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(count / (n + d))
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0)
            # The context without its first symbol.
            lower = below if order == 1 else np.tile(below.reshape(-1, SYMBOLS), (SYMBOLS if order > 1 else 1, 1))[: SYMBOLS ** (order - 1)]
            below = np.where(count > 0, seen, escape + (lower if order > 1 else below)).astype(np.float32).ravel()
        costs.append(below)
    return np.stack(costs, 1).astype(np.float16)


def train(df: DataFrame, key: str, text: str, lang: str, sample: int = 2000) -> np.ndarray:
    known = df.select(F.col(key).alias("id"), F.col(text).alias("text"), normal_label(F.col(lang)).alias("lang")).filter("lang is not null and length(text) > 0")
    # Ids are sorted, and only the texts of the sample are fetched; a repeated id brings all its rows.
    few = known.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    rows = known.join(F.broadcast(few), "id").select("text", "lang").toArrow()
    texts = Texts(rows.column("text"))
    label = np.array([LANGS.index(x) for x in rows.column("lang").to_pylist()], int)
    model = fit(texts, label[texts.doc])
    return fit(texts, texts.bits(model).argmin(1) if len(label) else label)


SEGMENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("n_bytes", T.IntegerType()),
])


def _decide(texts: Texts, cost: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scored lines, their language and confidence."""
    at = np.flatnonzero(texts.prose)
    bits = texts.bits(cost)[at]
    size = (texts.end - texts.start)[at]
    best = bits.argmin(1)
    doc = texts.doc[at]
    total = np.zeros((len(texts.offsets) - 1, len(LANGS)))
    np.add.at(total, doc, bits)
    main = total.argmin(1)[doc]
    gain = bits[np.arange(len(at)), main] - bits[np.arange(len(at)), best]
    lang = np.where(gain >= margin * size, best, main)
    rel = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -60, 0) / 8)
    conf = rel[np.arange(len(at)), lang] / rel.sum(1)
    return at, lang, conf


def segments(df: DataFrame, key: str, text: str, cost: np.ndarray, margin: float = 0.5) -> DataFrame:
    """``id, line, lang, confidence, n_bytes`` of every scored line."""
    model = df.sparkSession.sparkContext.broadcast(cost)

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            at, lang, conf = _decide(texts, model.value, margin)
            doc = texts.doc[at]
            line = np.arange(len(texts.start)) - np.searchsorted(texts.doc, texts.doc, side="left")
            ids = np.asarray(b.column("id"))[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(line[at].astype(np.int32)), pa.array(np.array(LANGS, object)[lang], pa.string()), pa.array(np.round(conf, 6)), pa.array((texts.end - texts.start)[at].astype(np.int32))],
                names=SEGMENT.names,
            )

    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).filter("length(text) > 0").mapInArrow(run, SEGMENT)


FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang", T.StringType())])


def wrong_labels(df: DataFrame, cost: np.ndarray, key: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = 0.5) -> DataFrame:
    """``<key>, lang``: the languages of each document whose label is missing or isn't exactly what its lines are in."""
    model = df.sparkSession.sparkContext.broadcast(cost)

    def run(batches):
        for b in batches:
            texts = Texts(b.column("text"))
            at, found, _ = _decide(texts, model.value, margin)
            doc = texts.doc[at]
            sets = np.zeros((b.num_rows, len(LANGS)), bool)
            sets[doc, found] = True
            label = b.column("label").to_pylist()
            has = np.array([LANGS.index(x) if x else -1 for x in label], int)
            agrees = (sets.sum(1) == 1) & (has >= 0) & sets[np.arange(len(has)), has]
            r, c = np.nonzero(sets & ~agrees[:, None])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), pa.array(np.array(LANGS, object)[c], pa.string())], names=FOUND.names)

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), normal_label(F.col(lang)).alias("label"))
    return rows.filter("length(text) > 0").mapInArrow(run, FOUND).withColumnRenamed("id", key)


def document_languages(df: DataFrame, cost: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and language: its share of the prose and the mean confidence, weighted by length."""
    s = segments(df, key, text, cost)
    per = s.groupBy("id", "lang").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_lines"), F.round(F.sum(F.col("confidence") * F.col("n_bytes")) / F.sum("n_bytes"), 6).alias("confidence"))
    return per.withColumnRenamed("id", key)
