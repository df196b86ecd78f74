"""Evaluation texts leaking into training text (problem 9): a generalised suffix automaton of the test items.

The folded words of all items form one automaton; the words of each document are streamed through it, and where the
longest match reaches ``least`` words, the items of the state are reported. Only runs of at least ``least`` words that
all occur in some item enter the automaton, since no match can leave such a run.

The automaton is broadcast, so the items' words are counted first: items beyond ``block`` words form further automata,
each run over the documents in turn.

Defined results: rows without a key, null and empty texts, and items of fewer than ``least`` words never match; a document that has a
passage several times gives one row for each item; documents are streamed whole, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.llm.copies import _closure
from vecquarry.llm.lookalike import INVISIBLE, VS15, VS16, ZWJ, mapping

WORDS = re.compile(r"[^\W_]+")


class Folding:
    """Case, white space, punctuation and look-alike differences removed from Python strings, word by word."""

    def __init__(self):
        src, dst = _closure()
        self.table = str.maketrans(mapping() | dict.fromkeys([ZWJ, VS15, VS16], ""))
        self.closure = str.maketrans(src, dst)
        # Invisible characters and marks stand within words, so texts with any of them are folded before they are split.
        self.within = re.compile("[" + re.escape(INVISIBLE + ZWJ + VS15 + VS16) + "\u0300-\u036f]")
        self.seen: dict[str, str] = {}

    def fold(self, text: str) -> str:
        return unicodedata.normalize("NFC", text.translate(self.table)).lower().translate(self.closure)

    def split(self, text: str) -> list[str]:
        """Words in lower case; those that aren't ASCII are folded by ``word``."""
        if not text.isascii() and self.within.search(text):
            text = self.fold(text)
        return WORDS.findall(text.lower())

    def word(self, w: str) -> str:
        if w.isascii():
            return w
        if w not in self.seen:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            self.seen[w] = self.fold(w)
        return self.seen[w]

    def words(self, text: str) -> list[str]:
        return [self.word(w) for w in self.split(text)]

    def places(self, text: str) -> list[tuple[int, int]]:
        """Where the words of ``split`` begin and end in the text."""
        if text.isascii():
            return [m.span() for m in WORDS.finditer(text)]
        # Character by character, so that a place in the folded text leads back; marks belong to the letter before them.
        within = self.within.search(text) is not None
        out, at = [], []
        for i, c in enumerate(text):
            piece = c.translate(self.table).lower().translate(self.closure) if within else c.lower()
            out.append(piece)
            at += [i] * len(piece)
        at.append(len(text))
        folded = "".join(out)
        if within:
            kept = [j for j, c in enumerate(folded) if not unicodedata.combining(c)]
            folded, at = "".join(folded[j] for j in kept), [at[j] for j in kept] + [len(text)]
        spans = []
        for m in WORDS.finditer(folded):
            begin, end = at[m.start()], at[m.end() - 1] + 1
            while end < len(text) and (unicodedata.combining(text[end]) or text[end] in INVISIBLE):
                end += 1
            spans.append((begin, end))
        return spans


class Numbers(dict):
    """Word -> number in a vocabulary, -1 for others; folds a word the first time it is seen."""

    def __init__(self, vocabulary: dict[str, int], folding: Folding, most: int = 2_000_000):
        super().__init__(vocabulary)
        self.vocabulary, self.folding, self.most = vocabulary, folding, most

    def __missing__(self, w: str) -> int:
        n = self.vocabulary.get(self.folding.word(w), -1)
        if len(self) > self.most:
            self.clear()
        self[w] = n
        return n


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        nxt, link, length, owners = [{}], [-1], [0], [set()]
        for number, words in items:
            last = 0
            for w in words:
                c = self.vocabulary.setdefault(w, len(self.vocabulary))
                last = self._extend(nxt, link, length, owners, last, c)
                owners[last].add(number)
        for s in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            owners[link[s]] |= owners[s] if link[s] > 0 else set()
        self.next, self.link, self.length = nxt, link, length
        # The state that holds the last ``least`` words of a match, and its items.
        self.items: list[tuple[int, ...]] = [()] * len(nxt)
        for s in range(1, len(nxt)):
            if length[s] >= least:
                u = s
                while length[link[u]] >= least:
                    u = link[u]
                self.items[s] = tuple(sorted(owners[u]))

    @staticmethod
    def _extend(nxt, link, length, owners, last, c):
        def clone(p, q):
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            owners.append(set())
            new = len(nxt) - 1
            link[q] = new
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            return new

        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else clone(last, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append(set())
        new, p = len(nxt) - 1, last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def matches(self, ids: np.ndarray):
        """Word numbers -> (item, position of the last word, length of the longest match) where it reaches ``least`` words."""
        known = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).astype(np.int8), 0]))
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.least:
                continue
            state = size = 0
            for at in range(start, end):
                c = int(ids[at])
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                state = self.next[state].get(c, 0)
                size = size + 1 if state else 0
                if size >= self.least:
                    yield from ((item, at, size) for item in self.items[state])


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
LEAK = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("item", T.LongType()), T.StructField("longest", T.IntegerType()),
    T.StructField("covered", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
    T.StructField("spans", SPANS),
])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = 12, block: int = 200_000) -> DataFrame:
    """``<key>, <item>, longest, covered, n_words, spans``: the longest shared passage of each document and item, the words of
    the document that lie in shared passages of at least ``least`` words, all its words, and the passages as positions of words (``Folding.split``),
    the end not included."""
    folding = Folding()
    blocks, size = [[]], 0
    for r in items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter("t is not null and i is not null").orderBy("i").toLocalIterator():
        words = folding.words(r.t)
        if size + len(words) > block and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, words))
        size += len(words)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("length(text) > 0")
    out = None
    for part in blocks:
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton(part, least))

        def run(batches, automaton=automaton):
            auto = automaton.value
            fold = Folding()
            numbers = Numbers(auto.vocabulary, fold)
            for b in batches:
                found = []
                for doc, body in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                    words = fold.split(body)
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    spans: dict[int, list] = {}
                    for i, at, size in auto.matches(ids):
                        # spans[i]: longest match, passages
                        s = spans.setdefault(i, [0, []])
                        s[0] = max(s[0], size)
                        begin = at + 1 - auto.least
                        if s[1] and begin <= s[1][-1]["end"]:
                            s[1][-1]["end"] = at + 1
                        else:
                            s[1].append({"begin": begin, "end": at + 1})
                    found += [(doc, i, s[0], sum(x["end"] - x["begin"] for x in s[1]), len(words), s[1]) for i, s in spans.items()]
                columns = list(zip(*found, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), ARROW_SPANS), strict=True)], names=LEAK.names)

        got = rows.mapInArrow(run, LEAK)
        out = got if out is None else out.unionByName(got)
    return out.withColumnsRenamed({"doc": key, "item": item})


def removals(found: DataFrame, key: str = "doc_id", most_words: int = 50, most_share: float = 0.2) -> DataFrame:
    """What to do with each leaking document: drop it beyond a limit of length or coverage, else cut its passages.

    ``spans`` are its passages, united over all items, as in ``leaks``; ``covered`` are the words in them. ``cleaned`` cuts them."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    per = found.groupBy(key).agg(F.max("longest").alias("longest"), F.max("n_words").alias("n_words"), F.count("*").alias("n_items"), spans.alias("spans"))

    def unite(united, x):
        last = F.try_element_at(united, F.lit(-1))
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = F.coalesce(last["end"] >= x["begin"], F.lit(False))
        return F.when(meets, F.concat(F.slice(united, 1, F.greatest(F.size(united) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(united, F.array(x)))

    per = per.withColumn("spans", F.aggregate("spans", F.array().cast(SPANS), unite))
    per = per.withColumn("covered", F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["begin"]))
    share = F.round(F.col("covered") / F.col("n_words"), 6)
    action = F.when((F.col("longest") > most_words) | (share > most_share), "drop").otherwise("cut")
    return per.select(key, "n_items", "longest", "covered", share.alias("share"), action.alias("action"), "spans")


def cleaned(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, text, n_removed``: every leaking document that stays (``removals`` says "cut"), without its passages. A blank
    stands in the place of a passage; what is left of the text is unchanged."""
    spans = removed.filter("action = 'cut'").select(key, "spans", F.col("covered").alias("n_removed"))
    rows = docs.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("text")).filter("length(text) > 0").join(spans, key)

    def run(batches):
        fold = Folding()
        for b in batches:
            out = []
            for body, passages in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                at, kept, done = fold.places(body), [], 0
                for p in passages:
                    begin, end = at[min(p["begin"], len(at) - 1)][0], at[min(p["end"], len(at)) - 1][1]
                    kept.append(body[done:begin])
                    done = end
                out.append(" ".join([*kept, body[done:]]))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.string()), b.column("n_removed")], names=[key, "text", "n_removed"])

    schema = T.StructType([docs.schema[key], T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())])
    return rows.mapInArrow(run, schema)
