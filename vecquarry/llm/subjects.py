"""Subject areas of documents (problem 10): labelling functions under an accuracy-learning latent model.

Labelling functions vote on (document, subject): the lexicon over the deciding section (claims, or the abstract where
there are none), over the abstract, over the description, the applicant and the source. A vote is a level: which share of the lexicon
words of the section, or of the applicant's documents, speak for the subject. The lexicon comes from the
labelled documents (at most ``sample`` of them, lowest hash of the id) and is then relearned over all documents that one
subject dominates, so a few wrong labels or rare words don't matter. An EM over the counts of vote patterns learns, without
labels, how often each function gives each level where the subject holds and where it doesn't; no share is fixed beforehand
as enough. Documents get the subjects whose posterior is at least one half.

Defined results: rows without a key, null and empty texts, and texts without a lexicon word, give no rows; equal
evidence gives several subjects; ties in a word's counts go to the subject first in the alphabet.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import cut

# Section headings of the five languages, as far as encoding damage leaves them.
CLAIMS = re.compile(r"^(?:CLAIMS|What is claimed is|PATENTANSPR|Anspr|REVENDICATIONS|Revendications|REIVINDICA|Reivindica)[^\n]{0,14}$", re.M)
ABSTRACT = re.compile(r"^(?:ABSTRACT|ZUSAMMENFASSUNG|RESUMEN|RESUMO|ABR)[^\n ]{0,8}$", re.M)
DESCRIPTION = re.compile(r"^(?:DESCR|BESCHREIBUNG)[^\n ]{0,14}$", re.M)
WORDS = re.compile(r"[^\W\d_]+")
FUNCTIONS = ("claims", "abstract", "description", "applicant", "source")


def sections(text: str) -> tuple[str, str, str]:
    """Claims, abstract and description; a text without headings is all abstract."""
    c = CLAIMS.search(text)
    end = c.start() if c else len(text)
    a = ABSTRACT.search(text, 0, end)
    d = DESCRIPTION.search(text, a.end() if a else 0, end)
    claims = text[c.end() :] if c else ""
    abstract = text[a.end() : d.start() if d else end] if a else ("" if c or d else text)
    return claims, abstract, text[d.end() : end] if d else ""


def hits(section: str, lexicon: dict[str, str]) -> Counter:
    out = Counter()
    for w in WORDS.findall(section.lower()):
        s = lexicon.get(w)
        if s is not None:
            out[s] += 1
    return out


COUNTS = T.StructType([T.StructField("word", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("n", T.LongType())])


def _count_words(batches, subjects_of):
    """(word, subject, documents) of the deciding sections; an empty subject counts all documents."""
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=COUNTS.names)
        counts.clear()
        return batch

    for b in batches:
        for row in b.select(["text", *(["subjects"] if "subjects" in b.schema.names else [])]).to_pylist():
            claims, abstract, _ = sections(row["text"])
            section = claims or abstract
            subjects = subjects_of(section, row)
            if subjects:
                for w in set(WORDS.findall(section.lower())):
                    counts[w, ""] += 1
                    for s in subjects:
                        counts[w, s] += 1
        if len(counts) > 300_000:
            yield flush()
    yield flush()


LEXICON = "word string, subject string"


def _lexicon(counted: DataFrame, least: int, purity: float) -> DataFrame:
    """``word, subject``: words of which at least ``purity`` of the documents are of one subject."""
    per = counted.groupBy("word", "subject").agg(F.sum("n").alias("n"))
    total, named = F.max(F.when(F.col("subject") == "", F.col("n"))), F.col("subject") != ""
    best = per.groupBy("word").agg(
        total.alias("total"), F.max(F.when(named, F.col("n"))).alias("n"),
        F.max_by("subject", F.when(named, F.struct("n", F.transform(F.split("subject", ""), lambda c: -F.ascii(c))))).alias("subject"),
    )
    return cut(best.filter((F.col("n") >= least) & (F.col("n") >= purity * F.col("total"))).select("word", "subject"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 20_000, purity: float = 0.75) -> DataFrame:
    """``docs``: id, text; ``labels``: id, subject; ``word, subject`` comes out."""
    marked = labels.groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows, so no text is shuffled for them.
    seen = docs.join(F.broadcast(marked), "id")
    first = _lexicon(seen.select("text", "subjects").mapInArrow(lambda it: _count_words(it, lambda section, row: row["subjects"]), COUNTS), 2, purity)
    # The words of at most ``sample`` documents.
    start = docs.sparkSession.sparkContext.broadcast({r.word: r.subject for r in first.collect()})

    def dominant(section: str, row: dict) -> list[str]:
        found = hits(section, start.value)
        h = found.most_common(1)
        return [h[0][0]] if h and h[0][1] >= 3 and h[0][1] >= 0.75 * found.total() else []

    second = _lexicon(docs.select("text").mapInArrow(lambda it: _count_words(it, dominant), COUNTS), 5, 0.8)
    return second if second.limit(1).count() else first


SECTIONS = FUNCTIONS[:3]
HITS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("applicant", T.StringType()), T.StructField("source", T.StringType()), T.StructField("subject", T.StringType()),
    *(T.StructField(f, T.IntegerType()) for f in SECTIONS), *(T.StructField(f"all_{f}", T.IntegerType()) for f in SECTIONS),
])
TOKENS = T.StructType([*HITS.fields[:3], T.StructField("word", T.StringType()), *(T.StructField(f, T.IntegerType()) for f in SECTIONS)])


def _parts(text: str) -> tuple[str, str, str]:
    """Deciding section, abstract where it doesn't decide, description."""
    claims, abstract, description = sections(text)
    return claims or abstract, abstract if claims else "", description


def section_hits(docs: DataFrame, lexicon: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``HITS``: for each document and subject with a lexicon word anywhere how many its sections hold, and how many of all
    subjects. A lexicon of more than ``most`` words isn't broadcast: the documents' words are joined with it."""
    docs = docs.select("id", "applicant", "source", "text")
    if lexicon.count() > most:

        def tokens(batches):
            for b in batches:
                out = []
                for row in b.to_pylist():
                    counts = [Counter(WORDS.findall(x.lower())) for x in _parts(row["text"])]
                    out += [(row["id"], row["applicant"], row["source"], w, *(c[w] for c in counts)) for w in dict.fromkeys(w for c in counts for w in c)]
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 3), strict=True)], names=TOKENS.names)

        met = docs.mapInArrow(tokens, TOKENS).join(lexicon, "word").groupBy("id", "subject").agg(*(F.first(c).alias(c) for c in ("applicant", "source")), *(F.sum(f).cast("int").alias(f) for f in SECTIONS))
        w = Window.partitionBy("id")
        return met.select(*HITS.names[:7], *(F.sum(f).over(w).cast("int").alias(f"all_{f}") for f in SECTIONS))
    shared = docs.sparkSession.sparkContext.broadcast({r.word: r.subject for r in lexicon.collect()})

    def run(batches):
        lex = shared.value
        for b in batches:
            out = []
            for row in b.to_pylist():
                found = [hits(x, lex) for x in _parts(row["text"])]
                totals = [c.total() for c in found]
                out += [(row["id"], row["applicant"], row["source"], s, *(c[s] for c in found), *totals) for s in sorted({s for c in found for s in c})]
            cols = list(zip(*out, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 6), strict=True)], names=HITS.names)

    return docs.mapInArrow(run, HITS)


#: Upper ends of the shares of a level, after level 1 (none). Level 0: the function says nothing.
LEVELS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)


def level(n: Column, total: Column) -> Column:
    share = n / F.when(total > 0, total)
    out = F.when(share.isNull(), 0).when(share <= 0, 1)
    for i, end in enumerate(LEVELS):
        out = out.when(share <= end, 2 + i)
    return out.otherwise(2 + len(LEVELS))


def key_votes(found: DataFrame, column: str, least: int = 10) -> DataFrame:
    """``<column>, subject, vote``: the level of the mean share of the subject in the deciding sections of an applicant's or a
    source's documents, if there are at least ``least``."""
    share = F.col("claims") / F.when(F.col("all_claims") > 0, F.col("all_claims"))
    per = found.filter(F.col(column).isNotNull()).groupBy(column, "subject").agg(F.round(F.sum(share), 6).alias("n"))
    # The shares of a document add up to one.
    total = per.groupBy(column).agg(F.sum("n").alias("total")).filter(F.col("total") >= least - 1e-3)
    return per.join(total, column).select(column, "subject", level(F.coalesce("n", F.lit(0.0)), F.col("total")).alias("vote"))


def learn_rates(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[tuple[float, float]]]]:
    """EM for one binary latent label and votes in levels: the prior, and how often each function gives each level where
    the label holds and where it doesn't.

    It starts from the belief that a subject is the likelier the larger its share in the deciding section.
    """
    m, top = len(patterns[0][0]), 2 + len(LEVELS)
    belief = [(v[0] - 1) / (top - 1) if v[0] else 0.2 for v, _ in patterns]
    prior, rates = 0.5, []
    for _ in range(rounds):
        yes = [[0.1] * (top + 1) for _ in range(m)]
        no = [[0.1] * (top + 1) for _ in range(m)]
        for (votes, n), p in zip(patterns, belief, strict=True):
            for j, v in enumerate(votes):
                yes[j][v] += n * p
                no[j][v] += n * (1 - p)
        # Levels are in order, so what is seen at one speaks for its neighbours too.
        yes, no = ([_spread(x) for x in part] for part in (yes, no))
        n_yes, n_no = (sum(n * q for (_, n), q in zip(patterns, part, strict=True)) + 1 for part in (belief, [1 - p for p in belief]))
        prior = n_yes / (n_yes + n_no)
        # Level 0 tells nothing.
        rates = [[(1.0, 1.0), *((a / sum(y[1:]), b / sum(x[1:])) for a, b in zip(y[1:], x[1:], strict=True))] for y, x in zip(yes, no, strict=True)]
        belief = [posterior(v, prior, rates) for v, _ in patterns]
    return prior, rates


def _spread(counts: list[float]) -> list[float]:
    """Counts of levels, each with a quarter of its neighbours' (level 0 stands apart)."""
    ends = [0.0, *counts[1:], 0.0]
    return [counts[0], *(ends[i] + 0.25 * (ends[i - 1] + ends[i + 1]) for i in range(1, len(ends) - 1))]


#: Most that one function other than the deciding section adds to the log odds: sections of one text don't vote independently.
DAMPED = 1.5


def posterior(votes: tuple[int, ...], prior: float, rates: list[list[tuple[float, float]]]) -> float:
    z = math.log(prior / (1 - prior))
    for j, (v, r) in enumerate(zip(votes, rates, strict=True)):
        odds = math.log(r[v][0] / r[v][1])
        z += odds if j == 0 else min(max(odds, -DAMPED), DAMPED)
    return 1 / (1 + math.exp(-min(max(z, -50), 50)))


def assign(docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """``<key>, subject, probability`` for every document and subject with a vote.

    ``docs``: key, text, applicant, source; ``labels``: key, subject.
    """
    docs = docs.select(F.col(key).alias("id"), "text", "applicant", "source").filter("id is not null and length(text) > 0")
    lexicon = learn_lexicon(docs.select("id", "text"), labels.select(F.col(key).alias("id"), "subject").dropna())
    found = cut(section_hits(docs, lexicon, most))
    votes = found.select("id", "subject", "applicant", "source", *(level(F.col(f), F.col(f"all_{f}")).alias(f"v_{f}") for f in SECTIONS))
    for column in FUNCTIONS[3:]:
        votes = votes.join(key_votes(found, column).withColumnRenamed("vote", f"v_{column}"), [column, "subject"], "left")
    names = [f"v_{f}" for f in FUNCTIONS]
    votes = cut(votes.select("id", "subject", *(F.coalesce(c, F.lit(0)).alias(c) for c in names)))
    counted = votes.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # bounded by the levels
    patterns = [(tuple(r[c] for c in names), r.n) for r in counted]
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in names), T.StructField("probability", T.DoubleType())])
    model = learn_rates(patterns) if patterns else (0.5, [])
    table = docs.sparkSession.createDataFrame([(*v, round(posterior(v, *model), 6)) for v, _ in patterns], schema)
    return votes.join(F.broadcast(table), names).select(F.col("id").alias(key), "subject", "probability")


def subjects_found(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return assign(docs, labels, key).filter("probability >= 0.5").select(key, "subject")


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents and their share for each subject area."""
    n = F.lit(docs.count())
    per = subjects_found(docs, labels, key).groupBy("subject").agg(F.count("*").alias("n_docs"))
    n_docs = F.coalesce("n_docs", F.lit(0))
    return areas.select("subject").join(per, "subject", "left").select("subject", n_docs.alias("n_docs"), F.round(n_docs / n, 6).alias("share"))
