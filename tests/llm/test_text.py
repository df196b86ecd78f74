"""Problems 1 to 4 and 8 to 10 on small hand-made rows: edge cases, and agreement with brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecquarry.llm import copies, encodings, language, leaks, lookalike, packing, subjects

CLASH = ["canon", "normal", "words", "h", "id", "kind", "r", "n"]


def captions(spark, texts, first=0):
    """Rows with a clashing extra column for every name that the operators use inside."""
    df = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "row_id bigint, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


SIX = "one two three four five six"


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｏｎｅ two three four five six", SIX), ("one two three four five six", SIX), ("on​e two three four five six", SIX), ("оne two three four five six", SIX),
        ("café two three four five six", "café two three four five six"), ("ﬁne two three four five six", "fine two three four five six"),
        ("q̣̇ two three four five six", "q̣̇ two three four five six"), ("a❤️b two three four five s️ix", "a❤️b two three four five six"),
    ],
)
def test_alike(spark, a, b):
    got = lookalike.lookalike_pairs(captions(spark, [a, b, a])).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 2)]
    assert lookalike.canonical(a) == lookalike.canonical(b)


def test_hot_copies_with_one_odd_spelling(spark):
    """Many copies of one string cost no pairs among themselves."""
    df = spark.range(100_000).select(F.col("id").alias("row_id"), F.lit(SIX).alias("text")).unionByName(spark.createDataFrame([(200_000, SIX.replace("o", "о", 1))], "row_id bigint, text string"))
    got = lookalike.lookalike_pairs(df).agg(F.count("*"), F.max("row_id_a"), F.min("row_id_b")).first()
    assert tuple(got) == (100_000, 99_999, 200_000)


def test_real_differences_stay(spark):
    texts = [SIX, SIX.upper(), SIX + ".", SIX.replace(" ", "  ", 1), SIX.replace(" ", "\t", 1), SIX.replace("o", "ö", 1), "👨‍🍳 " + SIX, "👨🍳 " + SIX, "x² " + SIX, "x2 " + SIX]
    assert lookalike.lookalike_pairs(captions(spark, texts)).count() == 0


def test_alike_edges(spark):
    long = "wоrd " * 60_000
    df = captions(spark, [None, "", "Ａ", "A", long, long.replace("о", "o"), "​", " "])
    assert sorted(map(tuple, lookalike.lookalike_pairs(df).collect())) == [(4, 5)]
    got = {r.row_id: r.canon for r in lookalike.canonical_rows(df, "row_id").collect()}
    assert got[1] == "" and got[2] == "A" and got[6] == "" and 0 not in got
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_canonical_against_one_string_rule(spark):
    random.seed(4)
    pool = "ab éé́ｅеο​‍ 👨🍳☠️❤ﬁ一ア½…“"
    texts = ["".join(random.choice(pool) for _ in range(random.randint(1, 14))) for _ in range(400)]
    for r in lookalike.canonical_texts(captions(spark, texts)).collect():
        assert r.canon == lookalike.canonical(r.text)
        assert lookalike.canonical(r.canon) == r.canon


# ---------------------------------------------------------------- 1


def test_copies(spark):
    fields = "name: red; size: 12; brand: Foo; form: old"
    texts = [
        SIX, "ONE  two\tthree, four five six!", "оne two three four five six", "two one three four five six", fields, '"BRAND=foo\nFORM=Old | size=12, Name=RED"', "name: 12; size: red; brand: Foo; form: old",
        "name red size 12 brand Foo form old", "five words are too few", "five words are too few", None, "", SIX,
    ]
    got = sorted(map(tuple, copies.copies_found(captions(spark, texts)).collect()))
    assert got == [(0, 1), (0, 2), (0, 12), (4, 5), (4, 7)]
    per = {r.keep_row_id: (r.n_copies, r.n_texts) for r in copies.collapse(captions(spark, texts)).collect()}
    assert per[0] == (4, 3) and per[8] == (2, 1) and per[3] == (1, 1) and sum(n for n, _ in per.values()) == 12


def test_copies_of_other_scripts(spark):
    """Texts of other scripts don't fall into one class of cheap invariants."""
    texts = ["быстрая лиса прыгает через очень старую собаку", "БЫСТРАЯ лиса; прыгает через очень старую собаку", "собака спит", "天 地 玄 黄 宇 宙", "天、地、玄、黄、宇、宙", "日 月 盈 昃 辰 宿", "가 나 다 라 마 바", "가, 나, 다, 라, 마, 바", "ΟΔΟΣ δυο τρια τεσσερα πεντε εξι", "οδος δυο τρια τεσσερα πεντε εξι", "й и к л м н", "й и к л м н"]
    df = captions(spark, texts)
    assert sorted(map(tuple, copies.copies_found(df).collect())) == [(0, 1), (3, 4), (6, 7), (8, 9), (10, 11)]
    inv = [tuple(r) for r in df.select(*copies.invariants(F.col("text"))).collect()]
    assert len(set(inv)) == 7 and all(n > 0 for i, (n, _) in enumerate(inv) if i not in (6, 7))


def test_copies_edges(spark):
    df = captions(spark, [SIX + " x" * 50_000, (SIX + " x" * 50_000).upper()] + [SIX] * 300)
    assert copies.copies_found(df).count() == 1 + 299
    assert copies.copies_found(df.limit(0)).count() == 0
    no_key = df.withColumn("row_id", F.when(F.col("row_id") != 5, F.col("row_id")))
    assert copies.copies_found(no_key).count() == 1 + 298


# ---------------------------------------------------------------- 3

LINES = {
    "en": "The upper valve is held against the lower spring by the screw that was described above.",
    "de": "Das obere Ventil wird durch die oben beschriebene Schraube gegen die untere Feder gehalten.",
    "fr": "La soupape supérieure est maintenue contre le ressort inférieur par la vis décrite plus haut.",
    "es": "La válvula superior se mantiene contra el muelle inferior mediante el tornillo descrito arriba.",
    "pt": "A válvula superior é mantida contra a mola inferior pelo parafuso que foi descrito acima.",
}


def documents(spark):
    rows = [(i, f"Title\nABSTRACT\n{LINES[lang]}\n{LINES[lang]}", lang) for i, lang in enumerate(list(LINES) * 8)]
    rows += [(100, "T\n" + LINES["de"], "en"), (101, "T\n" + LINES["fr"] + "\n" + LINES["es"], "FR-fr"), (102, "T\n" + LINES["pt"], None), (103, "T\n" + LINES["pt"], "POR"), (104, None, "en"), (105, "", "en"), (106, "Ventil", "??"), (None, LINES["en"], "de")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", *(F.lit("x").alias(c) for c in ("label", "id", "line")))


def test_languages(spark):
    df = documents(spark)
    cost = language.train(df, "doc_id", "text", "lang")
    assert sorted(map(tuple, language.wrong_labels(df, cost).collect())) == [(100, "de"), (101, "es"), (101, "fr"), (102, "pt")]
    s = {(r.id, r.line): (r.lang, r.confidence) for r in language.segments(df, "doc_id", "text", cost).collect()}
    assert s[101, 1][0] == "fr" and s[101, 2][0] == "es" and all(0 < c <= 1 for _, c in s.values()) and (0, 0) not in s
    assert language.wrong_labels(df.limit(0), cost).count() == 0
    long = spark.createDataFrame([(1, "\n".join([LINES["es"]] * 20_000), "en")], df.select("doc_id", "text", "lang").schema)
    assert [r.lang for r in language.wrong_labels(long, cost).collect()] == ["es"]


def test_lines_stand_alone(spark):
    """A line's code length doesn't depend on what stands before it; lines need no full stop; titles and formulas don't count."""
    df = documents(spark)
    cost = language.train(df, "doc_id", "text", "lang")
    alone = language.Texts(pa.array([LINES["fr"]])).bits(cost)[0]
    assert (language.Texts(pa.array([LINES["de"], "x\n" + LINES["es"] + "\n" + LINES["fr"]])).bits(cost)[3] == alone).all()
    bare = [v.rstrip(".") for v in LINES.values()]
    assert language.Texts(pa.array(["Some title of four words\n" + "\n".join(bare) + "\nx = a + b (one) [two] {six} <ten> #1 / 2 * 3 - 4 = 56\nHEAD"])).prose.tolist() == [False, *[True] * 5, False, False]


def test_costs_are_code_lengths(spark):
    cost = language.train(documents(spark), "doc_id", "text", "lang").astype(float)
    # With escapes, the probabilities of all symbols after a context never exceed one.
    total = (2.0 ** -cost.reshape(-1, language.SYMBOLS, len(language.LANGS))).sum(1)
    assert total.max() < 1.01
    assert language.train(documents(spark).limit(0), "doc_id", "text", "lang").shape == cost.shape


# ---------------------------------------------------------------- 4


def test_every_chain_is_found_and_restored(spark):
    clean = ["señal de café", "la cápsula está", "über größer prothèse"] * 30
    bad = {}
    for codec in encodings.READ_UTF8_AS:
        bad[codec] = encodings._read("señal de café".encode(), codec)
    bad["twice"] = encodings._read(bad["cp1252"].encode(), "cp1252")
    bad["mac"] = "café señal".encode("cp1252").decode("mac_roman")
    bad["lost"] = "se�al"
    rows = [(i, t) for i, t in enumerate([*clean, *bad.values(), None, "", "plain", "устройство 部材 Â(t) Σ ∞"])]
    df = spark.createDataFrame(rows, "row_id bigint, text string").select("*", F.lit(1).alias("tab"), F.lit(2).alias("data"))
    t = encodings.as_texts({"t": (df, "row_id", "text")})
    got = {r.row_key: r.restored for r in encodings.garbled_rows(t, restore=True).collect()}
    want = range(len(clean), len(clean) + len(bad))
    assert sorted(got) == list(want)
    assert {got[i] for i in list(want)[: len(encodings.READ_UTF8_AS) + 1]} == {"señal de café"} and got[want[-1]] == "señal"
    assert sorted(r.row_key for r in encodings.garbled_rows(t).collect()) == list(want)
    assert encodings.garbled_rows(t.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_shortest_pack_first():
    rng = np.random.default_rng(2)
    for _ in range(30):
        cap = int(rng.integers(5, 80))
        hist = {int(n): int(c) for n, c in zip(rng.integers(1, cap + 1, 9), rng.integers(1, 400, 9), strict=True)}
        plan = packing.shortest_pack_first(hist, cap)
        used = defaultdict(int)
        for pattern, count in plan:
            assert sum(pattern) <= cap and list(pattern) == sorted(pattern, reverse=True)
            for n in pattern:
                used[n] += count
        assert dict(used) == hist
    assert packing.shortest_pack_first({}, 10) == []
    assert packing.shortest_pack_first({6: 2, 4: 2}, 10) == [((6, 4), 2)]


def test_packing(spark):
    texts = [None, "", "a", "word " * 900, "word " * 255 + "w"] + ["same length here"] * 700
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", F.lit(1).alias("n"), F.lit(1).alias("piece"), F.lit(1).alias("id"))
    packs = spark.createDataFrame([("tiny", 256), ("one", 1)], "pack_name string, capacity_tokens int")
    got = packing.pack_all(df, packs).toPandas()
    few = packing.pack(packing.token_counts(df), 256, most=50).toPandas()
    assert not few.duplicated(["container_id", "slot"]).any() and few.groupby("container_id").n.sum().max() <= 256 and len(few) == (got.pack_name == "tiny").sum()
    count = packing.Counter(packing.vocabulary_path())
    for name, cap in (("tiny", 256), ("one", 1)):
        p = got[got.pack_name == name]
        assert p.groupby("container_id").n_tokens.sum().max() <= cap and not p.duplicated(["container_id", "slot"]).any() and not p.duplicated(["doc_id", "piece"]).any()
        assert p.groupby("doc_id").n_tokens.sum().to_dict() == {i: count(t) for i, t in enumerate(texts) if t}
        whole = p[p.doc_id.isin([i for i, t in enumerate(texts) if t and count(t) <= cap])]
        assert (whole.groupby("doc_id").size() == 1).all()
    assert packing.pack_all(df.limit(0), packs).count() == 0


# ---------------------------------------------------------------- 9


@pytest.mark.parametrize("copied", [True, False])
def test_garbled_majority(spark, copied):
    """More rows, or more different texts, with the garbled word than with the correct one."""
    bad = "DESCRIPCIÓN".encode("cp1252").decode("cp437")
    rows = [(i, f"DESCRIPCIÓN {i}") for i in range(20)] + [(100 + i, f"{bad} {0 if copied else i}") for i in range(60)]
    t = encodings.as_texts({"t": (spark.createDataFrame(rows, "row_id bigint, text string"), "row_id", "text")})
    assert {r.row_key for r in encodings.garbled_rows(t).collect()} == set(range(100, 160))


def test_removals_unite_items(spark):
    """Three items of 15 words each in a document of 100: 45 % leaked, no item above 20 %."""
    items = [(i, " ".join(f"item{i}w{j}" for j in range(15))) for i in range(3)]
    pad = [" ".join(f"pad{i}w{j}" for j in range(n)) for i, n in enumerate((10, 20, 25))]
    docs = [(1, " ".join(f"{p} {t}" for p, (_, t) in zip(pad, items, strict=True))), (2, f"{pad[2]} {pad[1]} {pad[0]} {items[0][1]} {pad[2]}")]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: (r.action, r.covered, [(x.begin, x.end) for x in r.spans]) for r in leaks.removals(found.unionByName(found)).collect()}
    assert got == {1: ("drop", 45, [(10, 25), (45, 60), (85, 100)]), 2: ("cut", 15, [(55, 70)])}


def test_cleaned(spark):
    item = " ".join(f"it\u00e9m{j}" for j in range(12))
    docs = [(1, f"Ｂefore, \u200ba\u0301b:\n{item.upper()}! After {' pad' * 60}"), (2, f"{'pad ' * 50}\u00c9t\u00e9 {item}. End, {item}"), (3, item), (4, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", F.lit(1).alias("spans"), F.lit(2).alias("n_removed"))
    e = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    removed = leaks.removals(leaks.leaks(d, e), most_share=0.5)
    got = {r.doc_id: r.text for r in leaks.cleaned(d, removed).collect()}
    assert got == {1: f"Ｂefore, \u200ba\u0301b:\n ! After {' pad' * 60}", 2: f"{'pad ' * 50}\u00c9t\u00e9  . End,  "}
    assert leaks.leaks(d, e).join(spark.createDataFrame([tuple(r) for r in leaks.cleaned(d, removed).select("doc_id", "text").collect()], "doc_id bigint, after string"), "doc_id").count() == 2


def test_leaks(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(20)] + [(50, None), (51, "too short"), (52, None)]
    docs = []
    for i in range(80):
        words = rng.choices(vocab, k=60)
        src = rng.choice(items[:20])[1].split()
        at, n = rng.randint(0, 25), rng.randint(8, 15)
        docs.append((i, " ".join(words[:20] + src[at : at + n] + words[20:])))
    docs += [(200, None), (201, ""), (202, items[3][1].upper().replace(" ", ",\n")), (203, "Ｗ1 x " * 30_000 + items[4][1])]
    schema = "doc_id bigint, text string"
    d = spark.createDataFrame(docs, schema).select("*", F.lit(1).alias("doc"), F.lit(1).alias("item"), F.lit(1).alias("item_id"))
    e = spark.createDataFrame(items, "item_id bigint, text string")
    fold = leaks.Folding()
    grams = defaultdict(set)
    for i, t in items:
        w = fold.words(t or "")
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    want = {(i, j) for i, t in docs for w in [fold.words(t or "")] for k in range(len(w) - 11) for j in grams.get(tuple(w[k : k + 12]), ())}
    for block in (200_000, 100):
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, e, block=block).collect()} == want
    found = {(r.doc_id, r.item_id): r for r in leaks.leaks(d, e).collect()}
    assert found[202, 3].longest == 40 and found[202, 3].covered == 40 == found[202, 3].n_words
    assert {r.doc_id: r.action for r in leaks.removals(leaks.leaks(d, e)).collect()}[202] == "drop"
    assert leaks.leaks(d.limit(0), e).count() == 0 and leaks.leaks(d, e.limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_subjects(spark):
    terms = {"food": ["dough", "oven", "flour"], "sport": ["racket", "ball", "net"]}
    rows, labels = [], []
    for i in range(60):
        s = "food" if i % 2 else "sport"
        body = " ".join(terms[s] * 3)
        rows.append((i, f"T\nABSTRACT\nabout {body}\nDESCRIPTION\nuseful when the oven is hot\nCLAIMS\n1. An assembly with {body}.", f"a{i % 3}", "o"))
        if i < 24:
            labels.append((i, s if i != 3 else "sport"))
    rows += [
        (100, "T\nABSTRACT\nabout dough oven\nCLAIMS\n1. A dough with oven and flour. 2. A racket with ball and net.", None, None), (101, "T\nABSTRACT\nracket ball net", "a1", "o"),
        (102, "", "a1", "o"), (103, None, "a1", "o"), (104, "nothing to see", "a1", "o"), (105, "T\nABSTRACT\ndough\nDESCRIPTION\ndough oven dough\nCLAIMS\n1. A racket, a ball and a net." + " A net." * 20_000, "a1", "o"),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, applicant string, source string").select("*", F.lit("x").alias("subject"), F.lit(1).alias("claims"))
    lab = spark.createDataFrame([*labels, (None, "food"), (7, None)], "doc_id bigint, subject string")
    got = defaultdict(set)
    for r in subjects.subjects_found(d, lab).collect():
        got[r.doc_id].add(r.subject)
    assert all(got[i] == {"food" if i % 2 else "sport"} for i in range(60))
    assert got[100] == {"food", "sport"} and got[101] == {"sport"} and got[105] == {"sport"} and not got[102] and not got[103] and not got[104]
    args = (d.select(F.col("doc_id").alias("id"), "text", "applicant", "source").filter("length(text) > 0"), spark.createDataFrame([("dough", "food"), ("net", "sport"), ("ball", "sport")], subjects.LEXICON))
    assert sorted(map(tuple, subjects.section_hits(*args).collect())) == sorted(map(tuple, subjects.section_hits(*args, most=0).collect()))
    # The model decides: among these documents a mention in the description is no evidence, and votes alone would say otherwise.
    votes = [((9, 9, 3, 0, 0), 60), ((3, 3, 9, 0, 0), 40), ((9, 1, 1, 0, 0), 1)]
    prior, rates = subjects.learn_rates(votes)
    p = [subjects.posterior(v, prior, rates) for v, _ in votes]
    assert p[0] > 0.9 and p[1] < 0.1 and rates[2][9][0] < rates[2][9][1]
    areas = spark.createDataFrame([("food",), ("law",)], "subject string")
    assert {r.subject: r.n_docs for r in subjects.composition(d, lab, areas).collect()} == {"food": 31, "law": 0}
    assert subjects.subjects_found(d.limit(0), lab).count() == 0 and subjects.subjects_found(d, lab.limit(0)).count() == 0
