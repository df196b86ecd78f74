"""Problems 5 to 7: recall against brute force, edge cases, hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.llm import clusters, neighbours, overlaps
from vecquarry.llm.vechash import Hashing, decoded, encode, nearest, packed, unpacked

BROKEN = [None, [1.0] * 10, [float("nan")] * 64, [0.0] * 64, [float("inf")] + [1.0] * 63]


def groups(rng, sizes, spread=0.02):
    out = []
    for n in sizes:
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        out += [c + spread * rng.standard_normal(64) for _ in range(n)]
    return [[float(x) for x in v] for v in out]


def unit(v):
    v = np.array(v, np.float32).astype(float)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


@pytest.mark.parametrize("stored", [400_000, 40])
def test_neighbours_against_brute_force(spark, stored):
    rng = np.random.default_rng(0)
    img = groups(rng, [1] * 150 + [4] * 30 + [60, 12])
    img += [img[-1]] * 120  # a hot group of identical vectors
    shift = np.r_[3.0, np.zeros(63)]
    txt = [[float(x) for x in unit(v) + 0.2 * shift] for v in img]
    rows = [(i, v, t) for i, (v, t) in enumerate(zip(img, txt, strict=True))] + [(5000 + i, b, b) for i, b in enumerate(BROKEN)] + [(None, img[0], txt[0])]
    df = spark.createDataFrame(rows, "row_id bigint, image_features array<float>, text_features array<float>").select("*", *(F.lit(1).alias(c) for c in ("id", "kind", "vec", "nn", "cos", "r")))
    hashing = Hashing(coarse=2, tables=3, stored=stored, asked=4 * stored)
    got = {}
    for r in neighbours.similar_vectors(df, hashing=hashing).collect():
        got.setdefault((r.direction, r.row_id), set()).add(r.nn_row_id)
    x = unit(img)
    hit = want = 0
    for name, q, least in (("ii", x, 0.90), ("ti", unit(txt), 0.705)):
        s = np.round(q @ x.T, 12)
        if name == "ii":
            np.fill_diagonal(s, -1)
        for i, row in enumerate(s):
            at = np.flatnonzero(row >= least)
            best = set(at[np.lexsort((at, -row[at]))][:5].tolist())
            mine = got.get((name, i), set())
            hit, want = hit + len(best & mine), want + len(best)
            assert len(mine) <= 5 and all(row[j] >= least for j in mine)
    assert hit >= 0.98 * want
    assert neighbours.similar_vectors(df.limit(0)).count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(5)
    sizes = [1] * 80 + [2] * 10 + [3] * 10 + [40]
    img = groups(rng, sizes)
    label = np.repeat(np.arange(len(sizes)), sizes)
    order = rng.permutation(len(img))
    rows = [(i, img[j]) for i, j in enumerate(order)] + [(9000 + i, b) for i, b in enumerate(BROKEN)] + [(8000, img[0]), (8001, img[0]), (None, img[0])]
    df = spark.createDataFrame(rows, "row_id bigint, v array<float>").select("*", *(F.lit(1).alias(c) for c in ("id", "kind", "vec", "com", "cluster", "size", "w")))
    got = clusters.clusters_found({"a": (df, "row_id", "v"), "b": (df.filter("row_id < 10"), "row_id", "v")}).collect()
    of = {i: int(label[j]) for i, j in enumerate(order)} | {8000: int(label[0]), 8001: int(label[0])}
    want = {}
    for i, c in of.items():
        want.setdefault(c, []).append(i)
    want = {(min(v), i) for v in want.values() if len(v) >= 3 for i in v}
    assert {(r.first_row_id, r.row_id) for r in got if r.tab == "a"} == want
    d = clusters.described({"a": (df, "row_id", "v")}).collect()
    assert max(r["size"] for r in d) == 40 and all(1 <= len(r.typical_row_ids) <= 3 for r in d)
    assert clusters.clusters_found({"a": (df.limit(0), "row_id", "v")}).count() == 0


def test_clumps_of_near_copies_join(spark):
    """Two clumps of 20 near copies, all 6 best links of each inside, at a cosine of 0.93 from each other."""
    rng = np.random.default_rng(11)
    c, o = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    far = 0.93 * c + np.sqrt(1 - 0.93**2) * o
    img = [v + 0.001 * rng.standard_normal(64) for v in (c, far) for _ in range(20)] + list(rng.standard_normal((60, 64)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(img)], "row_id bigint, v array<float>")
    got = {(r.first_row_id, r.row_id) for r in clusters.clusters_found({"a": (df, "row_id", "v")}).collect()}
    assert got == {(0, i) for i in range(40)}


def test_recall_holds_at_any_size():
    """Estimated success for pairs of cosine 0.95, from thousands to a billion vectors, asked from one end or from both."""
    for n in (20_000, 200_000, 10**6, 10**7, 10**8, 10**9):
        h = Hashing.planned(n)
        group = int(min(42 * n**0.5, 300_000))
        assert h.success(0.95, group, 2000) >= 0.93 and h.success(0.95, group, 2000, True) >= 0.97
    assert Hashing.planned(10**9).tables * Hashing.planned(10**9).groups <= 20


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 64)).astype(np.float32) * rng.uniform(1e-6, 1e6, (2000, 1)).astype(np.float32)
    c = encode(x)
    cos, exact = decoded(c).astype(float) @ decoded(c).astype(float).T, unit(x) @ unit(x).T
    assert (np.abs(cos - exact) <= c["rest"][:, None] + c["rest"][None] + 4e-6).all() and c["rest"].max() < 1e-4
    assert (unpacked(packed(c)) == c).all() and (unpacked(packed(c).slice(7, 90)) == c[7:97]).all()


@pytest.mark.parametrize("stored", [400_000, 40])
def test_kinds_never_meet(spark, stored):
    v = np.random.default_rng(9).standard_normal((300, 64))
    df = spark.createDataFrame([(i % 2, i, True, True, [float(x) for x in v[i]]) for i in range(300)], "kind int, id bigint, stored boolean, asks boolean, vec array<float>")
    got = nearest(df, Hashing(coarse=1, tables=1, stored=stored), {0: -1.0, 1: -1.0}, 300, selfless=True, by_kind=True).collect()
    assert len(got) > 10_000 and all(r.id % 2 == r.nn % 2 for r in got)
    near = [[float(x) for x in row] for row in v + 1e-4]
    both = {"a": (spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "row_id bigint, v array<float>"), "row_id", "v"), "b": (spark.createDataFrame(list(enumerate(near)), "row_id bigint, v array<float>"), "row_id", "v")}
    assert clusters.clusters(both).filter("size > 1").count() == 0


def test_groups_whose_buckets_nobody_meets(spark):
    """An evaluation image that visits none of the buckets in its group: no pair, and no error; others are found."""
    v = Hashing.planned(3).functions(0)[0][:, 0]
    far, *pair = [[float(x) for x in s * v / np.linalg.norm(v)] for s in (1, -1, -1)]
    for train, want in (([], set()), ([pair[1]], {(1, 2)})):
        rows = [(0, "train", far), (1, "val", pair[0])] + [(2, "train", x) for x in train]
        df = spark.createDataFrame(rows, "row_id bigint, split string, b32_img array<float>").withColumn("text", F.lit(None).cast("string"))
        assert {(r.row_id_a, r.row_id_b) for r in overlaps.cross_split_pairs(df).collect()} == want


def test_sparse_groups_of_a_graph(spark):
    """Groups of one or two vectors, most of whose visitors meet no bucket, in the settings of problem 7."""
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((3000, 64)))
    x = np.r_[x, x[:200] + 0.001 * rng.standard_normal((200, 64))]
    df = spark.createDataFrame([(0, i, True, True, [float(c) for c in v]) for i, v in enumerate(x)], "kind int, id bigint, stored boolean, asks boolean, vec array<float>")
    found = nearest(df, Hashing(coarse=8), {0: 0.85}, 6, by_kind=True, selfless=True, mutual=True, joined=0.9)
    assert {(r.id, r.nn) for r in found.collect()} == {p for i in range(200) for p in ((i, i + 3000), (i + 3000, i))}


def test_modularity_decides(spark):
    """Two groups at a cosine of 0.80 and one vector midway, near all of both: one component, but two clusters."""
    rng = np.random.default_rng(12)
    c, o = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    far = 0.80 * c + 0.6 * o
    img = [v + 0.015 * rng.standard_normal(64) for v in (c, far) for _ in range(30)] + [c + far]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(img)], "row_id bigint, v array<float>")
    x = unit(img)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    links = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, b, strict=True)], "a bigint, b bigint")
    assert clusters.components(links).select("root").distinct().count() == 1
    got = {r.row: r.first for r in clusters.clusters({"a": (df, "row_id", "v")}).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == 30 for i in range(30, 60)) and got[60] in (0, 30)


def test_codes_of_some_ids(spark):
    """Only the codes that are asked for leave their task; many ids are joined with the same result."""
    codes = spark.createDataFrame([(i, bytes([i % 256])) for i in range(1000)], "id bigint, code binary")
    ids = spark.createDataFrame([(i,) for i in (5, 7, 7, 999, 5000)], "id bigint")
    few = clusters.codes_of(codes, ids)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    for got in (few, clusters.codes_of(codes, ids, most=1)):
        assert sorted((r.id, bytes(r.code)) for r in got.collect()) == [(5, b"\x05"), (7, b"\x07"), (999, b"\xe7")]
    assert clusters.codes_of(codes, ids.limit(0)).count() == 0


def test_levels_send_only_typical_codes(spark, monkeypatch):
    """Two clumps that unite on a further level: what is joined there are the codes of four members each, not all."""
    rng = np.random.default_rng(11)
    c, o = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    img = [v + 0.001 * rng.standard_normal(64) for v in (c, 0.93 * c + np.sqrt(1 - 0.93**2) * o) for _ in range(20)] + list(rng.standard_normal((60, 64)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(img)], "row_id bigint, v array<float>")
    seen, estimated = [], clusters._estimated
    monkeypatch.setattr(clusters, "_estimated", lambda pairs, typical, codes, weak: seen.append((typical.count(), codes.count())) or estimated(pairs, typical, codes, weak))
    got = {(r.first_row_id, r.row_id) for r in clusters.clusters_found({"a": (df, "row_id", "v")}).collect()}
    assert got == {(0, i) for i in range(40)} and 0 < seen[0][0] == seen[0][1] < 40


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200)]
    pairs = [tuple(map(int, p)) for p in rng.permutation(pairs)]
    got = {r.id: r.root for r in clusters.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[200] == 200


def test_word_distance():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        a, b = ([str(x) for x in rng.integers(0, 3, rng.integers(0, 8))] for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert overlaps.word_distance(a, b, 2) == min(d[-1, -1], 3)


def test_chunks_lose_no_near_text(spark):
    """All pairs within two edits, over texts of every length, from a small vocabulary with hot phrases."""
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(60)]
    base = [[str(x) for x in rng.choice(vocab, n)] for n in list(range(6, 30)) * 6]
    rows, n = [], 0
    for w in base:
        for split in ("train", "val", "test"):
            v = list(w)
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(v)))
                kind = rng.integers(0, 3)
                if kind == 0:
                    v.insert(at, str(rng.choice(vocab)))
                elif kind == 1:
                    v[at] = str(rng.choice(vocab))
                elif len(v) > 6:
                    v.pop(at)
            rows.append((n, split, " ".join(v), None))
            n += 1
    rows += [(n, "val", None, BROKEN[1]), (n + 1, None, rows[0][2], None), (n + 2, "test", "", None), (None, "val", rows[0][2], None)]
    df = spark.createDataFrame(rows, "row_id bigint, split string, text string, b32_img array<float>").select("*", *(F.lit(1).alias(c) for c in ("nid", "side", "t", "seq", "row", "h1")))
    got = {(r.row_id_a, r.row_id_b) for r in overlaps.cross_split_pairs(df).collect()}
    want = set()
    for a in rows[:n]:
        for b in rows[:n]:
            if a[1] == "train" and b[1] in ("val", "test") and overlaps.word_distance(a[2].split(), b[2].split(), 2) <= 2:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want
    assert overlaps.cross_split_pairs(df.limit(0)).count() == 0


def test_cross_split_ways(spark):
    rng = np.random.default_rng(3)
    v = groups(rng, [1, 1])
    near = [float(x) for x in np.array(v[0]) + 1e-4 * rng.standard_normal(64)]
    fields = "name: red; size: 12; brand: Foo"
    rows = [
        (0, "train", "one two three four five six", v[0]), (1, "val", "ONE, two three four five six!", near), (2, "test", "one two three four seven eight", None), (3, "test", "one two nine four seven eight", v[1]),
        (4, "train", fields, None), (5, "val", "brand=foo; size=12; name=Red", None), (6, "val", "name: red; size: 13; brand: Foo", None), (7, "train", "one two three four five six", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, split string, text string, b32_img array<float>")
    got = {}
    for r in overlaps.cross_split_pairs(df).collect():
        got.setdefault((r.row_id_a, r.row_id_b), set()).add(r.way)
    assert got == {(0, 1): {"copy", "image"}, (1, 7): {"copy"}, (0, 2): {"near"}, (2, 7): {"near"}, (4, 5): {"copy"}}
    rep = {(r.split, r.source): r.n_overlapping for r in overlaps.overlap_report(df.withColumn("source", F.lit("s"))).collect()}
    assert rep == {("val", "s"): 2, ("test", "s"): 1}
    part = {r.row_id: r.overlap for r in overlaps.overlap_fractions(df).collect()}
    assert part[1] == 1 and part[5] == 1 and part[6] == 0 and 0 < part[2] < 1


def test_running_text_with_the_words_of_a_list(spark):
    """A list of named fields takes no near partners away from a running text of the same words, and gets none itself."""
    texts = [
        ("train", "name: red; size: 12; brand: foo"), ("val", "Name red, size 12, brand foo."), ("train", "name red size 13 brand foo"), ("test", "brand foo name red size 12"),
        ("test", "size=12; brand=foo; name=red"), ("train", "brand foo name red size 13"),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row_id bigint, split string, text string").withColumn("b32_img", F.lit(None).cast("array<float>"))
    got = {}
    for r in overlaps.cross_split_pairs(df).collect():
        got.setdefault(r.way, set()).add((r.row_id_a, r.row_id_b))
    assert got == {"copy": {(0, 1), (0, 4)}, "near": {(1, 2), (3, 5)}}
    part = {r.row_id: r.overlap for r in overlaps.overlap_fractions(df).collect()}
    assert part[1] == 1 and part[4] == 1 and 0 < part[3] < 1
