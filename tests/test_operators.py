"""Properties of the core operators that SQL can't check."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.functions import heuristics, text
from vecquarry.operators import cluster, dist, graph, ivf, knn, metrics, model, pca, select, series, splits, teacher


def rows(spark, x, key="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} bigint, e array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x, q = unit(rng.standard_normal((300, 16))), unit(rng.standard_normal((12, 16)))
    return x, q, rows(spark, x).repartition(5).persist(), rows(spark, q, "query_id").persist()


def ids(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = r.vec_id
    return {q: [v[k] for k in sorted(v)] for q, v in out.items()}


def test_strategies_agree_with_brute_force(data):
    x, q, b, qs = data
    want = {i: list(np.lexsort((np.arange(len(x)), -np.round(x @ v, 9)))[:7]) for i, v in enumerate(q)}
    for strategy in ("blocked", "catalyst"):
        assert ids(knn.exact_topk(qs, b, 7, strategy)) == want


def test_ties_and_large_k(spark):
    b = rows(spark, np.array([[1.0, 0.0]] * 4 + [[0.0, 1.0]]))
    q = rows(spark, np.array([[1.0, 0.0]]), "query_id")
    assert ids(knn.exact_topk(q, b, 3)) == {0: [0, 1, 2]}
    assert ids(knn.exact_topk(q, b, 99)) == {0: [0, 1, 2, 3, 4]}
    assert knn.exact_topk(q.limit(0), b, 3).count() == 0
    assert knn.exact_topk(q, b.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        knn.exact_topk(q, b, 0)


def test_recall_grows_to_one(spark, data):
    _, _, b, qs = data
    c, labels = cluster.kmeans(b, 8)
    celled = b.join(labels.select("vec_id", "cell_id"), "vec_id")
    r = {x.budget: x.recall for x in metrics.recall(ivf.sweep(qs, celled, c, 5, [1, 2, 4, 8]), knn.exact_topk(qs, b, 5), 5, "budget").collect()}
    assert r[8] == 1.0 and r[1] <= r[2] <= r[4] <= r[8]


def test_index_is_stored_and_read(data, tmp_path):
    _, _, b, _ = data
    c, one = ivf.build(b, 4, str(tmp_path))
    again, two = ivf.build(b, 4, str(tmp_path))
    assert np.allclose(c, again) and one.count() == two.count() == 300


def test_imi_with_all_cells_is_exact(data):
    _, _, b, qs = data
    s = cluster.seeds(b, 3)
    assert ids(ivf.imi_search(qs, b, s[:, :8], s[:, 8:], 5, 9)) == ids(knn.exact_topk(qs, b, 5))


def test_graph_search_recall(data):
    _, _, b, qs = data
    got, want = ids(graph.search(qs, graph.build(b), 10, iterations=100)), ids(knn.exact_topk(qs, b, 10))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_pca(data):
    _, _, b, qs = data
    w, mu, var = pca.fit(b, 16)
    assert np.allclose(w @ w.T, np.eye(16), atol=1e-9) and (np.diff(var) <= 1e-12).all()
    # A full rotation leaves neighbours as they are.
    turned = pca.transform(b, w)
    assert ids(knn.exact_topk(pca.transform(qs, w, keys=("query_id",)), turned, 5, digits=6)) == ids(knn.exact_topk(qs, b, 5, digits=6))
    kept = {r.dim: r.retention for r in pca.cosine_retention(b, w, [4, 16]).collect()}
    assert kept[4] < kept[16] and abs(kept[16] - 1) < 1e-6


def test_wasserstein(data):
    x, _, b, _ = data
    assert dist.gaussian_w2(b, b) < 1e-5
    a, c = np.diag([1.0, 4.0]), np.diag([9.0, 1.0])
    assert abs(dist.w2_of_moments(np.zeros(2), a, np.array([3.0, 0.0]), c) - np.sqrt(9 + 4 + 1)) < 1e-9


def test_teachers_sum_to_one_or_zero(spark, data):
    _, _, b, qs = data
    e = knn.exact_topk(qs, b, 5)
    p = teacher.mixed_pack(e, knn.exact_topk(qs, b.filter("vec_id % 2 = 0"), 5), 3, 5, 6)
    for t in (teacher.uniform_teacher(p, e), teacher.ranked_teacher(p, e), teacher.uniform_teacher(p, e.filter("query_id < 3"))):
        for r in t.groupBy("query_id").agg(F.sum("p").alias("s")).collect():
            assert abs(r.s - 1) < 1e-9 or r.s == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    m = model.initial(6, 5)
    t = rng.standard_normal((4, 6))
    packs = [unit(rng.standard_normal((7, 6))) for _ in range(4)]
    teach = [rng.dirichlet(np.ones(7)) for _ in range(4)]
    _, g = model.gradients(m, t, packs, teach)
    for name in model.NAMES:
        for at in list(np.ndindex(m[name].shape))[:6]:
            up, down = ({k: (v.copy() if k != "alpha" else v) for k, v in m.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            want = (model.gradients(up, t, packs, teach)[0] - model.gradients(down, t, packs, teach)[0]) / 2e-6
            assert abs(want - g[name][at]) < 1e-5


def test_distributed_step_and_checkpoint(spark, data, tmp_path):
    x, _, b, qs = data
    e = knn.exact_topk(qs, b, 6)
    p = teacher.mixed_pack(e, e, 6, 0, 6)
    r = model.training_rows(qs, b, p, teacher.ranked_teacher(p, e)).persist()
    m = model.initial(16, 8)
    loss, n, g = model.step_gradients(r, m)
    one = r.collect()
    want, wg = model.gradients(m, np.array([v.e for v in one]), [np.array(v.pack) for v in one], [np.array(v.teacher) for v in one])
    assert n == 12 and abs(loss - want / 12) < 1e-9 and np.allclose(g["w1"], wg["w1"] / 12)
    trained, average, history = model.train(r, m, epochs=4, batches=2)
    assert history[-1][2] < history[0][2]
    model.save(spark, average, str(tmp_path / "c"), epoch=4)
    back, meta = model.load(spark, str(tmp_path / "c"))
    assert np.allclose(back["w2"], average["w2"]) and back["alpha"] == m["alpha"] and meta == {"epoch": "4"}


def test_text_and_settings(spark):
    s = spark.createDataFrame([("A <b> & 'c'",), (None,)], "t string").select(text.html_escape(F.col("t")).alias("x"), text.keywords(F.col("t")).alias("k")).collect()
    assert s[0].x == "A &lt;b&gt; &amp; &#39;c&#39;" and s[0].k == ["c"] and s[1].x is None and s[1].k is None
    assert heuristics.recommended("laion", 10)["ivf_nlist"] == 512 and heuristics.recommended("laion", 600_000)["batch_size"] == 1024
    assert heuristics.recommended("coco", 82_783) | {"ivf_nlist": 2048, "hnsw_M": 64, "hnsw_efC": 400, "eval_ph": True} == heuristics.recommended("coco", 82_783)
    assert [heuristics.recommended("flickr30k", n)["ivf_nlist"] for n in (9_999, 10_000, 29_000, 50_000, 50_001)] == [64, 128, 128, 128, 256]
    assert heuristics.recommended("t2i", 10)["batch_size"] == 8192 == 2 * heuristics.recommended("t2i", 10**7)["ivf_nlist"] and heuristics.recommended("other", 10) == {}
    assert heuristics.resolve_path({"default": "d"}, "x") == "d" and heuristics.resolve_path("p", "x") == "p"
    with pytest.raises(ValueError):
        heuristics.resolve_path({}, "x")


def test_evaluation(spark, data):
    from vecquarry.operators import evaluate

    _, _, b, qs = data
    r = evaluate.evaluate(b, {"baseline": qs}, ["ivf", "exact"], [2, 8], [5], cells=8).collect()
    got = {(x.backend, x.budget): x.recall for x in r}
    assert got["exact", 2] == 1.0 and got["ivf", 8] == 1.0 and got["ivf", 2] <= 1.0 and all(x.qps > 0 for x in r)
    assert evaluate.budget_gain(spark.createDataFrame(r)).count() == 0
    with pytest.raises(ValueError):
        evaluate.evaluate(b, {"baseline": qs}, ["nothing"], [1], [1])


def test_synthetic(spark):
    from vecquarry.sources import synthetic

    b, q = synthetic.smoke_set(spark, 600, 24)
    x = np.array([r.e for r in b.orderBy("vec_id").collect()])
    assert x.shape == (600, 24) and q.count() == 12 and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)
    assert abs((x @ x.T - np.eye(600)).mean()) < 0.01
    assert np.allclose(x, np.array([r.e for r in synthetic.vectors(spark, 600, 24).repartition(3).orderBy("vec_id").collect()]))


def test_block_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(v, 1)]) for i, v in enumerate(rng.standard_normal((300, 4)))]  # many ties
    b = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    q = b.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "e")
    want = sorted(map(tuple, knn.exact_topk(q, b, 7, exclude_self=True).collect()))
    monkeypatch.setattr(knn, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 30)
    monkeypatch.setattr(knn, "BANK_BLOCK", 70)
    assert sorted(map(tuple, knn.exact_topk(q, b, 7, exclude_self=True).collect())) == want
    assert sorted(map(tuple, knn.exact_topk(q, b, 7, strategy="catalyst", exclude_self=True).collect())) == want
    assert knn.exact_topk(q.limit(0), b, 7).count() == 0 == knn.exact_topk(q, b.limit(0), 7).count()


def test_graph_by_descent(spark, monkeypatch):
    """Shards too large for exact lists: recall of the descent, and of a search in several shards and query blocks."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((60, 16))
    x = centre[rng.integers(0, 60, 3000)] + 0.5 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(graph, "EXACT", 100)
    _, at = graph.descent(x, 16)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :16]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(at.tolist(), best.tolist(), strict=True)]) / 16 > 0.9
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, e array<double>")
    q = b.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "e")
    monkeypatch.setattr(graph, "QUERY_BLOCK", 25)
    hits = graph.search(q, graph.build(b, shards=3), 10, 64, exclude_self=True).collect()
    got = {}
    for r in hits:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[i] & set(best[i][:10].tolist())) for i in range(0, 3000, 50)]) / 10 > 0.9
    assert graph.search(q.limit(0), graph.build(b.limit(0)), 10, 8).count() == 0


def test_long_series_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.standard_normal())) for s, n in (("a", 230), ("b", 30), ("c", 1)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "series string, i bigint, value double")
    want = [sorted(map(str, f(df).collect())) for f in (series.moving_average, series.improvements, series.stats)]
    blocks = series.blocks
    monkeypatch.setattr(series, "blocks", lambda df, before, after: blocks(df, before, after, 17))
    assert [sorted(map(str, f(df).collect())) for f in (series.moving_average, series.improvements, series.stats)] == want


def test_stored_rotation(spark, tmp_path):
    w, mu = np.eye(3)[:2], np.array([0.1, 0.2, 0.3])
    pca.save(spark, f"file://{tmp_path}/p", w, mu, True)
    a, b, c = pca.load(spark, f"file://{tmp_path}/p")
    assert (a == w).all() and (b == mu).all() and c is True
    pca.save(spark, f"file://{tmp_path}/q", w, None, False)
    assert pca.load(spark, f"file://{tmp_path}/q")[1:] == (None, False)


def test_selection_modes(spark):
    rows = [("d", b, v, r) for b, v, r in (("ivf", "baseline", 0.5), ("ivf", "proj_ep1", 0.7), ("ivf", "proj_ep2", 0.6), ("cuvs_cagra", "baseline", 0.5), ("cuvs_cagra", "proj_ep1", 0.5), ("cuvs_cagra", "proj_ep2", 0.8))]
    scores = spark.createDataFrame(rows, "dataset string, backend string, variant string, weighted_recall double")
    got = {(r["mode"], r.chosen) for r in select.selection_summary(scores, "ivf_only", "dataset").collect()}
    assert got == {("best", "proj_ep1"), ("generalization", "proj_ep2")}
    assert [(r["mode"], r.chosen) for r in select.selection_summary(scores, "exact_k", "dataset").collect()] == [("generalization", "proj_ep1")]


def test_four_way_refuses_leaks(spark):
    c = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "image bigint, row bigint, caption string")
    with pytest.raises(ValueError, match="held-out"):
        splits.four_way(c, c.filter("image = 2"), "image", "row", "caption")
    held = spark.createDataFrame([(9, 7, "x"), (9, 8, " ")], c.schema)
    got = sorted((r.split, r.image, r.caption, r.pair) for r in splits.four_way(c, held, "image", "row", "caption").collect())
    train = {i: t for s, i, t, _ in got if s == "train"}
    assert got[0] == ("inbound", 9, "x", None) and ("test", 9, "x", 9) in got and len(got) == 6
    assert {i: t for s, i, t, _ in got if s == "val"} == {1: "b" if train[1] == "a" else "a", 2: "c"}


def test_overrides_and_heads(spark):
    df = spark.createDataFrame([("laion=3, coco: 5; bad=x laion=4 zero=0",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parse_overrides(F.col("t"))).collect()] == [{"coco": 5, "laion": 4}, {}, None]
    h = spark.range(1).select(heuristics.fit_head(F.array(F.lit(5).cast("bigint")), 3).alias("a"), heuristics.head_k(F.lit(40), F.lit(10)).alias("b"), heuristics.head_k(F.lit(4000), F.lit(600)).alias("c")).first()
    assert h.a == [5, -1, -1] and (h.b, h.c) == (128, 600)
