"""The query catalogue: every operator as a query over whole test tables, with its SQL twin where SQL can express it.

Searches take every row whose id is divisible by 50 as a query, against all other rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecquarry.functions import heuristics as H
from vecquarry.functions import text as TX
from vecquarry.functions import vec as V
from vecquarry.operators import cluster, dist, evaluate, graph, ivf, knn, loss, metrics, model, pca, select, series, splits, teacher
from vecquarry.session import checkpoint_dir, cut, table

K, CELLS, DIM = 10, 16, 64
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- shared inputs


def bank(spark: SparkSession, d: str) -> DataFrame:
    return knn.unit_vectors(table(spark, d, "embeddings", "vec_id", "embedding"))


def asked(b: DataFrame) -> DataFrame:
    return b.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "e")


def moved(b: DataFrame) -> DataFrame:
    """Stand-in for projected queries: each mixed with the vector of the next id."""
    nxt = b.select((F.col("vec_id") - 1).alias("query_id"), F.col("e").alias("o"))
    m = asked(b).join(nxt, "query_id").select("query_id", V.mix(F.col("e"), F.col("o"), 0.3).alias("m"))
    return m.select("query_id", V.l2_normalize(F.col("m")).alias("e"))


def exact(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    b = bank(spark, d)
    return knn.exact_topk(asked(b), b, k, exclude_self=True)


def student(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    b = bank(spark, d)
    return knn.exact_topk(moved(b), b, k, exclude_self=True)


# SQL pieces of the same inputs
def unit_sql(x: str) -> str:
    return f"list_transform({x}, lambda y: y / (sqrt(list_inner_product({x}, {x})) + 1e-8))"


N = f"n AS (SELECT vec_id, label, {unit_sql('v')} e FROM (SELECT vec_id, label, list_transform(embedding, lambda y: y::DOUBLE) v FROM embeddings))"
Q = "q AS (SELECT vec_id query_id, e FROM n WHERE vec_id % 50 = 0)"
M = f"m AS (SELECT query_id, {unit_sql('w')} e FROM (SELECT query_id, list_transform(list_zip(q.e, n.e), lambda z: (1.0::DOUBLE - 0.3::DOUBLE) * z[1] + 0.3::DOUBLE * z[2]) w FROM q JOIN n ON n.vec_id = q.query_id + 1))"


def hits_sql(name: str, src: str, k: int = K) -> str:
    return (
        f"{name} AS (SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER rank "
        f"FROM (SELECT query_id, vec_id, round(list_inner_product({src}.e, n.e), 9) score FROM {src} JOIN n ON n.vec_id <> {src}.query_id)) WHERE rank <= {k})"
    )


BASE = ", ".join(["WITH " + N, Q, hits_sql("exact", "q")])
BOTH = ", ".join([BASE, M, hits_sql("student", "m")])


def lloyd_sql(rounds: int) -> str:
    out = [f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER cell_id, e c FROM (SELECT vec_id, e FROM n ORDER BY vec_id LIMIT {CELLS}))"]
    for i in range(rounds + 1):
        out.append(
            f"a{i} AS (SELECT vec_id, e, cell_id, s cell_score FROM (SELECT vec_id, e, cell_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell_id) r "
            f"FROM (SELECT vec_id, e, cell_id, round(list_inner_product(e, c), 9) s FROM n, c{i})) WHERE r = 1)"
        )
        if i < rounds:
            out.append(f"s{i} AS (SELECT cell_id, p, sum(x) v FROM (SELECT cell_id, unnest(e) x, generate_subscripts(e, 1) p FROM a{i}) GROUP BY cell_id, p)")
            out.append(f"c{i + 1} AS (SELECT cell_id, {unit_sql('l')} c FROM (SELECT cell_id, list(v ORDER BY p) l FROM s{i} GROUP BY cell_id))")
    return ", ".join(out)


def centroids(b: DataFrame, rounds: int):
    return cluster.lloyd(b, cluster.seeds(b, CELLS), rounds)


# ---------------------------------------------------------------- vector functions


@query("WITH " + N + " SELECT vec_id, list_transform(e, lambda y: round(y, 9)) e FROM n")
def l2_normalize(spark, d):
    return bank(spark, d).select("vec_id", F.transform("e", lambda x: F.round(x, 9)).alias("e"))


NORMS = "SELECT sqrt(list_inner_product(v, v)) s FROM (SELECT list_transform(embedding, lambda y: y::DOUBLE) v FROM embeddings)"


@query(f"SELECT round(avg(s), 9) mean_norm, round(min(s), 9) min_norm, round(max(s), 9) max_norm, bool_and(abs(s - 1) <= 1e-4 + 1e-5) all_unit FROM ({NORMS})")
def unit_norm_stats(spark, d):
    return V.unit_norm_stats(table(spark, d, "embeddings", "embedding"), "embedding")


@query(f"SELECT coalesce(bool_and(isfinite(s) AND abs(s - 1) <= 1e-3), true) is_normalized FROM ({NORMS})")
def is_normalized(spark, d):
    return V.is_normalized(table(spark, d, "embeddings", "embedding"), "embedding")


@query("WITH " + N + " SELECT a.vec_id, round(list_inner_product(a.e, b.e), 9) cosine, round(list_distance(a.e, b.e), 9) distance FROM n a JOIN n b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    b = bank(spark, d)
    nxt = b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("o"))
    return b.join(nxt, "vec_id").select("vec_id", F.round(V.dot(F.col("e"), F.col("o")), 9).alias("cosine"), F.round(V.l2_distance(F.col("e"), F.col("o")), 9).alias("distance"))


def moves(spark, d):
    b = bank(spark, d)
    j = asked(b).join(moved(b).select("query_id", F.col("e").alias("m")), "query_id")
    return j.select("query_id", V.dot(F.col("e"), F.col("m")).alias("cos"), V.l2_distance(F.col("e"), F.col("m")).alias("dist"))


MOVES = ", ".join(["WITH " + N, Q, M, "mv AS (SELECT query_id, list_inner_product(q.e, m.e) cos, list_distance(q.e, m.e) dist FROM q JOIN m USING (query_id))"])


@query(MOVES + " SELECT count(*) n, round(avg(dist), 9) mean_move, round(max(dist), 9) max_move FROM mv")
def displacement_stats(spark, d):
    return moves(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("dist"), 9).alias("mean_move"), F.round(F.max("dist"), 9).alias("max_move"))


@query()
def bank_fingerprint(spark, d):
    return V.bank_fingerprint(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


# ---------------------------------------------------------------- exact search


@query(BASE + " SELECT * FROM exact")
def exact_topk(spark, d):
    return exact(spark, d)


@query(BASE + " SELECT * FROM exact")
def exact_topk_catalyst(spark, d):
    b = bank(spark, d)
    return knn.exact_topk(asked(b), b, K, strategy="catalyst", exclude_self=True)


@query(BASE + " SELECT query_id, list(vec_id ORDER BY rank) cand FROM exact GROUP BY query_id")
def candidate_pack(spark, d):
    return knn.candidate_pack(exact(spark, d), K)


@query(BASE + " SELECT query_id, rank, vec_id, score, label FROM exact LEFT JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)")
def hydrated_results(spark, d):
    return knn.hydrate(exact(spark, d), table(spark, d, "embeddings", "vec_id", "label"), "label").select("query_id", "rank", "vec_id", "score", "label")


def _valid_sql(c: str) -> str:
    return f"{c} IS NOT NULL AND len({c}) = 64 AND len(list_filter({c}, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter({c}, lambda y: y <> 0)) > 0"


def _unit_of(c: str, where: str) -> str:
    return f"SELECT row_id, {unit_sql('v')} e FROM (SELECT row_id, list_transform({c}, lambda y: y::DOUBLE) v FROM laion_cache WHERE {_valid_sql(c)} {where})"


def valid_vector(c: str):
    v = F.col(c)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == DIM) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


@query(
    f"WITH x AS ({_unit_of('image_features', '')}), t AS ({_unit_of('text_features', 'AND row_id % 50 = 0')}) SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, "
    f"(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER rank FROM (SELECT t.row_id query_id, x.row_id vec_id, round(list_inner_product(t.e, x.e), 9) score FROM t, x)) WHERE rank <= {K}"
)
def text_to_image_topk(spark, d):
    df = table(spark, d, "laion_cache", "row_id", "image_features", "text_features")
    images = knn.unit_vectors(df.filter(valid_vector("image_features")), "row_id", "image_features")
    texts = knn.unit_vectors(df.filter(valid_vector("text_features")).filter("row_id % 50 = 0"), "row_id", "text_features")
    return knn.exact_topk(texts.withColumnRenamed("vec_id", "query_id"), images, K)


# ---------------------------------------------------------------- cells, inverted file, multi-index, graph


@query(f"WITH {N}, {lloyd_sql(0)} SELECT vec_id, cell_id, cell_score FROM a0")
def cell_assign(spark, d):
    b = bank(spark, d)
    return cluster.assign(b, centroids(b, 0))


@query(f"WITH {N}, {lloyd_sql(3)} SELECT vec_id, cell_id, cell_score FROM a3")
def lloyd_3_rounds(spark, d):
    b = bank(spark, d)
    return cluster.assign(b, centroids(b, 3))


@query(f"WITH {N}, {lloyd_sql(1)} SELECT cell_id, count(*) n FROM a1 GROUP BY cell_id")
def cell_sizes(spark, d):
    b = bank(spark, d)
    return cluster.assign(b, centroids(b, 1)).groupBy("cell_id").agg(F.count("*").alias("n"))


@query()
def kmeans_converged(spark, d):
    b = bank(spark, d)
    return cluster.kmeans(b, CELLS)[1].select("vec_id", "cell_id", F.round("cell_score", 6).alias("cell_score"))


SPILL = (
    f"WITH {N}, {lloyd_sql(1)}, o AS (SELECT * FROM (SELECT vec_id, e, cell_id, c, (row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell_id)) r FROM (SELECT vec_id, e, cell_id, c, "
    "round(list_inner_product(e, c), 9) s FROM n, c1)) WHERE r <= 8), own AS (SELECT vec_id, cell_id, list_transform(list_zip(e, c), lambda z: z[1] - z[2]) d FROM o WHERE r = 1), "
    f"u AS (SELECT vec_id, cell_id, {unit_sql('d')} d FROM own), w AS (SELECT o.vec_id, u.cell_id, o.cell_id spill, u.d, list_transform(list_zip(o.e, o.c), lambda z: z[1] - z[2]) f FROM o JOIN u USING (vec_id) WHERE o.r > 1), "
    "k AS (SELECT vec_id, cell_id, spill, round(list_inner_product(f, d) * list_inner_product(f, d) + 0.1 * list_inner_product(f, f), 9) cost FROM w) "
)


@query(SPILL + "SELECT vec_id, cell_id, spill spill_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, spill) r FROM k) WHERE r = 1")
def spill_cell(spark, d):
    b = bank(spark, d)
    return cluster.spill_cells(b, centroids(b, 1))


TARGET = f"{BASE}, {lloyd_sql(1)}, t AS (SELECT query_id, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY query_id) c FROM exact JOIN a1 USING (vec_id) GROUP BY query_id, cell_id)"


@query(TARGET + " SELECT query_id, cell_id, round(c, 9) target FROM t")
def cell_target(spark, d):
    b = bank(spark, d)
    return cluster.cell_targets(exact(spark, d), cluster.assign(b, centroids(b, 1)))


@query(
    SPILL.replace("WITH " + N, BASE)
    + ", sp AS (SELECT vec_id, spill FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, spill) r FROM k) WHERE r = 1), t AS (SELECT query_id, cell_id, "
    "0.95 * count(*) / sum(count(*)) OVER (PARTITION BY query_id) c FROM exact JOIN a1 USING (vec_id) GROUP BY query_id, cell_id), x AS (SELECT query_id, cell_id, 0.05 / count(*) OVER (PARTITION BY query_id) c "
    "FROM (SELECT DISTINCT query_id, spill cell_id FROM exact JOIN sp USING (vec_id))), a AS (SELECT query_id, cell_id, sum(c) c FROM (SELECT * FROM t UNION ALL SELECT * FROM x) GROUP BY ALL) "
    "SELECT query_id, cell_id, round(c / sum(c) OVER (PARTITION BY query_id), 9) target FROM a"
)
def cell_target_spill(spark, d):
    b = bank(spark, d)
    c = centroids(b, 1)
    return cluster.cell_targets(exact(spark, d), cluster.assign(b, c), cluster.spill_cells(b, c))


def celled(b: DataFrame, c) -> DataFrame:
    return b.join(cluster.assign(b, c).select("vec_id", "cell_id"), "vec_id")


PROBE = (
    f"{BASE}, {lloyd_sql(1)}, pr AS (SELECT query_id, cell_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cell_id))::INTEGER probe FROM (SELECT query_id, cell_id, round(list_inner_product(e, c), 9) s FROM q, c1)), "
    "sc AS (SELECT pr.query_id, probe, a1.vec_id, round(list_inner_product(q.e, a1.e), 9) score FROM pr JOIN q USING (query_id) JOIN a1 USING (cell_id) WHERE a1.vec_id <> pr.query_id)"
)


@query(PROBE + f" SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER rank FROM sc WHERE probe <= 4) WHERE rank <= {K}")
def ivf_topk_nprobe_4(spark, d):
    b = bank(spark, d)
    c = centroids(b, 1)
    return ivf.search(asked(b), celled(b, c), c, K, 4, exclude_self=True)


BUDGETS = [1, 2, 4, 8, 16]


@query(
    PROBE + f", bu AS (SELECT unnest({BUDGETS})::INTEGER budget), top AS (SELECT * FROM (SELECT budget, query_id, vec_id, row_number() OVER (PARTITION BY budget, query_id ORDER BY score DESC, vec_id) r FROM sc JOIN bu ON probe <= budget) "
    f"WHERE r <= {K}) SELECT budget, {K}::INTEGER k, round(count(*) / ({K} * (SELECT count(*) FROM q)), 9) recall FROM top JOIN exact USING (query_id, vec_id) GROUP BY budget"
)
def ivf_budget_sweep_recall(spark, d):
    b = bank(spark, d)
    c = centroids(b, 1)
    return metrics.recall(ivf.sweep(asked(b), celled(b, c), c, K, BUDGETS, exclude_self=True), exact(spark, d), K, "budget")


HALVES = f"WITH {N}, h AS (SELECT vec_id, e[1:32] a, e[33:64] b FROM n), k0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER cell_id, a, b FROM (SELECT * FROM h ORDER BY vec_id LIMIT 4)), "
PICK = "{x} AS (SELECT vec_id, cell_id FROM (SELECT vec_id, cell_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell_id) r FROM (SELECT vec_id, cell_id, round(list_inner_product(h.{x}, k0.{x}), 9) s FROM h, k0)) WHERE r = 1)"


@query(HALVES + PICK.format(x="a") + ", " + PICK.format(x="b") + " SELECT a.vec_id, a.cell_id c1, b.cell_id c2 FROM a JOIN b USING (vec_id)")
def imi_assign(spark, d):
    b = bank(spark, d)
    s = cluster.seeds(b, 4)
    return ivf.imi_assign(b, s[:, : DIM // 2], s[:, DIM // 2 :])


@query()
def imi_topk(spark, d):
    b = bank(spark, d)
    s = cluster.seeds(b, 4)
    return ivf.imi_search(asked(b), b, s[:, : DIM // 2], s[:, DIM // 2 :], K, 6)


@query(
    f"WITH {N}, p AS (SELECT a.vec_id, b.vec_id nn, round(list_inner_product(a.e, b.e), 9) s FROM n a JOIN n b ON a.vec_id <> b.vec_id), k AS (SELECT vec_id, nn, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nn) r FROM p) WHERE r <= 64), "
    "u AS (SELECT vec_id, nn, s FROM k UNION SELECT nn, vec_id, s FROM k) SELECT 0::INTEGER shard, vec_id, nn, r::INTEGER r FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nn) r FROM u) WHERE r <= 32"
)
def graph_index(spark, d):
    """In long form; up to ``graph.EXACT`` vectors of a shard have exact lists."""
    g = graph.build(bank(spark, d))
    return g.select("shard", "vec_id", F.posexplode("out").alias("r", "nn")).select("shard", "vec_id", "nn", (F.col("r") + 1).alias("r"))


@query()
def graph_topk(spark, d):
    b = bank(spark, d)
    return graph.search(asked(b), cut(graph.build(b)), K, iterations=64, itopk=64, exclude_self=True)


# ---------------------------------------------------------------- metrics


@query(BOTH + f" SELECT {K}::INTEGER k, round(count(*) / ({K} * (SELECT count(*) FROM q)), 9) recall FROM student JOIN exact USING (query_id, vec_id)")
def recall_at_k(spark, d):
    return metrics.recall(student(spark, d), exact(spark, d), K)


@query(BOTH + " SELECT 5::INTEGER k, round(count(*) / (5 * (SELECT count(*) FROM q)), 9) recall FROM student s JOIN exact e USING (query_id, vec_id) WHERE s.rank <= 5 AND e.rank <= 5")
def recall_at_5(spark, d):
    return metrics.recall(student(spark, d), exact(spark, d), 5)


@query(BASE + f" SELECT {K}::INTEGER k, round(avg(CASE WHEN EXISTS (SELECT 1 FROM exact x WHERE x.query_id = q.query_id AND x.vec_id = (q.query_id + 1)) THEN 1 ELSE 0 END), 9) pair_hit FROM q")
def pair_hit_at_k(spark, d):
    pairs = asked(bank(spark, d)).select("query_id", (F.col("query_id") + 1).alias("gt_vec_id"))
    return metrics.pair_hit(exact(spark, d), pairs, K)


# ---------------------------------------------------------------- packs, teachers, losses

PACK = f"{BOTH}, pk AS (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY p))::INTEGER pos FROM (SELECT query_id, vec_id, min(p) p FROM (SELECT query_id, vec_id, rank p FROM exact WHERE rank <= 8 UNION ALL SELECT query_id, vec_id, rank + 8 FROM student) GROUP BY ALL)), pack AS (SELECT * FROM pk WHERE pos <= 12), hd AS (SELECT pack.query_id, pos, pack.vec_id, coalesce(score, -1e9) head_score FROM pack LEFT JOIN student USING (query_id, vec_id)), "
TEACH = (
    PACK + "ex AS (SELECT pack.*, e.rank - 1 r FROM pack LEFT JOIN (SELECT * FROM exact WHERE rank <= 5) e USING (query_id, vec_id)), "
    "tu AS (SELECT query_id, pos, vec_id, CASE WHEN count(r) OVER w > 0 THEN (r IS NOT NULL)::INTEGER::DOUBLE / count(r) OVER w ELSE 0 END p FROM ex WINDOW w AS (PARTITION BY query_id)), "
    "tr AS (SELECT query_id, pos, vec_id, x / (sum(x) OVER (PARTITION BY query_id) + 1e-12) p FROM (SELECT *, coalesce(exp(-0.15 * r), 0) x FROM ex)), "
    "ta AS (SELECT query_id, pos, vec_id, z / sum(z) OVER (PARTITION BY query_id) p FROM (SELECT *, exp((head_score - max(head_score) OVER (PARTITION BY query_id)) / 0.07) z FROM hd)), "
    "tm AS (SELECT query_id, pos, vec_id, m / (sum(m) OVER (PARTITION BY query_id) + 1e-12) p FROM (SELECT ta.query_id, ta.pos, ta.vec_id, 0.9 * ta.p + (1 - 0.9) * tr.p m FROM ta JOIN tr USING (query_id, vec_id))), "
    "st AS (SELECT query_id, pos, vec_id, round(list_inner_product(m.e, n.e), 9) score FROM pack JOIN m USING (query_id) JOIN n USING (vec_id)) "
)


class Lists:
    """Exact and student lists of a query, searched once, and what is made of them."""

    def __init__(self, spark, d):
        b = bank(spark, d)
        asks = asked(b).select("query_id", "e", F.lit(0).alias("m")).unionByName(moved(b).select("query_id", "e", F.lit(1).alias("m")))
        # Both variants in one pass over the bank: the variant is the lowest bit of the query's number.
        hits = knn.exact_topk(asks.select((F.col("query_id") * 2 + F.col("m")).alias("query_id"), "e"), b, K + 1)
        hits = hits.select(F.floor(F.col("query_id") / 2).alias("query_id"), "vec_id", "score", (F.col("query_id") % 2).alias("m")).filter("vec_id != query_id")
        w = Window.partitionBy("m", "query_id").orderBy(F.desc("score"), "vec_id")
        hits = cut(hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= K))
        self.bank, self.moved = b, moved(b)
        self.exact, self.student = (hits.filter(F.col("m") == i).select("query_id", "rank", "vec_id", "score") for i in (0, 1))
        self.pack = cut(teacher.mixed_pack(self.exact, self.student, 8, K, 12))

    def teachers(self):
        p, e = self.pack, self.exact.filter("rank <= 5")
        ann = teacher.ann_teacher(teacher.head_scores(p, self.student))
        ranked = teacher.ranked_teacher(p, e)
        return {"uniform": teacher.uniform_teacher(p, e), "ranked": ranked, "ann": ann, "mixed": teacher.mixed_teacher(ann, ranked, 0.9)}

    def scores(self):
        j = self.pack.join(self.moved.select("query_id", F.col("e").alias("qe")), "query_id").join(self.bank, "vec_id")
        return j.select("query_id", "pos", "vec_id", F.round(V.dot(F.col("qe"), F.col("e")), 9).alias("score"))


@query(PACK.rstrip(", ") + " SELECT query_id, pos, vec_id FROM pack")
def mixed_pack_dedupe(spark, d):
    return Lists(spark, d).pack


@query(PACK.rstrip(", ") + " SELECT query_id, pos, vec_id, head_score FROM hd")
def head_score_lookup(spark, d):
    lists = Lists(spark, d)
    return teacher.head_scores(lists.pack, lists.student)


def _teacher(which: str):
    return lambda spark, d: Lists(spark, d).teachers()[which].withColumn("p", F.round("p", 9))


for _n, _t, _s in (("teacher_uniform", "uniform", "tu"), ("teacher_ranked", "ranked", "tr"), ("teacher_ann_softmax", "ann", "ta"), ("teacher_mixed", "mixed", "tm")):
    query(TEACH + f"SELECT query_id, pos, vec_id, round(p, 9) p FROM {_s}", _n)(_teacher(_t))

KL_SQL = (
    TEACH + ", j AS (SELECT query_id, p / (sum(p) OVER w + 1e-12) t, (score - max(score) OVER w) / 0.07 z FROM st JOIN tm USING (query_id, vec_id) WINDOW w AS (PARTITION BY query_id)), "
    "l AS (SELECT query_id, t, z - ln(sum(exp(z)) OVER (PARTITION BY query_id)) lq FROM j), kl AS (SELECT round(avg(x) * 0.07 * 0.07, 9) loss FROM (SELECT sum(CASE WHEN t > 0 THEN t * (ln(t) - lq) ELSE 0 END) x FROM l GROUP BY query_id)) "
)


@query(KL_SQL + "SELECT loss FROM kl")
def loss_kld(spark, d):
    lists = Lists(spark, d)
    return loss.listwise_kl(lists.scores(), lists.teachers()["mixed"])


GAP_SQL = TEACH + ", g AS (SELECT query_id, max(score) FILTER (r = 5) a, max(score) FILTER (r = 6) b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) r FROM st) GROUP BY query_id) "


@query(GAP_SQL + "SELECT round(coalesce(avg(greatest(0, 0.05 - (a - b))), 0), 9) loss FROM g WHERE b IS NOT NULL")
def loss_gap(spark, d):
    return loss.frontier_gap(Lists(spark, d).scores(), 5, loss.gap_margin(10))


@query(MOVES + " SELECT round(avg(greatest(0, 0.95 - cos)), 9) loss FROM mv")
def loss_cone(spark, d):
    return loss.cone_identity(moves(spark, d), H.cone_threshold(F.lit(10), F.lit(1)))


@query(MOVES + " SELECT round(avg(dist * dist), 9) loss FROM mv")
def loss_legacy_identity(spark, d):
    return loss.legacy_identity(moves(spark, d))


@query(MOVES + " SELECT round(avg(greatest(0, dist - 0.2 * sqrt(64 / 512))), 9) loss FROM mv")
def loss_trust_region(spark, d):
    return loss.trust_region(moves(spark, d), DIM)


@query(
    BOTH + ", po AS (SELECT query_id, exp(-0.1 * (rank - 1)) w, unnest(e) x, generate_subscripts(e, 1) i FROM exact JOIN n USING (vec_id) WHERE rank <= 8), ba AS (SELECT query_id, i, sum(w * x) / sum(w) x FROM po GROUP BY ALL), "
    "bu AS (SELECT query_id, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY query_id)), 1e-12) b FROM ba), tq AS (SELECT query_id, unnest(e) t, generate_subscripts(e, 1) i FROM q), mq AS (SELECT query_id, unnest(e) m, generate_subscripts(e, 1) i FROM m), "
    "c AS (SELECT query_id, m, (1 - 0.15) * t + 0.15 * b c FROM bu JOIN tq USING (query_id, i) JOIN mq USING (query_id, i)), cu AS (SELECT query_id, m, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY query_id)), 1e-12) c FROM c) "
    "SELECT round(avg(x), 9) loss FROM (SELECT sum((m - c) * (m - c)) x FROM cu GROUP BY query_id)"
)
def loss_barycentric(spark, d):
    b = bank(spark, d)
    return loss.barycentric_identity(moved(b), asked(b), exact(spark, d), b)


CELL_CE = (
    f"{BOTH}, {lloyd_sql(1)}, y AS (SELECT query_id, cell_id, count(*) / sum(count(*)) OVER (PARTITION BY query_id) t FROM exact JOIN a1 USING (vec_id) GROUP BY query_id, cell_id), "
    "cs AS (SELECT query_id, cell_id, (s - max(s) OVER (PARTITION BY query_id)) / 0.07 z FROM (SELECT query_id, cell_id, round(list_inner_product(e, c), 9) s FROM m, c1)), "
    "lq AS (SELECT query_id, cell_id, z - ln(sum(exp(z)) OVER (PARTITION BY query_id)) lq FROM cs) "
)


@query(CELL_CE + "SELECT round(avg(x) * 0.07 * 0.07, 9) loss FROM (SELECT sum(-t * lq) x FROM y JOIN lq USING (query_id, cell_id) GROUP BY query_id)")
def loss_cell_ce(spark, d):
    b = bank(spark, d)
    c = centroids(b, 1)
    cells = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cell_id int, c array<double>")
    scores = moved(b).crossJoin(F.broadcast(cells)).select("query_id", "cell_id", F.round(V.dot(F.col("e"), F.col("c")), 9).alias("score"))
    return loss.cell_cross_entropy(scores, cluster.cell_targets(exact(spark, d), cluster.assign(b, c)))


@query("SELECT epoch, round(1.0 * 0.5 + 0.1 * 0.2 + 0.1 * 0.03 + 0.1 * (1 - 0.4 * least(1, epoch / 3)) * 0.7 + 0.5 * 0.1 * least(1, greatest(0, (epoch - 1) / 2)) * 0.05, 9) total FROM (SELECT unnest([1, 2, 3, 4])::INTEGER epoch)")
def loss_total(spark, d):
    e = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "epoch int")
    parts = [F.lit(x) for x in (0.5, 0.2, 0.03, 0.7, 0.05)]
    return e.select("epoch", F.round(loss.total(*parts, F.col("epoch")), 9).alias("total"))


# ---------------------------------------------------------------- schedules and heuristics

SCHEDULE = "(SELECT b::INTEGER budget, e::INTEGER epoch FROM (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90, 100]) b), (SELECT unnest([1, 2, 3]) e))"


@query(
    "SELECT budget, epoch, round(CASE WHEN epoch = 1 THEN least(base, CASE WHEN budget <= 20 THEN 0.6 WHEN budget <= 30 THEN 0.7 ELSE 1 END) ELSE base END, 9) lambda_ann, least(256, greatest(96, 6 * budget))::INTEGER pack_size, "
    "round(least(1, greatest(0, (epoch - 1) / 2)), 9)::DOUBLE student_share, round(least(greatest(0.85, 0.95 - 0.1 * (budget - 10) / 90), greatest(0.8, 0.95 - 0.15 * (epoch - 1) / 10)), 9)::DOUBLE cone_threshold "
    f"FROM (SELECT *, greatest(0.6, 0.9 - (budget - 10) * 0.3 / 90)::DOUBLE base FROM {SCHEDULE})"
)
def budget_schedules(spark, d):
    s = spark.range(1, 11).select((F.col("id") * 10).cast("int").alias("budget")).crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("epoch")))
    b, e = F.col("budget"), F.col("epoch")
    return s.select("budget", "epoch", F.round(H.lambda_ann(b, e), 9).alias("lambda_ann"), H.pack_size(b).alias("pack_size"), F.round(H.student_share(e), 9).alias("student_share"), F.round(H.cone_threshold(b, e), 9).alias("cone_threshold"))


@query(
    "SELECT n, least(greatest(16, floor(4 * sqrt(n))::INTEGER), 65536)::INTEGER nlist_sqrt, (CASE WHEN n < 100000 THEN 1024 WHEN n < 1000000 THEN 2048 WHEN n < 10000000 THEN 4096 ELSE 8192 END)::INTEGER nlist_bucketed, "
    "least(4096, greatest(256, 110, greatest(512, least(2048, floor(0.0005 * n)::INTEGER))))::INTEGER em_candidates, least(140, greatest(60, round(60 + 20 * greatest(0, log10(n) - 6))::INTEGER))::INTEGER em_iterations "
    "FROM (SELECT unnest([1000, 50000, 500000, 3000000, 10000000, 100000000])::BIGINT n)"
)
def nlist_heuristics(spark, d):
    s = spark.createDataFrame([(n,) for n in (1000, 50_000, 500_000, 3_000_000, 10_000_000, 100_000_000)], "n bigint")
    n = F.col("n")
    return s.select("n", H.nlist_sqrt(n, F.lit(65536)).alias("nlist_sqrt"), H.nlist_bucketed(n).alias("nlist_bucketed"), H.em_candidates(n, F.lit(46)).alias("em_candidates"), H.em_iterations(n).alias("em_iterations"))


# ---------------------------------------------------------------- result tables and selection

FIN = "recall IS NOT NULL AND isfinite(recall)"
G = "dataset, backend, at_k"
WR = f"w AS (SELECT {G}, variant, round(sum(budget * r) / sum(budget), 9) weighted_recall FROM (SELECT {G}, variant, budget, avg(CASE WHEN {FIN} THEN recall ELSE 0 END) r FROM sweep_results GROUP BY ALL) GROUP BY ALL)"


def results(spark, d):
    return table(spark, d, "sweep_results")


def weighted(spark, d):
    return metrics.weighted_recall(results(spark, d), "dataset", "backend", "at_k", "variant")


@query(f"WITH {WR} SELECT * FROM w")
def weighted_recall(spark, d):
    return weighted(spark, d)


@query(f"SELECT {G}, variant, round(avg(recall), 9) avg_recall, round(max(recall), 9) max_recall, round(min(recall), 9) min_recall FROM sweep_results WHERE {FIN} GROUP BY ALL")
def recall_summary(spark, d):
    return metrics.recall_summary(results(spark, d), "dataset", "backend", "at_k", "variant")


@query(
    "SELECT backend, variant, budget, count(*) n_runs, round(avg(qps), 6) qps_mean, round(median(qps), 6) qps_median, round(stddev_pop(qps), 6) qps_std, round(min(qps), 6) qps_min, round(max(qps), 6) qps_max "
    "FROM sweep_results WHERE qps IS NOT NULL AND isfinite(qps) GROUP BY ALL"
)
def qps_statistics(spark, d):
    return metrics.qps_stats(results(spark, d), "backend", "variant", "budget")


@query(f"WITH {WR} SELECT {G}, variant best_variant, weighted_recall FROM (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY weighted_recall DESC, variant) r FROM w WHERE starts_with(variant, 'proj_')) WHERE r = 1")
def best_checkpoint(spark, d):
    return select.best_checkpoint(weighted(spark, d), "dataset", "backend", "at_k")


@query(
    f"WITH {WR}, o AS (SELECT dataset, at_k, variant, weighted_recall other FROM w WHERE backend = 'ivf'), s AS (SELECT dataset, at_k, variant, weighted_recall own FROM w WHERE backend = 'cagra'), "
    "v AS (SELECT o.*, own, b.other base, max(own) OVER (PARTITION BY dataset, at_k) best_own FROM o JOIN s USING (dataset, at_k, variant) JOIN (SELECT dataset, at_k, other FROM o WHERE variant = 'baseline') b USING (dataset, at_k) WHERE starts_with(variant, 'proj_')), "
    "x AS (SELECT *, other >= 0.85 * base AND own >= 0.8 * best_own ok FROM v), y AS (SELECT *, bool_or(ok) OVER (PARTITION BY dataset, at_k) any_ok FROM x), "
    "z AS (SELECT *, CASE WHEN any_ok THEN round(0.7 * other + 0.3 * own, 9) ELSE other END val FROM y WHERE ok OR NOT any_ok) "
    'SELECT dataset, at_k, variant chosen, val "value", any_ok constrained FROM (SELECT *, row_number() OVER (PARTITION BY dataset, at_k ORDER BY val DESC, variant) r FROM z) WHERE r = 1'
)
def generalization_checkpoint(spark, d):
    return select.generalization_checkpoint(weighted(spark, d), "cagra", "ivf", "dataset", "at_k")


@query(f"SELECT dataset, config_id, recall, qps FROM (SELECT dataset, result_id config_id, recall, qps, row_number() OVER (PARTITION BY dataset ORDER BY recall DESC, qps DESC, result_id) r FROM sweep_results WHERE {FIN}) WHERE r = 1")
def grid_search_best(spark, d):
    trials = results(spark, d).filter(metrics.finite(F.col("recall"))).select("dataset", F.col("result_id").alias("config_id"), "recall", "qps")
    return select.best_config(trials, "dataset")


@query("SELECT dataset, n, config_id, distance FROM (SELECT 'laion' dataset, n, config_id, abs(n - 2500000) distance, row_number() OVER (ORDER BY abs(n - 2500000), config_id) r FROM (SELECT unnest([1000000, 3000000, 10000000])::BIGINT n, unnest([1, 2, 3])::INTEGER config_id)) WHERE r = 1")
def nearest_config(spark, d):
    c = spark.createDataFrame([("laion", 64, 1_000_000, 1), ("laion", 64, 3_000_000, 2), ("laion", 64, 10_000_000, 3), ("coco", 64, 2_500_000, 4)], "dataset string, dim int, n bigint, config_id int")
    return select.nearest_config(c, "laion", DIM, 2_500_000).select("dataset", "n", "config_id", "distance")


@query(
    "SELECT (row_number() OVER (ORDER BY a, b))::INTEGER config_id, degree, intermediate FROM (SELECT unnest([32, 64, 96])::INTEGER degree, unnest([0, 1, 2]) a), (SELECT unnest([64, 128, 192])::INTEGER intermediate, unnest([0, 1, 2]) b) "
    "WHERE NOT (degree = 64 AND intermediate = 64)"
)
def parameter_grid(spark, d):
    skip = spark.createDataFrame([(64, 64)], "degree int, intermediate int")
    return select.parameter_grid(spark, skip, degree=[32, 64, 96], intermediate=[64, 128, 192])


IMPROVE = (
    BOTH + ", i AS (SELECT query_id, b, p, round(CASE WHEN b > 0 THEN (p - b) / (abs(b) + 1e-8) ELSE p - b END, 6) improvement FROM (SELECT query_id, avg(score) b FROM exact WHERE rank <= 3 GROUP BY query_id) "
    "JOIN (SELECT query_id, avg(score) p FROM student WHERE rank <= 3 GROUP BY query_id) USING (query_id)) SELECT query_id, round(b, 9) base_mean, round(p, 9) proj_mean, improvement FROM i"
)


@query(IMPROVE)
def query_improvement(spark, d):
    return select.query_improvement(exact(spark, d), student(spark, d))


@query(IMPROVE + " WHERE improvement >= 0.05")
def improved_queries(spark, d):
    return select.improved_queries(select.query_improvement(exact(spark, d), student(spark, d)))


@query(BOTH + " SELECT query_id, vec_id, e.rank base_rank, s.rank proj_rank, CASE WHEN e.rank IS NULL THEN 'proj_only' WHEN s.rank IS NULL THEN 'base_only' ELSE 'both' END label FROM exact e FULL JOIN student s USING (query_id, vec_id)")
def overlap_labels(spark, d):
    return select.overlap_labels(exact(spark, d), student(spark, d))


@query(f"SELECT DISTINCT {G}, variant FROM sweep_results WHERE ({G}, variant) NOT IN (SELECT ({G}, variant) FROM (SELECT {G}, variant, count(DISTINCT budget) n FROM sweep_results WHERE {FIN} GROUP BY ALL) WHERE n = 4)")
def pending_experiments(spark, d):
    r, key = results(spark, d), ["dataset", "backend", "at_k", "variant"]
    done = r.filter(metrics.finite(F.col("recall"))).groupBy(*key).agg(F.countDistinct("budget").alias("n")).filter("n = 4").select(*key)
    return select.pending(r.select(*key).distinct(), done, *key)


# ---------------------------------------------------------------- loss histories

S = "s AS (SELECT event_type series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) i, \"value\" v FROM events WHERE \"value\" IS NOT NULL)"


def history(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "event_type", "value").filter("value is not null")
    ranked = splits.global_rank(e, "event_type", "ts", "event_id")
    low = ranked.groupBy("event_type").agg(F.min("rank").alias("low"))
    i = (F.col("rank") - F.col("low") + 1).alias("i")
    return ranked.join(low, "event_type").select(F.col("event_type").alias("series"), i, "value").withColumn("epoch", F.floor((F.col("i") - 1) / 500))


STATS = (
    f"WITH {S}, p AS (SELECT *, v - lag(v) OVER (PARTITION BY series ORDER BY i) step, row_number() OVER (PARTITION BY series ORDER BY i DESC) back FROM s), g AS (SELECT series, count(*) n, arg_min(v, i) a, arg_max(v, i) z, min(v) lo, max(v) hi, avg(v) mean, "
    "stddev_pop(v) sd, avg(step) FILTER (back < 100) rate FROM p GROUP BY series) "
)


@query(
    STATS + "SELECT series, n, round(a, 6) initial, round(z, 6) final, round(lo, 6) min, round(hi, 6) max, round(mean, 6) mean, round(sd, 6) std, round(a - z, 6) improvement, round(CASE WHEN a <> 0 THEN 100 * (a - z) / a ELSE 0 END, 6) improvement_pct, "
    "round(CASE WHEN n >= 100 THEN rate ELSE 0 END, 9) convergence_rate FROM g"
)
def loss_stats(spark, d):
    return series.stats(history(spark, d))


@query(STATS + "SELECT series, CASE WHEN round(a - z, 6) > 1e-3 THEN 'decreasing' WHEN abs(round(a - z, 6)) <= 1e-3 THEN 'stable' ELSE 'increasing' END trend FROM g")
def loss_trend(spark, d):
    return series.trend(series.stats(history(spark, d)))


@query(STATS + "SELECT series, min(i) first_i FROM s JOIN g USING (series) WHERE v <= a - 0.9 * (a - z) GROUP BY series")
def iterations_to_90pct(spark, d):
    return series.iterations_to_share(history(spark, d))


@query(
    f"WITH {S}, e AS (SELECT series, (i - 1) // 500 epoch, round(avg(v), 9) mean_value FROM s GROUP BY ALL) SELECT series, epoch, mean_value, row_number() OVER (PARTITION BY series ORDER BY mean_value, epoch) = 1 best FROM e"
)
def epoch_best(spark, d):
    return series.epoch_means(history(spark, d))


@query(
    f"WITH {S}, w AS (SELECT series, i, v, count(*) OVER (PARTITION BY series) n, first_value(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) a, last_value(v) OVER (PARTITION BY series ORDER BY i "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) z, sum(v) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) t FROM s) "
    "SELECT series, i, round(CASE WHEN n < 50 THEN v ELSE (t + greatest(0, 26 - i) * a + greatest(0, i + 24 - n) * z) / 50 END, 6) smoothed FROM w"
)
def moving_average(spark, d):
    return series.moving_average(history(spark, d))


@query(f"WITH {S} SELECT series, i, round(first_value(v) OVER w - v, 6) cumulative, round(lag(v) OVER w - v, 6) step FROM s WINDOW w AS (PARTITION BY series ORDER BY i)")
def cumulative_improvement(spark, d):
    return series.improvements(history(spark, d))


@query(f"WITH {S} SELECT series, count(*) n FROM s WHERE series NOT IN ('error', 'view') GROUP BY series")
def enabled_losses(spark, d):
    weights = spark.createDataFrame([("error", 0.0), ("view", 0.0), ("click", 1.0)], "series string, weight double")
    return series.enabled(history(spark, d), weights).groupBy("series").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- PCA, distributions


@query("WITH " + N + " SELECT (p - 1)::INTEGER i, round(avg(x), 9) mean FROM (SELECT unnest(e) x, generate_subscripts(e, 1) p FROM n) GROUP BY p")
def mean_vector(spark, d):
    return pca.mean_vector(bank(spark, d))


@query(
    "WITH " + N + ", x AS (SELECT vec_id, (p - 1)::INTEGER i, x - avg(x) OVER (PARTITION BY p) x FROM (SELECT vec_id, unnest(e) x, generate_subscripts(e, 1) p FROM n)) "
    "SELECT a.i, b.i j, round(sum(a.x * b.x), 6) + 0.0 g FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL"
)
def gram_matrix(spark, d):
    return pca.gram_table(bank(spark, d))


@query()
def component_variance(spark, d):
    return pca.explained_variance(bank(spark, d), DIM)


@query()
def pca_transform(spark, d):
    b = bank(spark, d)
    return pca.transform(b, pca.fit(b, 32)[0])


@query()
def cosine_retention(spark, d):
    b = bank(spark, d)
    return pca.cosine_retention(b, pca.fit(b, DIM)[0], [8, 16, 32, 64])


@query()
def gaussian_w2_shift(spark, d):
    b = bank(spark, d)
    return dist.shift_report(b, asked(b), moved(b))


# ---------------------------------------------------------------- projector


@query()
def project_queries(spark, d):
    return model.project(asked(bank(spark, d)), model.initial(DIM, 128))


@query()
def train_epoch(spark, d):
    b, lists = bank(spark, d), Lists(spark, d)
    rows = model.training_rows(asked(b), b, lists.pack, lists.teachers()["mixed"]).persist()
    _, _, h = model.train(rows, model.initial(DIM, 128), epochs=1, batches=2)
    rows.unpersist()
    return spark.createDataFrame([(e, i, round(v, 9)) for e, i, v in h], "epoch int, batch int, loss double")


# ---------------------------------------------------------------- captions, splits, caches


STOP_SQL = ", ".join(f"'{w}'" for w in TX.STOP)
STRIP_SQL = TX.STRIP.replace("'", "''")


@query(
    "WITH w AS (SELECT row_id, x, i FROM (SELECT row_id, unnest(w) x, generate_subscripts(w, 1) i FROM (SELECT row_id, string_split(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') w FROM datacomp_pool WHERE text IS NOT NULL))), "
    f"k AS (SELECT row_id, trim(x, '{STRIP_SQL}') x, i FROM w), f AS (SELECT row_id, x, min(i) i FROM k WHERE regexp_full_match(x, '\\p{{L}}+') AND x NOT IN ({STOP_SQL}) GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i) r FROM f), g AS (SELECT row_id, list(x ORDER BY r) keywords FROM r WHERE r <= 5 GROUP BY row_id) "
    "SELECT row_id, coalesce(keywords, []) keywords FROM datacomp_pool LEFT JOIN g USING (row_id) WHERE text IS NOT NULL"
)
def keyword_tokens(spark, d):
    return table(spark, d, "datacomp_pool", "row_id", "text").filter("text is not null").select("row_id", TX.keywords(F.col("text")).alias("keywords"))


@query("SELECT row_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') escaped FROM datacomp_pool")
def html_escape(spark, d):
    return table(spark, d, "datacomp_pool", "row_id", "text").select("row_id", TX.html_escape(F.col("text")).alias("escaped"))


@query("SELECT unnest(['10,50,100', '5 5 x -3', '', 'a']) s, unnest([[10, 50, 100], [5], [10], [10]]::INTEGER[][]) ks")
def k_lists(spark, d):
    s = spark.createDataFrame([("10,50,100",), ("5 5 x -3",), ("",), ("a",)], "s string")
    return s.select("s", TX.parse_k_list(F.col("s")).alias("ks"))


@query("SELECT image_id, min(split) split, count(*) n_captions FROM coco_annotations WHERE caption IS NOT NULL AND length(trim(caption)) > 0 AND file_name IS NOT NULL GROUP BY image_id")
def captions_per_image(spark, d):
    df = table(spark, d, "coco_annotations", "image_id", "split", "file_name", "caption")
    return df.filter(splits.usable(F.col("caption")) & F.col("file_name").isNotNull()).groupBy("image_id").agg(F.min("split").alias("split"), F.count("*").alias("n_captions"))


CAP = "SELECT annotation_id, image_id, caption FROM coco_annotations WHERE caption IS NOT NULL AND length(trim(caption)) > 0"


@query(f"SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY annotation_id) - 1)::INTEGER place, caption FROM ({CAP})")
def caption_explode(spark, d):
    df = table(spark, d, "coco_annotations", "annotation_id", "image_id", "caption").filter(splits.usable(F.col("caption")))
    images = df.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("annotation_id", "caption"))), lambda x: x["caption"]).alias("captions"))
    return splits.explode_captions(images)


ONE = f"SELECT image_id, annotation_id, caption FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('0:' || annotation_id::VARCHAR), annotation_id) r FROM ({CAP})) WHERE r = 1"


def captions(spark, d):
    return table(spark, d, "coco_annotations", "annotation_id", "image_id", "caption")


@query(ONE)
def one_caption_per_image(spark, d):
    return splits.one_caption(captions(spark, d), "image_id", "annotation_id", "caption")


@query(
    f"WITH f AS ({ONE}), o AS (SELECT image_id, caption FROM (SELECT c.image_id, c.caption, row_number() OVER (PARTITION BY c.image_id ORDER BY md5('1:' || c.annotation_id::VARCHAR), c.annotation_id) r FROM ({CAP}) c JOIN f USING (image_id) "
    "WHERE c.caption <> f.caption) WHERE r = 1) SELECT image_id, f.caption train_caption, coalesce(o.caption, f.caption) alt_caption FROM f LEFT JOIN o USING (image_id)"
)
def alternative_caption(spark, d):
    return splits.alternative_caption(captions(spark, d), "image_id", "annotation_id", "caption")


@query(
    "WITH a AS (SELECT DISTINCT file_name, split FROM coco_annotations WHERE file_name IS NOT NULL) SELECT split, count(*) n_names, count(t.file_name) n_leaking FROM a LEFT JOIN (SELECT file_name FROM a WHERE split = 'train') t USING (file_name) WHERE split <> 'train' GROUP BY split"
)
def leakage_check(spark, d):
    return splits.leakage(table(spark, d, "coco_annotations", "file_name", "split"), "file_name")


@query("SELECT count(uid) n, count(DISTINCT uid) n_distinct, count(uid) - count(DISTINCT uid) n_duplicates FROM datacomp_pool")
def duplicate_ids(spark, d):
    return metrics.duplicate_ids(table(spark, d, "datacomp_pool", "uid"), "uid")


@query("SELECT split, count(*) n_rows, count(image_features) n_image_features, max(len(image_features))::INTEGER dim_image_features, count(text_features) n_text_features, max(len(text_features))::INTEGER dim_text_features FROM laion_cache GROUP BY split")
def split_info(spark, d):
    return splits.split_info(table(spark, d, "laion_cache", "split", "image_features", "text_features"), "image_features", "text_features")


@query(
    "WITH t AS (SELECT row_id FROM laion_cache WHERE split = 'train' AND image_features IS NOT NULL), w AS (SELECT DISTINCT c.row_id FROM (SELECT row_id, unnest(knn_indices) nn FROM laion_cache) c WHERE nn >= 0 AND nn NOT IN (SELECT row_id FROM t)) "
    "SELECT split, count(*) n_rows, count_if(knn_indices IS NULL) n_missing, count_if(len(knn_indices) < 10) n_short, count_if(len(list_filter(knn_indices, lambda x: x < 0)) > 0) n_padded, "
    "count_if(len(list_distinct(knn_indices)) < len(knn_indices)) n_repeated, count_if(row_id IN (SELECT row_id FROM w)) n_dangling FROM laion_cache GROUP BY split"
)
def cache_violations(spark, d):
    return splits.knn_violations(table(spark, d, "laion_cache", "row_id", "split", "image_features", "knn_indices"), 10)


@query("SELECT count(*) n_rows, count_if(image_exists) n_existing, round(avg(image_exists::INTEGER), 9) ratio FROM datacomp_pool")
def image_existence(spark, d):
    return table(spark, d, "datacomp_pool", "image_exists").agg(F.count("*").alias("n_rows"), F.count_if("image_exists").alias("n_existing"), F.round(F.avg(F.col("image_exists").cast("int")), 9).alias("ratio"))


@query("SELECT row_id, uid, image_paths FROM datacomp_pool WHERE image_exists")
def existence_filter(spark, d):
    return table(spark, d, "datacomp_pool", "row_id", "uid", "image_paths", "image_exists").filter("image_exists").drop("image_exists")


@query(
    "SELECT row_id, CASE WHEN r <= t THEN 'train' ELSE 'val' END split FROM (SELECT row_id, row_number() OVER (ORDER BY md5('0:' || row_id::VARCHAR), row_id) r, least((SELECT count(*) FROM datacomp_pool) * 8 // 10, (SELECT count(*) FROM datacomp_pool) - 100) t FROM datacomp_pool) WHERE r <= t + 100"
)
def permutation_split(spark, d):
    df = table(spark, d, "datacomp_pool", "row_id")
    return splits.permutation_split(df, "row_id", df.count() * 8 // 10, 100)


@query(
    "WITH l AS (SELECT * FROM (SELECT uid, text, b32_img, row_number() OVER (PARTITION BY uid ORDER BY row_id DESC) r FROM datacomp_pool) WHERE r = 1) SELECT a.row_id, a.uid, a.text IS NOT DISTINCT FROM l.text same_text, "
    "coalesce(len(a.b32_img) = len(l.b32_img), false) AND coalesce(len(list_filter(list_zip(a.b32_img, l.b32_img), lambda z: NOT coalesce(CASE WHEN isnan(z[1]) OR isnan(z[2]) THEN false ELSE abs(z[1]::DOUBLE - z[2]::DOUBLE) <= 1e-8 + 1e-5 * abs(z[2]::DOUBLE) END, false))) = 0, false) same_vector "
    "FROM datacomp_pool a JOIN l ON a.uid = l.uid"
)
def reverification(spark, d):
    df = table(spark, d, "datacomp_pool", "row_id", "uid", "text", "b32_img")
    return splits.verify_by_uid(df, df, "uid", "text", "b32_img", "row_id")


@query(
    f"WITH v AS (SELECT row_id, {unit_sql('a')} a, {unit_sql('b')} b FROM (SELECT row_id, list_transform(b32_img, lambda y: y::DOUBLE) a, list_transform(b32_txt, lambda y: y::DOUBLE) b FROM datacomp_pool WHERE {_valid_sql('b32_img')} AND {_valid_sql('b32_txt')})), "
    "c AS (SELECT list_inner_product(a, b) cos FROM v) SELECT count(cos) n, round(avg(cos), 9) mean_cos, round(stddev_pop(cos), 9) std_cos, round(min(cos), 9) min_cos, round(max(cos), 9) max_cos, round(avg((cos >= 0.99)::INTEGER), 9) share_99 FROM c"
)
def cosine_validation(spark, d):
    df = table(spark, d, "datacomp_pool", "b32_img", "b32_txt").filter(valid_vector("b32_img") & valid_vector("b32_txt"))
    return metrics.cosine_validation(df.select(V.dot(V.l2_normalize(F.col("b32_img")), V.l2_normalize(F.col("b32_txt"))).alias("cos")))


@query("SELECT vec_id new_id, vec_id FROM (SELECT vec_id FROM embeddings UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 - min(vec_id) FROM embeddings) FROM embeddings)")
def union_banks(spark, d):
    df = table(spark, d, "embeddings", "vec_id")
    u = splits.union_banks(df, df, "vec_id")
    return u.select(F.col("vec_id").alias("new_id"), "vec_id")


# ---------------------------------------------------------------- end to end


@query()
def evaluation_sweep(spark, d):
    b = bank(spark, d)
    r = evaluate.evaluate(b, {"baseline": asked(b), "proj_ep1": moved(b)}, ["ivf", "graph"], [2, 8], [1, 10], cells=8)
    return r.select("backend", "variant", "budget", "at_k", "recall")


@query(f"WITH {N}, {Q}, {hits_sql('x', 'q').replace('JOIN n ON n.vec_id <> q.query_id', ', n')} SELECT query_id, rank, vec_id, score, label FROM x JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)")
def batch_retrieval(spark, d):
    b = bank(spark, d)
    return evaluate.batch_retrieval(asked(b), b, table(spark, d, "embeddings", "vec_id", "label"), K, 8, 8)


@query()
def em_refresh(spark, d):
    b = bank(spark, d)
    return evaluate.em_refresh(asked(b), b, model.initial(DIM, 128), K, pca.fit(b, 32)[0])


# ---------------------------------------------------------------- splits, selection, stored results


def _captions(spark, d):
    c = table(spark, d, "coco_annotations", "annotation_id", "image_id", "split", "caption")
    train = c.filter("split = 'train'")
    held = c.filter("split in ('val', 'test')").join(train.select("image_id").distinct(), "image_id", "left_anti")
    return train.drop("split"), held.drop("split")


_PICK = "row_number() OVER (PARTITION BY image_id ORDER BY md5('{s}:' || annotation_id::VARCHAR), annotation_id)"
_SOME = "row_number() OVER (ORDER BY md5('{s}:' || image_id::VARCHAR), image_id)"


@query(
    "WITH u AS (SELECT image_id, annotation_id, split, caption FROM coco_annotations WHERE caption IS NOT NULL AND length(trim(caption)) > 0), t AS (SELECT * FROM u WHERE split = 'train'), "
    "h AS (SELECT * FROM u WHERE split IN ('val', 'test') AND image_id NOT IN (SELECT image_id FROM coco_annotations WHERE split = 'train' AND image_id IS NOT NULL)), "
    f"tr AS (SELECT image_id, annotation_id, caption FROM (SELECT *, {_PICK.format(s=0)} r FROM t) WHERE r = 1), "
    f"ot AS (SELECT image_id, annotation_id, caption FROM (SELECT t.*, {_PICK.format(s=1).replace('image_id', 't.image_id').replace('annotation_id', 't.annotation_id')} r FROM t JOIN tr ON t.image_id = tr.image_id WHERE t.caption <> tr.caption) WHERE r = 1), "
    f"va AS (SELECT * FROM (SELECT *, {_SOME.format(s=2)} r FROM tr) WHERE r <= 40), ho AS (SELECT image_id, annotation_id, caption FROM (SELECT *, {_PICK.format(s=0)} r FROM h) WHERE r = 1) "
    "SELECT 'train' split, image_id, annotation_id, caption, image_id pair FROM tr UNION ALL SELECT 'val', va.image_id, coalesce(ot.annotation_id, va.annotation_id), coalesce(ot.caption, va.caption), va.image_id FROM va LEFT JOIN ot ON va.image_id = ot.image_id "
    f"UNION ALL SELECT 'test', image_id, annotation_id, caption, image_id FROM (SELECT *, {_SOME.format(s=3)} r FROM ho) WHERE r <= 20 "
    f"UNION ALL SELECT 'inbound', image_id, annotation_id, caption, NULL FROM (SELECT *, {_SOME.format(s=4)} r FROM ho) WHERE r <= 20"
)
def four_way_split(spark, d):
    """The sizes of val, test and inbound are parameters of the operator."""
    return splits.four_way(*_captions(spark, d), "image_id", "annotation_id", "caption", 40, 20, 20)


_WEIGHTED = (
    "w AS (SELECT dataset, backend, variant, round(sum(budget * r) / sum(budget), 9) weighted_recall FROM (SELECT dataset, backend, variant, budget, avg(CASE WHEN recall IS NULL OR isnan(recall) OR isinf(recall) THEN 0 ELSE recall END) r FROM sweep_results GROUP BY ALL) GROUP BY ALL)"
)


@query(
    f"WITH {_WEIGHTED} SELECT dataset, 'best' AS mode, variant chosen, weighted_recall \"value\" FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY weighted_recall DESC, variant) r FROM w WHERE backend = 'ivf' AND starts_with(variant, 'proj_')) WHERE r = 1"
)
def selection_best(spark, d):
    r = metrics.weighted_recall(table(spark, d, "sweep_results"), "dataset", "backend", "variant")
    return select.selection_summary(r, "ivf", "dataset").filter("mode = 'best'")


@query("SELECT 10::INTEGER k, least(100, count(*))::INTEGER n_queries, 1.0::DOUBLE recall, true passed FROM embeddings WHERE vec_id % 50 = 0")
def external_truth_check(spark, d):
    """The blocked search against the declarative one in the place of published lists."""
    b = bank(spark, d)
    return metrics.truth_check(exact(spark, d), knn.exact_topk(asked(b), b, K, strategy="catalyst", exclude_self=True), K)


@query(f"SELECT row_id, len(list_resize(coalesce(knn_indices, []), 16, -1))::INTEGER n, list_resize(coalesce(knn_indices, []), 16, -1)[1] first, list_sum(list_resize(coalesce(knn_indices, []), 16, -1))::BIGINT total FROM laion_cache")
def fitted_heads(spark, d):
    h = H.fit_head(F.col("knn_indices"), 16)
    return table(spark, d, "laion_cache", "row_id", "knn_indices").select("row_id", F.size(h).alias("n"), h[0].alias("first"), F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"WITH {N}, {Q}, {hits_sql('x', 'q')} SELECT query_id, rank, vec_id, score FROM x WHERE rank > 7")
def last_hits(spark, d):
    return select.shown(exact(spark, d), 3, last=True)


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda y: y::DOUBLE)), 5) total FROM embeddings WHERE embedding IS NOT NULL")
def binary_roundtrip(spark, d):
    """Vectors and labels written as binary vector files and read again."""
    from vecquarry.sources import binvec

    binvec.register(spark)
    at = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    e = cut(splits.global_rank(table(spark, d, "embeddings", "vec_id", "embedding", "label").filter("embedding is not null"), "vec_id"))
    rows = e.repartitionByRange("rank").sortWithinPartitions("rank").select((F.col("rank") - 1).alias("id"), F.col("embedding").alias("vec"))
    rows.write.format("binvec").mode("append").save(at)
    back = spark.read.format("binvec").load(at).select((F.col("id") + 1).alias("rank"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return e.join(back, "rank").select("vec_id", "label", F.round("total", 5).alias("total"))


def _cache(spark, d):
    from vecquarry.sources import caches

    at = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    c = table(spark, d, "laion_cache", "row_id", "split", "image_features", "text_features", "knn_indices", "text_to_image")
    caches.write(c, at)
    r = caches.reader("laion")
    return r, r.load(spark, at)


@query("SELECT split, query_id, CAST(rank AS INTEGER) rank, vec_id FROM (SELECT split, row_id query_id, unnest(knn_indices) vec_id, generate_subscripts(knn_indices, 1) rank FROM laion_cache) WHERE vec_id >= 0 AND split = 'val'")
def cache_exact_lists(spark, d):
    """A cache written, read again, and its stored lists in long form."""
    r, c = _cache(spark, d)
    return r.exact(c, "val").select(F.lit("val").alias("split"), "query_id", "rank", "vec_id")


@query("SELECT row_id query_id, CASE WHEN text_to_image <> -1 THEN text_to_image END gt_vec_id FROM laion_cache WHERE split = 'test'")
def cache_pairs(spark, d):
    r, c = _cache(spark, d)
    return r.pairs(c, "test")


@query("SELECT variant, budget, round(avg(recall), 9) recall, count(*) n_runs, round(avg(qps), 6) qps_mean, round(median(qps), 6) qps_median, round(max(qps), 6) qps_max FROM sweep_results WHERE qps IS NOT NULL AND NOT isnan(qps) AND NOT isinf(qps) AND recall IS NOT NULL AND NOT isnan(recall) GROUP BY variant, budget")
def qps_report(spark, d):
    """The speed report written as JSON lines and read again."""
    from vecquarry.sources import reports

    at = f"{checkpoint_dir(spark)}/qps-{uuid.uuid4().hex}"
    r = table(spark, d, "sweep_results").filter(metrics.finite(F.col("qps")) & metrics.finite(F.col("recall")))
    reports.write_qps(r, at)
    return spark.read.schema("variant string, budget int, recall double, n_runs bigint, qps_mean double, qps_median double, qps_max double").json(at)
