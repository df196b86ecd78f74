"""The residual query projector: forward pass, distributed training step, checkpoints.

f(t) = normalize(t + alpha (W2 relu(W1 t + b1) + b2)) with t normalised. Training minimises the KL of the student's
softmax over its pack to a teacher plus the squared move, by AdamW with a cosine schedule, clipped gradients and a moving
average of the weights. Gradients are summed per partition and added by tensor row, so the driver sees one model's worth
of numbers a step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.operators.knn import _rows

NAMES = ("w1", "b1", "w2", "b2")


def initial(dim: int, hidden: int, alpha: float = 0.25, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    s1, s2 = 1 / math.sqrt(dim), 1 / math.sqrt(hidden)
    return {"w1": rng.uniform(-s1, s1, (hidden, dim)), "b1": rng.uniform(-s1, s1, hidden), "w2": rng.uniform(-s2, s2, (dim, hidden)), "b2": rng.uniform(-s2, s2, dim), "alpha": alpha}


def forward(model: dict, t: np.ndarray):
    t = t / (np.linalg.norm(t, axis=1, keepdims=True) + 1e-8)
    a = t @ model["w1"].T + model["b1"]
    h = np.maximum(a, 0)
    u = t + model["alpha"] * (h @ model["w2"].T + model["b2"])
    n = np.linalg.norm(u, axis=1, keepdims=True) + 1e-8
    return u / n, (t, a, h, u, n)


def gradients(model: dict, t: np.ndarray, packs: list[np.ndarray], teachers: list[np.ndarray], tau: float = 0.07, w_id: float = 0.1) -> tuple[float, dict]:
    """Summed loss and gradients of a batch; ``packs``: candidate vectors of each query, ``teachers``: their shares."""
    q, (t, a, h, u, n) = forward(model, t)
    dq, loss = np.zeros_like(q), 0.0
    for i, (x, p) in enumerate(zip(packs, teachers, strict=True)):
        if len(x) and p.sum() > 0:
            p = p / p.sum()
            z = x @ q[i] / tau
            z -= z.max()
            logq = z - np.log(np.exp(z).sum())
            loss += tau * tau * float((p[p > 0] * (np.log(p[p > 0]) - logq[p > 0])).sum())
            dq[i] += tau * x.T @ (np.exp(logq) - p)
    move = q - t
    loss += w_id * float((move**2).sum())
    dq += 2 * w_id * move
    size = n - 1e-8
    du = dq / n - u * ((dq * u).sum(1, keepdims=True) / (n**2 * np.maximum(size, 1e-12)))
    g = model["alpha"] * du
    dh = g @ model["w2"]
    da = dh * (a > 0)
    return loss, {"w1": da.T @ t, "b1": da.sum(0), "w2": g.T @ h, "b2": g.sum(0)}


def project(queries: DataFrame, model: dict) -> DataFrame:
    """``query_id, e`` with projected vectors."""
    shared = queries.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(list(forward(shared.value, _rows(b.column("e")))[0]))], names=schema.names)

    return queries.select("query_id", "e").mapInArrow(run, schema)


def step_gradients(batch: DataFrame, model: dict, tau: float = 0.07, w_id: float = 0.1) -> tuple[float, int, dict]:
    """Mean loss, rows and mean gradients over ``e, pack (vectors), teacher (shares)`` rows."""
    shared = batch.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m, total, loss, n = shared.value, None, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            packs = [np.array(x, float).reshape(-1, m["w1"].shape[1]) for x in b.column("pack").to_pylist()]
            part, g = gradients(m, _rows(b.column("e")), packs, [np.array(x, float) for x in b.column("teacher").to_pylist()], tau, w_id)
            loss, n = loss + part, n + b.num_rows
            total = g if total is None else {k: total[k] + g[k] for k in NAMES}
        if total is not None:
            rows = [("loss", 0, [loss, float(n)])] + [(k, i, list(map(float, r))) for k in NAMES for i, r in enumerate(np.atleast_2d(total[k]))]
            a, b_, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_, pa.int32()), pa.array(c)], names=schema.names)

    parts = batch.select("e", "pack", "teacher").mapInArrow(run, schema)
    width = F.posexplode("g").alias("j", "x")
    sums = parts.select("name", "row", width).groupBy("name", "row", "j").agg(F.sum("x").alias("x")).collect()
    grads = {k: np.zeros_like(np.atleast_2d(model[k])) for k in NAMES}
    loss = n = 0.0
    for r in sums:
        if r.name == "loss":
            loss, n = (r.x, n) if r.j == 0 else (loss, r.x)
        else:
            grads[r.name][r.row, r.j] = r.x
    n = max(n, 1.0)
    return loss / n, int(n), {k: grads[k].reshape(model[k].shape) / n for k in NAMES}


class AdamW:
    """AdamW with a cosine schedule over ``steps``, gradients clipped to norm 1, and a moving average of the weights."""

    def __init__(self, model: dict, steps: int, lr: float = 1e-3, decay: float = 1e-4, ema: float = 0.999):
        self.m, self.v = ({k: np.zeros_like(model[k]) for k in NAMES} for _ in range(2))
        self.t, self.steps, self.lr, self.decay, self.keep = 0, steps, lr, decay, ema
        self.average = {k: model[k].copy() for k in NAMES} | {"alpha": model["alpha"]}

    def step(self, model: dict, grads: dict) -> dict:
        norm = math.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / (norm + 1e-6))
        lr = 0.5 * self.lr * (1 + math.cos(math.pi * self.t / max(self.steps, 1)))
        self.t += 1
        new = {"alpha": model["alpha"]}
        for k in NAMES:
            g = grads[k] * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            mh, vh = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            new[k] = model[k] * (1 - lr * self.decay) - lr * mh / (np.sqrt(vh) + 1e-8)
            self.average[k] = self.keep * self.average[k] + (1 - self.keep) * new[k]
        return new


def training_rows(queries: DataFrame, bank: DataFrame, pack: DataFrame, teacher: DataFrame) -> DataFrame:
    """``query_id, e, pack, teacher``: each query with the vectors and teacher shares of its pack."""
    t = pack.join(teacher.select("query_id", "vec_id", "p"), ["query_id", "vec_id"]).join(bank.select("vec_id", F.col("e").alias("x")), "vec_id")
    per = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "p"))).alias("l"))
    return queries.join(per, "query_id").select("query_id", "e", F.transform("l", lambda r: r["x"]).alias("pack"), F.transform("l", lambda r: r["p"]).alias("teacher"))


def train(rows: DataFrame, model: dict, epochs: int = 1, batches: int = 4, **loss) -> tuple[dict, dict, list[tuple[int, int, float]]]:
    """Trained weights, their moving average, and (epoch, batch, loss); batches are drawn by hash, anew each epoch."""
    opt, history = AdamW(model, epochs * batches), []
    for epoch in range(1, epochs + 1):
        part = F.pmod(F.xxhash64("query_id", F.lit(epoch)), F.lit(batches))
        for i in range(batches):
            value, n, grads = step_gradients(rows.filter(part == i), model, **loss)
            model = opt.step(model, grads)
            history.append((epoch, i, value))
    return model, opt.average, history


def save(spark, model: dict, path: str, **meta) -> None:
    rows = [(k, list(np.shape(model[k])), [float(x) for x in np.ravel(model[k])]) for k in (*NAMES, "alpha")]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/tensors")
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> tuple[dict, dict]:
    """Weights (a ``module.`` prefix of tensor names is dropped) and meta data."""
    t = spark.read.parquet(f"{path}/tensors").withColumn("name", F.regexp_replace("name", r"^module\.", ""))
    model = {r.name: np.array(r.data).reshape(r["shape"]) if r["shape"] else float(r.data[0]) for r in t.collect()}
    return model, {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
