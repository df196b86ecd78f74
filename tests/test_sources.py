"""Sources and sinks: round trips and broken files."""

import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecquarry.operators.knn import exact_topk
from vecquarry.sources import annotations, arrays, binvec, caches, reports
from vecquarry.streaming import running_topk


def test_binvec_round_trip_and_cut_tail(spark, tmp_path):
    binvec.register(spark)
    x = np.arange(60, dtype="<f4").reshape(20, 3)
    p = tmp_path / "a.fbin"
    p.write_bytes(struct.pack("<II", 20, 3) + x.tobytes()[:-5])
    df = spark.read.format("binvec").option("rows", 7).load(str(p))
    got = {r.id: r.vec for r in df.collect()}
    assert df.rdd.getNumPartitions() == 3 and len(got) == 19 and got[7] == [21.0, 22.0, 23.0]
    out = str(tmp_path / "out")
    df.write.format("binvec").mode("append").save(out)
    back = spark.read.format("binvec").load(out)
    assert sorted(r.vec for r in back.collect()) == sorted(got.values())
    (tmp_path / "b.ibin").write_bytes(struct.pack("<II", 2, 2) + np.array([1, 2, 3, 4], "<i4").tobytes())
    assert [r.vec for r in spark.read.format("binvec").load(str(tmp_path / "b.ibin")).orderBy("id").collect()] == [[1, 2], [3, 4]]


def test_arrays(spark, tmp_path):
    for i in (2, 10):
        np.save(tmp_path / f"img_{i}.npy", np.full((3, 2), i, np.float32))
    v = arrays.with_ids(arrays.read_arrays(spark, str(tmp_path / "img_*.npy")))
    assert [(r.id, r.vec[0]) for r in v.orderBy("id").collect()] == [(0, 2.0), (1, 2.0), (2, 2.0), (3, 10.0), (4, 10.0), (5, 10.0)]
    np.savez(tmp_path / "q.npz", queries=np.ones((2, 2)))
    assert arrays.read_arrays(spark, str(tmp_path / "q.npz")).count() == 2
    short = v.filter("not (stem = 'img_2' and pos = 2)").withColumnRenamed("vec", "other")
    with pytest.raises(ValueError, match="img_2"):
        arrays.paired(v, short, "other")
    spark.createDataFrame([(f"u{i}",) for i in range(3)], "uid string").coalesce(1).write.parquet(str(tmp_path / "m"))
    pos = arrays.positional_parquet(spark, str(tmp_path / "m"), "uid")
    assert [r.uid for r in pos.orderBy("pos").collect()] == ["u0", "u1", "u2"]


def test_cache_readers(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, "train", [3.0, 4.0], [1.0, 0.0], [0, -1], 0), (1, "val", None, [0.0, 2.0], [0], -1)],
        "row_id bigint, split string, image_features array<float>, text_features array<float>, knn_indices array<bigint>, text_to_image bigint",
    )
    caches.write(df, str(tmp_path / "c"))
    r = caches.reader("laion")
    c = r.load(spark, str(tmp_path / "c"))
    assert r.bank(c, "val").collect()[0].e == pytest.approx([0.6, 0.8])
    assert [(x.query_id, x.rank, x.vec_id) for x in r.exact(c, "train").collect()] == [(0, 1, 0)]
    assert r.pairs(c, "val").collect()[0].gt_vec_id is None
    with pytest.raises(ValueError):
        caches.reader("flickr30k").load(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        caches.reader("nothing")


def test_annotations_and_tar(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x.jpg"}, {"id": 2, "file_name": "y.jpg"}], "annotations": [{"id": 5, "image_id": 1, "caption": "b"}, {"id": 4, "image_id": 1, "caption": "a"}]}))
    assert [(r.image_id, r.captions) for r in annotations.read_coco(spark, str(tmp_path / "a.json")).collect()] == [(1, ["a", "b"])]
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in (("k1.json", b'{"uid": "u1"}'), ("k1.png", b"P"), ("k1.jpg", b"J"), ("k2.json", b'{"uid": "u2"}'), ("k3.json", b"broken")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {r.key: (r.uid, r.ext, r.error) for r in annotations.read_tar(spark, str(tmp_path / "s.tar")).collect()}
    assert got["k1"] == ("u1", ".jpg", None) and got["k2"][2] == "no image" and got["k3"][0] is None
    listing = spark.createDataFrame([("u1.png",), ("u1.jpeg",)], "file_name string")
    rows = spark.createDataFrame([("u1",), ("u9",)], "uid string")
    assert [(r.image_path, r.image_exists) for r in annotations.with_image_paths(rows, listing).orderBy("uid").collect()] == [("u1.jpeg", True), ("u9.jpg", False)]


def test_reports(spark, tmp_path):
    hits = spark.createDataFrame([(1, 2, 7, 0.5), (1, 1, 9, 0.6)], "query_id bigint, rank int, vec_id bigint, score double")
    reports.write_retrieval(hits, str(tmp_path / "r"))
    assert [x["rank"] for x in json.loads(next((tmp_path / "r").glob("part-*.json")).read_text().splitlines()[0])["results"]] == [1, 2]
    reports.append_timing(spark, str(tmp_path / "t"), "build", 1.5, n=3)
    reports.append_timing(spark, str(tmp_path / "t"), "search", 0.5)
    assert {r.event: r.duration_sec for r in reports.read_timings(spark, str(tmp_path / "t")).collect()} == {"build": 1.5, "search": 0.5}
    (tmp_path / "l.json").write_text(json.dumps({"iterations": [0, 1], "epochs": [1, 1], "losses": {"kld": [2.0, 1.0]}}))
    assert [(r.i, r.value) for r in reports.read_losses(spark, str(tmp_path / "l.json")).orderBy("i").collect()] == [(0, 2.0), (1, 1.0)]
    res = spark.createDataFrame([("d", "ivf", "baseline", 1, 10, 0.5, 9.0)], "dataset string, backend string, variant string, budget int, at_k int, recall double, qps double")
    assert json.loads(reports.evaluation(res, {"k": 10}, {}).first()[0])["summary"][0]["avg"] == 0.5


def test_running_topk(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 4))
    src = tmp_path / "in"
    schema = "vec_id bigint, e array<double>"
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id bigint, e array<double>")
    for part in (x[:25], x[25:]):
        base = 0 if len(part) == 25 else 25
        spark.createDataFrame([(base + i, list(map(float, r))) for i, r in enumerate(part)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        running_topk.start(stream, q, 5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    bank = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], schema)
    got = [(r.rank, r.vec_id) for r in running_topk.current(spark, str(tmp_path / "out")).orderBy("rank").collect()]
    assert got == [(r.rank, r.vec_id) for r in exact_topk(q, bank, 5).orderBy("rank").collect()]
