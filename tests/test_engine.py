import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark import config as C
from curaspark.errors import ConfigurationError, FatalPipelineError
from curaspark.functions import audit, pooling
from curaspark.functions import geometry as G
from curaspark.functions import hashing as H
from curaspark.functions import text as T
from curaspark.functions.vectors import assign, box_key, nearest, normalize
from curaspark.operators import clustering, detections, inference, instances, review, summary
from curaspark.schemas import REVIEW, SchemaError, conform

DET = "image_path string, image_width int, image_height int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, score double, raw_class_id int"


def test_postprocess_thresholds_clips_and_caps(spark):
    raw = spark.createDataFrame([("a", 10, 10, (-2.0, -2.0, 8.0, 8.0), 0.8, 0), ("a", 10, 10, (5.0, 5.0, 20.0, 20.0), 0.9, None), ("a", 10, 10, (0.0, 0.0, 1.0, 1.0), 0.1, 0), ("a", 10, 10, (9.5, 0.0, 30.0, 9.0), 0.99, 0), ("a", 10, 10, (0.0, 0.0, 9.0, 9.0), float("nan"), 0)], DET)
    got = detections.postprocess(raw, detections.DetectionParams(0.5, 1)).collect()
    assert [(tuple(r.bbox), r.score, r.det_rank) for r in got] == [((5.0, 5.0, 10.0, 10.0), 0.9, 1)]


def test_scores_are_clamped_after_the_threshold_and_ties_have_an_order(spark):
    raw = spark.createDataFrame([("a", 10, 10, (1.0, 0.0, 5.0, 5.0), 1.5, 1), ("a", 10, 10, (0.0, 0.0, 5.0, 5.0), 1.2, None)], DET)
    got = detections.postprocess(raw, detections.DetectionParams(0.5, 5)).orderBy("det_rank").collect()
    assert [(r.score, r.bbox.xmin) for r in got] == [(1.0, 0.0), (1.0, 1.0)]


def test_geometry(spark):
    one = spark.range(1).select(G.box(-2.2, 4.1, 10.2, 20.01).alias("b"))
    c = G.clip(F.col("b"), F.lit(10), F.lit(18))
    got = one.select(c.alias("c"), G.integer_xywh(c).alias("x"), G.degenerate(c).alias("d")).first()
    assert tuple(got.c) == (0.0, 4.1, 10.0, 18.0) and tuple(got.x) == (0, 4, 10, 14) and not got.d
    with pytest.raises(Exception, match="must be positive"):
        one.select(G.clip(F.col("b"), F.lit(0), F.lit(5))).collect()
    with pytest.raises(ValueError):
        G.expand(F.col("b"), -0.1, F.lit(1), F.lit(1))


def test_letterbox_keeps_the_aspect(spark):
    b = spark.range(1).select(G.box(50, 20, 150, 60).alias("b"))
    crop = G.crop_box(G.expand(F.col("b"), 0.15, F.lit(200), F.lit(100)), F.lit(200), F.lit(100))
    b = b.withColumn("crop", crop).withColumn("lb", G.letterbox(F.col("crop"), 512))
    r = b.select("crop", "lb", G.into_letterbox(F.col("b"), F.col("crop"), F.col("lb"), 512).alias("m"), G.content_box(F.col("lb")).alias("c")).first()
    assert tuple(r.crop) == (35.0, 14.0, 165.0, 66.0)
    assert (r.lb.resized_width, r.lb.resized_height, r.lb.pad_left, r.lb.pad_top) == (512, 205, 0, 153)
    assert r.c.ymin <= r.m.ymin < r.m.ymax <= r.c.ymax


def test_identities(spark):
    rows = spark.createDataFrame([("p", "a" * 64, 0), ("q", "a" * 64, 0), ("p", "a" * 64, 1)], "image_path string, sha string, occ int")
    key = H.instance_key(F.col("sha"), box_key(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)), F.lit("b" * 64), F.col("occ"))
    p, q, again = rows.select(key.alias("k"), H.instance_id(F.col("image_path"), key).alias("i")).collect()
    assert p.k == q.k and p.i != q.i and again.k != p.k and p.i.startswith("di_") and len(p.i) == 19
    import hashlib

    want = hashlib.sha256(b"".join(len(x).to_bytes(8, "big") + x for x in ("é".encode(), b"", "日本".encode()))).hexdigest()
    assert spark.range(1).select(H.hash_join(F.lit("é"), F.lit(""), F.lit("日本"))).first()[0] == want


def test_box_keys_round_the_exact_value(spark):
    df = spark.createDataFrame([(123.45675,), (0.00005,), (2.5,)], "x double")
    assert [r[0] for r in df.select(box_key("x", "x", "x", "x")).collect()] == [",".join([f"{x:.4f}"] * 4) for x in (123.45675, 0.00005, 2.5)]


def test_paths_and_messages(spark):
    raw = ["/nested\\image.PNG", "../secret", "", "a//b/./c.jpg", "_u.png", ".h/x.png", "__MACOSX/x.png", "Thumbs.DB", "x.gif", "a/.png"]
    got = spark.createDataFrame([(x,) for x in raw], "p string").select(T.normalize_path(F.col("p")).alias("n")).withColumn("e", T.eligible(F.col("n"))).collect()
    assert [r.n for r in got] == ["nested/image.PNG", None, None, "a/b/c.jpg", "_u.png", ".h/x.png", "__MACOSX/x.png", "Thumbs.DB", "x.gif", "a/.png"]
    assert [bool(r.e) for r in got] == [True, False, False, True, True, False, False, False, False, False]
    said = spark.createDataFrame([("bad  /home/user/x.png\n here C:\\a\\b.txt",), ("y" * 600,)], "m string").select(T.sanitize(F.col("m"))).collect()
    assert said[0][0] == "bad <redacted-path> here <redacted-path>" and len(said[1][0]) == 500 and said[1][0].endswith("…")


def test_ranks_and_review_order(spark):
    rows = [("b", "i1", 0, 0.9, 0.5), ("a", "i1", 0, 0.9, 0.5), ("c", "i2", 0, 0.8, 0.9), ("d", "i3", 1, 0.7, 0.4), ("e", "i4", None, None, 0.9), ("f", "i4", 1, 0.9, 0.2), ("g", "i5", None, None, 0.1)]
    i = spark.createDataFrame(rows, "instance_id string, image_path string, cluster_id int, cosine_to_centroid double, score double")
    r = {x.instance_id: (x.cluster_rank, x.cluster_size) for x in review.ranked(i).collect()}
    assert r == {"a": (1, 3), "b": (2, 3), "c": (3, 3), "f": (1, 2), "d": (2, 2), "e": (None, None), "g": (None, None)}
    assert {x.image_path: (x.cluster_id, x.review_order) for x in review.review_order(i).collect()} == {"i1": (0, 1), "i2": (0, 2), "i4": (1, 1), "i3": (1, 2)}


@pytest.mark.parametrize("granularity", ["object", "image"])
def test_review_rows(spark, granularity):
    import json

    images = spark.createDataFrame([("a", "OK", 10, 10, [((0.5, 0.5, 4.2, 4.0), 0.9, 0), ((1.0, 1.0, 3.0, 3.0), 0.5, None)]), ("n", "NO_DETECTION", 10, 10, []), ("x", "ERROR", 10, 10, [((0.0, 0.0, 4.0, 4.0), 0.9, 0)])], f"image_path string, image_status string, image_width int, image_height int, detections array<struct<bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,score:double,raw_class_id:int>>")
    images = images.withColumn("error_code", F.lit(None).cast("string")).withColumn("error_message", F.lit(None).cast("string"))
    rows = [("j", "a", 3, 0.5, 0.9, (0, 0, 5, 4)), ("i", "a", 2, 0.25, 0.9, (1, 1, 2, 2)), ("k", "x", 3, 0.5, 0.9, (0, 0, 4, 4))]
    ins = spark.createDataFrame(rows, "instance_id string, image_path string, cluster_id int, cosine_to_centroid double, score double, bbox_xywh struct<x:int,y:int,w:int,h:int>")
    ins = review.ranked(ins).withColumn("embedding_status", F.lit("COMPUTED")).withColumn("warning_codes", F.array().cast("array<string>"))
    out = review.in_review_order(review.review_rows(images, ins, "r", granularity, exact_text=True)).collect()
    assert [r.image_path for r in out] == ["a", "n", "x"] and [r.num_defects for r in out] == [2, 0, 0] and out[0].primary_cluster_id == 2
    assert json.loads(out[0].detection_bbox) == [{"bbox": [0, 0, 5, 4], "category": "defect"}, {"bbox": [1, 1, 2, 2], "category": "defect"}]
    assert json.loads(out[0].detection_score) == [0.9, 0.5]
    cats = [x["category"] for x in json.loads(out[0].detection_bbox_cluster)]
    assert cats == (["2", "3"] if granularity == "object" else ["2", "2"])
    context = json.loads(out[0].instances_json)
    assert [x["instance_id"] for x in context] == ["i", "j"] and list(context[0]) == sorted(context[0]) and ("max_detector_score" in context[0]) == (granularity == "image")
    assert all(getattr(out[2], c) == "[]" for c in ("detection_bbox", "detection_score", "detection_bbox_cluster", "instances_json"))


def test_schema_is_enforced(spark):
    with pytest.raises(SchemaError, match="unknown"):
        conform(spark.range(1), REVIEW)


def test_checks(spark):
    images = spark.createDataFrame([("a", "OK")] * 9 + [("b", "ERROR")], "image_path string, image_status string")
    summary.require_few_failures(images, 0.1)  # at the ceiling
    with pytest.raises(FatalPipelineError):
        summary.require_few_failures(images, 0.09)
    d = spark.createDataFrame([(0,), (None,), (2,)], "raw_class_id int")
    with pytest.raises(FatalPipelineError, match=r"\[0, 2\]"):
        summary.require_one_class(d)


def test_clustering_groups_and_ignores_the_order_of_rows(spark):
    v = [(1.0, 0.02), (0.99, -0.01), (-1.0, 0.01), (-0.98, -0.02)]
    seen = []
    for order in ((0, 1, 2, 3), (2, 0, 3, 1)):
        df = spark.createDataFrame([(k, "badc"[i], list(v[i])) for k, i in enumerate(order)], "embedding_row bigint, instance_id string, vector array<float>")
        named, fit = clustering.fit(df, clustering.FitParams(k=2))
        seen.append({r.instance_id: r.cluster_id for r in named.collect()})
        assert np.allclose(np.linalg.norm(fit.centroids, axis=1), 1, atol=1e-5)
    assert seen[0] == seen[1] == {"a": 0, "b": 0, "c": 1, "d": 1}
    with pytest.raises(ConfigurationError):
        clustering.fit(df, clustering.FitParams(k=5))


def test_clusters_that_stay_empty_are_fatal(spark):
    df = spark.createDataFrame([(k, str(k), [1.0, 0.0]) for k in range(4)], "embedding_row bigint, instance_id string, vector array<float>")
    with pytest.raises(FatalPipelineError):
        clustering.fit(df, clustering.FitParams(k=2))


def test_assignment(spark):
    c = normalize(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]))
    assert nearest(np.array([[2.0, 0.0], [0.1, 3.0]]), c)[0].tolist() == [0, 2]  # the first of equals
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    with pytest.raises(Exception, match="dimensions"):
        assign(df, "v", c).collect()
    for bad in (np.zeros((1, 2)), np.array([[np.nan, 1.0]]), np.zeros((0, 2))):
        with pytest.raises(ValueError):
            normalize(bad)


def test_patch_weights(spark):
    w = pooling.patch_weights((16, 16, 32, 32), (4, 4), (64, 64))
    assert w[1, 1] == 1 and w.sum() == 1
    col = spark.range(1).select(G.patch_weights(G.box(3, 5, 40, 61), 4, 8, 64.0, 64.0)).first()[0]
    assert np.allclose(np.array(col).reshape(4, 8), pooling.patch_weights((3, 5, 40, 61), (4, 8), (64, 64)))


def test_thin_boxes_grow_inside_their_bounds():
    box, w, grown = pooling.box_with_weight((10, 10, 11, 11), 4.0, (32, 32), (512, 512))
    assert grown and 4 - 1e-5 <= w.sum() < 4.01
    bounds = (64, 128, 448, 384)
    box, w, grown = pooling.box_with_weight((64, 200, 65, 201), 4.0, (32, 32), (512, 512), bounds)
    assert grown and w.sum() >= 4 - 1e-5 and all(box[k] >= bounds[k] for k in (0, 1)) and all(box[k] <= bounds[k] for k in (2, 3))
    with pytest.raises(ValueError, match="weigh less"):
        pooling.box_with_weight((0, 0, 1, 1), 5.0, (2, 2), (64, 64))


def test_pooling_and_basis():
    rng = np.random.default_rng(1)
    f = rng.normal(size=(16, 8, 8)).astype(np.float32)
    basis = pooling.positional_basis(f, 3)
    assert pooling.is_basis(basis, (16, 3)) and not pooling.is_basis(np.ones((16, 3), np.float32))
    flat = pooling.without_basis(f, basis).reshape(16, -1)
    assert np.abs(basis.T @ flat).max() < 1e-5 and np.allclose(np.linalg.norm(flat, axis=0), 1, atol=1e-5)
    p = pooling.pool(f, (0, 0, 64, 64), 128.0, 4.0, basis)
    assert abs(np.linalg.norm(p.vector) - 1) < 1e-5 and not p.expanded
    with pytest.raises(ValueError, match="direction"):
        pooling.pool(np.zeros((4, 2, 2), np.float32), (0, 0, 64, 64), 64.0, 1.0)


@pytest.mark.parametrize(("k", "n", "bound"), [(59, 59, 0.95049), (99, 100, 0.95344), (196, 200, 0.95482), (388, 400, 0.95185), (484, 500, 0.95180), (962, 1000, 0.95049), (0, 10, 0.0)])
def test_audit_bound(k, n, bound):
    assert math.isclose(audit.lower_bound(k, n), bound, abs_tol=6e-6)
    assert audit.accepted(59, 59, 0.95) and not audit.accepted(58, 59, 0.95)


def test_batches_are_halved_until_the_bad_item_is_alone():
    calls = []

    def run(xs):
        calls.append(len(xs))
        if "bad" in xs:
            raise MemoryError("out of memory")
        return [x.upper() for x in xs]

    got = inference.adaptive(["a", "bad", "c", "d"], run, 8)
    assert [r for r, _, _ in got] == ["A", None, "C", "D"] and inference.out_of_memory(got[1][1]) and calls == [4, 2, 1, 1, 2]
    assert all(e for _, e, _ in inference.adaptive(["a", "bad"], run, 0))
    with pytest.raises(FatalPipelineError):
        inference.adaptive(["a", "b"], lambda xs: (_ for _ in ()).throw(FatalPipelineError("stop")), 8)


BASE = {"detector": {"checkpoint_path": "/m/d"}, "embedding": {"artifact_path": "/m/e", "artifact_revision": "r1"}, "clustering": {"k": 3}}


def test_config():
    cfg = C.compose(BASE, ["detector.threshold=0.5", "seed=7"])
    assert cfg.detector.threshold == 0.5 and cfg.clustering.seed == 7
    other = C.compose(BASE | {"detector": {"checkpoint_path": "/elsewhere"}}, ["detector.threshold=0.5", "seed=7"])
    assert C.config_hash(cfg) == C.config_hash(other) and "/m/d" not in C.as_yaml(cfg, True)
    sig = lambda *o: (C.detector_signature(c := C.compose(BASE, list(o)), "x"), C.embedding_signature(c, "y", "z"))
    base = sig()
    assert sig("clustering.k=9", "detector.batch_size=1", "embedding.oom_retries=1") == base
    assert sig("detector.threshold=0.6")[0] != base[0] and sig("embedding.box_padding_fraction=0.2")[1] != base[1]
    assert sig("embedding.granularity=image", "embedding.box_padding_fraction=0.2") == sig("embedding.granularity=image")


@pytest.mark.parametrize("bad", ["detector.threshold=1.0", "clustering.k=1", "detector.nope=1", "embedding.granularity=patch", "detector.device=cpu", "clustering.k=two", "runtime.temporary_root=rel", "embedding.box_padding_fraction=0.6", "embedding.positional_debias.components=5", "noequals"])
def test_config_errors(bad):
    with pytest.raises(ConfigurationError):
        C.compose(BASE, [bad])


def test_digest_guard():
    H.require_digest("a" * 64, " ", "model")
    H.require_digest("a" * 64, "A" * 64, "model")
    for expected in ("b" * 64, "xyz"):
        with pytest.raises(ConfigurationError):
            H.require_digest("a" * 64, expected, "model")


def test_full_image_instances(spark):
    d = "image_path string, image_sha256 string, image_width int, image_height int, image_status string, detections array<struct<bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,score:double,raw_class_id:int>>"
    rows = spark.createDataFrame([("a", "s", 8, 6, "OK", [((0.0, 0.0, 1.0, 1.0), 0.4, 0), ((0.0, 0.0, 1.0, 1.0), 0.7, 0)]), ("b", "s", 8, 6, "NO_DETECTION", []), ("c", None, 8, 6, "OK", []), ("d", "s", 8, 6, "ERROR", [])], d)
    got = {r.image_path: r for r in instances.of_images(instances.usable(rows)).collect()}
    assert set(got) == {"a", "b"} and got["a"].score == 0.7 and got["b"].score == 0.0 and got["a"].instance_key == got["b"].instance_key and tuple(got["a"].bbox_xywh) == (0, 0, 8, 6)


def test_written_tables_and_clean_up(spark):
    from curaspark.session import clean_up, spill

    df = spill(spark.range(3).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 3 and spill(df.limit(0), "none").count() == 0
    clean_up(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        df.collect()


def test_form_and_settings():
    over = C.overrides_from({"cluster_count": 4, "detection_threshold": 0.5, "embedding_granularity": ""}, {"detector_checkpoint_path": "/m/d", "embedder_artifact_path": "/m/e", "embedder_artifact_revision": "7"})
    cfg = C.compose(None, [o if "revision" not in o else "embedding.artifact_revision='7'" for o in over])
    assert cfg.clustering.k == 4 and cfg.detector.device == cfg.embedding.device == "cpu" and cfg.embedding.inference_precision == "float32" and cfg.embedding.granularity == "object"
    with pytest.raises(ConfigurationError):
        C.overrides_from({"k": 1}, {})


def test_basis_store(tmp_path):
    from curaspark.errors import ArtifactError
    from curaspark.sources.store import LocalStore, load_basis, save_basis

    store = LocalStore(tmp_path)
    basis = np.eye(4, 2, dtype=np.float32)
    digest = save_basis(store, "sig", basis)
    assert load_basis(store, "sig", (4, 2))[1] == digest and load_basis(store, "sig", (4, 3)) is None and load_basis(store, "other", (4, 2)) is None
    store.write_matrix("specs/basis/sig.npy", basis * 1.0001)
    assert load_basis(store, "sig", (4, 2)) is None
    with pytest.raises(ArtifactError):
        save_basis(store, "bad", np.ones((4, 2), np.float32))


def test_cache_contracts(spark):
    from curaspark.operators import caching

    d = "detector_signature string, image_sha256 string, image_width int, image_height int, detections array<struct<bbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>,score:double,raw_class_id:int>>"
    box = (1.0, 1.0, 9.0, 9.0)
    rows = [("s", "good", 10, 10, [(box, 0.9, 0)]), ("s", "none", 10, 10, []), ("s", "low", 10, 10, [(box, 0.4, 0)]), ("s", "out", 8, 10, [(box, 0.9, 0)]), ("s", "many", 10, 10, [(box, 0.9, 0)] * 3), ("t", "other", 10, 10, [(box, 0.9, 0)]), ("s", "thin", 10, 10, [((1.0, 1.0, 1.5, 9.0), 0.9, 0)])]
    got = caching.valid_detections(spark.createDataFrame(rows, d), "s", 0.5, 2)
    assert {r.image_sha256 for r in got.collect()} == {"good", "none"}
    v = [("s", "good", [1.0, 0.0]), ("s", "long", [1.1, 0.0]), ("s", "nan", [float("nan"), 1.0]), ("s", "short", [1.0]), ("t", "other", [1.0, 0.0])]
    got = caching.valid_vectors(spark.createDataFrame(v, "embedding_signature string, instance_key string, vector array<float>"), "s", 2)
    assert {r.instance_key for r in got.collect()} == {"good"}
