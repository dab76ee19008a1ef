import json
import shutil
import struct
import zlib

import numpy as np
import pytest

from curaspark import config as C
from curaspark.errors import ArtifactError, ConfigurationError, FatalPipelineError
from curaspark.plans import bundle
from curaspark.plans.pipeline import CurationPipeline, Models, audit
from curaspark.sources.images import Decoded
from curaspark.sources.store import LocalStore

RED, GREEN, BLUE, GRAY = (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)


def png(colour, w=96, h=64):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(colour) * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(data):
    if not data.startswith(b"\x89PNG"):
        raise ValueError("not a PNG: /secret/place/x.png")
    w, h = struct.unpack(">II", data[16:24])
    at = data.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(data[at + 4 :]), np.uint8).reshape(h, 1 + 3 * w)[:, 1:]
    return Decoded("RGB", w, h, rows.reshape(h, w, 3))


class Detector:
    def __init__(self, cfg):
        pass

    def predict(self, images, threshold):
        gray = lambda p: len(set(p[0, 0].tolist())) == 1
        return [[] if gray(x.pixels) else [((0.15 * x.width, 0.15 * x.height, 0.85 * x.width, 0.85 * x.height), 0.95, 0)] for x in images]


class Embedder:
    def __init__(self, cfg):
        self.dim, self.grid = cfg.embedding.embedding_dim, cfg.embedding.input_size // cfg.embedding.patch_size

    def patch_maps(self, items):
        for image, _ in items:
            k = int(image.pixels[0, 0].argmax())
            m = np.zeros((self.dim, self.grid, self.grid), np.float32)
            m[k], m[k + 3] = 1.0, 0.05
            yield m


def forbidden(cfg):
    raise AssertionError("no model may be built")


def config(*over):
    base = {"detector": {"checkpoint_path": "/m/d", "device": "cpu"}, "embedding": {"artifact_path": "/m/e", "artifact_revision": "r", "device": "cpu", "inference_precision": "float32", "embedding_dim": 32}, "clustering": {"k": 3}}
    return C.compose(base, list(over))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "images"
    for name, colour in (("red/1", RED), ("red/2", RED), ("green/1", GREEN), ("green/2", GREEN), ("blue/1", BLUE), ("_dir/2", BLUE), ("normal", GRAY)):
        p = root / f"{name}.png"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(png(colour, h=64 + len(name)))  # bytes differ by name length only: copies inside a colour
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.png").write_bytes(png(RED))
    (root / "notes.txt").write_text("x")
    return root


def run(spark, tmp_path, folder, cfg=None, detector=Detector, embedder=Embedder, name="out"):
    models = Models(decode, detector, embedder, "a" * 64, "b" * 64)
    return CurationPipeline(spark, str(folder), LocalStore(tmp_path / name), str(tmp_path / f"{name}-review"), cfg or config(), models)


def test_fit_then_recluster_then_score(spark, tmp_path, folder):
    first = run(spark, tmp_path, folder).fit()
    assert {k: first.counts[k] for k in ("images", "ok_images", "no_detection_images", "instances", "embedded_instances")} == {"images": 7, "ok_images": 6, "no_detection_images": 1, "instances": 6, "embedded_instances": 6}
    assert first.cache == {"detection_hits": 0, "detection_misses": 7, "embedding_hits": 0, "embedding_misses": 6}
    rows = spark.read.parquet(str(tmp_path / "out-review")).toPandas()
    assert len(rows) == 7 and rows.primary_cluster_id.nunique() == 3 and rows[rows.image_path == "normal.png"].detection_bbox.item() == "[]"
    by = rows.set_index("image_path").primary_cluster_id
    assert by["red/1.png"] == by["red/2.png"] != by["green/1.png"] and by["_dir/2.png"] == by["blue/1.png"]
    assert json.loads(rows.set_index("image_path").detection_bbox["red/1.png"])[0]["bbox"][0] == 14
    folder_of = tmp_path / "out" / first.manifest_path.rpartition("/")[0]
    assert bundle.validate(spark, str(folder_of)) == []
    # everything is cached: a change of k alone builds no model
    second = run(spark, tmp_path, folder, config("clustering.k=2"), forbidden, forbidden).fit()
    assert second.cache == {"detection_hits": 7, "detection_misses": 0, "embedding_hits": 6, "embedding_misses": 0}
    # scoring against the first fit
    scored = run(spark, tmp_path, folder, config(), forbidden, forbidden).score(first.run_id)
    assert scored.counts["embedded_instances"] == 6
    with pytest.raises(ConfigurationError, match="another way"):
        run(spark, tmp_path, folder, config("embedding.box_padding_fraction=0.2")).score(first.run_id)
    with pytest.raises(ConfigurationError, match="image vectors"):
        run(spark, tmp_path, folder, config("embedding.granularity=image")).score(first.run_id)
    # a damaged bundle
    (folder_of / "config.json").write_text("{}")
    assert bundle.validate(spark, str(folder_of)) == ["config.json: digest differs"]


def test_image_granularity(spark, tmp_path, folder):
    got = run(spark, tmp_path, folder, config("embedding.granularity=image")).fit()
    assert got.counts["instances"] == 7
    rows = spark.read.parquet(str(tmp_path / "out-review")).toPandas().set_index("image_path")
    assert rows.num_defects["normal.png"] == 0 and rows.primary_cluster_id.notna().all() and rows.detection_bbox_cluster["normal.png"] == "[]"


def test_corrupt_image_is_a_row(spark, tmp_path, folder):
    (folder / "broken.png").write_bytes(b"not-an-image")
    got = run(spark, tmp_path, folder, config("runtime.max_failure_fraction=0.25")).fit()
    assert got.counts["error_images"] == 1
    bad = spark.read.parquet(str(tmp_path / "out-review")).filter("image_status = 'ERROR'").collect()
    assert [(r.image_path, r.error_code, r.instances_json) for r in bad] == [("broken.png", "IMAGE_DECODE_FAILED", "[]")]
    log = spark.read.parquet(str(tmp_path / "out" / got.manifest_path.rpartition("/")[0] / "failures.parquet")).collect()
    assert [(r.stage, r.error_code, r.sanitized_message) for r in log] == [("decode", "IMAGE_DECODE_FAILED", "not a PNG: <redacted-path>")]
    with pytest.raises(FatalPipelineError):
        run(spark, tmp_path, folder, config("runtime.max_failure_fraction=0.1"), name="again").fit()


def test_image_that_changes_during_the_run(spark, tmp_path, folder):
    p = run(spark, tmp_path, folder, config("runtime.max_failure_fraction=0.5"))
    detect = p._detect

    def then_change(images):
        out = detect(images)
        (folder / "red" / "1.png").write_bytes(png(RED, 100))
        return out

    p._detect = then_change
    got = p.fit()
    rows = spark.read.parquet(str(tmp_path / "out-review")).filter("image_status = 'ERROR'").collect()
    assert [(r.image_path, r.error_code) for r in rows] == [("red/1.png", "IMAGE_CHANGED_DURING_RUN")] and got.counts["embedded_instances"] == 5


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(FatalPipelineError):
        run(spark, tmp_path, tmp_path / "none").fit()


def test_pointer_moves_last(spark, tmp_path):
    store = LocalStore(tmp_path / "s")
    empty = {n: spark.createDataFrame([], s) for n, s in bundle.TABLES.items()}
    first = bundle.publish(store, "r1", empty, {"centroids.f32.npy": np.eye(2, dtype=np.float32)}, {}, {"clustering": {"k": 2}, "signatures": {"granularity": "object", "padding_fraction": 0.15, "embedding": "e"}}, lambda: None)

    def crash():
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        bundle.publish(store, "r2", empty, {}, {}, {}, lambda: None, crash)
    assert bundle.load_fit(store).run_id == first.run_id == store.read_json("LATEST.json")["run_id"]
    shutil.copy(store.path("runs/r2/manifest.json"), store.path("runs/r1/manifest.json"))
    with pytest.raises(ArtifactError):
        bundle.load_fit(store)
    with pytest.raises(ArtifactError):
        store.read("../outside")


def test_audit(spark):
    df = spark.createDataFrame([(True,)] * 99 + [(False,)], "ok boolean")
    got = audit(df, "ok", 0.95)
    assert got["accepted"] and got["audited"] == 100 and abs(got["lower_bound"] - 0.95344) < 1e-5


def test_streaming_scores(spark, tmp_path):
    from curaspark.streaming.score import cluster_counts, score_stream, vector_stream

    rows = spark.createDataFrame([(i, [1.0, 0.1] if i % 2 else [0.1, 1.0]) for i in range(10)], "vec_id bigint, v array<float>")
    rows.write.parquet(str(tmp_path / "in"))
    c = np.eye(2)
    q = score_stream(vector_stream(spark, str(tmp_path / "in"), rows.schema), "v", c, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert {r.vec_id: r.cluster_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: 0 if i % 2 else 1 for i in range(10)}
    from pyspark.sql import functions as F

    timed = rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert sorted(r.n for r in cluster_counts(timed, "v", c, "ts").collect()) == [5, 5]
