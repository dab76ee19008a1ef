"""Runs over a folder of images: fit clusters, score against a fit, audit.

Models are injected: a detector (``predict(list of Decoded, threshold)`` gives a
list of (box, score, class) per image) and an embedder (``patch_maps(list of
(Decoded, geometry))`` gives a (C, H, W) map each).  They see only what the
caches lack; the driver composes tables, writes them between the stages, and
stops a run where too much fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import schemas as S
from ..errors import FatalPipelineError, RowError
from ..functions import geometry as G
from ..functions import pooling
from ..functions.audit import lower_bound
from ..functions.hashing import sha256_json
from ..functions.vectors import assign
from ..operators import caching, clustering, detections, inference, instances, review, summary
from ..session import ship_package, spill
from ..sources import images as sources
from ..sources.store import LocalStore, load_basis, save_basis, save_signature
from . import bundle


@dataclass(frozen=True)
class Models:
    """Factories of the injected models, and the digests that identify them."""

    decode: Callable[[bytes], sources.Decoded]
    detector: Callable[[C.Config], Any]
    embedder: Callable[[C.Config], Any]
    checkpoint_sha256: str
    artifact_sha256: str
    blank_patches: np.ndarray | None = None  # the embedder's map of a blank image, for the positional basis


@dataclass(frozen=True)
class Result:
    run_id: str
    manifest_path: str
    counts: dict[str, int]
    cache: dict[str, int]


class CurationPipeline:
    def __init__(self, spark: SparkSession, root: str, store: LocalStore, review_path: str, cfg: C.Config, models: Models, cache_path: str | None = None, read: Callable[[str], bytes] | None = None):
        ship_package(spark)
        self.spark, self.root, self.store, self.review_path, self.cfg, self.models = spark, root, store, review_path, cfg, models
        self.cache = cache_path or str(store.path("cache"))
        self.read = read or sources.read_bytes(root)

    # the stages

    def _images(self) -> DataFrame:
        paths = spill(sources.eligible_paths(sources.list_files(self.spark, self.root)), "paths")
        if paths.isEmpty():
            raise FatalPipelineError("the folder has no images")
        n = max(1, min(paths.count(), self.spark.sparkContext.defaultParallelism * 4))
        return spill(sources.scan(paths.repartition(n, "image_path"), self.read, self.models.decode), "images")

    def _detect(self, images: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """Images with detections and status, failures, cache counters."""
        cfg, read, decode, detector = self.cfg, self.read, self.models.decode, self.models.detector
        d = cfg.detector
        signature = C.detector_signature(cfg, self.models.checkpoint_sha256)
        save_signature(self.store, "detector", signature, C.as_dict(cfg, True)["detector"] | {"checkpoint_sha256": self.models.checkpoint_sha256})
        usable = instances.usable(images)
        stored = caching.read_cache(self.spark, f"{self.cache}/detections", S.DETECTION_CACHE)
        known = caching.valid_detections(stored, signature, d.threshold, d.max_detections_per_image)
        if cfg.runtime.force_recompute:
            known = known.limit(0)
        known = spill(known, "known")
        counts = caching.counters(usable, known, ["image_sha256"]).first()
        todo = caching.misses(usable, known, ["image_sha256"]).dropDuplicates(["image_sha256"])

        def call(model, rows):
            found = model.predict([decode(read(r["image_path"])) for r in rows], d.threshold)
            box = lambda b: dict(zip(G.SIDES, map(float, b), strict=True))
            return [{"raw": [{"bbox": box(b), "score": float(s), "raw_class_id": c} for b, s, c in one]} for one in found]

        keep = ["image_path", "image_sha256", "image_width", "image_height"]
        tried = spill(inference.apply_model(todo.select(*keep), keep, lambda: detector(cfg), call, f"raw array<{S.DETECTION}>", d.batch_size, d.oom_retries, "DETECTOR", "detection"), "detected")
        good = tried.filter("error_code is null")
        raw = good.select(*keep, F.explode("raw").alias("x")).select(*keep, "x.*")
        nested = detections.nest(detections.postprocess(raw, detections.DetectionParams(d.threshold, d.max_detections_per_image)))
        fresh = good.select(*keep).join(nested, "image_path", "left")
        empty = F.filter(F.from_json(F.lit("[]"), f"array<{S.DETECTION}>"), lambda _: F.lit(False))
        fresh = fresh.select(F.lit(signature).alias("detector_signature"), "image_sha256", "image_width", "image_height", F.coalesce("detections", empty).alias("detections"))
        fresh = spill(S.conform(fresh, S.DETECTION_CACHE), "fresh")
        caching.append_new(fresh, f"{self.cache}/detections", ["detector_signature", "image_sha256"], "detector_signature")
        by_content = known.select("image_sha256", "detections").unionByName(fresh.select("image_sha256", "detections"))
        lost = tried.filter("error_code is not null").select("image_sha256", F.col("error_code").alias("_code"), F.col("error_message").alias("_message"))
        joined = images.join(by_content, "image_sha256", "left").join(lost, "image_sha256", "left")
        failed = F.col("_code").isNotNull()
        joined = joined.withColumn("detections", F.coalesce("detections", empty)).withColumn("error_code", F.coalesce("_code", "error_code")).withColumn("error_message", F.coalesce("_message", "error_message"))
        status = F.when(failed, "ERROR").when((F.col("image_status") == "OK") & (F.size("detections") == 0), "NO_DETECTION").otherwise(F.col("image_status"))
        out = joined.withColumn("image_status", status).withColumn("warning_codes", F.array().cast("array<string>")).drop("_code", "_message")
        return spill(out, "with-detections"), self._failures(tried), {"detection_hits": counts.hits, "detection_misses": counts.misses}

    def _failures(self, tried: DataFrame) -> DataFrame:
        bad = tried.filter("error_code is not null")
        has = set(bad.columns)
        text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
        retries = F.coalesce("retry_count", F.lit(0)) if "retry_count" in has else F.lit(0)
        return bad.select("image_path", text("image_sha256").alias("image_sha256"), text("instance_id").alias("instance_id"), "stage", "error_code", F.coalesce(text("exception_type"), F.lit("RowError")).alias("exception_type"), F.coalesce(text("error_message"), F.lit("")).alias("message"), retries.alias("retry_count"))

    def _basis(self) -> tuple[np.ndarray | None, str]:
        """The positional basis, from the store or from the embedder's map of a blank image, and its digest."""
        e, blank = self.cfg.embedding, self.models.blank_patches
        if not e.positional_debias.enabled or blank is None:
            return None, "none"
        signature = C.basis_signature(self.cfg, self.models.artifact_sha256)
        n = e.positional_debias.components
        got = load_basis(self.store, signature, (blank.shape[0], n))
        if got is None:
            basis = pooling.positional_basis(blank, n)
            got = basis, save_basis(self.store, signature, basis)
        return got

    def _embed(self, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int], str]:
        """Images with their status, instances with vectors, failures, cache counters, embedding signature."""
        cfg, read, decode, embedder = self.cfg, self.read, self.models.decode, self.models.embedder
        e = cfg.embedding
        basis, basis_sha = self._basis()
        signature = C.embedding_signature(cfg, self.models.artifact_sha256, basis_sha)
        save_signature(self.store, "embedding", signature, C.as_dict(cfg, True)["embedding"] | {"artifact_sha256": self.models.artifact_sha256, "basis_sha256": basis_sha})
        usable = instances.usable(images)
        if e.granularity == "image":
            made = instances.of_images(usable)
        else:
            flat = usable.select("image_path", "image_sha256", "image_width", "image_height", F.posexplode("detections").alias("p", "x"))
            flat = flat.select("image_path", "image_sha256", "image_width", "image_height", (F.col("p") + 1).alias("det_rank"), "x.*")
            made = instances.of_objects(flat, C.detector_signature(cfg, self.models.checkpoint_sha256))
        cols = ["instance_id", "instance_key", "image_path", "image_sha256", "image_width", "image_height", "bbox", "bbox_xywh", "score", "raw_class_id", "det_rank", "embedding_granularity"]
        made = spill(made.select(*cols), "instances")
        stored = caching.read_cache(self.spark, f"{self.cache}/embeddings", S.EMBEDDING_CACHE)
        known = caching.valid_vectors(stored, signature, e.embedding_dim)
        known = spill(known.limit(0) if cfg.runtime.force_recompute else known, "known")
        counts = caching.counters(made, known, ["instance_key"]).first()
        # a second scan, after detection is written: changed images fail even where every vector is cached
        again = sources.scan(made.select("image_path").distinct(), read, None)
        moved = spill(sources.changed(made.select("image_path", "image_sha256").distinct(), again), "changed")
        steady = made.join(moved.select("image_path"), "image_path", "left_anti")
        todo = caching.misses(steady, known, ["instance_key"]).dropDuplicates(["instance_key"])
        w, h, padding = F.col("image_width"), F.col("image_height"), 0.0 if e.granularity == "image" else e.box_padding_fraction
        todo = todo.withColumn("crop", G.crop_box(G.expand(F.col("bbox"), padding, w, h), w, h)).withColumn("letterbox", G.letterbox(F.col("crop"), e.input_size))
        todo = todo.withColumn("target", G.into_letterbox(F.col("bbox"), F.col("crop"), F.col("letterbox"), e.input_size)).withColumn("content", G.content_box(F.col("letterbox")))
        side = lambda b: tuple(b[k] for k in G.SIDES)

        def call(model, rows):
            items = []
            for r in rows:
                data = read(r["image_path"])
                if hashlib.sha256(data).hexdigest() != r["image_sha256"]:
                    raise RowError("IMAGE_CHANGED_DURING_RUN", "embedding_read", "the bytes differ from those first read")
                items.append((decode(data), {k: r[k] for k in ("crop", "letterbox", "target", "content")}))
            out = []
            for r, m in zip(rows, model.patch_maps(items), strict=True):
                try:
                    p = pooling.pool(np.asarray(m), side(r["target"]), float(e.input_size), e.pooling.min_effective_patch_weight, basis, side(r["content"]))
                except ValueError as error:
                    raise RowError("EMBEDDING_POOLING_FAILED", "pooling", str(error)) from error
                out.append({"vector": p.vector.astype(np.float16).astype(np.float32).tolist(), "expanded": bool(p.expanded)})
            return out

        keep = ["instance_id", "instance_key", "image_path", "image_sha256"]
        tried = spill(inference.apply_model(todo, keep, lambda: embedder(cfg), call, "vector array<float>, expanded boolean", e.batch_size, e.oom_retries, "EMBEDDER", "embedding"), "embedded")
        fresh = tried.filter("error_code is null").select(F.lit(signature).alias("embedding_signature"), "instance_key", "vector")
        caching.append_new(S.conform(fresh, S.EMBEDDING_CACHE), f"{self.cache}/embeddings", ["embedding_signature", "instance_key"], "embedding_signature")
        vectors = known.select("instance_key", "vector", F.lit("CACHED").alias("_how"), F.lit(False).alias("_grown")).unionByName(tried.filter("error_code is null").select("instance_key", "vector", F.lit("COMPUTED").alias("_how"), F.col("expanded").alias("_grown")))
        j = made.join(vectors, "instance_key", "left").join(moved.select("image_path", F.lit(True).alias("_moved")), "image_path", "left")
        ok = F.col("_moved").isNull() & F.col("vector").isNotNull()
        j = j.withColumn("embedding_status", F.when(ok, F.col("_how")).otherwise("ERROR")).withColumn("vector", F.when(ok, F.col("vector")))
        j = j.withColumn("warning_codes", F.when(ok & F.col("_grown"), F.array(F.lit("POOLING_BOX_EXPANDED"))).otherwise(F.array().cast("array<string>"))).drop("_how", "_grown", "_moved")
        j = spill(j, "with-vectors")
        marked = summary.statuses_after_embedding(images, j.select("image_path", "embedding_status"))
        marked = marked.join(moved.select("image_path", F.col("error_code").alias("_code")), "image_path", "left")
        marked = marked.withColumn("image_status", F.when(F.col("_code").isNotNull(), "ERROR").otherwise(F.col("image_status"))).withColumn("error_code", F.coalesce("_code", "error_code")).drop("_code")
        failures = self._failures(tried).unionByName(self._failures(moved))
        return spill(marked, "judged"), j, failures, {"embedding_hits": counts.hits, "embedding_misses": counts.misses}, signature

    def _prepare(self):
        scanned = self._images()
        images, failed, cache = self._detect(scanned)
        most = self.cfg.runtime.max_failure_fraction
        summary.require_few_failures(images, most)
        summary.require_one_class(images.select(F.explode("detections").alias("x")).select("x.raw_class_id"))
        images, made, more, counters, signature = self._embed(images)
        summary.require_few_failures(images, most)
        early = self._failures(scanned.withColumn("stage", F.col("error_stage")))
        return images, made, early.unionByName(failed).unionByName(more), cache | counters, signature

    # the entry points

    def fit(self) -> Result:
        cfg = self.cfg
        started, (images, made, failures, cache, signature) = bundle.now(), self._prepare()
        valid = made.filter("vector is not null")
        n = valid.count()
        if n < cfg.runtime.min_successful_instances:
            raise FatalPipelineError(f"{n} instances could be embedded; {cfg.runtime.min_successful_instances} are needed")
        rows = spill(summary.embedding_rows(valid, ["image_path", "det_rank", "instance_id"]), "rows")
        c = cfg.clustering
        named, fit = clustering.fit(rows, clustering.FitParams(c.k, c.niter, c.nredo, c.seed, c.max_points_per_centroid, c.max_empty_cluster_retries, c.backend))
        return self._publish("fit", started, images, made, named, fit.centroids, failures, cache, signature, {"k": c.k, "seed_used": fit.seed_used, "objective": fit.objective})

    def score(self, fit_run_id: str | None = None, fit_store: LocalStore | None = None) -> Result:
        fit = bundle.load_fit(fit_store or self.store, fit_run_id)
        started = bundle.now()
        if fit.granularity != self.cfg.embedding.granularity or fit.centroids.shape[1] != self.cfg.embedding.embedding_dim:
            bundle.require_compatible(fit, self.cfg.embedding.granularity, self.cfg.embedding.embedding_dim, fit.embedding_signature)
        images, made, failures, cache, signature = self._prepare()
        bundle.require_compatible(fit, self.cfg.embedding.granularity, self.cfg.embedding.embedding_dim, signature)
        valid = made.filter("vector is not null")
        if valid.isEmpty():
            raise FatalPipelineError("no instance could be embedded")
        rows = spill(summary.embedding_rows(valid, ["image_path", "det_rank", "instance_id"]), "rows")
        named = assign(rows, "vector", fit.centroids)
        return self._publish("score", started, images, made, named, fit.centroids, failures, cache, signature, {"k": len(fit.centroids), "fit_reference": fit.run_id})

    def _publish(self, kind, started, images, made, named, centroids, failures, cache, signature, clustered) -> Result:
        cfg, run_id = self.cfg, bundle.new_run_id()
        places = named.select("instance_id", "embedding_row", "cluster_id", "cosine_to_centroid")
        full = spill(review.ranked(made.join(places, "instance_id", "left")), "ranked")
        counts = summary.run_counts(images, full).first().asDict()
        manifest_rows = images.select("image_path", "image_sha256", "byte_size", "source_mode", "image_width", "image_height", "image_status", "error_code", "error_message", "warning_codes")
        failed = failures.withColumn("run_id", F.lit(run_id)).withColumn("occurred_at_utc", F.lit(bundle.now()))
        b = F.col("bbox")
        flat = full.select(
            F.lit(run_id).alias("run_id"), "instance_id", "instance_key", "image_path", "image_sha256", *(F.col("bbox_xywh")[s].alias(f"bbox_{t}") for s, t in (("x", "xmin"), ("y", "ymin"), ("w", "width"), ("h", "height"))),
            F.array(*(b[k] for k in G.SIDES)).alias("bbox_xyxy_float"), F.col("score").alias("detector_score"), "raw_class_id", "embedding_granularity", "embedding_row", "embedding_status", "cluster_id", "cosine_to_centroid", "cluster_rank", "cluster_size", "warning_codes",
        )
        tables = {"input_manifest.parquet": manifest_rows, "instances.parquet": flat, "cluster_summary.parquet": summary.cluster_summary(full), "failures.parquet": summary.failure_log([failed])}
        vectors = named.select("embedding_row", "vector").orderBy("embedding_row")
        padding = 0.0 if cfg.embedding.granularity == "image" else cfg.embedding.box_padding_fraction
        manifest = {
            "pipeline": kind, "job": {"started_at_utc": started, "completed_at_utc": bundle.now()},
            "input": {"root": self.root, "image_count": counts["images"], "input_manifest_sha256": summary.input_manifest_sha(manifest_rows)}, "counts": counts, "cache": cache,
            "signatures": {"detector": C.detector_signature(cfg, self.models.checkpoint_sha256), "embedding": signature, "granularity": cfg.embedding.granularity, "padding_fraction": padding, "config": C.config_hash(cfg)},
            "models": {"checkpoint_sha256": self.models.checkpoint_sha256, "artifact_sha256": self.models.artifact_sha256}, "clustering": clustered,
            "effective_batch_sizes": {"detector": cfg.detector.batch_size, "embedder": cfg.embedding.batch_size},
        }
        documents = {"config.json": C.as_dict(cfg, True), "provenance.json": {"spark": self.spark.version, "numpy": np.__version__, "run_sha256": sha256_json(manifest["signatures"])}}
        rows = review.in_review_order(review.review_rows(images, full, run_id, cfg.embedding.granularity, exact_text=True))
        matrices = {"centroids.f32.npy": np.asarray(centroids, np.float32)}
        # vectors stay a table: row i of a matrix is embedding_row i of it
        vectors.write.mode("overwrite").parquet(str(self.store.path(f"embeddings/{run_id}")))
        got = bundle.publish(self.store, run_id, tables, matrices, documents, manifest, lambda: rows.write.mode("overwrite").parquet(self.review_path))
        return Result(run_id, got.manifest_path, counts, cache)


def export_matrix(store: LocalStore, spark: SparkSession, run_id: str, name: str = "embeddings.f16.npy") -> None:
    """The vectors of a run as one 16-bit matrix in embedding_row order, streamed row group by row group into the file."""
    df = spark.read.parquet(str(store.path(f"embeddings/{run_id}")))
    n, first = df.count(), df.first()
    path = store.path(f"embeddings/{name}")
    out = np.lib.format.open_memmap(path, "w+", np.float16, (n, len(first.vector)))
    for r in df.orderBy("embedding_row").toLocalIterator():
        out[r.embedding_row] = r.vector
    out.flush()


def audit(reviewed: DataFrame, correct: str, target: float, confidence: float = 0.95) -> dict[str, float | int | bool]:
    """Counts of reviewed rows, the exact lower bound of the correct share, and whether it passes the target."""
    r = reviewed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("k")).first()
    bound = lower_bound(r.k, r.n, confidence)
    return {"audited": r.n, "correct": r.k, "lower_bound": bound, "accepted": bound > target}


__all__ = ["CurationPipeline", "Models", "Result", "audit", "export_matrix"]
