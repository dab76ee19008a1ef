"""Run bundles: a versioned folder of tables and documents, its checksums, its manifest, and the pointer to the latest.

Tables are written by Spark into a staging folder as part files; every part is
hashed and listed.  Order of commitment: tables, matrices, checksums, manifest
(read back and compared), review rows, pointer.  A crash before the pointer
leaves the previous run in force.  Whether a bundle is intact is a join of what
its manifest lists with what its files hash to.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError, ConfigurationError
from ..schemas import CLUSTER_SUMMARY, FAILURES, INPUT_MANIFEST, INSTANCES, conform
from ..session import map_arrow, ship_package
from ..sources.store import LocalStore, file_sha256

TABLES = {"input_manifest.parquet": INPUT_MANIFEST, "instances.parquet": INSTANCES, "cluster_summary.parquet": CLUSTER_SUMMARY, "failures.parquet": FAILURES}
MANIFEST, CHECKSUMS, LATEST = "manifest.json", "checksums.sha256", "LATEST.json"


@dataclass(frozen=True)
class Published:
    run_id: str
    manifest_path: str
    manifest_sha256: str


def now() -> str:
    """One stamp, taken on the driver."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def new_run_id() -> str:
    return str(uuid.uuid4())


def publish(store: LocalStore, run_id: str, tables: dict[str, DataFrame], matrices: dict[str, np.ndarray], documents: dict[str, object], manifest: dict, write_review: Callable[[], None], before_latest: Callable[[], None] | None = None) -> Published:
    """Writes ``runs/<run_id>`` and moves the pointer. ``write_review`` writes the review table."""
    folder = f"runs/{run_id}"
    if store.path(folder).exists():
        raise ArtifactError(f"run {run_id} exists")
    store.path("runs").mkdir(exist_ok=True)
    staging = Path(tempfile.mkdtemp(dir=store.path("runs"), prefix=".staging-"))
    try:
        inner = LocalStore(staging)
        for name, df in tables.items():
            conform(df, TABLES[name]).write.option("compression", "zstd").parquet(str(staging / name))
        for name, rows in matrices.items():
            inner.write_matrix(name, rows)
        for name, value in documents.items():
            inner.write_json(name, value)
        names = [n for n in inner.list() if not Path(n).name.startswith(("_", "."))]
        artifacts = {n: {"sha256": file_sha256(inner.path(n))} for n in names}
        inner.write(CHECKSUMS, "".join(f"{artifacts[n]['sha256']}  {n}\n" for n in names).encode())
        artifacts[CHECKSUMS] = {"sha256": file_sha256(inner.path(CHECKSUMS))}
        digest = inner.write_json(MANIFEST, manifest | {"schema_version": "1.0", "run_id": run_id, "created_at_utc": now(), "artifacts": artifacts})
        staging.rename(store.path(folder))
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    path = f"{folder}/{MANIFEST}"
    if hashlib.sha256(store.read(path)).hexdigest() != digest:
        raise ArtifactError("the manifest differs from what was written")
    write_review()
    if before_latest is not None:
        before_latest()
    store.write_json(LATEST, {"schema_version": 1, "run_id": run_id, "manifest_path": path, "manifest_sha256": digest, "published_at_utc": now()})
    return Published(run_id, path, digest)


@dataclass(frozen=True)
class FitReference:
    run_id: str
    centroids: np.ndarray
    granularity: str
    padding: float
    embedding_signature: str


def load_fit(store: LocalStore, run_id: str | None = None) -> FitReference:
    """A fitted run's centroids and what scoring has to agree with; manifest and centroids are verified in either case."""
    if run_id:
        path, want = f"runs/{run_id}/{MANIFEST}", None
    else:
        latest = store.read_json(LATEST)
        path, want = latest["manifest_path"], latest["manifest_sha256"]
    raw = store.read(path)
    if want is not None and hashlib.sha256(raw).hexdigest() != want:
        raise ArtifactError("the latest manifest differs from its pointer")
    manifest = json.loads(raw)
    folder = path.rpartition("/")[0]
    name = "centroids.f32.npy"
    if file_sha256(store.path(f"{folder}/{name}")) != manifest["artifacts"][name]["sha256"]:
        raise ArtifactError("the centroids differ from their manifest")
    c = store.read_matrix(f"{folder}/{name}")
    if c.ndim != 2 or not np.isfinite(c).all() or len(c) != manifest["clustering"]["k"]:
        raise ArtifactError("the centroids are not a finite K x D matrix")
    s = manifest["signatures"]
    return FitReference(manifest["run_id"], c, s["granularity"], float(s["padding_fraction"]), s["embedding"])


def require_compatible(fit: FitReference, granularity: str, dimension: int, signature: str) -> None:
    if fit.granularity != granularity:
        raise ConfigurationError(f"the fit is of {fit.granularity} vectors, not of {granularity} vectors")
    if fit.centroids.shape[1] != dimension:
        raise ConfigurationError(f"the fit has {fit.centroids.shape[1]} dimensions, not {dimension}")
    if fit.embedding_signature != signature:
        raise ConfigurationError("the fit's vectors were made in another way")


def listed_artifacts(manifest: DataFrame) -> DataFrame:
    """name, expected from a DataFrame with a column ``artifacts`` (map of name to digest)."""
    return manifest.select(F.explode("artifacts").alias("name", "expected"))


def artifact_errors(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """name, error for every listed artifact that is unsafe, malformed, missing or different. ``actual``: name, sha256."""
    unsafe = F.col("name").startswith("/") | F.col("name").contains("\\") | F.exists(F.split("name", "/"), lambda x: x.isin("", ".", ".."))
    j = listed.join(actual, "name", "left")
    error = F.when(unsafe, "unsafe path").when(~F.col("expected").rlike("^[0-9a-f]{64}$"), "malformed digest").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "digest differs")
    return j.select("name", error.alias("error")).filter("error is not null")


def parse_checksums(text: str) -> tuple[dict[str, str], list[str]]:
    """name to digest, and the lines that do not read as a digest, two spaces and a name."""
    good, bad = {}, []
    for line in text.splitlines():
        digest, gap, name = line.partition("  ")
        if gap and name and len(digest) == 64 and not set(digest) - set("0123456789abcdef"):
            good[name] = digest
        else:
            bad.append(line)
    return good, bad


def validate(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with a bundle; the files' digests are taken by tasks."""
    ship_package(spark)
    root = Path(folder).resolve()
    if not (root / MANIFEST).is_file():
        return [f"{MANIFEST}: missing"]
    manifest = json.loads((root / MANIFEST).read_text())
    listed = {n: str(v.get("sha256", "")) for n, v in manifest.get("artifacts", {}).items()}
    sums, bad = parse_checksums((root / CHECKSUMS).read_text()) if (root / CHECKSUMS).is_file() else ({}, [])
    out = [f"{CHECKSUMS}: malformed line {line!r}" for line in bad]
    out += [f"{n}: the manifest and the checksums disagree" for n, d in sums.items() if listed.get(n) != d]
    present = [(p.relative_to(root).as_posix(),) for p in root.rglob("*") if p.is_file() and not p.is_symlink()]
    if not listed:
        return [*out, "the manifest lists nothing"]
    files = spark.createDataFrame(present, "name string")
    top = str(root)

    def digest(batches):
        import pyarrow as pa

        for b in batches:
            names = b.column("name").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([file_sha256(f"{top}/{n}") for n in names], pa.string())], ["name", "sha256"])

    actual = map_arrow(files, digest, "name string, sha256 string")
    found = artifact_errors(spark.createDataFrame(list(listed.items()), "name string, expected string"), actual)
    return out + [f"{r.name}: {r.error}" for r in found.orderBy("name").collect()]


def demo_errors(spark: SparkSession) -> DataFrame:
    """The errors of a small made-up listing: one artifact of each kind."""
    sha = lambda x: F.sha2(F.lit(x).cast("binary"), 256)
    one = spark.range(1)
    names = F.explode(F.array(*(F.named_struct(F.lit("name"), F.lit(n), F.lit("expected"), e) for n, e in (("a.bin", sha("a")), ("b.bin", sha("other")), ("c.bin", sha("c")), ("../d.bin", sha("d")), ("e.bin", F.lit("xyz"))))))
    files = F.explode(F.array(*(F.named_struct(F.lit("name"), F.lit(n), F.lit("sha256"), sha(n[0])) for n in ("a.bin", "b.bin", "e.bin"))))
    return artifact_errors(one.select(names.alias("x")).select("x.*"), one.select(files.alias("x")).select("x.*"))
