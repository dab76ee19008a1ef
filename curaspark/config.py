"""Run configuration: frozen dataclasses, YAML groups with dotted overrides, declarative checks, redaction, hashes."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import types
import typing
from dataclasses import dataclass, field
from typing import Any

import yaml

from .errors import ConfigurationError
from .functions.hashing import sha256_json

MISSING = "???"


@dataclass(frozen=True)
class Detector:
    name: str = "detector"
    checkpoint_path: str = MISSING
    expected_checkpoint_sha256: str | None = None
    model_class: str = "Small"
    package_version: str = ""
    class_agnostic: bool = True
    threshold: float = 0.35
    max_detections_per_image: int = 20
    clip_to_image: bool = True
    drop_degenerate: bool = True
    safe_checkpoint_loading: bool = True
    device: str = "cuda"
    batch_size: int = 4
    oom_retries: int = 8
    preprocessing_spec: str = "package_default"
    loader_version: str = "1"


@dataclass(frozen=True)
class Debias:
    enabled: bool = True
    components: int = 20
    basis_image: str = "normalized_zero"


@dataclass(frozen=True)
class Pooling:
    method: str = "fractional_box_mean"
    min_effective_patch_weight: float = 4.0


@dataclass(frozen=True)
class Embedding:
    name: str = "embedder"
    granularity: str = "object"
    model_id: str = ""
    package_version: str = ""
    artifact_path: str = MISSING
    expected_artifact_sha256: str | None = None
    artifact_revision: str = MISSING
    expected_prefix_tokens: int = 5
    input_size: int = 512
    patch_size: int = 16
    embedding_dim: int = 768
    box_padding_fraction: float = 0.15
    letterbox_fill: str = "imagenet_mean"
    layer: str = "final"
    patch_normalization: str = "l2"
    output_normalization: str = "l2"
    positional_debias: Debias = field(default_factory=Debias)
    pooling: Pooling = field(default_factory=Pooling)
    inference_precision: str = "bf16"
    persist_dtype: str = "float16"
    device: str = "cuda"
    batch_size: int = 16
    oom_retries: int = 8
    loader_version: str = "1"


@dataclass(frozen=True)
class Clustering:
    name: str = "spherical_kmeans"
    k: int = 0
    backend: str = "local_sample"
    spherical: bool = True
    niter: int = 25
    nredo: int = 5
    seed: int = 42
    fit_dtype: str = "float32"
    canonicalize_ids: bool = True
    max_points_per_centroid: int = 256
    assignment_chunk_size: int = 100_000
    max_empty_cluster_retries: int = 3


@dataclass(frozen=True)
class Runtime:
    image_extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")
    continue_on_image_error: bool = True
    max_failure_fraction: float = 0.10
    min_successful_instances: int = 2
    force_recompute: bool = False
    sort_paths: bool = True
    temporary_root: str | None = None
    write_checksums: bool = True
    input_read_chunk_size: int = 1_048_576


@dataclass(frozen=True)
class Config:
    schema_version: int = 1
    seed: int = 42
    detector: Detector = field(default_factory=Detector)
    embedding: Embedding = field(default_factory=Embedding)
    clustering: Clustering = field(default_factory=Clustering)
    runtime: Runtime = field(default_factory=Runtime)


#: (group, key, what a persisted configuration shows instead)
REDACTED = (("detector", "checkpoint_path", "<redacted-model-path>"), ("embedding", "artifact_path", "<redacted-model-path>"), ("runtime", "temporary_root", "<redacted-temporary-root>"))


def _among(*values):
    return lambda x: x in values, f"must be one of {', '.join(map(repr, values))}"


def _range(lo, hi, open_ends: bool = False):
    return (lambda x: lo < x < hi, f"must be strictly between {lo} and {hi}") if open_ends else (lambda x: lo <= x <= hi, f"must be in [{lo}, {hi}]")


def _least(lo):
    return lambda x: x >= lo, f"must be at least {lo}"


_TRUE = _among(True)
_PATH = (lambda x: os.path.isabs(str(x)), "must be an absolute path")
_TEXT = (lambda x: bool(str(x).strip()) and x != MISSING, "must be given")
_POSITIVE = (lambda x: x > 0, "must be positive")

#: Each setting's check: what must hold of it, and how a failure reads.
CHECKS: dict[str, tuple[typing.Callable[[Any], bool], str]] = {
    "schema_version": _among(1),
    "detector.checkpoint_path": _PATH,
    "detector.model_class": (lambda x: str(x).strip().lower() not in ("", "auto"), "must name a concrete variant"),
    "detector.class_agnostic": _TRUE,
    "detector.threshold": _range(0.0, 1.0, True),
    "detector.max_detections_per_image": _range(1, 200),
    "detector.clip_to_image": _TRUE,
    "detector.drop_degenerate": _TRUE,
    "detector.safe_checkpoint_loading": _TRUE,
    "detector.device": _among("cuda", "cpu"),
    "detector.batch_size": _least(1),
    "detector.oom_retries": _least(0),
    "embedding.granularity": _among("object", "image"),
    "embedding.artifact_path": _PATH,
    "embedding.artifact_revision": _TEXT,
    "embedding.expected_prefix_tokens": _least(0),
    "embedding.input_size": _least(1),
    "embedding.patch_size": _least(1),
    "embedding.embedding_dim": _least(1),
    "embedding.box_padding_fraction": _range(0.0, 0.5),
    "embedding.letterbox_fill": _among("imagenet_mean"),
    "embedding.layer": _among("final"),
    "embedding.patch_normalization": _among("l2"),
    "embedding.output_normalization": _among("l2"),
    "embedding.pooling.method": _among("fractional_box_mean"),
    "embedding.pooling.min_effective_patch_weight": _POSITIVE,
    "embedding.inference_precision": _among("bf16", "float32"),
    "embedding.persist_dtype": _among("float16"),
    "embedding.device": _among("cuda", "cpu"),
    "embedding.batch_size": _least(1),
    "embedding.oom_retries": _least(0),
    "clustering.k": _least(2),
    "clustering.backend": _among("local_sample", "mllib_cosine"),
    "clustering.spherical": _TRUE,
    "clustering.niter": _least(1),
    "clustering.nredo": _least(1),
    "clustering.fit_dtype": _among("float32"),
    "clustering.canonicalize_ids": _TRUE,
    "clustering.max_points_per_centroid": _least(1),
    "clustering.assignment_chunk_size": _least(1),
    "clustering.max_empty_cluster_retries": _least(0),
    "runtime.image_extensions": _among((".jpg", ".jpeg", ".png")),
    "runtime.continue_on_image_error": _TRUE,
    "runtime.sort_paths": _TRUE,
    "runtime.write_checksums": _TRUE,
    "runtime.max_failure_fraction": _range(0.0, 1.0),
    "runtime.min_successful_instances": _least(2),
    "runtime.input_read_chunk_size": _least(1),
}


def _get(cfg: Any, path: str) -> Any:
    for k in path.split("."):
        cfg = getattr(cfg, k)
    return cfg


def problems(cfg: Config) -> list[str]:
    """Everything that is wrong with a configuration."""
    out = [f"{path} {says}" for path, (ok, says) in CHECKS.items() if not ok(_get(cfg, path))]
    if cfg.detector.device != cfg.embedding.device:
        out.append("detector.device and embedding.device must agree")
    if cfg.embedding.device == "cpu" and cfg.embedding.inference_precision != "float32":
        out.append("embedding.inference_precision must be 'float32' on a CPU")
    if cfg.embedding.patch_size > 0 and cfg.embedding.input_size % cfg.embedding.patch_size:
        out.append("embedding.input_size must be a multiple of embedding.patch_size")
    d = cfg.embedding.positional_debias
    if d.enabled and d.components != 20:
        out.append("embedding.positional_debias.components must be 20")
    if d.enabled and d.basis_image != "normalized_zero":
        out.append("embedding.positional_debias.basis_image must be 'normalized_zero'")
    if cfg.runtime.temporary_root is not None and not os.path.isabs(cfg.runtime.temporary_root):
        out.append("runtime.temporary_root must be an absolute path")
    return out


def _typed(value: Any, kind: Any, path: str) -> Any:
    if isinstance(kind, types.UnionType):
        if value is None:
            return None
        kind = next(k for k in typing.get_args(kind) if k is not type(None))
    if typing.get_origin(kind) is tuple:
        return tuple(value)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigurationError(f"{path} must be {getattr(kind, '__name__', kind)}, not {value!r}")
    return value


def _build(cls: type, values: dict[str, Any], path: str = "") -> Any:
    kinds = typing.get_type_hints(cls)
    unknown = set(values) - set(kinds)
    if unknown:
        raise ConfigurationError(f"unknown settings: {', '.join(sorted(path + k for k in unknown))}")
    made = {k: _build(kinds[k], v, f"{path}{k}.") if dataclasses.is_dataclass(kinds[k]) else _typed(v, kinds[k], path + k) for k, v in values.items()}
    return cls(**made)


def _merge(base: dict, over: dict) -> dict:
    return base | {k: _merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def compose(groups: dict[str, Any] | str | None = None, overrides: list[str] | None = None) -> Config:
    """A checked configuration from nested settings (or YAML text) and ``a.b=value`` overrides; overrides win."""
    given = yaml.safe_load(groups) if isinstance(groups, str) else groups
    tree: dict[str, Any] = dict(given or {})
    for text in overrides or []:
        path, eq, value = text.partition("=")
        if not eq:
            raise ConfigurationError(f"an override reads a.b=value, not {text!r}")
        one: Any = yaml.safe_load(value)
        for k in reversed(path.strip().split(".")):
            one = {k: one}
        tree = _merge(tree, one)
    if "seed" in tree:  # the run's seed is the clustering's unless that has one
        tree = _merge({"clustering": {"seed": tree["seed"]}}, tree)
    cfg = _build(Config, tree)
    if found := problems(cfg):
        raise ConfigurationError("; ".join(found))
    return cfg


def as_dict(cfg: Config, redact: bool = False) -> dict[str, Any]:
    out = dataclasses.asdict(cfg)
    out["runtime"]["image_extensions"] = list(cfg.runtime.image_extensions)
    for group, key, shown in REDACTED if redact else ():
        if out[group][key] is not None:
            out[group][key] = shown
    return out


def as_yaml(cfg: Config, redact: bool = False) -> str:
    return yaml.safe_dump(as_dict(cfg, redact), sort_keys=True, allow_unicode=True)


def config_hash(cfg: Config) -> str:
    """Independent of where models lie on a host."""
    return hashlib.sha256(as_yaml(cfg, True).encode()).hexdigest()


def detector_signature(cfg: Config, checkpoint_sha256: str) -> str:
    """What a cached detection depends on; batch sizes and retries are not part of it."""
    d = cfg.detector
    keys = ("package_version", "model_class", "preprocessing_spec", "threshold", "max_detections_per_image", "device", "clip_to_image", "drop_degenerate", "loader_version")
    return sha256_json({k: getattr(d, k) for k in keys} | {"checkpoint_sha256": checkpoint_sha256, "postprocess_version": 1})


def basis_signature(cfg: Config, artifact_sha256: str) -> str:
    e = cfg.embedding
    keys = ("artifact_revision", "model_id", "package_version", "loader_version", "input_size", "patch_size", "device", "inference_precision")
    return sha256_json({k: getattr(e, k) for k in keys} | {"artifact_sha256": artifact_sha256, "components": e.positional_debias.components, "basis_image": e.positional_debias.basis_image, "basis_version": 2})


def embedding_signature(cfg: Config, artifact_sha256: str, basis_sha256: str) -> str:
    """What a cached vector depends on; whole images have no padding."""
    e = cfg.embedding
    keys = ("artifact_revision", "model_id", "package_version", "loader_version", "input_size", "patch_size", "granularity", "layer", "letterbox_fill", "patch_normalization", "device", "inference_precision")
    padding = 0.0 if e.granularity == "image" else e.box_padding_fraction
    return sha256_json({k: getattr(e, k) for k in keys} | {"artifact_sha256": artifact_sha256, "basis_sha256": basis_sha256, "padding_fraction": padding, "pooling": dataclasses.asdict(e.pooling), "embedding_version": 2, "pooling_version": 1})


#: Form fields of a run and administrator's settings, with the setting that each one is: fixed values.
FORM = {
    "cluster_count": "clustering.k",
    "embedding_granularity": "embedding.granularity",
    "detection_threshold": "detector.threshold",
    "box_padding_fraction": "embedding.box_padding_fraction",
    "max_detections_per_image": "detector.max_detections_per_image",
    "force_recompute": "runtime.force_recompute",
}
ADMIN = {
    "detector_checkpoint_path": "detector.checkpoint_path",
    "detector_checkpoint_sha256": "detector.expected_checkpoint_sha256",
    "detector_model_class": "detector.model_class",
    "embedder_artifact_path": "embedding.artifact_path",
    "embedder_artifact_sha256": "embedding.expected_artifact_sha256",
    "embedder_artifact_revision": "embedding.artifact_revision",
    "max_failure_fraction": "runtime.max_failure_fraction",
    "temporary_root": "runtime.temporary_root",
}


def overrides_from(form: dict[str, Any], admin: dict[str, Any], gpu: bool = False) -> list[str]:
    """Overrides of a submitted form and the administrator's settings; blank fields keep their defaults, unknown ones are errors.

    Both models run on the same kind of device; without a GPU the embedder computes in 32 bits.
    """
    out = []
    for given, known in ((form, FORM), (admin, ADMIN)):
        if unknown := set(given) - set(known):
            raise ConfigurationError(f"unknown fields: {', '.join(sorted(unknown))}")
        out += [f"{known[k]}={yaml.safe_dump(v, default_flow_style=True).splitlines()[0]}" for k, v in given.items() if v is not None and v != ""]
    device, precision = ("cuda", "bf16") if gpu else ("cpu", "float32")
    return [*out, f"detector.device={device}", f"embedding.device={device}", f"embedding.inference_precision={precision}"]
