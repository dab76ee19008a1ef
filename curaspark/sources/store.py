"""Artifact stores: small documents and matrices beside the tables, written atomically, paths kept inside the root."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
from pathlib import Path

import numpy as np

from ..errors import ArtifactError
from ..functions.pooling import is_basis


class LocalStore:
    """Documents below a local or mounted folder."""

    def __init__(self, root: str | os.PathLike):
        self.root = Path(root).resolve()
        self.root.mkdir(parents=True, exist_ok=True)

    def path(self, name: str) -> Path:
        full = (self.root / name).resolve()
        if full != self.root and self.root not in full.parents:
            raise ArtifactError(f"{name!r} leaves the store")
        return full

    def exists(self, name: str) -> bool:
        return self.path(name).is_file()

    def read(self, name: str) -> bytes:
        try:
            return self.path(name).read_bytes()
        except OSError as e:
            raise ArtifactError(f"{name!r} cannot be read: {e}") from e

    def list(self, prefix: str = "") -> list[str]:
        return sorted(p.relative_to(self.root).as_posix() for p in self.path(prefix).rglob("*") if p.is_file() and not p.name.startswith("."))

    def write(self, name: str, data: bytes) -> str:
        """Writes whole or not at all; returns the SHA-256."""
        full = self.path(name)
        full.parent.mkdir(parents=True, exist_ok=True)
        fd, temporary = tempfile.mkstemp(dir=full.parent, prefix=".")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            os.replace(temporary, full)
        except BaseException:
            Path(temporary).unlink(missing_ok=True)
            raise
        return hashlib.sha256(data).hexdigest()

    def read_json(self, name: str) -> dict:
        try:
            return json.loads(self.read(name))
        except ValueError as e:
            raise ArtifactError(f"{name!r} is not JSON: {e}") from e

    def write_json(self, name: str, value: object) -> str:
        return self.write(name, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False).encode())

    def read_matrix(self, name: str) -> np.ndarray:
        return np.load(io.BytesIO(self.read(name)), allow_pickle=False)

    def write_matrix(self, name: str, rows: np.ndarray) -> str:
        out = io.BytesIO()
        np.save(out, rows, allow_pickle=False)
        return self.write(name, out.getvalue())


def save_basis(store: LocalStore, signature: str, basis: np.ndarray) -> str:
    """Writes an orthonormal basis and its digest under its signature."""
    if not is_basis(basis):
        raise ArtifactError("the basis is not orthonormal")
    digest = store.write_matrix(f"specs/basis/{signature}.npy", basis)
    store.write_json(f"specs/basis/{signature}.json", {"signature": signature, "sha256": digest, "shape": list(basis.shape)})
    return digest


def load_basis(store: LocalStore, signature: str, shape: tuple[int, int]) -> tuple[np.ndarray, str] | None:
    """The stored basis and its digest, or None where it is absent or breaks its contract."""
    names = [f"specs/basis/{signature}.{x}" for x in ("json", "npy")]
    if not all(map(store.exists, names)):
        return None
    spec, raw = store.read_json(names[0]), store.read(names[1])
    digest = hashlib.sha256(raw).hexdigest()
    if spec.get("signature") != signature or spec.get("sha256") != digest:
        return None
    basis = np.load(io.BytesIO(raw), allow_pickle=False)
    return (basis, digest) if is_basis(basis, shape) else None


def save_signature(store: LocalStore, kind: str, signature: str, inputs: dict) -> None:
    """What a signature stands for, beside the caches that it names."""
    store.write_json(f"specs/{kind}/{signature}.json", {"kind": kind, "signature": signature, "inputs": inputs})


def file_sha256(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
