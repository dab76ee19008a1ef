"""Patch pooling kernels: numpy on one feature map at a time, for use inside an injected embedder."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .vectors import LEAST_NORM

TOLERANCE = 1e-6
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Pooled:
    vector: np.ndarray
    weight: float
    box: Box
    expanded: bool


def _cover(lo: float, hi: float, cells: int, canvas: float) -> np.ndarray:
    edges = np.linspace(0.0, canvas, cells + 1)
    lo, hi = min(max(lo, 0.0), canvas), min(max(hi, 0.0), canvas)
    return np.clip(np.minimum(edges[1:], hi) - np.maximum(edges[:-1], lo), 0.0, None)


def patch_weights(box: Box, grid: tuple[int, int], canvas: tuple[float, float]) -> np.ndarray:
    """Share of each (row, column) patch that the box covers."""
    (rows, cols), (h, w) = grid, canvas
    if min(rows, cols, h, w) <= 0:
        raise ValueError("grid and canvas must be positive")
    return (np.outer(_cover(box[1], box[3], rows, h), _cover(box[0], box[2], cols, w)) * (rows * cols) / (h * w)).astype(np.float32)


def _into(box: Box, bounds: Box) -> Box:
    fit = lambda v, k: float(min(max(v, bounds[k]), bounds[k + 2]))
    return fit(box[0], 0), fit(box[1], 1), fit(box[2], 0), fit(box[3], 1)


def _grown(box: Box, factor: float, bounds: Box) -> Box:
    centre = [(box[k] + box[k + 2]) / 2 for k in (0, 1)]
    half = [max(box[k + 2] - box[k], 1e-6) * factor / 2 for k in (0, 1)]
    return _into((centre[0] - half[0], centre[1] - half[1], centre[0] + half[0], centre[1] + half[1]), bounds)


def box_with_weight(box: Box, least: float, grid: tuple[int, int], canvas: tuple[float, float], bounds: Box | None = None) -> tuple[Box, np.ndarray, bool]:
    """The box, or the smallest enlargement about its centre, that weighs ``least`` patches; its weights; whether it grew."""
    whole = (0.0, 0.0, float(canvas[1]), float(canvas[0]))
    bounds = whole if bounds is None else _into(bounds, whole)
    if bounds[2] <= bounds[0] or bounds[3] <= bounds[1]:
        raise ValueError("the bounds leave no room")

    def tried(b: Box) -> tuple[Box, np.ndarray, bool]:
        w = patch_weights(b, grid, canvas)
        return b, w, float(w.sum()) + TOLERANCE >= least

    box = _into(box, bounds)
    own = tried(box)
    if own[2]:
        return own[0], own[1], False
    if not tried(bounds)[2]:
        raise ValueError("the bounds weigh less than the minimum")
    # enough is found by doubling, then narrowed; 20 doublings pass a factor of a million
    too_small, factor = 1.0, 2.0
    found = tried(_grown(box, factor, bounds))
    while not found[2] and factor < 1e6 and found[0] != bounds:
        factor *= 2
        found = tried(_grown(box, factor, bounds))
    for _ in range(40):
        middle = (too_small + factor) / 2
        at = tried(_grown(box, middle, bounds))
        if at[2]:
            factor, found = middle, at
        else:
            too_small = middle
    return found[0], found[1], True


def unit_patches(features: np.ndarray) -> np.ndarray:
    """(C, H, W) with each patch of unit length; zero patches stay zero. 64-bit maps stay so, others are 32-bit."""
    x = np.asarray(features, np.float64 if np.asarray(features).dtype == np.float64 else np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), LEAST_NORM)


def positional_basis(features: np.ndarray, components: int) -> np.ndarray:
    """Orthonormal columns that span the strongest position-only directions of a blank image's patches."""
    x = unit_patches(features).reshape(features.shape[0], -1)
    if not 0 < components <= min(x.shape):
        raise ValueError("more components than directions")
    return np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)[0][:, :components].astype(np.float32)


def is_basis(basis: np.ndarray, shape: tuple[int, int] | None = None) -> bool:
    return basis.ndim == 2 and (shape is None or basis.shape == shape) and basis.dtype == np.float32 and bool(np.isfinite(basis).all()) and bool(np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4))


def without_basis(features: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Patches with the basis' span taken out, of unit length again."""
    x = unit_patches(features)
    flat = x.reshape(x.shape[0], -1)
    return unit_patches((flat - basis @ (basis.T @ flat)).reshape(x.shape))


def pool(features: np.ndarray, box: Box, canvas: float, least: float, basis: np.ndarray | None = None, bounds: Box | None = None) -> Pooled:
    """Weighted mean of the patches under the box, of unit length."""
    if features.ndim != 3 or not features.shape[0]:
        raise ValueError("a feature map has channels, rows and columns")
    used, w, expanded = box_with_weight(box, least, features.shape[1:], (canvas, canvas), bounds)
    patches = unit_patches(features) if basis is None else without_basis(features, basis)
    total = float(w.sum())
    if not np.isfinite(total) or total <= 0:
        raise ValueError("the box weighs nothing")
    mean = (patches * w).sum(axis=(1, 2)) / total
    norm = float(np.linalg.norm(mean))
    if not np.isfinite(norm) or norm <= LEAST_NORM:
        raise ValueError("the pooled vector has no direction")
    return Pooled(mean / norm, total, used, expanded)
