"""Pixels and model outputs as arrays: decoding, letterboxed crops, model input, checked shapes."""

from __future__ import annotations

import io

import numpy as np

from ..errors import RowError
from ..sources.images import Decoded

#: The fill of a letterbox, and the channel means and deviations of model input.
FILL = (124, 116, 104)
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def decode(data: bytes) -> Decoded:
    """Upright RGB pixels (height, width, 3) of an encoded image, by Pillow where it is installed."""
    from PIL import Image, ImageOps

    try:
        with Image.open(io.BytesIO(data)) as raw:
            mode = raw.mode
            pixels = np.asarray(ImageOps.exif_transpose(raw).convert("RGB"))
    except (OSError, ValueError) as e:
        raise RowError("IMAGE_DECODE_FAILED", "decode", "not an image of a supported format") from e
    return Decoded(mode, pixels.shape[1], pixels.shape[0], pixels)


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n): what each of n samples adds to each of m; the kernel widens where samples get fewer."""
    wide = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    w = _cubic((np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic: rows first, then columns, each rounded to 8 bits."""
    bits = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = bits(np.einsum("wn,hnc->hwc", _weights(pixels.shape[1], width), pixels.astype(np.float64)))
    return bits(np.einsum("hn,nwc->hwc", _weights(pixels.shape[0], height), across)).astype(np.uint8)


def letterboxed(pixels: np.ndarray, crop: dict, fit: dict, size: int) -> np.ndarray:
    """The crop (xmin ... ymax, whole numbers) scaled into a filled square as ``geometry.letterbox`` places it."""
    if pixels.ndim != 3 or pixels.shape[2] != 3:
        raise ValueError("crops are made of RGB pixels")
    x0, y0, x1, y1 = (int(crop[k]) for k in ("xmin", "ymin", "xmax", "ymax"))
    out = np.empty((size, size, 3), np.uint8)
    out[:] = FILL
    left, top, w, h = (int(fit[k]) for k in ("pad_left", "pad_top", "resized_width", "resized_height"))
    out[top : top + h, left : left + w] = resize(pixels[y0:y1, x0:x1], w, h)
    return out


def model_input(crop: np.ndarray, size: int) -> np.ndarray:
    """(3, size, size) float32: shares of 255, less the mean, by the deviation."""
    if crop.shape != (size, size, 3):
        raise ValueError(f"expected RGB crops of {size} x {size}, got {crop.shape}")
    scaled = crop.astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(((scaled - np.float32(MEAN)) / np.float32(DEVIATION)).transpose(2, 0, 1))


def patch_maps(patches: np.ndarray, prefixes: np.ndarray, n: int, size: int, patch: int, dim: int, n_prefix: int) -> np.ndarray:
    """(n, dim, grid, grid) float32 from the last layer's tokens; a wrong shape or a number that is not finite ends the run."""
    from ..errors import FatalPipelineError

    grid = size // patch
    for name, got, want in (("prefix", prefixes.shape, (n, n_prefix, dim)), ("patch", patches.shape, (n, grid * grid, dim))):
        if tuple(got) != want:
            raise FatalPipelineError(f"expected {name} tokens of shape {want}, got {tuple(got)}")
    out = np.asarray(patches, np.float32).transpose(0, 2, 1).reshape(n, dim, grid, grid)
    if not np.isfinite(out).all():
        raise FatalPipelineError("the model gave features that are not finite")
    return out


def blank_patches(features, size: int) -> np.ndarray:
    """The map of a black image, from which the positional basis is taken. ``features``: (n, 3, size, size) -> (n, dim, grid, grid)."""
    return np.asarray(features(model_input(np.zeros((size, size, 3), np.uint8), size)[None]))[0]


def raw_detections(boxes, scores, classes=None) -> list[tuple[tuple[float, ...], float, int | None]]:
    """A detector's arrays as (box, score, class) rows; arrays that do not fit each other end the run."""
    from ..errors import FatalPipelineError

    xyxy, score = np.asarray(boxes, np.float64), np.asarray(scores, np.float64)
    if xyxy.size == 0:
        xyxy = xyxy.reshape(0, 4)
    if xyxy.ndim != 2 or xyxy.shape[1] != 4:
        raise FatalPipelineError(f"boxes must be n x 4, not {xyxy.shape}")
    if score.shape != (len(xyxy),):
        raise FatalPipelineError(f"{len(xyxy)} boxes need as many scores, not {score.shape}")
    kind = [None] * len(xyxy) if classes is None else np.asarray(classes).tolist()
    if not isinstance(kind, list) or len(kind) != len(xyxy):
        raise FatalPipelineError(f"{len(xyxy)} boxes need as many classes")
    return [(tuple(b), s, None if c is None else int(c)) for b, s, c in zip(xyxy.tolist(), score.tolist(), kind, strict=True)]
