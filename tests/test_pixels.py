"""Pixels and checked model outputs."""

import numpy as np
import pytest

from curaspark.errors import FatalPipelineError
from curaspark.functions import pixels as P


def test_resize_keeps_flat_and_identity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (7, 9, 3), np.uint8)
    assert (P.resize(x, 9, 7) == x).all()
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (P.resize(flat, 13, 57) == 77).all() and P.resize(flat, 13, 57).shape == (57, 13, 3)


def test_resize_of_a_ramp_is_a_ramp():
    ramp = np.repeat(np.arange(0, 200, 4, dtype=np.uint8)[None, :, None], 3, axis=2).repeat(5, axis=0)
    up = P.resize(ramp, 100, 5)[2, 10:90, 0].astype(int)
    assert (np.abs(up - (np.arange(10, 90) * 2 - 1)) <= 1).all()


def test_letterbox_places_the_crop():
    x = np.zeros((60, 200, 3), np.uint8)
    x[:, 100:] = 255
    out = P.letterboxed(x, dict(xmin=100, ymin=0, xmax=200, ymax=50), dict(pad_left=0, pad_top=2, resized_width=8, resized_height=4), 8)
    assert (out[2:6] == 255).all() and (out[:2] == P.FILL).all() and (out[6:] == P.FILL).all()
    with pytest.raises(ValueError):
        P.letterboxed(x[:, :, 0], {}, {}, 8)


def test_model_input():
    out = P.model_input(np.full((4, 4, 3), 255, np.uint8), 4)
    assert out.shape == (3, 4, 4) and out.dtype == np.float32
    assert np.allclose(out[:, 0, 0], (1 - np.array(P.MEAN)) / np.array(P.DEVIATION), atol=1e-6)
    with pytest.raises(ValueError):
        P.model_input(np.zeros((4, 5, 3), np.uint8), 4)
    assert P.blank_patches(lambda x: x, 4).shape == (3, 4, 4)


def test_patch_maps_are_checked():
    tokens = np.arange(2 * 16 * 3, dtype=np.float32).reshape(2, 16, 3)
    got = P.patch_maps(tokens, np.zeros((2, 5, 3)), 2, 64, 16, 3, 5)
    assert got.shape == (2, 3, 4, 4) and got[1, 2, 1, 3] == tokens[1, 7, 2]
    for bad in (tokens[:, :15], np.full_like(tokens, np.nan)):
        with pytest.raises(FatalPipelineError):
            P.patch_maps(bad, np.zeros((2, 5, 3)), 2, 64, 16, 3, 5)
    with pytest.raises(FatalPipelineError):
        P.patch_maps(tokens, np.zeros((2, 4, 3)), 2, 64, 16, 3, 5)


def test_raw_detections_are_checked():
    assert P.raw_detections([], []) == []
    assert P.raw_detections([[0, 1, 2, 3]], [0.5]) == [((0.0, 1.0, 2.0, 3.0), 0.5, None)]
    assert P.raw_detections([[0, 1, 2, 3]], [0.5], np.array([4]))[0][2] == 4
    for boxes, scores, classes in (([[0, 1, 2]], [0.5], None), ([[0, 1, 2, 3]], [0.5, 0.6], None), ([[0, 1, 2, 3]], [0.5], [1, 2])):
        with pytest.raises(FatalPipelineError):
            P.raw_detections(boxes, scores, classes)


def test_decode():
    image = pytest.importorskip("PIL.Image")
    import io

    buffer = io.BytesIO()
    image.new("L", (3, 2), 9).save(buffer, "PNG")
    got = P.decode(buffer.getvalue())
    assert (got.mode, got.width, got.height) == ("L", 3, 2) and (got.pixels == 9).all()
