"""Box arithmetic as columns. A box is a struct of four doubles, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def box(xmin, ymin, xmax, ymax) -> Column:
    # named_struct keeps its names beside a generator, where aliases inside expressions are trimmed
    sides = [v if isinstance(v, Column) else F.lit(v) for v in (xmin, ymin, xmax, ymax)]
    return F.named_struct(*(x for k, v in zip(SIDES, sides, strict=True) for x in (F.lit(k), v.cast("double"))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_box(b: Column) -> Column:
    out = F.lit(True)
    for k in SIDES:
        out &= finite(b[k])
    return out


def width(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def height(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def degenerate(b: Column) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def _within(x: Column, most: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), most.cast("double"))


def clip(b: Column, w: Column, h: Column) -> Column:
    """The box inside [0, w] x [0, h]; sizes that are not positive are an error."""
    w = F.when(w > 0, w).otherwise(F.raise_error(F.lit("image sizes must be positive")).cast("double"))
    h = F.when(h > 0, h).otherwise(F.raise_error(F.lit("image sizes must be positive")).cast("double"))
    return box(_within(b["xmin"], w), _within(b["ymin"], h), _within(b["xmax"], w), _within(b["ymax"], h))


def expand(b: Column, fraction: float, w: Column, h: Column) -> Column:
    """Grown by a fraction of its own sides on each of them, then clipped."""
    if fraction < 0:
        raise ValueError("the expansion must not be negative")
    dx, dy = width(b) * fraction, height(b) * fraction
    return clip(box(b["xmin"] - dx, b["ymin"] - dy, b["xmax"] + dx, b["ymax"] + dy), w, h)


def integer_xywh(b: Column) -> Column:
    """struct(x, y, w, h) of ints: mins rounded down, maxes up."""
    x, y = F.floor(b["xmin"]), F.floor(b["ymin"])
    span = lambda hi, lo: F.greatest(F.ceil(hi) - lo, F.lit(0))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), span(b["xmax"], x).cast("int").alias("w"), span(b["ymax"], y).cast("int").alias("h"))


def crop_box(b: Column, w: Column, h: Column) -> Column:
    """Integer crop around the box with one pixel at least."""
    x, y = (F.greatest(F.lit(0), F.least(size - 1, F.floor(b[k]))) for k, size in (("xmin", w), ("ymin", h)))
    return box(x, y, F.greatest(x + 1, F.least(w, F.ceil(b["xmax"]))), F.greatest(y + 1, F.least(h, F.ceil(b["ymax"]))))


def letterbox(crop: Column, size: int) -> Column:
    """How a crop is scaled into a square: struct(scale_x, scale_y, resized_width, resized_height, pad_left, pad_top). Sides round half to even."""
    if size <= 0:
        raise ValueError("the output size must be positive")
    w, h = width(crop), height(crop)
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    side = lambda x: F.greatest(F.lit(1), F.least(F.lit(size), F.bround(x * scale).cast("int")))
    rw, rh = side(w), side(h)
    return F.struct(
        (rw / w).alias("scale_x"), (rh / h).alias("scale_y"), rw.alias("resized_width"), rh.alias("resized_height"),
        F.floor((F.lit(size) - rw) / 2).cast("int").alias("pad_left"), F.floor((F.lit(size) - rh) / 2).cast("int").alias("pad_top"),
    )


def content_box(lb: Column) -> Column:
    return box(lb["pad_left"], lb["pad_top"], lb["pad_left"] + lb["resized_width"], lb["pad_top"] + lb["resized_height"])


def into_letterbox(b: Column, crop: Column, lb: Column, size: int) -> Column:
    x = lambda v: (v - crop["xmin"]) * lb["scale_x"] + lb["pad_left"]
    y = lambda v: (v - crop["ymin"]) * lb["scale_y"] + lb["pad_top"]
    return clip(box(x(b["xmin"]), y(b["ymin"]), x(b["xmax"]), y(b["ymax"])), F.lit(size), F.lit(size))


def overlaps(lo: Column, hi: Column, cells: int, canvas: float) -> Column:
    """Length of [lo, hi) in each of the cells that divide [0, canvas)."""
    step = canvas / cells
    lo, hi = _within(lo, F.lit(canvas)), _within(hi, F.lit(canvas))
    return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.greatest(F.lit(0.0), F.least((i + 1) * step, hi) - F.greatest(i * step, lo)))


def patch_weights(b: Column, rows: int, cols: int, canvas_h: float, canvas_w: float) -> Column:
    """Share of each patch that the box covers, row by row."""
    per = (canvas_w / cols) * (canvas_h / rows)
    xs, ys = overlaps(b["xmin"], b["xmax"], cols, canvas_w), overlaps(b["ymin"], b["ymax"], rows, canvas_h)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * x / per)))
