"""Box and crop expressions. A box is four columns x1, y1, x2, y2, optionally with a prefix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest crop side, and decimals of a resize scale.
CROP_SIDE, SCALE_DIGITS = 4096, 8


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])

    @property
    def area(self) -> Column:
        return F.greatest(self.x2 - self.x1, F.lit(0)) * F.greatest(self.y2 - self.y1, F.lit(0))

    @property
    def mid(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def coverage(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    least = F.least(a.area, b.area)
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    """Closed intervals that meet."""
    return (a.x1 <= b.x2) & (b.x1 <= a.x2) & (a.y1 <= b.y2) & (b.y1 <= a.y2)


def valid(b: Box, width: Column, height: Column) -> Column:
    """Finite, ordered and inside the picture."""
    inf = F.lit(float("inf"))
    finite = F.lit(True)
    for c in (b.x1, b.y1, b.x2, b.y2):
        finite = finite & c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf)
    return F.coalesce(finite & (b.x1 >= 0) & (b.x1 < b.x2) & (b.x2 <= width) & (b.y1 >= 0) & (b.y1 < b.y2) & (b.y2 <= height), F.lit(False))


def rounded(b: Box) -> list[Column]:
    """Half to even."""
    return [F.rint(c).cast("long").alias(n) for c, n in ((b.x1, "x1"), (b.y1, "y1"), (b.x2, "x2"), (b.y2, "y2"))]


def from_center(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [(x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2")]


def unletterbox(b: Box, gain: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> list[Column]:
    """From model to picture coordinates, clamped to the picture."""

    def one(v, pad, most):
        return F.least(F.greatest((v - pad) / gain, F.lit(0.0)), most)

    return [one(b.x1, pad_x, width).alias("x1"), one(b.y1, pad_y, height).alias("y1"), one(b.x2, pad_x, width).alias("x2"), one(b.y2, pad_y, height).alias("y2")]


def stride_size(side: Column, stride: int = 32) -> Column:
    """The next multiple of the stride."""
    return (F.ceil(side / stride) * stride).cast("int")


def letterbox(width: Column, height: Column, side_w: int = 640, side_h: int = 640, mode: str = "stride", scale_up: bool = True, stride: int = 32) -> list[Column]:
    """Numbers of a picture scaled into a frame: ratios, new size, paddings of one side, borders in pixels.
    mode: ``stride`` pads to a multiple of the stride, ``frame`` to the whole frame, ``fill`` stretches."""
    if mode not in ("stride", "frame", "fill"):
        raise ValueError(mode)
    rw, rh = F.lit(float(side_w)) / width, F.lit(float(side_h)) / height
    if mode != "fill":
        r = F.least(rw, rh, *([] if scale_up else [F.lit(1.0)]))
        rw = rh = r
    new_w, new_h = F.rint(width * rw).cast("int"), F.rint(height * rh).cast("int")
    pads = [(F.pmod(side - new, F.lit(stride)) if mode == "stride" else side - new) / 2 for side, new in ((F.lit(side_w), new_w), (F.lit(side_h), new_h))]
    border = [F.rint(p + d).cast("int") for p in pads for d in (-0.1, 0.1)]
    return [rw.alias("ratio_w"), rh.alias("ratio_h"), new_w.alias("new_w"), new_h.alias("new_h"), pads[0].alias("pad_x"), pads[1].alias("pad_y"), *[b.alias(n) for b, n in zip(border, ("left", "right", "top", "bottom"), strict=True)]]


def crop_size(b: Box, side: int = CROP_SIDE) -> tuple[Column, Column, Column]:
    """(scale, width, height) of a crop whose longest side is at most ``side``; half to even, 1 at least."""
    w, h = b.x2 - b.x1, b.y2 - b.y1
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    return scale, F.greatest(F.rint(w * scale), F.lit(1)).cast("int"), F.greatest(F.rint(h * scale), F.lit(1)).cast("int")


def resize_scale(out: Column, src: Column) -> Column:
    return F.bround(out / src, SCALE_DIGITS)


def constrained(b: Box, width: Column, height: Column) -> list[Column]:
    """Clamped to the picture, one pixel wide and high at least."""
    x1 = F.least(F.greatest(b.x1, F.lit(0)), width - 1)
    y1 = F.least(F.greatest(b.y1, F.lit(0)), height - 1)
    return [x1.alias("x1"), y1.alias("y1"), F.greatest(F.least(b.x2, width), x1 + 1).alias("x2"), F.greatest(F.least(b.y2, height), y1 + 1).alias("y2")]


def corners(b: Box) -> Column:
    return F.struct(F.array(b.x1, b.y1).alias("top_left"), F.array(b.x2, b.y1).alias("top_right"), F.array(b.x2, b.y2).alias("bottom_right"), F.array(b.x1, b.y2).alias("bottom_left"))


def from_corners(c: Column) -> tuple[Column, list[Column]]:
    """(whether the corners are an axis-aligned rectangle, its box)."""
    at = lambda name, i: F.get(c[name], F.lit(i))
    ok = (at("top_left", 1) == at("top_right", 1)) & (at("bottom_left", 1) == at("bottom_right", 1)) & (at("top_left", 0) == at("bottom_left", 0)) & (at("top_right", 0) == at("bottom_right", 0))
    ok = ok & (at("top_left", 0) < at("top_right", 0)) & (at("top_left", 1) < at("bottom_left", 1))
    return ok, [at("top_left", 0).alias("x1"), at("top_left", 1).alias("y1"), at("bottom_right", 0).alias("x2"), at("bottom_right", 1).alias("y2")]


def transformed(b: Box, dx: Column, dy: Column, sx: Column, sy: Column) -> list[Column]:
    """Moved by a crop's origin, scaled, with corners put in order."""
    xs, ys = [(v - dx) * sx for v in (b.x1, b.x2)], [(v - dy) * sy for v in (b.y1, b.y2)]
    return [F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2")]


def moved(b: Box, dx: Column, dy: Column, width: Column, height: Column) -> list[Column]:
    """Shifted as far as the picture allows."""
    mx = F.least(F.greatest(dx, -b.x1), width - b.x2)
    my = F.least(F.greatest(dy, -b.y1), height - b.y2)
    return [(b.x1 + mx).alias("x1"), (b.y1 + my).alias("y1"), (b.x2 + mx).alias("x2"), (b.y2 + my).alias("y2")]


def corner_resized(b: Box, corner: str, x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """A box whose corner (``top_left`` …) went to (x, y), kept in the picture and one pixel wide and high at least."""
    v, _, h = corner.partition("_")
    if v not in ("top", "bottom") or h not in ("left", "right"):
        raise ValueError(corner)
    x1 = F.greatest(F.lit(0.0), F.least(x, b.x2 - 1)) if h == "left" else b.x1
    x2 = F.least(width, F.greatest(x, b.x1 + 1)) if h == "right" else b.x2
    y1 = F.greatest(F.lit(0.0), F.least(y, b.y2 - 1)) if v == "top" else b.y1
    y2 = F.least(height, F.greatest(y, b.y1 + 1)) if v == "bottom" else b.y2
    return [x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")]
