"""Rectangles [x, y, w, h] as struct-free column expressions: a rectangle is a tuple of four columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, array: Column) -> Rect:
        return cls(*[F.get(array, F.lit(k)) for k in range(4)])

    def array(self) -> Column:
        return F.array(*[c.cast("double") for c in self])

    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(v, hi))


def _zero() -> Column:
    return F.lit(0.0)


def intersection(a: Rect, b: Rect) -> Column:
    across = F.greatest(_zero(), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    return across * F.greatest(_zero(), F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 where the union is."""
    both = intersection(a, b)
    union = a.w * a.h + b.w * b.h - both
    return F.when(union != 0, both / union).otherwise(_zero())


def contains(outer: Rect, inner: Rect, share: float = 0.8) -> Column:
    area = inner.w * inner.h
    return (area > 0) & F.coalesce(F.try_divide(intersection(outer, inner), area) >= share, F.lit(False))


def to_px(r: Rect, width: Column, height: Column) -> Rect:
    return Rect(r.x * width, r.y * height, r.w * width, r.h * height)


def four_places(x: Column) -> Column:
    """x to four places, ties to even. What is a tie is decided on ten thousand times the decimal that x prints as, as a double: 0.12374999999999999, a product's error below 0.12375, is one."""
    ten_thousandths = (x.cast("string").try_cast("decimal(28,20)") * F.lit(10000).cast("decimal(5,0)")).cast("double")
    return F.coalesce(F.bround(ten_thousandths) / 10000, F.bround(x, 4))


def to_share(r: Rect, width: Column, height: Column) -> Rect:
    """Shares of the frame, to four places."""
    return Rect(*[four_places((a / b).cast("double")) for a, b in zip(r, (width, height, width, height), strict=True)])


def point_in(x: Column, y: Column, r: Rect, margin: float = 0.0) -> Column:
    return x.between(r.x + r.w * margin, r.x + r.w - r.w * margin) & y.between(r.y + r.h * margin, r.y + r.h - r.h * margin)


def visible_after_cover(r: Rect, aspect: float) -> Rect:
    """What a centred crop to the aspect leaves of r."""
    wide = r.w / r.h > aspect
    vw, vh = r.h * aspect, r.w / aspect
    return Rect(F.when(wide, r.x + (r.w - vw) / 2).otherwise(r.x), F.when(wide, r.y).otherwise(r.y + (r.h - vh) / 2), F.when(wide, vw).otherwise(r.w), F.when(wide, r.h).otherwise(vh))


def expand_to_aspect(r: Rect, aspect: float, width: Column, height: Column, focus: tuple[Column, Column] | None = None) -> Rect:
    """r grown, never trimmed, to the aspect inside the frame; room goes to the side of the focus, 30 to 70 of 100.

    The two directions are one rule along the axis that grows: `grow` states it, and is asked for each axis.
    """
    fx, fy = focus or r.centre()

    def grow(at: Column, size: Column, other_at: Column, other: Column, wanted: Column, other_of: Column, room: Column, other_room: Column, f: Column) -> tuple[Column, ...]:
        need = wanted - size
        moved = at - need * (1 - clamp((f - at) / size, F.lit(0.3), F.lit(0.7)))
        fits = wanted <= room
        other_new = other_of
        return (
            F.when(fits, F.least(F.greatest(moved, _zero()), room - wanted)).otherwise(_zero()), F.when(fits, wanted).otherwise(room),
            F.when(fits, other_at).otherwise(F.least(F.greatest(other_at + other / 2 - other_new / 2, _zero()), other_room - other_new)), F.when(fits, other).otherwise(other_new),
        )

    wx, ww, wy, wh = grow(r.x, r.w, r.y, r.h, r.h * aspect, width / aspect, width, height, fx)
    hy, hh, hx, hw = grow(r.y, r.h, r.x, r.w, r.w / aspect, height * aspect, height, width, fy)
    tall, wide = r.w / r.h < aspect, r.w / r.h > aspect
    pick = lambda a, b, c: F.when(tall, a).when(wide, b).otherwise(c)
    return Rect(pick(wx, hx, r.x), pick(wy, hy, r.y), pick(ww, hw, r.w), pick(wh, hh, r.h))


def inset_window(cam: Rect, face: Rect, has_face: Column, width: Column, height: Column, pane: float) -> Rect:
    """A pane-shaped window on the face (or the camera rectangle), 3.3 faces high within limits, at the bottom if the camera is."""
    face_h = F.when(has_face, face.h).otherwise(cam.h * 0.35)
    fx = F.when(has_face, face.x + face.w / 2).otherwise(cam.x + cam.w / 2)
    fy = F.when(has_face, face.y + face.h / 2).otherwise(cam.y + cam.h / 2)
    h = F.greatest(clamp(face_h * 3.3, height * 0.22, height * 0.36), cam.h)
    w = h * pane
    x = clamp(fx - w / 2, _zero(), F.greatest(_zero(), width - w))
    y = F.when(cam.y + cam.h >= height * 0.96, height - h).otherwise(clamp(fy - h * 0.42, _zero(), F.greatest(_zero(), height - h)))
    return Rect(x, y, F.least(w, width), F.least(h, height))


def corner_distance(r: Rect, width: Column, height: Column) -> Column:
    cx, cy = r.centre()
    return F.least(*[F.sqrt((cx - a) * (cx - a) + (cy - b) * (cy - b)) for a in (F.lit(0.0), width) for b in (F.lit(0.0), height)])


def is_corner_blob(r: Rect, width: Column, height: Column) -> Column:
    """Of inset size and shape, touching a corner."""
    area = r.w * r.h / (width * height)
    touches = ((r.x < width * 0.02) | (r.x + r.w > width * 0.98)) & ((r.y < height * 0.02) | (r.y + r.h > height * 0.98))
    return touches & area.between(0.015, 0.14) & (r.w / r.h).between(0.7, 2.4)


def is_panel(r: Rect, width: Column, height: Column) -> Column:
    """Hugs neither side and isn't the whole screen."""
    return (r.x >= width * 0.02) & (r.x + r.w <= width * 0.98) & (r.w * r.h <= width * height * 0.85)
