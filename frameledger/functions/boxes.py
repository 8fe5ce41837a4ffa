"""Box arithmetic on (x1, y1, x2, y2) columns; x2 and y2 are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from frameledger.constants import DET_STRIDE, EPS_AREA
from frameledger.functions.numeric import clip


def _extent(lo: Column, hi: Column) -> Column:
    return F.greatest(hi - lo, F.lit(0.0))


def area(b) -> Column:
    return _extent(b[0], b[2]) * _extent(b[1], b[3])


def _overlap(a, b):
    inter = (_extent(F.greatest(a[0], b[0]), F.least(a[2], b[2]))
             * _extent(F.greatest(a[1], b[1]), F.least(a[3], b[3])))
    return inter, area(a) + area(b) - inter


def iou(a, b) -> Column:
    """Overlap of two paired boxes; degenerate boxes give 0, NULL boxes give NULL."""
    inter, union = _overlap(a, b)
    known = a[0].isNotNull() & b[0].isNotNull()
    return F.when(known, inter / F.greatest(union, F.lit(EPS_AREA)))


def giou_loss(a, b) -> Column:
    """1 - generalised overlap, in [0, 2]."""
    inter, union = _overlap(a, b)
    hull = F.greatest(
        _extent(F.least(a[0], b[0]), F.greatest(a[2], b[2]))
        * _extent(F.least(a[1], b[1]), F.greatest(a[3], b[3])), F.lit(EPS_AREA))
    score = inter / F.greatest(union, F.lit(EPS_AREA)) - (hull - union) / hull
    return F.when(a[0].isNotNull() & b[0].isNotNull(), F.lit(1.0) - score)


def mean_l1(a, b) -> Column:
    return sum(F.abs(p - q) for p, q in zip(a, b)) / F.lit(4.0)


def width(b) -> Column:
    return F.greatest(b[2] - b[0], F.lit(1.0))


def height(b) -> Column:
    return F.greatest(b[3] - b[1], F.lit(1.0))


def _least_root(a: Column, b: Column, c: Column) -> Column:
    """Smallest root >= 0 of a*r^2 + b*r + c, 0 when there is none."""
    disc = F.sqrt(F.greatest(b * b - F.lit(4.0) * a * c, F.lit(0.0)))
    roots = F.array((-b - disc) / (F.lit(2.0) * a), (-b + disc) / (F.lit(2.0) * a))
    return F.coalesce(F.array_min(F.filter(roots, lambda r: r >= 0.0)), F.lit(0.0))


def gaussian_radius(h: Column, w: Column, overlap: float = 0.7) -> Column:
    """Largest corner shift that keeps the given overlap: least of shift, shrink and grow."""
    h, w = F.greatest(h.cast("double"), F.lit(0.0)), F.greatest(w.cast("double"), F.lit(0.0))
    o = min(max(float(overlap), 1e-6), 1.0)
    hw, per = h * w, h + w
    shift = _least_root(F.lit(1.0), -per, hw * F.lit((1 - o) / (1 + o)))
    shrink = _least_root(F.lit(4.0), F.lit(-2.0) * per, hw * F.lit(1 - o))
    grow = _least_root(F.lit(4.0 * o), F.lit(2.0 * o) * per, hw * F.lit(o - 1.0))
    return F.greatest(F.lit(0.0), F.least(shift, shrink, grow))


def encode_targets(b, grid_w: int, grid_h: int, stride: int = DET_STRIDE) -> dict[str, Column]:
    """Centre cell, in-cell offset, log size and splat radius of a box."""
    w, h = width(b), height(b)
    cx = (b[0] + b[2]) / F.lit(2.0 * stride)
    cy = (b[1] + b[3]) / F.lit(2.0 * stride)
    cell_x = F.floor(clip(cx, 0.0, float(grid_w - 1))).cast("int")
    cell_y = F.floor(clip(cy, 0.0, float(grid_h - 1))).cast("int")
    radius = F.floor(gaussian_radius(h / F.lit(float(stride)), w / F.lit(float(stride)))).cast("int")
    return {
        "cell_x": cell_x, "cell_y": cell_y, "cell": cell_y * F.lit(grid_w) + cell_x,
        "log_w": F.log(w), "log_h": F.log(h),
        "off_x": cx - cell_x, "off_y": cy - cell_y, "radius": radius,
    }


def decode_box(cell_x, cell_y, off_x, off_y, log_w, log_h, img_w, img_h,
               stride: int = DET_STRIDE) -> list[Column]:
    """Inverse of encode_targets, clamped to the image."""
    cx, cy = (cell_x + off_x) * F.lit(float(stride)), (cell_y + off_y) * F.lit(float(stride))
    hw, hh = F.exp(log_w) * 0.5, F.exp(log_h) * 0.5
    return [clip(cx - hw, 0.0, float(img_w)), clip(cy - hh, 0.0, float(img_h)),
            clip(cx + hw, 0.0, float(img_w)), clip(cy + hh, 0.0, float(img_h))]


def pad_clamp(b, pad: float, img_w, img_h) -> list[Column]:
    """Grow a box by a share of its own size, clamped to the image."""
    px, py = (b[2] - b[0]) * F.lit(pad), (b[3] - b[1]) * F.lit(pad)
    return [F.greatest(F.lit(0.0), b[0] - px), F.greatest(F.lit(0.0), b[1] - py),
            F.least(F.lit(float(img_w)), b[2] + px), F.least(F.lit(float(img_h)), b[3] + py)]


def rotate_corners(b, angle_deg: Column, img_w: float, img_h: float) -> list[Column]:
    """Extent of the four corners rotated about the image centre, clipped, at least 1 px."""
    a = F.radians(angle_deg)
    c, s = F.cos(a), F.sin(a)
    mx, my = F.lit(img_w / 2.0), F.lit(img_h / 2.0)
    xs, ys = [], []
    for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])):
        xs.append(c * (x - mx) + s * (y - my) + mx)
        ys.append(-s * (x - mx) + c * (y - my) + my)
    x1, x2 = clip(F.least(*xs), 0.0, img_w - 1), clip(F.greatest(*xs), 1.0, img_w)
    y1, y2 = clip(F.least(*ys), 0.0, img_h - 1), clip(F.greatest(*ys), 1.0, img_h)
    return [x1, y1, F.greatest(x2, x1 + 1), F.greatest(y2, y1 + 1)]
