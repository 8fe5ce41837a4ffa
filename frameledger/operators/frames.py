"""Image jobs over whole frames: one row per frame, worked by array kernels over Arrow batches.

A frame row has frame_id, w, h, `rgb` (bytes, row by row, three a pixel) and, where there is one, `mask` (bytes, one a
pixel). Parameters are drawn per frame by column expressions (operators/images.py) and ride along as columns. Kernels
take slices of frames of one size as arrays; nothing is exploded, shuffled or joined, and a slice holds a bounded number
of pixels (a frame is never cut). Chains of kernels run in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameledger.constants import (
    LUM_B, LUM_G, LUM_R, SHIFT_AMOUNT, SHIFT_RADIUS, SHIFT_SATURATION, SHIFT_SIGMA, SHIFT_TONE_X, SHIFT_TONE_Y)

LUM = np.array([LUM_R, LUM_G, LUM_B])
_PIXELS = 1 << 17                # of a slice: what kernels hold follows this, not the rows of a task


@dataclass
class Frames:
    """Frames of one size: `rgb` (n, h, w, 3), `mask` (n, h, w), and other columns by name in `p` (null numbers are NaN)."""

    ids: np.ndarray
    w: int
    h: int
    rgb: np.ndarray | None
    mask: np.ndarray | None
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def col(self, name: str) -> np.ndarray:
        """A parameter shaped to go with pixels and channels."""
        return self.p[name].reshape(-1, 1, 1, 1)

    def matrix(self, name: str) -> np.ndarray:
        """Nine columns as (n, 3, 3)."""
        return np.stack([self.p[f"{name}{i}{j}"] for i in range(3) for j in range(3)], 1).reshape(-1, 3, 3)


def _numbers(array: pa.Array) -> np.ndarray:
    if pa.types.is_list(array.type):
        flat = array.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(array), -1)
    return array.to_numpy(zero_copy_only=False)


def _bytes(array: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """The bytes of equally long binaries, as one array. A null plane is all zeros."""
    size = int(np.prod(shape[1:]))
    if array.null_count:
        array = pa.array([v if v is not None else bytes(size) for v in array.to_pylist()], pa.binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    if len(array) and not (np.diff(at) == size).all():
        raise ValueError("a frame's bytes do not match its width and height")
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(shape) if size * len(array) else np.zeros(shape, np.uint8)


def over(df: DataFrame, work: Callable[[Frames], dict[str, object]], schema: str, pixels: int = _PIXELS) -> DataFrame:
    """Rows that `work` returns for each slice of frames, as columns in the order of `schema`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = (batch.column(c).to_numpy() for c in ("w", "h"))
            shape = w.astype(np.int64) << 32 | h
            for size in np.unique(shape):
                at = np.flatnonzero(shape == size)
                wide, high = int(size >> 32), int(size & 0xFFFFFFFF)
                step = max(1, pixels // max(wide * high, 1))
                for lo in range(0, len(at), step):
                    part = batch.take(pa.array(at[lo : lo + step]))
                    names = part.schema.names
                    n = part.num_rows
                    frames = Frames(part.column("frame_id").to_numpy(), wide, high,
                                    _bytes(part.column("rgb"), (n, high, wide, 3)) if "rgb" in names else None,
                                    _bytes(part.column("mask"), (n, high, wide)) if "mask" in names else None,
                                    {c: _numbers(part.column(c)) for c in names if c not in ("frame_id", "w", "h", "rgb", "mask")})
                    found = work(frames)
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in found.values()], names=list(found))

    return df.mapInArrow(run, schema)


def steps(*kernels: Callable[[Frames], None]) -> Callable[[Frames], None]:
    def work(f: Frames) -> None:
        for k in kernels:
            k(f)
    return work


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


WEIGHTED = "frame_id bigint, r double, g double, b double"


def weighted(f: Frames, digits: int = 5) -> dict[str, object]:
    """Per frame and channel the mean of value x (x + 1) x (y + 2): it changes when a pixel moves."""
    place = np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
    mean = np.tensordot(f.rgb.astype(float), place, ([1, 2], [0, 1])) / (f.w * f.h)
    return {"frame_id": f.ids, **{c: rounded(mean[:, i], digits) for i, c in enumerate("rgb")}}


def weighted_in_turn(f: Frames, digits: int = 5) -> dict[str, object]:
    """`weighted` with every product and sum in the order SQL takes them, column by column: means on the edge of rounding agree."""
    placed = f.rgb * np.arange(1, f.w + 1)[:, None] * np.arange(2, f.h + 2)[:, None, None]
    total = np.cumsum(placed.transpose(0, 2, 1, 3).reshape(len(f.ids), -1, 3), 1)[:, -1]
    return {"frame_id": f.ids, **{c: rounded(total[:, i] / (f.w * f.h), digits) for i, c in enumerate("rgb")}}


PLANES = "frame_id bigint, w int, h int, rgb binary"


def planes(f: Frames) -> dict[str, object]:
    """The frames as bytes again, from values in [0, 1]."""
    levels = np.floor(np.clip(f.rgb, 0, 1) * 255 + 0.5).astype(np.uint8)
    return {"frame_id": f.ids, "w": np.full(len(f.ids), f.w, np.int32), "h": np.full(len(f.ids), f.h, np.int32),
            "rgb": pa.array([v.tobytes() for v in levels], pa.binary())}


def applied(df: DataFrame, *kernels: Callable[[Frames], None], finish=planes, schema: str = PLANES) -> DataFrame:
    """The kernels one after the other on every frame, then what `finish` returns."""
    chain = steps(*kernels)

    def work(f: Frames):
        chain(f)
        return finish(f)

    return over(df, work, schema)


# -- points ---------------------------------------------------------------------------------------

_UNIT = np.arange(256) / 255.0


def to_unit(f: Frames) -> None:
    f.rgb = _UNIT[f.rgb]


def to_levels(f: Frames) -> None:
    """Values of 0 to 255 as whole levels again, halves up."""
    f.rgb = np.floor(np.clip(np.round(f.rgb, 9), 0, 255) + 0.5).astype(np.uint8)


def _mapped(rgb: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Each frame's colours by its 3x3 matrix."""
    n, h, w, _ = rgb.shape
    return (rgb.reshape(n, h * w, 3) @ m.transpose(0, 2, 1)).reshape(n, h, w, 3)


def colour_map(name: str) -> Callable[[Frames], None]:
    """The matrix in the frame columns `name`00 to `name`22, clipped to [0, 1]."""
    def work(f: Frames) -> None:
        f.rgb = np.clip(_mapped(f.rgb, f.matrix(name)), 0, 1)
    return work


def colour_maps_in_turn(*names: str) -> Callable[[Frames], None]:
    """The matrices of `names` one after the other, each sum from red to blue, then clipped to [0, 1]: the plain form of one
    composed `colour_map`, which rounds otherwise in the last bit."""
    def work(f: Frames) -> None:
        for name in names:
            m = f.matrix(name)[:, None, None]
            f.rgb = f.rgb[..., :1] * m[..., 0] + f.rgb[..., 1:2] * m[..., 1] + f.rgb[..., 2:] * m[..., 2]
        f.rgb = np.clip(f.rgb, 0, 1)
    return work


def color_jitter(f: Frames) -> None:
    """Columns of images.jitter_params. Contrast turns about the luma mean of the frame as it comes in."""
    to_unit(f)
    grey = (f.rgb.mean((1, 2)) * LUM).sum(1)
    shift = np.stack([f.p[f"jbeta{i}"] for i in range(3)], 1) * grey[:, None]
    f.rgb = np.clip(_mapped(f.rgb, f.matrix("jm")) + shift[:, None, None, :], 0, 1)


_LINEAR = _UNIT ** 2.2


def linear_stage(f: Frames) -> None:
    """Display to linear light (power 2.2), then white balance, exposure and colour matrix as one."""
    f.rgb = _mapped(_LINEAR[f.rgb], f.matrix("lin"))


def _mixed(z: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def counted_normal(key: np.ndarray, n: int) -> np.ndarray:
    """(len(key), n) standard normal values: of each key's counter-based stream (SplitMix64), two numbers a value."""
    step, top = np.uint64(0x9E3779B97F4A7C15), float(1 << 52)
    at = np.arange(n, dtype=np.uint64) * np.uint64(2)
    a, b = (_mixed(key.astype(np.uint64)[:, None] + (at + np.uint64(k)) * step) >> np.uint64(12) for k in (1, 2))
    return np.sqrt(-2 * np.log((a + 1.0) / (top + 1.0))) * np.cos(2 * np.pi * (b / top))


def sensor_noise(f: Frames) -> None:
    """Shot and read noise with deviation sqrt(a * x + b) from the streams of nk0 to nk2; then the one clip of linear light."""
    on = np.flatnonzero((f.p["na"] > 0) | (f.p["nb"] > 0))
    if len(on):
        x = f.rgb[on]
        sd = np.sqrt(np.maximum(x, 0) * f.col("na")[on] + f.col("nb")[on])
        noise = np.stack([counted_normal(f.p[f"nk{c}"][on], f.h * f.w).reshape(-1, f.h, f.w) for c in range(3)], 3)
        f.rgb[on] = x + sd * noise
    f.rgb = np.clip(f.rgb, 0, 1)


def _by_frame(table: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Values of each frame's own table at its levels."""
    n = len(table)
    return np.take_along_axis(table, level.reshape(n, -1), 1).reshape(level.shape)


def display_stage(f: Frames) -> None:
    """Linear to display: a gamma-2 code of 256 levels, then one table a frame for the rest of the power and the tone curve."""
    v = _UNIT[None, :] ** (2.0 / f.p["gamma"][:, None])
    knots = np.stack([f.p[f"ty{k}"] for k in range(5)], 1)
    i = np.minimum(np.floor(v * 4), 3).astype(int)
    lo, hi = np.take_along_axis(knots, i, 1), np.take_along_axis(knots, i + 1, 1)
    f.rgb = _by_frame(lo + (hi - lo) * (v * 4 - i), np.floor(np.sqrt(f.rgb) * 255 + 0.5).astype(int))


# -- neighbourhoods -------------------------------------------------------------------------------

def mirrored(n: int, r: int) -> np.ndarray:
    """Places -r to n - 1 + r of a line, mirrored about its end pixels."""
    if n == 1:
        return np.zeros(2 * r + 1, int)
    m = np.abs(np.arange(-r, n + r)) % (2 * (n - 1))
    return np.where(m < n, m, 2 * (n - 1) - m)


def gaussian(x: np.ndarray, sigma: np.ndarray, radius: int) -> np.ndarray:
    """Separable Gaussian, borders mirrored; the half-width is int(2.5 * sigma), at least 1 and at most `radius`."""
    half = np.clip(np.floor(sigma * 2.5), 1, radius)
    r = int(half.max()) if len(half) else 0
    d = np.arange(-r, r + 1)
    k = np.exp(-(d * d) / (2.0 * sigma[:, None] ** 2)) * (np.abs(d) <= half[:, None])
    k /= k.sum(1, keepdims=True)
    for axis in (2, 1):
        n = x.shape[axis]
        if n == 1:
            continue
        wide = np.take(x, mirrored(n, r), axis)
        x = sum(k[:, i].reshape(-1, 1, 1, 1) * wide[:, :, i : i + n] if axis == 2 else k[:, i].reshape(-1, 1, 1, 1) * wide[:, i : i + n] for i in range(2 * r + 1))
    return x


def blur_or_sharpen(f: Frames, radius: int = 4) -> None:
    """Exactly one of blur (no amount) or unsharp mask; no sigma leaves the frame alone."""
    on = np.flatnonzero(np.isfinite(f.p["sigma"].astype(float)))
    if len(on):
        x, amount = f.rgb[on], f.col("amount")[on].astype(float)
        soft = gaussian(x, f.p["sigma"][on].astype(float), radius)
        f.rgb[on] = np.where(np.isnan(amount), soft, np.clip(x * (1 + amount) - soft * amount, 0, 1))


def resample_mismatch(f: Frames, least: int = 8) -> None:
    """Down by each frame's own `factor` (any number from 1 on; area means) and up again (nearest). No side gets under `least`."""
    for axis, size in ((2, f.w), (1, f.h)):
        small = np.minimum(np.maximum(np.floor(size / f.p["factor"] + 0.5), min(least, size)), size)[:, None]
        cell = np.floor((np.arange(size) + 0.5) * small / size)
        lo, hi = cell * size / small, (cell + 1) * size / small
        total = np.concatenate([np.zeros_like(np.take(f.rgb, [0], axis)), np.cumsum(f.rgb, axis)], axis)      # up to each border

        def upto(t: np.ndarray) -> np.ndarray:
            i = np.minimum(np.floor(t + 1e-9), size - 1).astype(int)
            shape = (-1, 1, size, 1) if axis == 2 else (-1, size, 1, 1)
            low, high = np.take_along_axis(total, i.reshape(shape), axis), np.take_along_axis(total, i.reshape(shape) + 1, axis)
            return low + (high - low) * (t - i).reshape(shape)

        f.rgb = (upto(hi) - upto(lo)) / (hi - lo).reshape((-1, 1, size, 1) if axis == 2 else (-1, size, 1, 1))


def chroma_shift(f: Frames) -> None:
    """Red by (dx, dy) and blue by (-dx, -dy), edges repeated."""
    row = np.arange(len(f.ids))[:, None, None]
    for channel, sign in ((0, 1), (2, -1)):
        y = np.clip(np.arange(f.h)[None, :] - sign * f.p["dy"].astype(int)[:, None], 0, f.h - 1)
        x = np.clip(np.arange(f.w)[None, :] - sign * f.p["dx"].astype(int)[:, None], 0, f.w - 1)
        f.rgb[..., channel] = f.rgb[row, y[:, :, None], x[:, None, :], channel]


def camera_chain(stages) -> Callable[[Frames], None]:
    """All camera stages in order over frames with images.camera_params. No codec stage."""
    on = set(stages)
    return steps(linear_stage, sensor_noise, display_stage, *[k for name, k in (
        ("satihue", colour_map("sh")), ("sharpblur", blur_or_sharpen), ("resample", resample_mismatch), ("chroma", chroma_shift)) if name in on])


def random_convolution(strength: float = 1.0) -> Callable[[Frames], None]:
    """Random 1x1 or 3x3 convolution (columns of images.convolution_params), first two moments matched to the input, then blended."""
    def work(f: Frames) -> None:
        to_unit(f)
        x, wide3 = f.rgb, f.p["r3"].astype(bool).reshape(-1, 1, 1, 1, 1)
        weights = counted_normal(f.p["rk"], 81).reshape(-1, 3, 3, 3, 3) * np.where(wide3, np.sqrt(2.0 / 27), np.sqrt(2.0 / 3))      # out, dy, dx, in
        centre = np.zeros((1, 1, 3, 3, 1), bool)
        centre[:, :, 1, 1] = True
        weights = np.where(wide3 | centre, weights, 0.0)
        wide = np.take(np.take(x, mirrored(f.h, 1), 1), mirrored(f.w, 1), 2)
        y = sum(_mapped(np.ascontiguousarray(wide[:, dy : dy + f.h, dx : dx + f.w]), weights[:, :, dy, dx, :]) for dy in range(3) for dx in range(3))

        def moments(v):
            mean, square = v.mean((1, 2, 3)), (v * v).mean((1, 2, 3))
            return mean.reshape(-1, 1, 1, 1), (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6).reshape(-1, 1, 1, 1)

        (mx, sx), (my, sy) = moments(x), moments(y)
        alpha = 1 - strength * f.col("ra")
        f.rgb = np.clip(alpha * x + (1 - alpha) * ((y - my) / sy * sx + mx), 0, 1)
    return work


_SHIFT = np.interp(_UNIT, SHIFT_TONE_X, SHIFT_TONE_Y)


def held_out_shift(f: Frames) -> None:
    """Fixed tone curve, strong unsharp mask, saturation. (No resampling round trip.)"""
    x = _SHIFT[f.rgb]
    soft = gaussian(x, np.full(len(x), SHIFT_SIGMA), SHIFT_RADIUS)
    m = np.tile(LUM, (3, 1)) * (1 - SHIFT_SATURATION) + np.eye(3) * SHIFT_SATURATION
    f.rgb = np.clip((x * (1 + SHIFT_AMOUNT) - soft * SHIFT_AMOUNT) @ m.T, 0, 1)


# -- levels ---------------------------------------------------------------------------------------

def histograms(levels: np.ndarray) -> np.ndarray:
    """(n, channels, 256) counts of whole levels."""
    n, c = len(levels), levels.shape[-1]
    flat = levels.reshape(n, -1, c).transpose(0, 2, 1).astype(np.int64) + 256 * np.arange(n * c).reshape(n, c, 1)
    return np.bincount(flat.ravel(), minlength=n * c * 256).reshape(n, c, 256)


def _ends(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo = np.argmax(hist > 0, -1)[..., None]
    return lo, 255 - np.argmax(hist[..., ::-1] > 0, -1)[..., None]


def autocontrast_table(hist: np.ndarray) -> np.ndarray:
    v, (lo, hi) = np.arange(256), _ends(hist)
    scaled = np.floor(np.round((v - lo) * 255.0 / np.maximum(hi - lo, 1), 9)).astype(int)
    return np.where(hi > lo, np.clip(scaled, 0, 255), v)


def equalise_table(hist: np.ndarray) -> np.ndarray:
    """Histogram equalisation with integer steps."""
    v, (lo, hi) = np.arange(256), _ends(hist)
    step = (hist.sum(-1, keepdims=True) - np.take_along_axis(hist, hi, -1)) // 255
    below = np.cumsum(hist, -1) - hist
    safe = np.maximum(step, 1)
    return np.where((hi > lo) & (step > 0), np.minimum((safe // 2 + below) // safe, 255), v)


def posterise_table(bits: np.ndarray) -> np.ndarray:
    """Tables (..., 256) that keep the upper bits."""
    v = np.arange(256)
    return v - v % (1 << (8 - bits.astype(int)))[..., None]


def solarise_table(threshold: np.ndarray) -> np.ndarray:
    v = np.arange(256)
    return np.where(v < threshold[..., None], v, 255 - v)


def look_up(table: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Levels through (n, channels, 256) tables."""
    return np.stack([_by_frame(table[:, c], levels[..., c]) for c in range(levels.shape[-1])], -1)


def level_step(table: np.ndarray, hist: np.ndarray, choice: np.ndarray, bits: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """One op on the values of (n, channels, 256) tables over `hist`: 0 autocontrast, 1 equalise, 2 posterise, 3 solarise, else none."""
    n, c, _ = table.shape
    at = table + 256 * np.arange(n * c).reshape(n, c, 1)
    now = np.bincount(at.ravel(), hist.ravel(), n * c * 256).reshape(n, c, 256).astype(np.int64)
    per = [autocontrast_table(now), equalise_table(now), np.broadcast_to(posterise_table(bits)[:, None], now.shape), np.broadcast_to(solarise_table(threshold)[:, None], now.shape)]
    op = np.broadcast_to(np.arange(256), now.shape)
    for k, t in enumerate(per):
        op = np.where((choice == k)[:, None, None], t, op)
    return np.take_along_axis(op, table, 2)


def chain_mix(strength: float = 1.0) -> Callable[[Frames], None]:
    """Weighted mix of chains of one to three level ops (columns of images.mix_params), blended with the frame.

    Every op maps levels to levels, so the chains run on tables of 256 levels and the pixels meet only the final one.
    """
    def work(f: Frames) -> None:
        hist = histograms(f.rgb)
        n, width = f.p["mix_weight"].shape
        mix = np.zeros(hist.shape)
        for b in range(width):
            table = np.broadcast_to(np.arange(256), hist.shape)
            for step in range(3):
                level = f.p["mix_level"][:, 3 * b + step]
                choice = np.where(f.p["mix_depth"][:, b] > step, f.p["mix_op"][:, 3 * b + step], -1)
                table = level_step(table, hist, choice, 4 - np.floor(level * 0.4), 256 - np.floor(level * 25.6))
            mix += table * f.p["mix_weight"][:, b, None, None]
        mix /= f.p["mix_weight"].sum(1)[:, None, None] * 255.0
        blend = f.col("mix_blend") * strength
        f.rgb = (1 - blend) * _UNIT[f.rgb] + blend * look_up(mix, f.rgb)
    return work


# -- geometry -------------------------------------------------------------------------------------

def centre_crop_43(f: Frames) -> None:
    """Width-only centre crop to 4:3, when wider."""
    target = int(round(f.h * 4 / 3))
    if f.w > target:
        x0 = (f.w - target) // 2
        f.rgb = f.rgb[:, :, x0 : x0 + target]
        f.mask = None if f.mask is None else f.mask[:, :, x0 : x0 + target]
        f.w = target


def rotated_nearest(mask: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Masks turned about the centre by inverse nearest mapping; outside is background."""
    n, h, w = mask.shape
    a = np.radians(degrees)[:, None, None]
    x, y = np.arange(w)[None, None, :] - w / 2.0, np.arange(h)[None, :, None] - h / 2.0
    sx = np.floor(np.cos(a) * x - np.sin(a) * y + w / 2.0 + 0.5).astype(int)
    sy = np.floor(np.sin(a) * x + np.cos(a) * y + h / 2.0 + 0.5).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, mask[np.arange(n)[:, None, None], np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0)


def bilinear(planes: np.ndarray, sx: np.ndarray, sy: np.ndarray, outside: float | None = None) -> np.ndarray:
    """(n, h, w, c) planes at fractional places (n, h', w'): edges repeated, or `outside` for what lies beyond them."""
    n, h, w, _ = planes.shape
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    row = np.arange(n)[:, None, None]

    def at(y, x):
        v = planes[row, np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)].astype(float)
        if outside is not None:
            v = np.where(((x >= 0) & (x < w) & (y >= 0) & (y < h))[..., None], v, outside)
        return v

    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def mask_boxes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) boxes x1, y1, x2, y2 with open ends, and whether there is any foreground (128 and more)."""
    on = mask >= 128
    cols, rows = on.any(1), on.any(2)
    some = cols.any(1)
    box = np.stack([np.argmax(cols, 1), np.argmax(rows, 1), mask.shape[2] - np.argmax(cols[:, ::-1], 1), mask.shape[1] - np.argmax(rows[:, ::-1], 1)], 1)
    return np.where(some[:, None], box, 0), some


def geometry(f: Frames, min_visible: float = 0.5) -> None:
    """One map a frame for image, mask and box: turn about the centre, crop, flip (columns of images.geometry_params).

    The crop is the first proposal that keeps enough of the turned mask, else the whole frame. Image and mask are read
    once, at the places that the whole map gives them; beyond the edges an image repeats them and a mask is background.
    Frames keep their arrays' size; `cw` and `ch` say how much of it counts. The box is that of the new mask.
    """
    n, h, w = f.mask.shape
    a = np.radians(f.p["angle"])[:, None, None]
    cos, sin = np.cos(a), np.sin(a)

    def places(x, y):
        x, y = x - w / 2.0, y - h / 2.0
        return np.round(cos * x - sin * y + w / 2.0, 9), np.round(sin * x + cos * y + h / 2.0, 9)

    gx, gy = np.broadcast_arrays(np.arange(w)[None, None, :], np.arange(h)[None, :, None])
    turned = np.round(bilinear(f.mask[..., None], *places(gx, gy), outside=0)[..., 0], 9) >= 128
    need = np.ceil(min_visible * (f.mask >= 128).sum((1, 2)))
    total = np.zeros((n, h + 1, w + 1), np.int64)
    total[:, 1:, 1:] = turned.cumsum(1).cumsum(2)
    cw, ch, x0, y0 = np.full(n, w), np.full(n, h), np.zeros(n, int), np.zeros(n, int)
    open_, row = np.ones(n, bool), np.arange(n)
    offered = f.p["crops"].reshape(n, -1, 4).astype(int)               # (cw, ch, x0, y0); no width: no proposal
    for k in range(offered.shape[1]):
        pw, ph, px, py = offered[:, k].T
        seen = total[row, py + ph, px + pw] - total[row, py, px + pw] - total[row, py + ph, px] + total[row, py, px]
        take = open_ & (pw > 0) & ((need == 0) | (seen >= np.maximum(need, 1)))
        cw, ch, x0, y0 = (np.where(take, v, old) for v, old in ((pw, cw), (ph, ch), (px, x0), (py, y0)))
        open_ &= ~take
    flip = f.p["flip"].astype(bool)
    x = np.where(flip[:, None, None], (cw - 1)[:, None, None] - gx, gx) + x0[:, None, None]
    y = np.broadcast_to(gy, x.shape) + y0[:, None, None]
    inside = (gx < cw[:, None, None]) & (gy < ch[:, None, None])
    sx, sy = places(x, y)
    f.rgb = np.where(inside[..., None], bilinear(f.rgb, sx, sy), 0)
    f.mask = np.where(inside & turned[row[:, None, None], np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], 255, 0)
    box, some = mask_boxes(f.mask)
    f.p |= {"cw": cw, "ch": ch, "x0": x0, "y0": y0, "box": box, "boxed": some}


# -- masks ----------------------------------------------------------------------------------------

def laplacian_variance(grey: np.ndarray) -> np.ndarray:
    """Focus measure: population variance of the 4-neighbour Laplacian, borders mirrored."""
    g = grey.astype(float)
    n, h, w = g.shape
    y, x = mirrored(h, 1), mirrored(w, 1)
    lap = g[:, y[:-2]] + g[:, y[2:]] + g[:, :, x[:-2]] + g[:, :, x[2:]] - 4 * g
    return lap.var((1, 2))


def orientation_features(grey: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """(n, block rows, block columns, 4 * bins): histograms of gradient orientation in cells of `cell` pixels, weighted between
    the two nearest bins; blocks of 2 x 2 cells (by row, column and bin), scaled to length one, cut at 0.2 and scaled again."""
    v = grey.astype(float) / 255.0
    n, h, w = v.shape
    gx, gy = np.zeros_like(v), np.zeros_like(v)
    gx[:, :, 1:-1], gy[:, 1:-1] = v[:, :, 2:] - v[:, :, :-2], v[:, 2:] - v[:, :-2]
    b = np.mod(np.degrees(np.arctan2(gy, gx)), 180.0) / (180.0 / bins) - 0.5
    low, size = np.floor(b), np.hypot(gx, gy)
    rows, cols = h // cell, w // cell
    hist = np.zeros((n, rows, cols, bins))
    place = np.broadcast_to(((np.arange(n)[:, None, None] * rows + np.arange(h)[None, :, None] // cell) * cols + np.arange(w)[None, None, :] // cell) * bins, v.shape)[:, : rows * cell, : cols * cell]
    for k, weight in ((0, size * (1 - (b - low))), (1, size * (b - low))):
        at = place + np.mod(low + k, bins).astype(int)[:, : rows * cell, : cols * cell]
        hist += np.bincount(at.ravel(), weight[:, : rows * cell, : cols * cell].ravel(), hist.size).reshape(hist.shape)
    block = np.concatenate([hist[:, y : rows - 1 + y, x : cols - 1 + x] for y in (0, 1) for x in (0, 1)], -1)
    for cut in (0.2, None):
        block = block / np.sqrt((block * block).sum(-1, keepdims=True) + 1e-6)
        block = block if cut is None else np.minimum(block, cut)
    return block


def _slide(mask: np.ndarray, size: int, best, blank: int) -> np.ndarray:
    r = size // 2
    for axis in (2, 1):
        n = mask.shape[axis]
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(mask, pad, constant_values=blank)
        mask = best.reduce([np.take(wide, np.arange(i, i + n), axis) for i in range(2 * r + 1)])
    return mask


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """Box maximum; pixels outside the frame do not count."""
    return _slide(mask, size, np.maximum, 0)


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    return _slide(mask, size, np.minimum, 255)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilated(eroded(mask, size), size)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return eroded(dilated(mask, size), size)


COMPONENTS = "frame_id bigint, label bigint, area bigint, x1 int, y1 int, x2 int, y2 int"


def run_roots(line: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """For runs [x1, x2] sorted by line and place, the first run that each hangs together with, corners included.

    Runs of neighbouring lines that touch are linked, and labels fall to the smallest by rounds of hooking and pointer
    jumping over all runs at once.
    """
    root = np.arange(len(line))
    if not len(line):
        return root
    least = int(x1.min())
    stride = int(x2.max()) - least + 4                                 # no run reaches into the next line
    x1, x2 = x1 - least, x2 - least
    start, end = line * stride + x1 + 1, line * stride + x2 + 1
    lo = np.searchsorted(end, (line + 1) * stride + x1)
    hi = np.searchsorted(start, (line + 1) * stride + x2 + 2, "right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(line)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def components(ids: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
    """8-connected components of (n, h, w) foregrounds: one row each with label, area and box (open ends).

    Horizontal runs are the nodes, linked by `run_roots`. A label is the place (y * w + x) of the first pixel.
    """
    n, h, w = on.shape
    edge = np.diff(np.pad(on, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2).reshape(n * h, w + 1)
    line, x1 = np.nonzero(edge == 1)
    x2 = np.nonzero(edge == -1)[1] - 1
    root = run_roots(line + line // h, x1, x2)                         # an empty line between frames
    heads, of = np.unique(root, return_inverse=True)

    def fold(best, values, first):
        out = np.full(len(heads), first, np.int64)
        best.at(out, of, values)
        return out

    y = line % h
    return {"frame_id": ids[line[heads] // h], "label": y[heads].astype(np.int64) * w + x1[heads], "area": np.bincount(of, x2 - x1 + 1, len(heads)).astype(np.int64),
            "x1": fold(np.minimum, x1, w).astype(np.int32), "y1": fold(np.minimum, y, h).astype(np.int32),
            "x2": (fold(np.maximum, x2, 0) + 1).astype(np.int32), "y2": (fold(np.maximum, y, 0) + 1).astype(np.int32)}


def skin(rgb: np.ndarray, band) -> np.ndarray:
    """Chroma inside a (Cr, Cb) band; luma and chroma by the usual linear conversion, rounded."""
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    luma = r * 0.299 + g * 0.587 + b * 0.114
    cr, cb = np.floor((r - luma) * 0.713 + 128.5), np.floor((b - luma) * 0.564 + 128.5)
    return (cr >= band[0]) & (cr <= band[1]) & (cb >= band[2]) & (cb <= band[3])
