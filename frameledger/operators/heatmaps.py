"""Centre-point heat maps: splat, peak suppression, decoding and their losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.functions.boxes import decode_box
from frameledger.functions.numeric import clip, sigmoid
from frameledger.operators.masks import along_column, along_row

C = F.col
_TINY = 1.1920928955078125e-07      # smallest kept splat value relative to the peak (float32 step)


def splat(points: DataFrame, cx: str, cy: str, radius: str, grid_w: int, grid_h: int) -> DataFrame:
    """Unnormalised Gaussians, peak 1, merged by maximum; off-grid centres and tails vanish."""
    r = F.greatest(C(radius), F.lit(0))
    inside = C(cx).between(0, grid_w - 1) & C(cy).between(0, grid_h - 1)
    spread = (points.filter(inside).withColumn("_r", r)
              .withColumn("_dy", F.explode(F.sequence(-C("_r"), C("_r"))))
              .withColumn("_dx", F.explode(F.sequence(-C("_r"), C("_r")))))
    sigma = (C("_r") * 2.0 + 1.0) / 6.0
    value = F.exp(-(C("_dx") * C("_dx") + C("_dy") * C("_dy")) / (sigma * sigma * 2.0))
    return (spread.select("frame_id", (C(cy) + C("_dy")).alias("y"), (C(cx) + C("_dx")).alias("x"), value.alias("heat"))
            .filter(C("x").between(0, grid_w - 1) & C("y").between(0, grid_h - 1) & (C("heat") >= _TINY))
            .groupBy("frame_id", "y", "x").agg(F.max("heat").alias("heat")))


def peaks(heat: DataFrame, value: str = "heat") -> DataFrame:
    """Cells equal to the maximum of their 3x3 neighbourhood (two separable windows)."""
    across = heat.withColumn("_m", F.max(value).over(along_row().rowsBetween(-1, 1)))
    both = across.withColumn("_m", F.max("_m").over(along_column().rowsBetween(-1, 1)))
    return both.filter(C(value) == C("_m")).drop("_m")


def top_peaks(heat: DataFrame, k: int, value: str = "heat") -> DataFrame:
    """k strongest peaks per frame, ties by cell order. A frame has at most its grid's cells."""
    order = W.partitionBy("frame_id").orderBy(C(value).desc(), "y", "x")
    return peaks(heat, value).withColumn("rank", F.row_number().over(order)).filter(C("rank") <= k)


def decode(peak: DataFrame, img_w: int, img_h: int) -> DataFrame:
    """Boxes of peaks that carry off_x, off_y, log_w, log_h."""
    b = decode_box(C("x"), C("y"), C("off_x"), C("off_y"), C("log_w"), C("log_h"), img_w, img_h)
    return peak.select("*", *[c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))])


def gather_at(dense: DataFrame, cells: DataFrame, grid_w: int, value: str = "heat") -> DataFrame:
    """Value at one flat cell index per frame. Each task holds the cells of its own frames: nothing is broadcast."""
    flat = dense.select("frame_id", (C("y") * grid_w + C("x")).alias("cell"), value)
    return cells.hint("shuffle_hash").join(flat, ["frame_id", "cell"])


def focal_loss(logit: Column, target: Column, alpha: float = 2.0, beta: float = 4.0) -> Column:
    """Aggregate: penalty-reduced focal loss over all cells, per positive."""
    p = clip(sigmoid(logit), 1e-4, 1 - 1e-4)
    pos = target == 1.0
    hit = -F.pow(F.lit(1.0) - p, F.lit(alpha)) * F.log(p)
    miss = -F.pow(F.lit(1.0) - target, F.lit(beta)) * F.pow(p, F.lit(alpha)) * F.log(F.lit(1.0) - p)
    return F.sum(F.when(pos, hit).otherwise(miss)) / F.greatest(F.sum(F.when(pos, 1.0).otherwise(0.0)), F.lit(1.0))
