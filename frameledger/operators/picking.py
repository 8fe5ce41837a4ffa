"""Choosing frames, candidates and rungs: the best or the first that fits, per group.

All are min/max aggregates over a struct, so they combine before the shuffle and never sort a
whole clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import AREA_HI, AREA_LO, HOLD_HI, HOLD_LO, PICK_STRIDE
from frameledger.operators.ranking import best_per_group

C = F.col


def window_of(idx: Column, lo: Column, hi: Column, n: int) -> Column:
    """Window of a frame index among n equal windows of [lo, hi), bounds truncated to integers.

    The bound table of a clip is n + 1 numbers, so the interval join is an array lookup: the last
    bound not above the index.
    """
    step = (hi - lo).cast("double") / n
    bounds = F.array(*[F.floor(lo + step * i) for i in range(n)])
    w = F.size(F.filter(bounds, lambda b: b <= idx)) - 1
    return F.when((idx >= lo) & (idx < hi), w)


def sharpest_frames(frames: DataFrame, n: int = 3, total: str = "total") -> DataFrame:
    """(clip, w, idx, sharp): sharpest frame of each window of the held part, earliest on ties."""
    lo = F.floor(C(total) * HOLD_LO)
    hi = F.floor(C(total) * HOLD_HI)
    held = (frames.withColumn("w", window_of(C("idx"), lo, hi, n))
            .filter(C("w").isNotNull() & ((C("idx") - lo) % PICK_STRIDE == 0)))
    return best_per_group(held, ["clip", "w"], [-C("sharp"), C("idx")], ["idx", "sharp"])


def complete_clips(picks: DataFrame, n: int = 3) -> DataFrame:
    """Clips with fewer than n picks are an error in strict use; here they are marked."""
    return picks.groupBy("clip").agg(F.count(F.lit(1)).alias("picks")).withColumn("complete", C("picks") == n)


def spacing(picks: DataFrame, fps: float, min_gap_s: float) -> DataFrame:
    """Gap to the previous pick in seconds, and whether it keeps the rule (n rows per clip)."""
    gap = (C("idx") - F.lag("idx").over(W.partitionBy("clip").orderBy("w"))) / F.lit(float(fps))
    return picks.withColumn("gap_s", gap).withColumn("gap_ok", gap.isNull() | (gap >= min_gap_s))


def ladder_pick(cands: DataFrame, key: str, rank: str, frac: str, lo: float = AREA_LO, hi: float = AREA_HI) -> DataFrame:
    """First candidate inside the band, else the one nearest to it (the earlier one on ties)."""
    miss = F.greatest(F.lit(lo) - C(frac), F.lit(0.0)) + F.greatest(C(frac) - F.lit(hi), F.lit(0.0))
    inside = C(frac).between(lo, hi)
    order = [F.when(inside, 0).otherwise(1), F.when(inside, F.lit(0.0)).otherwise(F.round(miss, 9)), C(rank)]
    return best_per_group(cands, [key], order, [rank, frac])


def first_below(cands: DataFrame, key: str, rank: str, frac: str, bound: float = AREA_HI) -> DataFrame:
    """First rung at or below the bound, else the last rung."""
    ok = C(frac) <= bound
    return best_per_group(cands, [key], [F.when(ok, 0).otherwise(1), F.when(ok, C(rank)).otherwise(-C(rank))], [rank, frac])


def head_and_tail(frames: DataFrame, share: float = 0.10) -> DataFrame:
    """Frames of the first and last tenth of their clip."""
    head = C("idx") < F.greatest(F.lit(1), F.floor(C("total") * share))
    tail = C("idx") >= F.floor(C("total") * (1 - share))
    return (frames.filter(head).withColumn("part", F.lit("head"))
            .unionByName(frames.filter(tail).withColumn("part", F.lit("tail"))))


def stratified_examples(rows: DataFrame, n: int, order: list[str], cls: str = "gt") -> DataFrame:
    """The first n // 4 failures, then others until a class holds n // 10 rows, in `order`.

    The rank filter is a constant, so Spark trims each class inside every partition before the
    shuffle and no class is sorted whole.
    """
    per_class, budget = max(1, n // 10), max(1, n // 4)
    wrong = rows.filter(C("gt") != C("pred")).orderBy(*order).limit(budget).withColumn("kind", F.lit("failure"))
    rest = rows.join(wrong.select(*order), order, "left_anti")
    first = rest.withColumn("_r", F.row_number().over(W.partitionBy(cls).orderBy(*order))).filter(C("_r") <= per_class)
    taken = wrong.groupBy(cls).agg(F.count(F.lit(1)).alias("_t"))
    fill = (first.join(taken, cls, "left").filter(C("_r") <= per_class - F.coalesce("_t", F.lit(0)))
            .drop("_r", "_t").withColumn("kind", F.lit("fill")))
    return wrong.unionByName(fill)
