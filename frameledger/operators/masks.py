"""Mask and pixel analytics over pixel rows (frame_id, y, x, value...).

Groupings and windows are all by frame (optionally plus row or column), so a table placed by
frame_id is never shuffled again, and no group is larger than one image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import (
    AREA_HI, AREA_LO, AREA_PCT_P05, AREA_PCT_P95, ASPECT_HI, ASPECT_LO, CENTRE_HI, CENTRE_LO,
    MASK_THRESHOLD, MIN_COMPONENT, MIN_FILL, PRIOR_CENTRE)
from frameledger.operators.frames import run_roots
from frameledger.sources.durable import cut_lineage, stored

C = F.col


def along_row():
    return W.partitionBy("frame_id", "y").orderBy("x")


def along_column():
    return W.partitionBy("frame_id", "x").orderBy("y")


def foreground(value: str, threshold: float = MASK_THRESHOLD) -> Column:
    return C(value) >= threshold


def stats(px: DataFrame, value: str, threshold: float = MASK_THRESHOLD) -> DataFrame:
    """Area and tight box per frame; the box is NULL for an empty mask."""
    on = foreground(value, threshold)
    return px.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_px"), F.count_if(on).alias("n_fg"),
        F.min(F.when(on, C("x"))).alias("x1"), F.min(F.when(on, C("y"))).alias("y1"),
        (F.max(F.when(on, C("x"))) + 1).alias("x2"), (F.max(F.when(on, C("y"))) + 1).alias("y2"),
        (F.max("x") + 1).alias("img_w"), (F.max("y") + 1).alias("img_h"))


def pair_stats(px: DataFrame, gt: str, pr: str, keep=()) -> DataFrame:
    """Counts and boxes of two masks on the same pixels, in one grouping."""
    g, p = foreground(gt), foreground(pr)

    def box(on, tag):
        return [F.min(F.when(on, C("x"))).alias(f"{tag}x1"), F.min(F.when(on, C("y"))).alias(f"{tag}y1"),
                (F.max(F.when(on, C("x"))) + 1).alias(f"{tag}x2"), (F.max(F.when(on, C("y"))) + 1).alias(f"{tag}y2")]

    return px.groupBy("frame_id").agg(
        *[F.first(k).alias(k) for k in keep], F.count(F.lit(1)).alias("n_px"),
        F.count_if(g & p).alias("inter"), F.count_if(g).alias("n_gt"), F.count_if(p).alias("n_pr"),
        *box(g, "g"), *box(p, "p"))


def overlap_scores(inter: Column, n_gt: Column, n_pr: Column, n_px: Column) -> dict[str, Column]:
    """Two-class overlap and Dice from counts; nothing there and nothing found is a perfect 1."""
    union = n_gt + n_pr - inter
    one = F.lit(1.0)
    hand = F.when(union > 0, inter / union).otherwise(one)
    back = F.when(n_px - inter > 0, (n_px - union) / (n_px - inter)).otherwise(one)
    dice = F.when(n_gt + n_pr > 0, inter * 2.0 / (n_gt + n_pr)).otherwise(one)
    return {"iou_hand": hand, "iou_bg": back, "miou": (hand + back) / 2, "dice": dice}


def shape(st: DataFrame) -> DataFrame:
    """Area share, aspect, centre and fill of `stats` rows."""
    bw, bh = F.greatest(C("x2") - C("x1"), F.lit(1)), F.greatest(C("y2") - C("y1"), F.lit(1))
    return (st.withColumn("area", C("n_fg") / C("n_px")).withColumn("aspect", bw / bh)
            .withColumn("cx", (C("x1") + C("x2")) / 2.0 / C("img_w"))
            .withColumn("cy", (C("y1") + C("y2")) / 2.0 / C("img_h"))
            .withColumn("fill", C("n_fg") / (bw * bh)))


def qc_flags(sh: DataFrame, components: str | None = None) -> DataFrame:
    """Review flags; EMPTY_MASK excludes the others. `components` counts large components."""
    def text(fmt, *cols):
        return F.format_string(fmt, *cols)

    pct = C("area") * 100
    edge = (C("x1") <= 1) | (C("y1") <= 1) | (C("x2") >= C("img_w") - 1) | (C("y2") >= C("img_h") - 1)
    off = ~(C("cx").between(CENTRE_LO, CENTRE_HI) & C("cy").between(CENTRE_LO, CENTRE_HI))
    rules = [
        F.when(C("area") < AREA_LO, text("TOO_SMALL(%.1f%%)", pct)),
        F.when(C("area") > AREA_HI, text("TOO_LARGE(%.1f%%)", pct)),
        F.when(~C("aspect").between(ASPECT_LO, ASPECT_HI), text("ASPECT(%.2f)", C("aspect"))),
        F.when(off, text("OFF_CENTRE(%.2f,%.2f)", C("cx"), C("cy"))),
        F.when(edge, F.lit("TOUCHES_BORDER")),
    ]
    if components:
        rules.append(F.when(C(components) > 1, text("MULTI_COMPONENT(%d)", C(components))))
    rules.append(F.when(C("fill") < MIN_FILL, text("LOW_FILL(%.2f)", C("fill"))))
    return sh.withColumn("flags", F.when(C("n_fg") == 0, F.array(F.lit("EMPTY_MASK")))
                         .otherwise(F.array_compact(F.array(*rules))))


def band_flags(sh: DataFrame) -> DataFrame:
    """Second rule set: area band in percent, border contact, nothing detected."""
    pct = C("area") * 100
    edge = (C("x1") == 0) | (C("y1") == 0) | (C("x2") == C("img_w")) | (C("y2") == C("img_h"))
    rules = [F.when(~pct.between(AREA_PCT_P05, AREA_PCT_P95), F.format_string("AREA_OUT_OF_BAND(%.2f%%)", pct)),
             F.when(edge, F.lit("TOUCHES_BORDER"))]
    return sh.withColumn("flags", F.when(C("n_fg") == 0, F.array(F.lit("NO_HAND_DETECTED")))
                         .otherwise(F.array_compact(F.array(*rules))))


def hand_prior(sh: DataFrame) -> DataFrame:
    """Likeness to a hand: hinge penalties on area, aspect, centre and fill; empty is -10.

    Too wide and too narrow are both penalised.
    """
    def over(x, lo):
        return F.greatest(x - F.lit(lo), F.lit(0.0))

    def under(x, hi):
        return F.greatest(F.lit(hi) - x, F.lit(0.0))

    area, aspect = C("area"), C("aspect")
    penalty = (under(area, AREA_LO) * (6.0 / AREA_LO) + over(area, AREA_HI) * (6.0 / AREA_HI)
               + (under(aspect, ASPECT_LO) + over(aspect, ASPECT_HI)) * 2.0
               + (F.abs(C("cx") - PRIOR_CENTRE[0]) + F.abs(C("cy") - PRIOR_CENTRE[1])) * 2.0
               + under(C("fill"), MIN_FILL) * 2.0)
    return sh.withColumn("prior", F.when(C("n_fg") == 0, F.lit(-10.0)).otherwise(-penalty))


def background_plate(px: DataFrame, scene: str, values: list[str], minimum: int = 5) -> DataFrame:
    """Per-pixel median across the frames of a scene, truncated; NULL below `minimum` frames.

    percentile() keeps value counts, and a byte has 256 values, so a scene of any size fits.
    """
    return px.groupBy(scene, "y", "x").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.when(F.count(F.lit(1)) >= minimum, F.floor(F.percentile(v, F.lit(0.5))).cast("int")).alias(v) for v in values])


def plate_distance(px: DataFrame, plate: DataFrame, scene: str, lum: str, a: str, b: str, weight: float = 0.25) -> DataFrame:
    """Distance of each pixel to its scene's plate, lightness weighted, clipped to 0..255.

    The plates (one image per scene) are stored once and broadcast when a count shows they are
    small, so the pixels stay where they are; otherwise the join spreads over pixel positions.
    """
    p = cut_lineage(plate).select(scene, "y", "x", *[C(c).alias(f"_{c}") for c in (lum, a, b)])
    d = [C(c) - C(f"_{c}") for c in (lum, a, b)]
    dist = F.sqrt(F.lit(weight) * d[0] * d[0] + (d[1] * d[1] + d[2] * d[2]).cast("double"))
    return (px.join(p, [scene, "y", "x"]).withColumn("dist", F.least(dist, F.lit(255.0)))
            .drop(*[f"_{c}" for c in (lum, a, b)]))


def otsu(px: DataFrame, value: str) -> DataFrame:
    """Level that best separates two populations, per frame, from a 256-bin histogram.

    Ties go to the lowest level. A level t puts values <= t into the lower class.
    """
    hist = px.groupBy("frame_id", C(value).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("frame_id")
    cum = w.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    h = hist.select("frame_id", "level", F.sum("n").over(cum).alias("n0"),
                    F.sum(C("n") * C("level")).over(cum).alias("s0"),
                    F.sum("n").over(w).alias("nt"), F.sum(C("n") * C("level")).over(w).alias("st"))
    n0, n1 = C("n0").cast("double"), (C("nt") - C("n0")).cast("double")
    gap = C("s0") / n0 - (C("st") - C("s0")) / n1
    between = F.when(n1 > 0, n0 * n1 * gap * gap / (C("nt").cast("double") * C("nt"))).otherwise(F.lit(0.0))
    best = F.min(F.struct((-F.round(between, 9)).alias("o"), C("level").alias("level"))).alias("b")
    return h.groupBy("frame_id").agg(best).select("frame_id", C("b.level").alias("threshold"))


def half_plane(px: DataFrame, landmarks: DataFrame, value: str) -> DataFrame:
    """Clear the mask behind a wrist point; (dx, dy) points to the fingers. No axis: unchanged.

    Each task holds the landmarks of its own frames: they grow with the frames, so they are not broadcast.
    """
    j = px.join(landmarks.hint("shuffle_hash"), "frame_id", "left")
    forward = (C("x") - C("wx")) * C("dx") + (C("y") - C("wy")) * C("dy") >= 0
    short = F.sqrt(C("dx") * C("dx") + C("dy") * C("dy")) < 1e-6
    keep = C("wx").isNull() | short | forward
    return j.withColumn(value, F.when(keep, C(value)).otherwise(F.lit(0))).select(*px.columns)


def paint_box(px: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, out: str = "mask") -> DataFrame:
    inside = (C("x") >= x1) & (C("x") < x2) & (C("y") >= y1) & (C("y") < y2)
    return px.withColumn(out, F.when(inside, F.lit(255)).otherwise(F.lit(0)))


def pooled(px: DataFrame, feature: Column, mask: Column) -> DataFrame:
    """Mask-weighted mean of a feature and its plain mean, per frame."""
    return px.groupBy("frame_id").agg(
        (F.sum(feature * mask) / (F.sum(mask) + F.lit(1e-6))).alias("masked"), F.avg(feature).alias("whole"))


def block_mean(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Area downscale by an integer factor."""
    return (px.groupBy("frame_id", F.floor(C("y") / factor).cast("int").alias("y"), F.floor(C("x") / factor).cast("int").alias("x"))
            .agg(F.avg(value).alias(value)))


def resize_mask(px: DataFrame, value: str, factor: int) -> DataFrame:
    """Downscale and binarise again at the mask threshold."""
    small = block_mean(px.withColumn(value, F.when(foreground(value), 255).otherwise(0)), value, factor)
    return small.withColumn(value, F.when(C(value) >= MASK_THRESHOLD, 255).otherwise(0))


def runs_of(px: DataFrame, on: Column) -> DataFrame:
    """Horizontal foreground runs: (frame_id, y, x1, x2 inclusive, n). `components_by_joins` labels them."""
    fg = px.filter(on).select("frame_id", "y", "x")
    tagged = fg.withColumn("g", C("x") - F.row_number().over(along_row()))
    return (tagged.groupBy("frame_id", "y", "g").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.count(F.lit(1)).alias("n"))
            .drop("g"))


_ROW = 1 << 32                  # label = y * _ROW + x1: apart for any whole-number places


def _component_boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("frame_id", "label").agg(F.sum("area").alias("area"), *[best(c).alias(c) for best, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])


def _band_parts(band: int):
    """A function over bands of images (rows of `runs`) that gives their parts: what hangs together within the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("runs")
            y, x1, x2 = (held.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((x1, y, row))
            y, x1, x2, row = y[order], x1[order], x2[order], row[order]
            place = y % band
            root = run_roots(row * (band + 1) + place, x1, x2)             # an empty line between bands
            order = np.argsort(root, kind="stable")
            heads, begin = np.unique(root[order], return_index=True)

            def fold(best, values):
                return pa.array(best.reduceat(values[order], begin) if len(begin) else values)

            edge = order[(place[order] == 0) | (place[order] == band - 1)]
            ends = np.searchsorted(root[edge], np.append(heads, len(root))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(v[edge]) for v in (y, x1, x2)], names=["y", "x1", "x2"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("frame_id").take(pa.array(row[heads])), pa.array(y[heads] * _ROW + x1[heads]), fold(np.add, x2 - x1 + 1), fold(np.minimum, x1), fold(np.minimum, y),
                 fold(np.maximum, x2 + 1), fold(np.maximum, y + 1), pa.ListArray.from_arrays(pa.array(ends), runs)],
                names=["frame_id", "label", "area", "x1", "y1", "x2", "y2", "edge"])

    return run


def components_by_joins(px: DataFrame, on: Column, band: int = 64) -> DataFrame:
    """8-connected components for images too large for one task (others: frames.components).

    One row per component with label (of its first run in reading order), area and box.

    An image is cut into bands of `band` rows. What hangs together within a band is found in its task and stored as one row, a
    part; neither pixels nor runs are stored. Parts that reach a band's first or last row are joined with those of the next
    band, and labels spread over what touches: every round takes the least label of the neighbours, hands it to the node that
    named it until then, and jumps to that label's own label, so the number of rounds grows with the logarithm of the longest chain of parts. Each round is cut with
    a reliable checkpoint; the loop ends when no label changes. All joins are sort-merge joins: both sides grow with the
    images, whatever size is expected of them, and none goes through the driver.
    """
    kinds = dict(px.dtypes)
    place = [C(c).cast("long").alias(c) for c in ("y", "x1", "x2")]
    bands = (runs_of(px.dropna(subset=["frame_id", "y", "x"]), on).groupBy("frame_id", F.floor((C("y") - F.pmod("y", F.lit(band))) / band).alias("band"))
             .agg(F.collect_list(F.struct(*place)).alias("runs")).select("frame_id", "runs"))
    parts = stored(bands.mapInArrow(_band_parts(band), f"frame_id {kinds['frame_id']}, label bigint, area bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, edge array<struct<y: bigint, x1: bigint, x2: bigint>>"), "mask-parts")
    parts = parts.withColumns({c: C(c).cast(kinds[c[0]]) for c in ("x1", "y1", "x2", "y2")})
    inner, outer = parts.where("size(edge) = 0").drop("edge"), parts.where("size(edge) > 0")
    reach = outer.select("frame_id", "label", F.explode("edge").alias("e")).select("frame_id", "label", "e.*")
    a = reach.where(F.pmod("y", F.lit(band)) == band - 1).select("frame_id", (C("y") + 1).alias("y"), C("label").alias("src"), C("x1").alias("a1"), C("x2").alias("a2"))
    b = reach.where(F.pmod("y", F.lit(band)) == 0).select("frame_id", "y", C("label").alias("dst"), "x1", "x2")
    down = (a.join(b.hint("merge"), ["frame_id", "y"])
            .filter((C("x1") <= C("a2") + 1) & (C("x2") >= C("a1") - 1)).select("frame_id", "src", "dst").distinct())
    edges = cut_lineage(down.unionByName(down.select("frame_id", C("dst").alias("src"), C("src").alias("dst"))))
    label = cut_lineage(edges.select("frame_id", C("src").alias("id")).distinct().withColumn("label", C("id")))
    rounds = 0
    while True:
        seen = label.select("frame_id", C("id").alias("src"), C("label").alias("other"))
        near = edges.join(seen.hint("merge"), ["frame_id", "src"]).groupBy("frame_id", C("dst").alias("id")).agg(F.min("other").alias("other"))
        low = (label.join(near.hint("merge"), ["frame_id", "id"], "left")
               .select("frame_id", "id", "label", F.least("label", F.coalesce("other", "label")).alias("low")))
        # What a node has found holds for its label too.
        up = (low.unionByName(low.select("frame_id", C("label").alias("id"), F.lit(None).cast("long").alias("label"), "low"))
              .groupBy("frame_id", "id").agg(F.max("label").alias("label"), F.min("low").alias("low")))
        jump = up.select("frame_id", C("id").alias("low"), C("low").alias("far"))
        step = cut_lineage(up.join(jump.hint("merge"), ["frame_id", "low"]).select("frame_id", "id", "label", F.least("low", "far").alias("next")))
        moved = step.filter("label <> next").limit(1).count()
        label = step.select("frame_id", "id", C("next").alias("label"))
        if moved == 0:
            break
        rounds += 1
        if rounds % 4 == 0:                 # a checkpoint keeps the expected size, which multiplies with every join
            label = stored(label, "mask-labels")
    first = label.select("frame_id", C("id").alias("label"), C("label").alias("first"))
    named = outer.drop("edge").join(first.hint("merge"), ["frame_id", "label"], "left").withColumn("label", F.coalesce("first", "label")).drop("first")
    return inner.unionByName(_component_boxes(named))


def component_summary(comp: DataFrame, n_px: int) -> DataFrame:
    """Per frame: number of components, those above the area floor, and the largest one."""
    top = F.max(F.struct(C("area").alias("area"), (-C("label")).alias("o"))).alias("t")
    return comp.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if(C("area") > MIN_COMPONENT * n_px).alias("n_large"), top
    ).select("frame_id", "n_components", "n_large", C("t.area").alias("largest_area"), (-C("t.o")).alias("largest_label"))
