"""Input tables of the registered queries, derived from the star-schema tables.

Image-like inputs are expanded from one row per frame. The frame rows are hash-partitioned by frame
*before* they are expanded, so later groupings and windows by frame reuse that placement: the
shuffle moves frames, never pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameledger.constants import GESTURES, N_CLASSES
from frameledger.functions import boxes
from frameledger.functions.numeric import clip, flag, uniform
from frameledger.operators import masks, ranking

C = F.col


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pred(spark, sf) -> DataFrame:
    pk, sk, ln, q = C("l_partkey"), C("l_suppkey"), C("l_linenumber"), C("l_quantity")
    x, y = (pk % 200).cast("double"), (sk % 100).cast("double")
    return table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("clip"), ln.alias("frame"), "l_partkey", "l_suppkey", "l_quantity",
        (sk % 10).cast("int").alias("gt"),
        F.when(q > 10, sk % 10).otherwise(pk % 10).cast("int").alias("pred"),
        (((pk * 37 + sk * 11 + ln * 101) % 1000).cast("double") / 1000).alias("conf"),
        (((pk * 13 + ln * 7) % 1000).cast("double") / 1000).alias("det_conf"),
        (C("l_returnflag") != "N").alias("has_mask"),
        x.alias("gx1"), y.alias("gy1"), (x + 40 + q).alias("gx2"), (y + 60).alias("gy2"),
        (x + ln * 3).alias("px1"), (y + ln * 2).alias("py1"),
        (x + 40 + q + ln * 3).alias("px2"), (y + 60 + ln * 2).alias("py2"))


def gt_box() -> list[Column]:
    return [C("gx1"), C("gy1"), C("gx2"), C("gy2")]


def pred_box() -> list[Column]:
    return [C("px1"), C("py1"), C("px2"), C("py2")]


def pred_iou(spark, sf) -> DataFrame:
    """Predictions with their overlap; NULL where the frame carries no annotation."""
    raw = boxes.iou(pred_box(), gt_box())
    return pred(spark, sf).withColumn("box_iou", F.when(C("has_mask"), raw))


def classes(spark) -> DataFrame:
    """The ten-row label dimension (fixed size)."""
    return spark.createDataFrame(list(enumerate(GESTURES)), "cls int, gesture string")


def frames(spark, sf) -> DataFrame:
    key, cust = C("o_orderkey"), C("o_custkey")
    return table(spark, sf, "orders").select(
        key.alias("oid"), F.concat(F.lit("s"), (cust % 23).cast("string")).alias("subject"),
        (key % 10).cast("int").alias("cls"), F.concat(F.lit("clip0"), (cust % 5).cast("string")).alias("clip"),
        F.floor(key / 10).alias("frame"),
        F.when(C("o_orderstatus") != "P", F.concat(F.lit("ann/"), key.cast("string"))).alias("ann"))


def grid(df: DataFrame, w: int, h: int) -> DataFrame:
    """One row per pixel of each frame row; keeps the partitioning of `df`."""
    return (df.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1)))))


_TARGET_BYTES = 32 << 20        # per task after expansion


def placed(df: DataFrame, key: str, rows_per_row: int, row_bytes: int = 64) -> DataFrame:
    """Hash-place rows that are about to be expanded, sized for what they expand to.

    Adaptive coalescing looks at the small rows before the expansion and would pack far too many into one task, so the
    number of partitions is set from the expanded size instead. The rows are counted (for a Parquet table its footers
    tell): the size of a compressed file says little about them.
    """
    expanded = df.count() * rows_per_row * row_bytes
    n = max(df.sparkSession.sparkContext.defaultParallelism, expanded // _TARGET_BYTES + 1)
    return df.repartition(int(n), key)


def frame_rows(spark, sf, expand: int = 256, **extra: Column) -> DataFrame:
    """One row per frame placed by frame; `extra` adds per-frame columns before expansion."""
    base = table(spark, sf, "part").select(C("p_partkey").alias("frame_id"), "p_size")
    for name, col in extra.items():
        base = base.withColumn(name, col)
    return placed(base, "frame_id", expand)


def image_rows(spark, sf, w: int = 8, h: int = 8, **extra: Column) -> DataFrame:
    """One row per frame with its picture and mask as bytes; `extra` adds per-frame columns.

    The table of frames is one small file, so it is dealt to every core; frames stream through, and nothing grows with a
    partition. Stands for the decoding of image files.
    """
    base = table(spark, sf, "part").select(C("p_partkey").alias("frame_id"), "p_size")
    base = base.withColumns(extra).repartition(2 * spark.sparkContext.defaultParallelism, "frame_id")
    fields = ", ".join(f"{name} {kind}" for name, kind in base.dtypes)
    x, y = np.meshgrid(np.arange(w), np.arange(h))

    def draw(batches):
        for batch in batches:
            step = max(1, (1 << 16) // (w * h))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                f, s = (part.column(c).to_numpy().astype(np.int64)[:, None, None] for c in ("frame_id", "p_size"))
                rgb = np.stack(np.broadcast_arrays((x * 16 + f) % 256, (y * 16 + s * 3) % 256, (x * y + f * 5) % 256), -1).astype(np.uint8)
                on = (x >= f % 5) & (x < f % 5 + s % 11) & (y >= f % 4) & (y < f % 4 + 6)
                mask = np.where(on, 255, (x * 7 + y * 13 + f) % 100).astype(np.uint8)
                n = part.num_rows
                made = [pa.array(np.full(n, v, np.int32)) for v in (w, h)] + [pa.array([v.tobytes() for v in plane], pa.binary()) for plane in (rgb, mask)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "w", "h", "rgb", "mask"])

    return base.mapInArrow(draw, f"{fields}, w int, h int, rgb binary, mask binary")


def px(spark, sf) -> DataFrame:
    f, s, x, y = C("frame_id"), C("p_size"), C("x"), C("y")
    gt = (x >= f % 5) & (x < f % 5 + s % 11) & (y >= f % 4) & (y < f % 4 + 6)
    wide = F.when((s % 11 == 0) & (f % 2 == 0), F.lit(0)).otherwise(s % 9)
    pr = (x >= f % 5 + 1) & (x < f % 5 + 1 + wide) & (y >= f % 4 + 1) & (y < f % 4 + 7)
    return grid(frame_rows(spark, sf), 16, 16).select(
        "frame_id", "p_size", "y", "x",
        F.when(gt, F.lit(255)).otherwise((x * 7 + y * 13 + f) % 100).cast("int").alias("gt_v"),
        F.when(pr, F.lit(220)).otherwise((x * 3 + y * 5 + f) % 100).cast("int").alias("pr_v"))


def rgb(spark, sf, **extra: Column) -> DataFrame:
    f, s, x, y = C("frame_id"), C("p_size"), C("x"), C("y")
    return grid(frame_rows(spark, sf, 64, **extra), 8, 8).select(
        "frame_id", (f % 10).cast("int").alias("scene"), "y", "x",
        ((x * 16 + f) % 256).cast("int").alias("r"), ((y * 16 + s * 3) % 256).cast("int").alias("g"),
        ((x * y + f * 5) % 256).cast("int").alias("b"), *extra)


def heat(spark, sf) -> DataFrame:
    f, s, x, y = C("frame_id"), C("p_size"), C("x"), C("y")

    def bump(cx, cy):
        return F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 4.0)

    return grid(frame_rows(spark, sf, 108), 12, 9).select(
        "frame_id", "p_size", "y", "x",
        F.round(bump(f % 12, s % 9) + F.lit(0.5) * bump(s % 12, f % 9), 9).alias("heat"))


def maskpair(spark, sf) -> DataFrame:
    """Both masks of a frame reduced to counts and boxes in one grouping."""
    return masks.pair_stats(px(spark, sf), "gt_v", "pr_v", keep=["p_size"])


def segrec(spark, sf) -> DataFrame:
    s = masks.overlap_scores(C("inter"), C("n_gt"), C("n_pr"), C("n_px"))
    known = C("frame_id") % 5 != 0
    return maskpair(spark, sf).select(
        "frame_id", F.floor(C("frame_id") / 15).alias("clip"),
        *[F.when(known, s[k]).alias(k) for k in ("iou_hand", "iou_bg", "dice")])


def evals(spark, sf) -> DataFrame:
    """Full evaluation records: real masks scored per frame, with class predictions."""
    f, s = C("frame_id"), C("p_size")
    known = C("n_gt") > 0
    empty = [F.coalesce(C(c), F.lit(0)).cast("double") for c in ("px1", "py1", "px2", "py2")]
    sc = masks.overlap_scores(C("inter"), C("n_gt"), C("n_pr"), C("n_px"))
    return maskpair(spark, sf).select(
        "frame_id", F.floor(f / 15).alias("clip"), (f % 10).cast("int").alias("gt"),
        F.when(s > 10, f % 10).otherwise(s % 10).cast("int").alias("pred"),
        (((f * 37 + s * 11) % 1000).cast("double") / 1000).alias("conf"),
        flag(C("n_pr") > 0).alias("det_conf"),
        F.when(known, boxes.iou(empty, [C(c).cast("double") for c in ("gx1", "gy1", "gx2", "gy2")])).alias("box_iou"),
        *[F.when(known, sc[k]).alias(k) for k in ("iou_hand", "iou_bg", "miou", "dice")])


def maskstats(spark, sf) -> DataFrame:
    """Area share and box of frames with a foreground; the others are absent on purpose."""
    return (masks.stats(px(spark, sf), "gt_v").filter("n_fg > 0")
            .select("frame_id", (C("n_fg") / C("n_px")).alias("area"), "x1", "y1", "x2", "y2"))


def clipframes(spark, sf) -> DataFrame:
    """Frame position within each clip. A hot clip is spread over the range sort like any other rows."""
    ev = table(spark, sf, "events").select(C("user_id").alias("clip"), "event_id", "ts", C("value").alias("sharp"))
    ranked = ranking.sorted_row_number(ev, ["clip"], ["ts", "event_id"], "rn", total="total")
    return ranked.select("clip", "event_id", (C("rn") - 1).alias("idx"), "total", "sharp")


def cands(spark, sf) -> DataFrame:
    return (frame_rows(spark, sf, 7).withColumn("rk", F.explode(F.sequence(F.lit(0), F.lit(6))))
            .withColumn("frac", ((C("frame_id") * 31 + C("rk") * 17) % 200).cast("double") / 1000))


def epochs(spark, sf) -> DataFrame:
    return (table(spark, sf, "events")
            .groupBy(C("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
            .agg(F.round(F.avg("value") / 100, 12).alias("score"), F.count(F.lit(1)).alias("n")))


def runs(spark, sf) -> DataFrame:
    """Headline numbers of one run per family and split (about twenty rows)."""
    fam = (F.when(C("l_suppkey") % 10 < 8, F.concat(F.lit("b"), (C("l_suppkey") % 10).cast("string")))
           .when(C("l_suppkey") % 10 == 8, "e1").otherwise("e3"))
    split = F.when(C("l_partkey") % 3 == 0, "rs_val").otherwise("rs_test")
    base = pred_iou(spark, sf).withColumn("fam", fam).withColumn("split", split)
    # Two steps, so that distinct clips are counted on pre-aggregated rows.
    per_clip = base.groupBy("fam", "split", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(C("pred") == C("gt"))).alias("s_top"), F.sum("conf").alias("s_conf"),
        F.count("box_iou").alias("n_box"), F.sum("box_iou").alias("s_iou"),
        F.sum(F.when(C("box_iou").isNotNull(), flag(C("box_iou") >= 0.5))).alias("s_hit"))
    return per_clip.groupBy("fam", "split").agg(
        F.sum("n").alias("n_frames"), F.count(F.lit(1)).alias("n_clips"),
        F.round(F.sum("s_top") / F.sum("n"), 9).alias("cls_top1"),
        F.round(F.sum("s_conf") / F.sum("n"), 9).alias("mean_conf"),
        F.round(F.sum("s_hit") / F.sum("n_box"), 9).alias("det_acc50"),
        F.round(F.sum("s_iou") / F.sum("n_box"), 9).alias("mean_box_iou"),
    ).select(F.concat_ws("_", "fam", "split").alias("run"), "fam", "split",
             (~C("fam").isin("b1", "b4")).alias("has_det"), "n_frames", "n_clips",
             "cls_top1", "mean_conf", "det_acc50", "mean_box_iou")


def corrections(spark, sf) -> DataFrame:
    k = C("p_partkey") % 10
    return table(spark, sf, "part").filter(k < 4).select(
        C("p_partkey").alias("frame_id"),
        F.when(k == 0, "drop").when(k == 1, "mask").when(k == 2, "box").otherwise("point").alias("kind"))


def sig(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", C("source").alias("subject"), F.md5("text").alias("sig"), "n_chars")


def layers(spark, sf) -> DataFrame:
    k = C("p_partkey") % 4
    return (table(spark, sf, "part").groupBy(
        C("p_brand").alias("run"), (C("p_size") % 3).cast("int").alias("layer"),
        F.when(k == 0, "lr").when(k == 1, "photometric").when(k == 2, "epochs").otherwise("bogus").alias("k"))
        .agg(F.max(F.when(C("p_size") % 7 != 0, C("p_type"))).alias("v")))


def knots(spark, sf) -> DataFrame:
    """Five perturbed tone knots per frame."""
    kx = C("k") / 4.0
    return (frame_rows(spark, sf, 5).select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
            .select("frame_id", "k", kx.alias("kx"),
                    clip(kx + (F.lit(-0.1) + F.lit(0.2) * uniform("tone", C("frame_id"), C("k"))), 0.0, 1.0).alias("ky")))


def names(spark, sf) -> DataFrame:
    k, s = C("p_partkey"), C("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 4 == 0, F.format_string("G0%d_call_clip0%d.mov", k % 9 + 1, s % 3 + 1))
        .when(k % 4 == 1, F.format_string("G%d_rock.MOV", s % 3 + 1))
        .when(k % 4 == 2, ".DS_Store")
        .otherwise(F.format_string("frame_%03d.png", k % 1000)).alias("name"))


def paths(spark, sf) -> DataFrame:
    key, cust = C("o_orderkey"), C("o_custkey")
    folders = F.array(*[F.lit(g) for g in GESTURES + ("G11_x", "notes")])
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("/root/s"), (cust % 23).cast("string"), F.when(cust % 7 == 0, "/wrap").when(cust % 5 == 0, "/data/set").otherwise(""),
                 F.lit("/"), F.element_at(folders, (key % 12).cast("int") + 1),
                 F.when(cust % 11 == 0, "/misc0").otherwise("/clip0"), (cust % 5).cast("string"),
                 F.when(key % 3 == 0, "/annotation").otherwise("/rgb"),
                 F.when(C("o_orderstatus") == "P", "/.DS_Store").otherwise(F.format_string("/frame_%03d.png", F.when(key % 13 == 0, key + 1_700_000_000_000_000).otherwise(key % 1000)))).alias("path"),
        F.round("o_totalprice").cast("long").alias("size"))


def emb(spark, sf) -> DataFrame:
    return (table(spark, sf, "embeddings")
            .select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
            .withColumn("v", C("v").cast("double")))


def centroids(spark, sf) -> DataFrame:
    """Class means per dimension: classes x dimensions rows, fixed by the model's shape."""
    return emb(spark, sf).groupBy(C("label").alias("k"), "pos").agg(F.avg("v").alias("m"))


def emb_scores(spark, sf) -> DataFrame:
    """Vector times class mean: all ten scores of a vector in one row."""
    from frameledger.operators import learning
    means = centroids(spark, sf).groupBy("k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
    return learning.class_scores(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), means, "embedding", "label").select("vec_id", "gt", "zs")


def emb_pred(spark, sf) -> DataFrame:
    from frameledger.operators import learning
    return learning.predict(emb_scores(spark, sf)).select(
        "vec_id", F.floor(C("vec_id") / 15).alias("clip"), "gt", "pred", "conf")
