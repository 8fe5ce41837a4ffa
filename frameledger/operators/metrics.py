"""Evaluation metrics at two grains: every frame equal, or every clip equal.

Records carry: clip, gt, pred, conf, det_conf, box_iou (NULL = no usable truth) and optionally
iou_hand, iou_bg, miou, dice (NULL = no mask). Everything is derived from one grouped table,
`cells` (one row per clip, truth, prediction), so the raw records are shuffled once, already
combined, and no later step sees more than N_CLASSES**2 rows of a clip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import DETECTION_THRESHOLDS, GESTURES, N_CLASSES
from frameledger.functions.numeric import flag, ratio_or_zero

C = F.col
SEG = ("miou", "iou_hand", "iou_bg", "dice")


def checked_classes(records: DataFrame, n: int = N_CLASSES) -> DataFrame:
    """Fail the job on a class outside [0, n)."""
    def check(name):
        bad = (C(name) < 0) | (C(name) >= n) | C(name).isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} outside the class range: "), C(name).cast("string")))
                      ).otherwise(C(name)).cast("int").alias(name)
    return records.select(*[check(c) if c in ("gt", "pred") else C(c) for c in records.columns])


def coerce_seg(records: DataFrame) -> DataFrame:
    """NULL record stays NULL, a half-filled one is an error, a missing mean is derived."""
    parts = [C(k) for k in ("iou_hand", "iou_bg", "dice")]
    none = reduce(lambda a, b: a & b, [p.isNull() for p in parts])
    some = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    given = C("miou") if "miou" in records.columns else F.lit(None).cast("double")
    miou = (F.when(none, F.lit(None).cast("double"))
            .when(some, F.raise_error(F.lit("segmentation record with missing scores")).cast("double"))
            .otherwise(F.coalesce(given, (C("iou_hand") + C("iou_bg")) / 2)))
    return records.withColumn("miou", miou)


def with_clip_key(records: DataFrame, clip: str, order: str) -> DataFrame:
    """A frame without a clip is its own clip, so it is never lumped with others."""
    return records.withColumn(clip, F.coalesce(C(clip).cast("string"), F.concat(F.lit("_frame"), C(order).cast("string"))))


def cells(records: DataFrame, keys: tuple = ()) -> DataFrame:
    """Sufficient statistics per (keys, clip, truth, prediction)."""
    seg = [k for k in SEG if k in records.columns]
    aggs = [F.count(F.lit(1)).alias("n"), F.count("box_iou").alias("n_box"), F.sum("box_iou").alias("s_iou"),
            F.sum("conf").alias("s_conf"), F.sum("det_conf").alias("s_det")]
    aggs += [F.sum(flag(C("box_iou") >= t)).alias(f"hit{int(t * 100)}") for t in DETECTION_THRESHOLDS]
    if seg:
        aggs += [F.count("dice").alias("n_seg")] + [F.sum(k).alias(f"s_{k}") for k in seg]
    return records.groupBy(*keys, "clip", "gt", "pred").agg(*aggs)


def _weighted_cells(cell: DataFrame, keys: tuple) -> DataFrame:
    """Add clip totals; the window holds at most N_CLASSES**2 rows per clip."""
    w = W.partitionBy(*keys, "clip")
    for name in ("n", "n_box", "n_seg"):
        if name in cell.columns:
            cell = cell.withColumn(f"c_{name}", F.sum(name).over(w))
    return cell


def _value_list(cell: DataFrame) -> dict[str, tuple[str, str]]:
    """metric -> (sum column, count column)."""
    out = {f"det_acc{int(t * 100)}": (f"hit{int(t * 100)}", "n_box") for t in DETECTION_THRESHOLDS}
    out["mean_box_iou"] = ("s_iou", "n_box")
    for k in SEG:
        if f"s_{k}" in cell.columns:
            out[f"seg_{k}"] = (f"s_{k}", "n_seg")
    return out


def confusion(cell: DataFrame, keys: tuple = ()) -> DataFrame:
    """Long confusion table: n (frame counts) and w (each frame adds 1 / frames of its clip)."""
    wide = _weighted_cells(cell, keys)
    return wide.groupBy(*keys, "gt", "pred").agg(
        F.sum("n").alias("n"), F.sum(C("n") / C("c_n")).alias("w"))


def dense_confusion(cm: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """All class pairs, zeros kept."""
    spark = cm.sparkSession
    axes = (spark.range(n_classes).select(C("id").cast("int").alias("gt"))
            .withColumn("pred", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))))
    return (axes.join(cm, ["gt", "pred"], "left")
            .select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w")))


def class_scores(cm: DataFrame, weight: str = "n", keys: tuple = (), n_classes: int = N_CLASSES) -> DataFrame:
    """Per class: support, f1. A class never seen and never predicted gets f1 = 0."""
    side = F.explode(F.array(F.struct(C("gt").alias("cls"), F.lit(0).alias("as_pred")),
                             F.struct(C("pred").alias("cls"), F.lit(1).alias("as_pred"))))
    v = C(weight).cast("double")
    per = (cm.select(*keys, "gt", "pred", v.alias("v"), side.alias("s"))
           .groupBy(*keys, C("s.cls").alias("cls"))
           .agg(F.sum(F.when((C("s.as_pred") == 0) & (C("gt") == C("pred")), C("v")).otherwise(0.0)).alias("tp"),
                F.sum(F.when(C("s.as_pred") == 0, C("v")).otherwise(0.0)).alias("support"),
                F.sum(F.when(C("s.as_pred") == 1, C("v")).otherwise(0.0)).alias("predicted")))
    every = cm.sparkSession.range(n_classes).select(C("id").cast("int").alias("cls"))
    if keys:
        # Keys times classes through an exploded sequence, not a product join.
        every = (cm.select(*keys).distinct()
                 .withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))))
    return (every.join(per, [*keys, "cls"], "left").na.fill(0.0, ["tp", "support", "predicted"])
            .withColumn("f1", ratio_or_zero(C("tp") * 2, C("support") + C("predicted"))))


def overall_scores(cm: DataFrame, weight: str = "n", keys: tuple = (), n_classes: int = N_CLASSES) -> DataFrame:
    """top1 and macro F1 over all classes."""
    return (class_scores(cm, weight, keys, n_classes).groupBy(*keys)
            .agg(ratio_or_zero(F.sum("tp"), F.sum("support")).alias("cls_top1"),
                 (F.sum("f1") / n_classes).alias("cls_macro_f1")))


def row_normalised(dense: DataFrame, weight: str = "n") -> DataFrame:
    """Each truth row sums to one; an empty row stays zero. (N_CLASSES rows per window.)"""
    total = F.sum(weight).over(W.partitionBy("gt"))
    return dense.withColumn("share", ratio_or_zero(C(weight).cast("double"), total.cast("double")))


def pairs(cell: DataFrame) -> DataFrame:
    """Everything a metric document needs, per (truth, prediction): at most N_CLASSES**2 rows.

    A cell carries n / c_n of its clip, so sums of x / c_n over cells are sums of clip means.
    """
    wide = _weighted_cells(cell, ())
    out = [F.sum("n").alias("n"), F.sum(C("n") / C("c_n")).alias("w"),
           F.sum("s_conf").alias("s_conf"), F.sum("s_det").alias("s_det")]
    for n in ("n_box", "n_seg"):
        if n in cell.columns:
            out += [F.sum(n).alias(n), F.sum(F.when(C(f"c_{n}") > 0, C(n) / C(f"c_{n}"))).alias(f"w_{n}")]
    for s, n in _value_list(cell).values():
        out += [F.sum(s).alias(s), F.sum(F.when(C(f"c_{n}") > 0, F.coalesce(C(s), F.lit(0.0)) / C(f"c_{n}"))).alias(f"w_{s}")]
    return wide.groupBy("gt", "pred").agg(*out)


def _class_counts(weight: str, zero: Column):
    """Class index -> (tp, support, found) over the collected `_pairs`."""
    def total(keep):
        return F.aggregate(F.filter("_pairs", keep), zero, lambda acc, c: acc + c[weight])

    return lambda k: F.struct(total(lambda c: (c["gt"] == k) & (c["pred"] == k)).alias("tp"),
                              total(lambda c: c["gt"] == k).alias("support"), total(lambda c: c["pred"] == k).alias("found"))


def block_values(cell: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """One wide row: frame_* and clip_* metrics of the whole table, from one scan."""
    pair = pairs(cell)
    whole = F.coalesce(F.sum("n"), F.lit(0))

    def count(c):                       # sums of clip weights are whole numbers
        return F.coalesce(F.round(F.sum(c)).cast("long"), F.lit(0).cast("long"))

    def over(num, den):
        return F.coalesce(num / F.when(den > 0, den), F.lit(0.0))

    out = [whole.alias("n_frames"), count("w").alias("n_clips")]
    for name, (s, n) in _value_list(cell).items():
        out += [over(F.sum(s), F.sum(n)).alias(f"frame_{name}"), over(F.sum(f"w_{s}"), count(f"w_{n}")).alias(f"clip_{name}")]
    for label, n in (("boxes", "n_box"), ("seg", "n_seg")):
        if n in cell.columns:
            out += [count(n).alias(f"frame_n_{label}_scored"), (whole - count(n)).alias(f"frame_n_{label}_skipped"),
                    count(f"w_{n}").alias(f"clip_n_{label}_scored"), (count("w") - count(f"w_{n}")).alias(f"clip_n_{label}_skipped")]
    good = C("gt") == C("pred")
    out += [over(F.sum("s_conf"), F.sum("n")).alias("mean_cls_conf"), over(F.sum("s_det"), F.sum("n")).alias("mean_det_conf"),
            over(F.sum(F.when(good, C("s_conf"))), F.sum(F.when(good, C("n")))).alias("cls_conf_correct"),
            over(F.sum(F.when(~good, C("s_conf"))), F.sum(F.when(~good, C("n")))).alias("cls_conf_incorrect"),
            F.collect_list(F.struct("gt", "pred", "n", "w")).alias("_pairs")]
    row = pair.groupBy().agg(*out)
    axis = F.sequence(F.lit(0), F.lit(n_classes - 1))
    for grain, v, zero in (("frame", "n", F.lit(0).cast("long")), ("clip", "w", F.lit(0.0))):
        row = row.withColumn("_cls", F.transform(axis, _class_counts(v, zero)))
        row = (row.withColumn(f"{grain}_support", C("_cls.support"))
               .withColumn(f"{grain}_f1", F.transform("_cls", lambda c: F.when(
                   c["support"] + c["found"] > 0, c["tp"] * 2.0 / (c["support"] + c["found"])).otherwise(F.lit(0.0))))
               .withColumn(f"{grain}_cls_top1", over(F.aggregate("_cls", zero, lambda acc, c: acc + c["tp"]),
                                                     F.aggregate("_cls", zero, lambda acc, c: acc + c["support"])))
               .withColumn(f"{grain}_cls_macro_f1", F.aggregate(f"{grain}_f1", F.lit(0.0), lambda acc, c: acc + c) / n_classes)
               .drop("_cls"))
    return row


def evaluation_document(records: DataFrame, class_names=GESTURES) -> DataFrame:
    """The full metric document: one nested row, safe on empty input."""
    return from_cells(cells(records), class_names)


def from_cells(cell: DataFrame, class_names=GESTURES) -> DataFrame:
    """The document from its sufficient statistics, wherever they were summed."""
    n = len(class_names)
    names = F.array(*[F.lit(g) for g in class_names])
    flat = block_values(cell, n)
    for grain in ("frame", "clip"):
        for part in ("f1", "support"):
            flat = flat.withColumn(f"{grain}_per_class_{part}", F.map_from_arrays(names, C(f"{grain}_{part}"))).drop(f"{grain}_{part}")

    def matrix(field, zero):
        axis = F.sequence(F.lit(0), F.lit(n - 1))
        return F.transform(axis, lambda g: F.transform(axis, lambda p: F.coalesce(F.try_element_at(F.filter(
            C("_pairs"), lambda c: (c["gt"] == g) & (c["pred"] == p)), F.lit(1))[field], zero)))

    def block(prefix):
        return F.struct(*[C(c).alias(c[len(prefix) + 1:]) for c in flat.columns if c.startswith(prefix + "_")])

    return flat.select(
        "n_frames", "n_clips", block("frame").alias("frame"), block("clip").alias("clip"),
        matrix("n", F.lit(0).cast("long")).alias("confusion_matrix"),
        F.transform(matrix("w", F.lit(0.0)), lambda r: F.transform(r, lambda v: F.round(v, 9))).alias("confusion_matrix_clip"),
        "mean_cls_conf", "mean_det_conf", "cls_conf_correct", "cls_conf_incorrect",
        names.alias("class_names"), F.lit(0.5).alias("iou_thresh"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Running-mean meter: sum(v*n)/sum(n), 0 when nothing was seen."""
    return df.groupBy(*keys).agg(
        ratio_or_zero(F.coalesce(F.sum(C(value) * C(weight)), F.lit(0.0)),
                      F.coalesce(F.sum(weight), F.lit(0))).alias("avg"), F.coalesce(F.sum(weight), F.lit(0)).alias("n"))


def pair_predictions(predictions: DataFrame, truth: DataFrame, key: str, best: str = "conf") -> tuple[DataFrame, DataFrame]:
    """(pairs, report): predictions joined to ground truth on an id.

    An id pairs once: of several predictions the one with the highest `best` counts (of equals the least in the
    other columns), of several truths the least row. Ids on one side only, and null ids, do not pair. The report has one
    row: n_pairs, n_prediction_only, n_truth_only (ids), n_predictions_repeated, n_truths_repeated (rows beyond the first).
    """
    def once(df: DataFrame, order: list, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        pick = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest)).alias("row")
        return df.where(C(key).isNotNull()).groupBy(key).agg(pick, F.count(F.lit(1)).alias(name)).select(key, *[C(f"row.{c}") for c in rest], name)

    one, two = once(predictions, [-C(best)], "n_left"), once(truth, [], "n_right")
    pairs = one.join(two, key).drop("n_left", "n_right")
    sides = one.select(key, "n_left").join(two.select(key, "n_right"), key, "full")
    count = lambda c: F.count(F.when(c, 1))
    report = sides.agg(
        count(C("n_left").isNotNull() & C("n_right").isNotNull()).alias("n_pairs"), count(C("n_right").isNull()).alias("n_prediction_only"), count(C("n_left").isNull()).alias("n_truth_only"),
        F.coalesce(F.sum(C("n_left") - 1), F.lit(0)).alias("n_predictions_repeated"), F.coalesce(F.sum(C("n_right") - 1), F.lit(0)).alias("n_truths_repeated"))
    return pairs, report
