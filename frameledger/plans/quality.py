"""Prediction quality: overlap, confusion, calibration, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameledger.functions import boxes
from frameledger.functions.numeric import flag, mean_or_zero, ratio_or_zero
from frameledger.operators import bootstrap, calibration, metrics
from frameledger.plans import inputs as I
from frameledger.plans.registry import query

C = F.col


def _long(df, groups: dict, keys=()):
    """Unpivot one wide row into (grain, metric, value)."""
    items = [F.struct(F.lit(g).alias("grain"), F.lit(m).alias("metric"), F.round(C(c).cast("double"), 9).alias("value"))
             for (g, m), c in groups.items()]
    return df.select(*keys, F.explode(F.array(*items)).alias("u")).select(*keys, "u.*")


_SUMMARY = ["det_acc50", "det_acc75", "det_acc90", "mean_box_iou", "n_boxes_scored", "n_boxes_skipped",
            "cls_top1", "cls_macro_f1"]


@query("A2 A3 A4 A5 A7 A11 W1 F1", """
WITH p AS (SELECT *, CASE WHEN has_mask THEN iou END AS bi FROM pred_iou),
c AS (SELECT clip, avg(bi) AS m, avg(CASE WHEN bi>=0.5e0 THEN 1e0 WHEN bi<0.5e0 THEN 0e0 END) AS h5,
  avg(CASE WHEN bi>=0.75e0 THEN 1e0 WHEN bi<0.75e0 THEN 0e0 END) AS h7, avg(CASE WHEN bi>=0.9e0 THEN 1e0 WHEN bi<0.9e0 THEN 0e0 END) AS h9,
  count(bi) AS nb, avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END) AS t1 FROM p GROUP BY clip),
k AS (SELECT cls, coalesce(2*sum(CASE WHEN gt=cls AND pred=cls THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN gt=cls THEN 1e0 ELSE 0e0 END)+sum(CASE WHEN pred=cls THEN 1e0 ELSE 0e0 END),0),0) AS f1,
  coalesce(2*sum(CASE WHEN gt=cls AND pred=cls THEN w ELSE 0e0 END)/nullif(sum(CASE WHEN gt=cls THEN w ELSE 0e0 END)+sum(CASE WHEN pred=cls THEN w ELSE 0e0 END),0),0) AS f1w
  FROM classes CROSS JOIN (SELECT gt,pred,1e0/count(*) OVER (PARTITION BY clip) AS w FROM pred) GROUP BY cls)
SELECT grain, metric, round(CAST(value AS DOUBLE),9) AS value FROM (
SELECT 'frame' AS grain,'det_acc50' AS metric, avg(CASE WHEN bi>=0.5e0 THEN 1e0 WHEN bi<0.5e0 THEN 0e0 END) AS value FROM p
UNION ALL SELECT 'frame','det_acc75', avg(CASE WHEN bi>=0.75e0 THEN 1e0 WHEN bi<0.75e0 THEN 0e0 END) FROM p
UNION ALL SELECT 'frame','det_acc90', avg(CASE WHEN bi>=0.9e0 THEN 1e0 WHEN bi<0.9e0 THEN 0e0 END) FROM p
UNION ALL SELECT 'frame','mean_box_iou', avg(bi) FROM p
UNION ALL SELECT 'frame','n_boxes_scored', count(bi) FROM p
UNION ALL SELECT 'frame','n_boxes_skipped', count(*)-count(bi) FROM p
UNION ALL SELECT 'frame','cls_top1', avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END) FROM p
UNION ALL SELECT 'frame','cls_macro_f1', sum(f1)/10 FROM k
UNION ALL SELECT 'clip','det_acc50', avg(h5) FROM c UNION ALL SELECT 'clip','det_acc75', avg(h7) FROM c
UNION ALL SELECT 'clip','det_acc90', avg(h9) FROM c UNION ALL SELECT 'clip','mean_box_iou', avg(m) FROM c
UNION ALL SELECT 'clip','n_boxes_scored', sum(CASE WHEN nb>0 THEN 1 ELSE 0 END) FROM c
UNION ALL SELECT 'clip','n_boxes_skipped', sum(CASE WHEN nb>0 THEN 0 ELSE 1 END) FROM c
UNION ALL SELECT 'clip','cls_top1', avg(t1) FROM c UNION ALL SELECT 'clip','cls_macro_f1', sum(f1w)/10 FROM k)
""", "pred_iou classes")
def frame_clip_summary(spark, sf):
    row = metrics.block_values(metrics.cells(I.pred_iou(spark, sf)))
    return _long(row, {(g, m): f"{g}_{m}" for g in ("frame", "clip") for m in _SUMMARY})


@query("A1", """SELECT gt, round(coalesce(sum(conf*l_quantity)/nullif(sum(l_quantity),0),0),9) AS avg, round(sum(l_quantity),9) AS n
FROM pred GROUP BY gt""", "pred")
def weighted_meter(spark, sf):
    out = metrics.weighted_mean(I.pred(spark, sf), ["gt"], "conf", "l_quantity")
    return out.select("gt", F.round("avg", 9).alias("avg"), F.round(C("n").cast("double"), 9).alias("n"))


@query("F1 F2", """SELECT clip, frame, l_partkey, l_suppkey, round(iou,9) AS iou,
  round(1-(iou-(hull-((gx2-gx1)*(gy2-gy1)+(px2-px1)*(py2-py1)-it))/hull),9) AS giou_loss
FROM (SELECT *, (greatest(gx2,px2)-least(gx1,px1))*(greatest(gy2,py2)-least(gy1,py1)) AS hull FROM pred_iou)""", "pred_iou")
def box_overlap_rows(spark, sf):
    return I.pred(spark, sf).select(
        "clip", "frame", "l_partkey", "l_suppkey", F.round(boxes.iou(I.pred_box(), I.gt_box()), 9).alias("iou"),
        F.round(boxes.giou_loss(I.pred_box(), I.gt_box()), 9).alias("giou_loss"))


@query("A6 A7", """
WITH s AS (SELECT *, (iou_hand+iou_bg)/2 AS miou FROM segrec),
c AS (SELECT clip, avg(miou) AS miou, avg(iou_hand) AS iou_hand, avg(iou_bg) AS iou_bg, avg(dice) AS dice FROM s GROUP BY clip)
SELECT 'frame' AS grain, round(avg(miou),9) AS seg_miou, round(avg(iou_hand),9) AS seg_iou_hand, round(avg(iou_bg),9) AS seg_iou_bg, round(avg(dice),9) AS seg_dice, count(dice) AS n_seg_scored, count(*)-count(dice) AS n_seg_skipped FROM s
UNION ALL SELECT 'clip', round(avg(miou),9), round(avg(iou_hand),9), round(avg(iou_bg),9), round(avg(dice),9), count(dice), count(*)-count(dice) FROM c""", "segrec")
def segmentation_means(spark, sf):
    rec = metrics.coerce_seg(I.segrec(spark, sf))
    per_clip = rec.groupBy("clip").agg(*[a for k in metrics.SEG for a in (F.sum(k).alias(f"s_{k}"), F.count(k).alias(f"n_{k}"))],
                                       F.count(F.lit(1)).alias("n"))
    scored = F.sum((C("n_dice") > 0).cast("long"))
    r9 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)

    def block(grain, mean, n, skipped):
        return F.struct(F.lit(grain).alias("grain"), *[r9(mean(k)).alias(f"seg_{k}") for k in metrics.SEG], n.alias("n_seg_scored"), skipped.alias("n_seg_skipped"))

    both = per_clip.agg(F.array(
        block("frame", lambda k: F.sum(f"s_{k}") / F.sum(f"n_{k}"), F.sum("n_dice"), F.sum(C("n") - C("n_dice"))),
        block("clip", lambda k: F.avg(C(f"s_{k}") / F.when(C(f"n_{k}") > 0, C(f"n_{k}"))), scored, F.count(F.lit(1)) - scored)).alias("b"))
    return both.select(F.explode("b").alias("b")).select("b.*")


_CM = """
WITH w AS (SELECT gt,pred,1e0/count(*) OVER (PARTITION BY clip) AS w FROM pred),
m AS (SELECT a.cls AS gt, b.cls AS pred, count(w.w) AS n, coalesce(sum(w.w),0) AS w
  FROM classes a CROSS JOIN classes b LEFT JOIN w ON w.gt=a.cls AND w.pred=b.cls GROUP BY 1,2) """


@query("A8 A9 W1", _CM + "SELECT gt, pred, n, round(w,9) AS w FROM m", "pred classes")
def confusion_matrix(spark, sf):
    cm = metrics.dense_confusion(metrics.confusion(metrics.cells(I.pred_iou(spark, sf))))
    return cm.select("gt", "pred", "n", F.round("w", 9).alias("w"))


@query("A8", "SELECT gt, " + ", ".join(f"count(*) FILTER (WHERE pred={k}) AS p{k}" for k in range(10)) + " FROM pred GROUP BY gt", "pred")
def confusion_pivot(spark, sf):
    wide = I.pred(spark, sf).groupBy("gt").pivot("pred", list(range(10))).count().na.fill(0)
    return wide.select("gt", *[C(str(k)).alias(f"p{k}") for k in range(10)])


@query("A10", _CM + "SELECT gt, pred, round(CASE WHEN sum(n) OVER (PARTITION BY gt)>0 THEN CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY gt) ELSE 0 END,9) AS share FROM m", "pred classes")
def confusion_row_shares(spark, sf):
    cm = metrics.dense_confusion(metrics.confusion(metrics.cells(I.pred_iou(spark, sf))))
    return metrics.row_normalised(cm).select("gt", "pred", F.round("share", 9).alias("share"))


@query("A11", _CM + """SELECT gesture, round(f1,9) AS f1, round(f1w,9) AS f1_clip, sup AS support, round(supw,9) AS support_clip FROM (
SELECT gesture, c.cls, sum(CASE WHEN gt=c.cls THEN n ELSE 0 END)::BIGINT AS sup, sum(CASE WHEN gt=c.cls THEN w ELSE 0 END) AS supw,
 coalesce(2e0*sum(CASE WHEN gt=c.cls AND pred=c.cls THEN n ELSE 0 END)/nullif(sum(CASE WHEN gt=c.cls THEN n ELSE 0 END)+sum(CASE WHEN pred=c.cls THEN n ELSE 0 END),0),0) AS f1,
 coalesce(2e0*sum(CASE WHEN gt=c.cls AND pred=c.cls THEN w ELSE 0 END)/nullif(sum(CASE WHEN gt=c.cls THEN w ELSE 0 END)+sum(CASE WHEN pred=c.cls THEN w ELSE 0 END),0),0) AS f1w
FROM classes c CROSS JOIN m GROUP BY 1,2)""", "pred classes")
def class_f1(spark, sf):
    row = metrics.block_values(metrics.cells(I.pred_iou(spark, sf)))
    cols = {"f1": "frame_f1", "support": "frame_support", "f1_clip": "clip_f1", "support_clip": "clip_support"}
    long = row.select(F.posexplode(F.arrays_zip(*[C(v).alias(k) for k, v in cols.items()])).alias("cls", "z")).select("cls", "z.*")
    return (long.join(F.broadcast(I.classes(spark)), "cls")
            .select("gesture", F.round("f1", 9).alias("f1"), F.round("f1_clip", 9).alias("f1_clip"), "support",
                    F.round("support_clip", 9).alias("support_clip")))


@query("A11 L6", """
WITH w AS (SELECT gt,pred,1e0/count(*) OVER (PARTITION BY clip) AS w FROM emb_pred)
SELECT round(avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END),9) AS top1, round(sum(CASE WHEN gt=pred THEN w ELSE 0 END)/sum(w),9) AS top1_clip FROM w""", "emb_pred")
def classifier_top1(spark, sf):
    per = I.emb_pred(spark, sf).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.sum(flag(C("gt") == C("pred"))).alias("ok"))
    return per.agg(F.round(F.sum("ok") / F.sum("n"), 9).alias("top1"), F.round(F.avg(C("ok") / C("n")), 9).alias("top1_clip"))


@query("A12", """SELECT round(avg(conf),9) AS mean_cls_conf, round(avg(det_conf),9) AS mean_det_conf,
 round(avg(conf) FILTER (WHERE gt=pred),9) AS cls_conf_correct, round(avg(conf) FILTER (WHERE gt<>pred),9) AS cls_conf_incorrect FROM pred""", "pred")
def confidence_means(spark, sf):
    v = metrics.block_values(metrics.cells(I.pred_iou(spark, sf)))
    return v.select(*[F.round(c, 9).alias(c) for c in ("mean_cls_conf", "mean_det_conf", "cls_conf_correct", "cls_conf_incorrect")])


@query("A21 A26", """SELECT round(coalesce(avg(CASE WHEN has_mask THEN (abs(px1-gx1)+abs(py1-gy1)+abs(px2-gx2)+abs(py2-gy2))/4 END),0),9) AS l1,
 round(coalesce(avg(CASE WHEN has_mask THEN 1-(iou-(hull-((gx2-gx1)*(gy2-gy1)+(px2-px1)*(py2-py1)-it))/hull) END),0),9) AS giou,
 round(avg(-ln(greatest(conf,1e-3))),9) AS cls, sum(CASE WHEN has_mask THEN 1 ELSE 0 END)::BIGINT AS n_annotated
FROM (SELECT *, (greatest(gx2,px2)-least(gx1,px1))*(greatest(gy2,py2)-least(gy1,py1)) AS hull FROM pred_iou)""", "pred_iou")
def sparse_losses(spark, sf):
    """Box terms over annotated rows only (0, not NaN, when there are none); class term over all."""
    seen = C("has_mask")
    return I.pred(spark, sf).agg(
        F.round(mean_or_zero(F.when(seen, boxes.mean_l1(I.pred_box(), I.gt_box()))), 9).alias("l1"),
        F.round(mean_or_zero(F.when(seen, boxes.giou_loss(I.pred_box(), I.gt_box()))), 9).alias("giou"),
        F.round(mean_or_zero(-F.log(F.greatest(C("conf"), F.lit(1e-3)))), 9).alias("cls"),
        F.coalesce(F.sum(seen.cast("long")), F.lit(0)).alias("n_annotated"))


@query("A30 A2 A3 A6 A7 A9 L6 P6", """
WITH s AS (SELECT *, (iou_hand+iou_bg)/2 AS miou, count(*) OVER (PARTITION BY clip) AS cn FROM evals),
c AS (SELECT clip, avg(iou) AS iou, avg(CASE WHEN iou>=0.5e0 THEN 1e0 WHEN iou<0.5e0 THEN 0e0 END) AS hit, avg(miou) AS miou, avg(dice) AS dice FROM s GROUP BY clip),
m AS (SELECT a.cls AS gt, b.cls AS pred, count(s.gt) AS n, coalesce(sum(1e0/s.cn),0) AS w
  FROM classes a CROSS JOIN classes b LEFT JOIN s ON s.gt=a.cls AND s.pred=b.cls GROUP BY 1,2)
SELECT (SELECT count(*) FROM s) AS n_frames, (SELECT count(*) FROM c) AS n_clips,
 (SELECT round(avg(CASE WHEN iou>=0.5e0 THEN 1e0 WHEN iou<0.5e0 THEN 0e0 END),9) FROM s) AS frame_det_acc50, (SELECT round(avg(hit),9) FROM c) AS clip_det_acc50,
 (SELECT round(avg(iou),9) FROM s) AS frame_mean_box_iou, (SELECT round(avg(iou),9) FROM c) AS clip_mean_box_iou,
 (SELECT round(avg(miou),9) FROM s) AS frame_seg_miou, (SELECT round(avg(miou),9) FROM c) AS clip_seg_miou,
 (SELECT round(avg(dice),9) FROM s) AS frame_seg_dice, (SELECT round(avg(dice),9) FROM c) AS clip_seg_dice,
 (SELECT count(dice) FROM s) AS frame_n_seg_scored, (SELECT count(dice) FROM c) AS clip_n_seg_scored,
 (SELECT round(sum(CASE WHEN gt=pred THEN w ELSE 0 END)/sum(w),9) FROM m) AS clip_top1,
 (SELECT '['||string_agg(r, ',' ORDER BY gt)||']' FROM (SELECT gt, '['||string_agg(n::VARCHAR, ',' ORDER BY pred)||']' AS r FROM m GROUP BY gt)) AS confusion_matrix,
 (SELECT round(avg(det_conf),9) FROM s) AS mean_det_conf""", "evals classes")
def evaluation_document(spark, sf):
    d = metrics.evaluation_document(metrics.checked_classes(I.evals(spark, sf)))
    r9 = lambda c, n: F.round(C(c), 9).alias(n)
    return d.select(
        "n_frames", "n_clips", *[r9(f"{g}.{m}", f"{g}_{m}") for m in ("det_acc50", "mean_box_iou", "seg_miou", "seg_dice") for g in ("frame", "clip")],
        C("frame.n_seg_scored").alias("frame_n_seg_scored"), C("clip.n_seg_scored").alias("clip_n_seg_scored"),
        r9("clip.cls_top1", "clip_top1"), F.to_json("confusion_matrix").alias("confusion_matrix"), r9("mean_det_conf", "mean_det_conf"))


@query("A31", """SELECT subject, round(avg(CASE WHEN ann IS NOT NULL THEN 1e0 ELSE 0e0 END),9) AS annotated, round(avg(CASE WHEN ann IS NULL THEN 1e0 ELSE 0e0 END),9) AS skipped, count(*) AS n
FROM frames GROUP BY subject""", "frames")
def annotation_density(spark, sf):
    return I.frames(spark, sf).groupBy("subject").agg(
        F.round(F.avg(flag(C("ann").isNotNull())), 9).alias("annotated"),
        F.round(F.avg(flag(C("ann").isNull())), 9).alias("skipped"), F.count(F.lit(1)).alias("n"))


@query("P13", "SELECT gt, pred, count(*) AS n FROM pred GROUP BY gt, pred", "pred")
def class_range_check(spark, sf):
    return metrics.checked_classes(I.pred(spark, sf)).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("P14", "SELECT frame_id, round((iou_hand+iou_bg)/2,9) AS miou FROM segrec", "segrec")
def segmentation_record(spark, sf):
    return metrics.coerce_seg(I.segrec(spark, sf)).select("frame_id", F.round("miou", 9).alias("miou"))


@query("P11", """SELECT count(DISTINCT k) AS n_clips, sum(CASE WHEN k LIKE '_frame%' THEN 1 ELSE 0 END)::BIGINT AS n_fallback FROM (
SELECT CASE WHEN o_orderstatus='P' THEN concat('_frame', row_number() OVER (ORDER BY o_orderkey)-1) ELSE CAST(o_custkey AS VARCHAR) END AS k FROM orders)""")
def clip_key_fallback(spark, sf):
    from frameledger.operators.ranking import sorted_row_number
    rows = I.table(spark, sf, "orders").select("o_orderkey", F.when(C("o_orderstatus") != "P", C("o_custkey")).alias("clip"))
    at = sorted_row_number(rows, [], ["o_orderkey"], "pos").withColumn("pos", C("pos") - 1)
    keyed = metrics.with_clip_key(at, "clip", "pos").groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(F.count(F.lit(1)).alias("n_clips"),
                     F.coalesce(F.sum(F.when(C("clip").startswith("_frame"), C("n"))), F.lit(0)).alias("n_fallback"))


@query("P12 F13 F14", """SELECT event_type, coalesce(CAST(json_extract_string(props,'$.k') AS INT), -1) AS k, coalesce(json_extract_string(props,'$.missing'),'none') AS other, count(*) AS n
FROM events GROUP BY 1,2,3""")
def optional_fields(spark, sf):
    meta = F.from_json("props", "map<string,string>")
    return (I.table(spark, sf, "events").select("event_type", meta.alias("m"))
            .groupBy("event_type", F.coalesce(F.try_element_at("m", F.lit("k")).cast("int"), F.lit(-1)).alias("k"),
                     F.coalesce(F.try_element_at("m", F.lit("missing")), F.lit("none")).alias("other"))
            .agg(F.count(F.lit(1)).alias("n")))


_BINS = """
WITH b AS (SELECT CAST(i AS INT) AS bin, i*(1e0/15) AS lo, CASE WHEN i=14 THEN 1e0 ELSE (i+1)*(1e0/15) END AS hi FROM range(15) t(i)),
j AS (SELECT b.bin, b.lo, b.hi, p.conf, CASE WHEN p.gt=p.pred THEN 1e0 WHEN p.conf IS NOT NULL THEN 0e0 END AS ok FROM b LEFT JOIN pred p ON (p.conf>b.lo OR (b.bin=0 AND p.conf>=b.lo)) AND p.conf<=b.hi) """


@query("A14 J8", _BINS + "SELECT bin, round(min(lo),9) AS lo, round(min(hi),9) AS hi, count(conf) AS n, round(avg(conf),9) AS conf, round(avg(ok),9) AS acc, round(count(conf)/(SELECT CAST(count(*) AS DOUBLE) FROM pred),9) AS share FROM j GROUP BY bin", "pred")
def reliability_curve(spark, sf):
    r = calibration.reliability(I.pred(spark, sf))
    return r.select("bin", *[F.round(c, 9).alias(c) for c in ("lo", "hi")], "n", *[F.round(c, 9).alias(c) for c in ("conf", "acc", "share")])


@query("A13", _BINS + "SELECT round(sum(n*abs(a-c))/(SELECT CAST(count(*) AS DOUBLE) FROM pred),9) AS cls_ece, (SELECT count(*) FROM pred) AS n FROM (SELECT bin, count(conf) AS n, avg(conf) AS c, avg(ok) AS a FROM j GROUP BY bin)", "pred")
def calibration_error(spark, sf):
    return calibration.calibration_error(I.pred(spark, sf)).select(F.round("cls_ece", 9).alias("cls_ece"), "n")


def _boot_sql(**metrics_of: str) -> str:
    """1,000 draws over the clips: a clip's weight is the Poisson quantile of a cubic in the draw, its coefficients from the clip's digest."""
    names, p = list(metrics_of), bootstrap.PRIME
    h = "0"
    for k in range(4):
        h = f"(({h})*d+c{k})%{p}"
    weight = "+".join(f"(h>={t})::INT" for t in bootstrap.poisson_steps())
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round((SELECT sum(s_{m})/sum(n_{m}) FROM c),9) AS mean, round(quantile_cont({m},0.025),9) AS lo, round(quantile_cont({m},0.975),9) AS hi, (SELECT count(*) FROM c WHERE n_{m}>0) AS n_clips FROM r" for m in names)
    return f"""
WITH c AS (SELECT *, {', '.join(f"CAST('0x'||substr(md5(concat('0|',clip)),{8 * k + 1},8) AS BIGINT)%{p} AS c{k}" for k in range(4))} FROM
  (SELECT clip, {', '.join(f"coalesce(sum({e}),0) AS s_{m}, count({e}) AS n_{m}" for m, e in metrics_of.items())} FROM pred_iou GROUP BY clip)),
w AS (SELECT * EXCLUDE (h), {weight} AS w FROM (SELECT d, {', '.join(f's_{m}, n_{m}' for m in names)}, {h} AS h FROM c CROSS JOIN range(1,1001) t(d))),
r AS (SELECT d, {', '.join(f'sum(w*s_{m})/nullif(sum(w*n_{m}),0) AS {m}' for m in names)} FROM w GROUP BY d)
{rows}"""


_SEVEN_SQL = {"cls_top1": "CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END", "mean_cls_conf": "conf", "mean_det_conf": "det_conf", "mean_box_iou": "CASE WHEN has_mask THEN iou END",
              **{f"det_acc{t}": f"CASE WHEN has_mask THEN CASE WHEN iou>=0.{t}e0 THEN 1e0 ELSE 0e0 END END" for t in (50, 75, 90)}}


def _seven() -> dict:
    hits = {f"det_acc{int(t * 100)}": F.when(C("box_iou").isNotNull(), flag(C("box_iou") >= t)) for t in (0.5, 0.75, 0.9)}
    return {"cls_top1": flag(C("gt") == C("pred")), "mean_cls_conf": C("conf"), "mean_det_conf": C("det_conf"), "mean_box_iou": C("box_iou"), **hits}


def _rounded_intervals(out):
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")], "n_clips")


@query("A16", _boot_sql(cls_top1=_SEVEN_SQL["cls_top1"]), "pred_iou")
def bootstrap_interval(spark, sf):
    return _rounded_intervals(bootstrap.clip_intervals(I.pred(spark, sf), "clip", {"cls_top1": flag(C("gt") == C("pred"))}))


@query("A17", _boot_sql(**_SEVEN_SQL), "pred_iou")
def bootstrap_metrics(spark, sf):
    """Seven metrics, 1,000 draws, all clips; box metrics over annotated frames only."""
    return _rounded_intervals(bootstrap.clip_intervals(I.pred_iou(spark, sf), "clip", _seven()))


@query("A16 A17")
def bootstrap_split(spark, sf):
    """The two-level split; random, so checked by its distribution in tests."""
    return bootstrap.split_intervals(I.pred_iou(spark, sf), "clip", _seven())


_DOCUMENT_SEVEN = {k: v for k, v in _SEVEN_SQL.items() if not k.startswith("mean_c") and not k.startswith("mean_d")}


@query("A30 A13 A14 A16 A17", f"""WITH boot AS ({_boot_sql(**_DOCUMENT_SEVEN)}), b AS ({_BINS} SELECT bin, count(conf) AS n, avg(conf) AS conf, avg(ok) AS acc FROM j GROUP BY bin)
SELECT metric, mean, lo, hi, n_clips, (SELECT round(sum(n*abs(acc-conf))/sum(n),9) FROM b) AS cls_ece, (SELECT sum(n)::BIGINT FROM b) AS n_binned, (SELECT count(*) FROM b) AS n_bins,
 (SELECT count(*) FROM pred) AS n_frames, (SELECT round(avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END),9) FROM pred) AS cls_top1 FROM boot""", "pred_iou pred")
def result_document(spark, sf):
    """The document written as a file and read back, an interval a row."""
    from frameledger.operators.documents import result_document
    from frameledger.sources import readers, writers
    from frameledger.sources.durable import scratch_path
    path = scratch_path(spark, "document")
    writers.write_results(result_document(I.pred_iou(spark, sf)).drop("config"), path)
    good, _ = readers.result_set(spark, path, F.lit("one"))
    r9 = lambda c: F.round(c, 9)
    return good.select(F.explode("ci").alias("metric", "v"), r9(C("frame")["cls_ece"]).alias("cls_ece"), F.aggregate("reliability", F.lit(0).cast("bigint"), lambda s, b: s + b["n"]).alias("n_binned"),
                       F.size("reliability").cast("bigint").alias("n_bins"), "n_frames", r9(C("frame")["cls_top1"]).alias("cls_top1")).select(
        "metric", *[r9(C(f"v.{k}")).alias(k) for k in ("mean", "lo", "hi")], "v.n_clips", "cls_ece", "n_binned", "n_bins", "n_frames", "cls_top1")


def _sides(spark, sf):
    """One prediction per order line, ground truth per order; orders and lines drop out at other ids."""
    lines = I.table(spark, sf, "lineitem").select(
        F.when(C("l_partkey") % 9 == 0, -C("l_orderkey")).otherwise(C("l_orderkey")).alias("id"), (C("l_partkey") % 10).cast("int").alias("pred"),
        ((C("l_partkey") * 37 + C("l_suppkey") * 11 + C("l_linenumber") * 101) % 1000 / 1000.0).cast("double").alias("conf"))
    orders = I.table(spark, sf, "orders").select((C("o_orderkey") + F.when(C("o_custkey") % 8 == 0, 1).otherwise(0)).alias("id"), (C("o_custkey") % 10).cast("int").alias("gt"))
    return lines, orders


_SIDES_SQL = """p AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN -l_orderkey ELSE l_orderkey END AS id, CAST(l_partkey % 10 AS INT) AS pred,
  CAST((l_partkey*37 + l_suppkey*11 + l_linenumber*101) % 1000 AS DOUBLE)/1000 AS conf FROM lineitem),
 t AS (SELECT o_orderkey + CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END AS id, CAST(o_custkey % 10 AS INT) AS gt FROM orders)"""


@query("J3", f"""WITH {_SIDES_SQL}, p1 AS (SELECT id, pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, pred) AS r FROM p) WHERE r = 1),
 t1 AS (SELECT id, min(gt) AS gt FROM t GROUP BY id) SELECT gt, pred, count(*) AS n FROM p1 JOIN t1 USING (id) GROUP BY gt, pred""")
def paired_predictions(spark, sf):
    return metrics.pair_predictions(*_sides(spark, sf), "id")[0].groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("J3", f"""WITH {_SIDES_SQL}, p1 AS (SELECT id, count(*) AS a FROM p GROUP BY id), t1 AS (SELECT id, count(*) AS b FROM t GROUP BY id)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_pairs, count(*) FILTER (b IS NULL) AS n_prediction_only, count(*) FILTER (a IS NULL) AS n_truth_only,
 CAST(sum(a-1) AS BIGINT) AS n_predictions_repeated, CAST(sum(b-1) AS BIGINT) AS n_truths_repeated FROM p1 FULL JOIN t1 USING (id)""")
def pairing_report(spark, sf):
    return metrics.pair_predictions(*_sides(spark, sf), "id")[1]
