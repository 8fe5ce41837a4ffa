"""Classifier, features, epoch logs and schedules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from frameledger.functions.numeric import flag
from frameledger.operators import frames as K
from frameledger.operators import learning, series
from frameledger.plans import inputs as I
from frameledger.plans.registry import query

C = F.col


@query("L5 T9 F10", "SELECT vec_id, gt, pred, round(conf,6) AS conf FROM emb_pred", "emb_pred")
def predict_class(spark, sf):
    return I.emb_pred(spark, sf).select("vec_id", "gt", "pred", F.round("conf", 6).alias("conf"))


@query("F10", "SELECT vec_id, k, round(exp(z-max(z) OVER w)/sum(exp(z)) OVER w*exp(max(z) OVER w),6) AS p FROM emb_scores WINDOW w AS (PARTITION BY vec_id)", "emb_scores")
def softmax_rows(spark, sf):
    rows = learning.softmax(I.emb_scores(spark, sf)).select("vec_id", F.posexplode("ps").alias("k", "p"))
    return rows.select("vec_id", "k", F.round("p", 6).alias("p"))


@query("A25", "SELECT round(avg(l),6) AS cls FROM (SELECT vec_id, sum((CASE WHEN k=gt THEN 0.95e0 ELSE 0 END+0.05e0/10)*(lse-z)) AS l FROM (SELECT *, ln(sum(exp(z)) OVER (PARTITION BY vec_id)) AS lse FROM emb_scores) GROUP BY vec_id)", "emb_scores")
def smoothed_cross_entropy(spark, sf):
    return learning.smoothed_cross_entropy(I.emb_scores(spark, sf)).select(F.round("cls", 6).alias("cls"))


_STD = "(SELECT vec_id, label, pos, (v-avg(v) OVER w)/(stddev_pop(v) OVER w+1e-6) AS v FROM emb WINDOW w AS (PARTITION BY pos))"


@query("L3", f"SELECT vec_id, round(sum(v*(pos+1)),5) AS checksum, round(max(v),5) AS top FROM {_STD} GROUP BY vec_id", "emb")
def standardise(spark, sf):
    s = learning.standardised(I.table(spark, sf, "embeddings"), "embedding", 64)
    weighed = F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return s.select("vec_id", F.round(weighed, 5).alias("checksum"), F.round(F.array_max("embedding"), 5).alias("top"))


@query("L4", """SELECT CAST(pos AS INT) AS pos, k, round(sum(v*(0.1e0-CASE WHEN label=k THEN 1 ELSE 0 END))/(SELECT count(*) FROM embeddings),6) AS g
FROM (SELECT label, pos, v FROM emb UNION ALL SELECT label, 64, 1e0 FROM embeddings) CROSS JOIN (SELECT CAST(i AS INT) AS k FROM range(10) t(i)) GROUP BY 1,2""", "emb")
def gradient_step(spark, sf):
    v = I.table(spark, sf, "embeddings").withColumn("features", F.transform("embedding", lambda x: x.cast("double")))
    return learning.gradient(v, "features", "label", 10).select("pos", "k", F.round("g", 6).alias("g"))


def _vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector
    return I.table(spark, sf, "embeddings").select("vec_id", C("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("L4 L5 L6")
def logistic_regression(spark, sf):
    """Distributed fit, then training accuracy per class."""
    data = _vectors(spark, sf)
    model = learning.fit_multinomial(data, "features", "label")
    scored = model.transform(data)
    return scored.groupBy(C("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(C("label") == C("prediction"))).alias("accuracy"))


@query("L7")
def training_log(spark, sf):
    model = learning.fit_multinomial(_vectors(spark, sf), "features", "label")
    history = model.stages[-1].summary.objectiveHistory      # one number per iteration
    return spark.createDataFrame(list(enumerate(map(float, history))), "iteration int, loss double")


def _hog_sql():
    cells = ", ".join(f"sum(CASE WHEN bin={k} THEN w ELSE 0 END) AS b{k}" for k in range(9))
    blocks = " UNION ALL ".join(f"SELECT frame_id, {p}*9+{k} AS i, b{k} AS v FROM c WHERE cy={p // 2} AND cx={p % 2}" for p in range(4) for k in range(9))
    return f"""
WITH g AS (SELECT frame_id, y, x, coalesce(lead(gt_v) OVER r - lag(gt_v) OVER r, 0)/255e0 AS gx, coalesce(lead(gt_v) OVER c - lag(gt_v) OVER c, 0)/255e0 AS gy FROM px
  WINDOW r AS (PARTITION BY frame_id,y ORDER BY x), c AS (PARTITION BY frame_id,x ORDER BY y)),
a AS (SELECT *, sqrt(gx*gx+gy*gy) AS mag, (CASE WHEN d>=180 THEN d-180 WHEN d<0 THEN d+180 ELSE d END)/20e0-0.5e0 AS b FROM (SELECT *, degrees(atan2(gy,gx)) AS d FROM g)),
s AS (SELECT frame_id, y//8 AS cy, x//8 AS cx, CAST((CAST(floor(b) AS INT)+9)%9 AS INT) AS bin, mag*(1-(b-floor(b))) AS w FROM a UNION ALL SELECT frame_id, y//8, x//8, CAST((CAST(floor(b) AS INT)+10)%9 AS INT), mag*(b-floor(b)) FROM a),
c AS (SELECT frame_id, cy, cx, {cells} FROM s GROUP BY 1,2,3), v AS ({blocks}),
n AS (SELECT frame_id, i, least(v/sqrt(sum(v*v) OVER (PARTITION BY frame_id)+1e-6),0.2e0) AS v FROM v),
m AS (SELECT frame_id, i, v/sqrt(sum(v*v) OVER (PARTITION BY frame_id)+1e-6) AS f FROM n)
SELECT frame_id, count(*) AS n, round(sum(f*(i+1)),4) AS checksum, round(max(f),5) AS top FROM m GROUP BY frame_id"""


@query("L1 F7", _hog_sql(), "px")
def orientation_features(spark, sf):
    def finish(f):
        v = K.orientation_features(f.mask).reshape(len(f.ids), -1)
        return {"frame_id": f.ids, "n": np.full(len(v), v.shape[1]), "checksum": K.rounded((v * np.arange(1, v.shape[1] + 1)).sum(1), 4), "top": K.rounded(v.max(1), 5)}

    return K.over(I.image_rows(spark, sf, 16, 16).drop("rgb"), finish, "frame_id bigint, n bigint, checksum double, top double")


@query("L2", """SELECT clip, frame, l_partkey, l_suppkey, CASE WHEN ok THEN x1 ELSE 0 END AS x1, CASE WHEN ok THEN y1 ELSE 0 END AS y1, CASE WHEN ok THEN x2 ELSE 200 END AS x2, CASE WHEN ok THEN y2 ELSE 120 END AS y2 FROM (
SELECT *, has_mask AND x2>x1 AND y2>y1 AS ok FROM (SELECT clip, frame, l_partkey, l_suppkey, has_mask, CAST(round_even(px1,0) AS INT) AS x1, CAST(round_even(py1,0) AS INT) AS y1,
 least(200, greatest(CAST(round_even(px1,0) AS INT)+2, CAST(round_even(px2,0) AS INT))) AS x2, least(120, greatest(CAST(round_even(py1,0) AS INT)+2, CAST(round_even(py2,0) AS INT))) AS y2 FROM pred))""", "pred")
def crop_choice(spark, sf):
    """The predicted crop, or the whole frame when nothing was found."""
    b = [F.when(C("has_mask"), c) for c in I.pred_box()]
    out = learning.crop_choice(b, 200, 120)
    return I.pred(spark, sf).select("clip", "frame", "l_partkey", "l_suppkey", *[c.alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"))])


@query("L6 A30", """SELECT round(avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END),6) AS cls_top1, round(avg(conf),6) AS mean_conf, round(avg(conf) FILTER (WHERE gt=pred),6) AS conf_correct, count(*) AS n_frames, count(DISTINCT clip) AS n_clips FROM emb_pred""", "emb_pred")
def baseline_scoring(spark, sf):
    """Classifier output through the metric document (no boxes or masks: all skipped)."""
    from frameledger.operators import metrics
    rec = I.emb_pred(spark, sf).select("clip", "gt", "pred", "conf", F.lit(0.0).alias("det_conf"), F.lit(None).cast("double").alias("box_iou"))
    d = metrics.evaluation_document(metrics.checked_classes(rec))
    return d.select(F.round("frame.cls_top1", 6).alias("cls_top1"), F.round("mean_cls_conf", 6).alias("mean_conf"), F.round("cls_conf_correct", 6).alias("conf_correct"), "n_frames", "n_clips")


_TERMS = "(SELECT p_brand AS run, CASE CAST(p_partkey%7 AS INT) WHEN 0 THEN 'heat' WHEN 1 THEN 'size' WHEN 2 THEN 'off' WHEN 3 THEN 'giou' WHEN 4 THEN 'bce' WHEN 5 THEN 'dice' ELSE 'cls' END AS term, avg(p_retailprice)/1000 AS value FROM part GROUP BY 1,2)"
_W = {"heat": 1.0, "size": 0.1, "off": 1.0, "giou": 1.0, "bce": 1.0, "dice": 1.0, "cls": 1.0}
_GROUPS = {"heat": "det", "size": "det", "off": "det", "giou": "det", "bce": "seg", "dice": "seg", "cls": "cls"}


def _terms(spark, sf):
    names = F.array(*[F.lit(t) for t in _W])
    return (I.table(spark, sf, "part").groupBy(C("p_brand").alias("run"), F.element_at(names, (C("p_partkey") % 7).cast("int") + 1).alias("term"))
            .agg((F.avg("p_retailprice") / 1000).alias("value")))


@query("A27", f"SELECT run, round(sum(CASE WHEN term='size' THEN 0.1e0 ELSE 1 END*value),6) AS total FROM {_TERMS} GROUP BY run")
def weighted_loss(spark, sf):
    return series.loss_totals(_terms(spark, sf), _W).select("run", F.round("total", 6).alias("total"))


@query("A27", f"SELECT run, round(sum(exp(-s)*l+s),6) AS total FROM (SELECT run, CASE WHEN term IN ('bce','dice') THEN 0.2e0 WHEN term='cls' THEN -0.1e0 ELSE 0.5e0 END AS s, sum(CASE WHEN term='size' THEN 0.1e0 ELSE 1 END*value) AS l FROM {_TERMS} GROUP BY 1,2) GROUP BY run")
def uncertainty_loss(spark, sf):
    out = series.loss_totals(_terms(spark, sf), _W, _GROUPS, {"det": 0.5, "seg": 0.2, "cls": -0.1})
    return out.select("run", F.round("total", 6).alias("total"))


@query("F6", """SELECT run, epoch, round(CASE WHEN s<300 THEN (s+1)*3e-4/300 ELSE 3e-4*(0.01e0+0.99e0*0.5e0*(1+cos(pi()*least((s-300)/5700e0,1)))) END*1e6,4) AS lr FROM (SELECT run, epoch, n*epoch//10 AS s FROM epochs)""", "epochs")
def learning_rate(spark, sf):
    e = I.epochs(spark, sf).withColumn("s", F.floor(C("n") * C("epoch") / 10))
    return e.select("run", "epoch", F.round(series.learning_rate(C("s"), 100) * 1e6, 4).alias("lr"))


@query("W2", "SELECT run, epoch, score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS is_best FROM epochs", "epochs")
def best_so_far(spark, sf):
    return series.best_so_far(I.epochs(spark, sf)).select("run", "epoch", "is_best")


@query("W13", """
WITH RECURSIVE o AS (SELECT run, score, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM epochs),
r(run, k, v) AS (SELECT run, 0::BIGINT, score FROM o WHERE k=1 UNION ALL SELECT r.run, r.k+1, r.v*(0.999e0*(1-exp(-(r.k+1)/20e0)))+o.score*(1-0.999e0*(1-exp(-(r.k+1)/20e0))) FROM r JOIN o ON o.run=r.run AND o.k=r.k+1)
SELECT run, CAST(max(k) AS INT) AS updates, round(arg_max(v,k),6) AS ema FROM r GROUP BY run""", "epochs")
def moving_average(spark, sf):
    return series.moving_average(I.epochs(spark, sf), ramp=20.0).withColumn("ema", F.round("ema", 6))


@query("W14", "SELECT run, epoch, 'val' AS part, 'score' AS name, score AS value FROM epochs WHERE n >= 60 UNION ALL SELECT run, epoch, 'train', 'loss', round(1-score,12) FROM epochs", "epochs")
def curve_points(spark, sf):
    e = I.epochs(spark, sf).select("run", "epoch", F.round(F.lit(1.0) - C("score"), 12).alias("train/loss"), F.when(C("n") >= 60, C("score")).alias("val/score"), C("n").alias("train/n_annotated"))
    return series.curves(e, ["run", "epoch"])


@query("F16", "SELECT event_type, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen, CAST(epoch_us(max(ts))-epoch_us(min(ts)) AS BIGINT) AS elapsed_us FROM events GROUP BY event_type")
def run_times(spark, sf):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return I.table(spark, sf, "events").groupBy("event_type").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"), (us(F.max("ts")) - us(F.min("ts"))).alias("elapsed_us"))


@query("F9 F12", "SELECT gt, round(quantile_cont(conf,0.025),6) AS lo, round(quantile_cont(conf,0.5),6) AS mid, round(quantile_cont(conf,0.975),6) AS hi FROM pred GROUP BY gt", "pred")
def percentiles(spark, sf):
    """Exact linear-interpolated percentiles; the confidence has a thousand levels, so buffers stay small."""
    q = F.percentile("conf", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    g = I.pred(spark, sf).groupBy("gt").agg(q.alias("q"))
    return g.select("gt", *[F.round(F.element_at("q", i + 1), 6).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@query("F9", "SELECT gt, round(quantile_cont(iou,0.025),9) AS lo, round(quantile_cont(iou,0.5),9) AS mid, round(quantile_cont(iou,0.975),9) AS hi FROM pred_iou WHERE has_mask GROUP BY gt", "pred_iou")
def continuous_percentiles(spark, sf):
    """The same over a value with about as many levels as rows."""
    from frameledger.operators.ranking import exact_quantiles
    q = exact_quantiles(I.pred_iou(spark, sf), ["gt"], "box_iou", {"lo": 0.025, "mid": 0.5, "hi": 0.975})
    return q.select("gt", *[F.round(n, 9).alias(n) for n in ("lo", "mid", "hi")])


@query("L5 S13", "SELECT vec_id, gt, pred FROM emb_pred", "emb_pred")
def batch_scoring(spark, sf):
    """A user model (class means as a matrix) applied to Arrow batches of vectors."""
    from frameledger.operators import scoring
    means = sorted(I.centroids(spark, sf).collect(), key=lambda r: (r["k"], r["pos"]))     # classes x dimensions numbers
    weights = np.array([r["m"] for r in means]).reshape(10, -1)

    def predict(model, pdf):
        z = np.round(np.stack(pdf["embedding"].to_numpy()).astype(float) @ model.T, 9)
        return pdf[["vec_id"]].assign(gt=pdf["label"], pred=z.argmax(axis=1))

    vectors = I.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return scoring.score(vectors, lambda: weights, predict, "vec_id long, gt int, pred int")
