"""Comparing runs: report tables, deltas, ablations, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameledger.operators import compare, metrics, picking
from frameledger.plans import inputs as I
from frameledger.plans.registry import query
from frameledger.sources import readers, writers
from frameledger.sources.durable import scratch_path

C = F.col
METRICS = ["det_acc50", "mean_box_iou", "cls_top1", "mean_conf"]


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _r_sql(*names):
    return ", ".join(f"round({n},6) AS {n}" for n in names)


@query("K4 U5", """SELECT run, split, n_frames, n_clips, round(cls_top1,4) AS cls_top1, CASE WHEN split='rs_val' THEN round(mean_conf,4) END AS mean_conf FROM runs""", "runs")
def comparison_table(spark, sf):
    r = I.runs(spark, sf)
    top = F.round("cls_top1", 4).alias("cls_top1")
    val = r.filter("split = 'rs_val'").select("run", "split", "n_frames", "n_clips", top, F.round("mean_conf", 4).alias("mean_conf"))
    test = r.filter("split = 'rs_test'").select("run", "split", "n_frames", "n_clips", top)
    return compare.comparison_table([val, test], ["run", "split", "n_frames", "n_clips"])


@query("K4 K2 S5", "SELECT run, split, n_frames, round(cls_top1,4) AS cls_top1 FROM runs", "runs")
def comparison_file(spark, sf):
    t = I.runs(spark, sf).select("run", "split", "n_frames", F.round("cls_top1", 4).alias("cls_top1"))
    path = scratch_path(spark, "comparison")
    writers.write_comparison(t, path)
    return spark.read.schema("run string, split string, n_frames long, cls_top1 double").csv(path, header=True)


@query("S5 K2 F14", "SELECT run, n_frames, CASE WHEN has_det THEN round(det_acc50,6) END AS det_acc50, round(cls_top1,6) AS cls_top1, 0e0 AS cls_ece_missing FROM runs", "runs")
def result_documents(spark, sf):
    """Result documents of two shapes plus one broken file: written, scanned, headlines flattened."""
    r = I.runs(spark, sf)
    heads = F.when(C("has_det"), F.array(F.lit("det"), F.lit("seg"), F.lit("cls"))).otherwise(F.array(F.lit("cls")))
    doc = F.to_json(F.struct(
        "n_frames", "n_clips", F.struct(C("det_acc50").alias("det_acc@0.5"), "cls_top1", F.lit(0.0).alias("cls_ece")).alias("frame"),
        F.struct("split", F.struct(heads.alias("heads")).alias("train_cfg")).alias("config")))
    path = scratch_path(spark, "results")
    r.select("run", doc.alias("value")).repartition("run").write.partitionBy("run").text(path + "/good")
    r.filter("fam = 'b0'").select(F.lit("{ broken").alias("value"), F.concat(F.lit("bad_"), C("run")).alias("run")).write.partitionBy("run").text(path + "/bad")
    good, _ = readers.result_set(spark, [path + "/good/run=*", path + "/bad/run=*"], F.regexp_extract("_metadata.file_path", "run=([^/]+)/", 1), "*.txt")
    flat = compare.suppress_absent(readers.result_headlines(good))
    return flat.select("run", "n_frames", *_r("det_acc50", "cls_top1"), F.coalesce("cls_ece", F.lit(0.0)).alias("cls_ece_missing"))


@query("S5 K2 A30", """WITH c AS (SELECT clip, count(*) AS n, sum(CASE WHEN gt=pred THEN 1 ELSE 0 END) AS ok, count(iou) FILTER (has_mask) AS nb, count(*) FILTER (has_mask AND iou>=0.5) AS hit FROM pred_iou GROUP BY clip)
SELECT 'one' AS run, CAST(sum(n) AS BIGINT) AS n_frames, round(sum(hit)/sum(nb),6) AS det_acc50, round(sum(ok)/sum(n),6) AS cls_top1 FROM c""", "pred_iou")
def result_round_trip(spark, sf):
    """The evaluation document, written under its file names and read back by the result scan."""
    path = scratch_path(spark, "results")
    writers.write_results(metrics.evaluation_document(I.pred_iou(spark, sf)).withColumn("note", F.struct(F.lit(float("nan")).alias("nan"))), path)
    good, _ = readers.result_set(spark, path, F.lit("one"))
    return readers.result_headlines(good).select("run", "n_frames", *_r("det_acc50", "cls_top1"))


@query("P15", "SELECT run, CASE WHEN has_det THEN round(det_acc50,6) END AS det_acc50, CASE WHEN has_det THEN round(mean_box_iou,6) END AS mean_box_iou, round(cls_top1,6) AS cls_top1 FROM runs", "runs")
def absent_heads(spark, sf):
    heads = F.when(C("has_det"), F.array(F.lit("det"), F.lit("cls"))).otherwise(F.array(F.lit("cls")))
    return compare.suppress_absent(I.runs(spark, sf).withColumn("heads", heads)).select("run", *_r("det_acc50", "mean_box_iou", "cls_top1"))


FAMILIES = [("low", r"^b[1-4]", "e3"), ("high", r"^(b[5-7]|e3$)", "e1"), ("floor", r"^b0$", "zz")]
_FAM_SQL = """(SELECT 'low' AS family, 'e3' AS base, * FROM runs WHERE split='rs_test' AND regexp_matches(fam,'^b[1-4]') UNION ALL SELECT 'high','e1',* FROM runs WHERE split='rs_test' AND regexp_matches(fam,'^(b[5-7]|e3$)')
 UNION ALL SELECT 'floor','zz',* FROM runs WHERE split='rs_test' AND fam='b0')"""


@query("P16", f"SELECT family, base, run FROM {_FAM_SQL}", "runs")
def run_families(spark, sf):
    return compare.run_families(I.runs(spark, sf), FAMILIES, "rs_test").select("family", "base", "run")


@query("J4 P15", f"SELECT f.family, f.run, round(coalesce(f.cls_top1-b.cls_top1,f.cls_top1),6) AS cls_top1, round(coalesce(f.mean_conf-b.mean_conf,f.mean_conf),6) AS mean_conf FROM {_FAM_SQL} f LEFT JOIN (SELECT * FROM runs WHERE split='rs_test') b ON b.fam=f.base", "runs")
def ablation_deltas(spark, sf):
    r = I.runs(spark, sf)
    fam = compare.run_families(r, FAMILIES, "rs_test")
    return compare.base_deltas(fam, r, ["cls_top1", "mean_conf"], "rs_test").select("family", "run", *_r("cls_top1", "mean_conf"))


@query("J5", "SELECT run, round(cls_top1-(SELECT cls_top1 FROM runs WHERE run='e3_rs_test'),6) AS delta FROM runs WHERE split='rs_test'", "runs")
def baseline_delta(spark, sf):
    return compare.required_baseline(I.runs(spark, sf).filter("split = 'rs_test'"), "e3_rs_test", "cls_top1").select("run", *_r("delta"))


@query("P17", "SELECT run, n_frames FROM runs WHERE split='rs_test'", "runs")
def headline_split(spark, sf):
    return compare.headline_split(I.runs(spark, sf), C("split") == "rs_test").select("run", "n_frames")


@query("P17", "SELECT run, n_frames FROM runs", "runs")
def headline_split_fallback(spark, sf):
    return compare.headline_split(I.runs(spark, sf), C("split") == "phone").select("run", "n_frames")


@query("P21", "SELECT run, " + ", ".join(f"round({m},5) AS {m}" for m in METRICS) + " FROM runs", "runs")
def headline_projection(spark, sf):
    return I.runs(spark, sf).select("run", *[F.round(m, 5).alias(m) for m in METRICS])


@query("J6 K7", """SELECT pos, label, s.run, CASE WHEN cls_top1 IS NULL THEN '--' ELSE printf('%.3f', round(cls_top1,3)) END AS top1, CASE WHEN mean_conf IS NULL THEN '--' ELSE printf('%.2f [%.2f,%.2f]', round(mean_conf,2), round(mean_conf-0.125,2), round(mean_conf+0.125,2)) END AS conf
FROM (VALUES (0,'floor','b0_rs_val'),(1,'first','e1_rs_test'),(2,'first','e1_phone'),(3,'third','e3_rs_test')) AS s(pos,label,run) LEFT JOIN runs r ON r.run=s.run""", "runs")
def report_table(spark, sf):
    sk = spark.createDataFrame([(0, "floor", "b0_rs_val"), (1, "first", "e1_rs_test"), (2, "first", "e1_phone"), (3, "third", "e3_rs_test")], "pos int, label string, run string")
    v, m = F.round("cls_top1", 3), C("mean_conf")
    cells = {"top1": compare.fixed(v, 3), "conf": compare.interval_cell(F.round(m, 2), F.round(m - 0.125, 2), F.round(m + 0.125, 2), 2)}
    return compare.skeleton_table(sk, I.runs(spark, sf), cells)


_GAIN = """(SELECT m AS metric, max(CASE WHEN run='e1_rs_test' THEN v END) AS a, max(CASE WHEN run='e3_rs_test' THEN v END) AS b FROM (""" + " UNION ALL ".join(
    f"SELECT run, '{m}' AS m, {m} AS v FROM runs" for m in METRICS) + ") GROUP BY m)"


@query("J7 U2", f"SELECT metric, round(a,6) AS a, round(b,6) AS b, round(b-a,6) AS delta, CAST(sign(round(b-a,3)) AS INT) AS direction FROM {_GAIN}", "runs")
def two_run_gain(spark, sf):
    g = compare.two_run_gain(I.runs(spark, sf), "e1_rs_test", "e3_rs_test", METRICS)
    return g.select("metric", *_r("a", "b", "delta"), "direction")


@query("K7 J7 F11", f"""SELECT metric, CASE WHEN round(b-a,3)=0 THEN '0.000' ELSE concat(CASE WHEN b>a THEN '+' ELSE '-' END, printf('%.3f', abs(round(b-a,3))), CASE WHEN b>a THEN ' up' ELSE ' down' END) END AS cell FROM {_GAIN}""", "runs")
def gain_cells(spark, sf):
    g = compare.two_run_gain(I.runs(spark, sf), "e1_rs_test", "e3_rs_test", METRICS)
    return g.select("metric", compare.gain_cell(F.round("delta", 3)).alias("cell"))


@query("J14", "SELECT 'one' AS label, run, round(cls_top1,6) AS cls_top1 FROM runs WHERE run='e1_rs_val' UNION ALL SELECT 'three', run, round(cls_top1,6) FROM runs WHERE run='e3_rs_test'", "runs")
def curated_series(spark, sf):
    want = [("one", 0, "e1_phone"), ("one", 1, "e1_rs_val"), ("one", 2, "e1_rs_test"), ("three", 0, "e3_rs_test"), ("three", 1, "e3_rs_val"), ("none", 0, "missing")]
    return compare.prioritised(I.runs(spark, sf), want).select("label", "run", *_r("cls_top1"))


@query("J15 K8", "SELECT concat(CASE run WHEN 'e1_rs_test' THEN 'EoneRs' ELSE 'EthreeRs' END, CASE m WHEN 'cls_top1' THEN 'Topone' ELSE 'BoxIoU' END) AS name, round(v,6) AS value FROM (SELECT run, 'cls_top1' AS m, cls_top1 AS v FROM runs UNION ALL SELECT run, 'mean_box_iou', mean_box_iou FROM runs) WHERE run IN ('e1_rs_test','e3_rs_test')", "runs")
def named_numbers(spark, sf):
    ra = spark.createDataFrame([("e1_rs_test", "EoneRs"), ("e3_rs_test", "EthreeRs"), ("gone", "Gone")], "run string, run_alias string")
    ma = spark.createDataFrame([("cls_top1", "Topone"), ("mean_box_iou", "BoxIoU")], "metric string, metric_alias string")
    return compare.named_numbers(I.runs(spark, sf), ra, ma, METRICS).select("name", *_r("value"))


@query("W11 U2", """WITH r AS (SELECT *, row_number() OVER (ORDER BY cls_top1, run) AS lo, row_number() OVER (ORDER BY cls_top1 DESC, run DESC) AS hi FROM runs)
SELECT run, round(cls_top1,6) AS cls_top1 FROM r WHERE lo<=3 OR hi<=3 OR run IN ('e1_rs_test','e3_rs_test')""", "runs")
def ablation_extremes(spark, sf):
    return compare.extremes(I.runs(spark, sf), "cls_top1", 8, ["e1_rs_test", "e3_rs_test"]).select("run", *_r("cls_top1"))


@query("W16", "SELECT m AS metric, " + ", ".join(f"round(max(CASE WHEN run='{r}' THEN v END),6) AS {r}" for r in ("e1_rs_test", "e1_rs_val", "e3_rs_test", "e3_phone")) + " FROM (" + " UNION ALL ".join(f"SELECT run, '{m}' AS m, {m} AS v FROM runs" for m in METRICS) + ") GROUP BY m", "runs")
def domain_gap(spark, sf):
    want = ["e1_rs_test", "e1_rs_val", "e3_rs_test", "e3_phone"]
    long = compare.unpivot(I.runs(spark, sf).filter(C("run").isin(*want)), ["run"], METRICS)
    return long.groupBy("metric").pivot("run", want).agg(F.round(F.max("value"), 6))


@query("A20", "SELECT run, round((cls_top1+mean_box_iou+det_acc50)/3,6) AS score FROM runs", "runs")
def selection_score(spark, sf):
    r = I.runs(spark, sf).withColumn("cls_macro_f1", C("cls_top1")).withColumn("seg_iou_hand", C("mean_box_iou"))
    return compare.selection_score(r).select("run", *_r("score"))


@query("P23 F11", "SELECT run, replace(run,'_rs_test','') AS short FROM runs WHERE split='rs_test' UNION ALL SELECT run, run FROM runs", "runs")
def strip_suffix(spark, sf):
    r = I.runs(spark, sf)
    sufs = ["_rs_test", "_rs_val", "_pseudo"]
    same = compare.strip_common_suffix(r.filter("split = 'rs_test'"), sufs)
    return same.select("run", "short").unionByName(compare.strip_common_suffix(r, sufs).select("run", "short"))


@query("P22", "SELECT run, round(greatest(cls_top1-mean_conf,0),6) AS below, round(greatest(0.55e0-cls_top1,0),6) AS above, CASE WHEN cls_top1<mean_conf THEN 1 ELSE 0 END + CASE WHEN 0.55e0<cls_top1 THEN 1 ELSE 0 END AS clamped FROM runs", "runs")
def interval_arms(spark, sf):
    r = I.runs(spark, sf).withColumn("hi", F.lit(0.55))
    return compare.error_arms(r, "cls_top1", "mean_conf", "hi").select("run", *_r("below", "above"), "clamped")


@query("K7 A11", """SELECT g.gesture, round(coalesce(max(CASE WHEN v=0 THEN f END),0),3) AS rs_val, round(coalesce(max(CASE WHEN v=1 THEN f END),0),3) AS rs_test FROM classes g LEFT JOIN (
 SELECT cls, v, 2e0*sum(CASE WHEN gt=cls AND pred=cls THEN 1 ELSE 0 END)/nullif(sum(CASE WHEN gt=cls THEN 1 ELSE 0 END)+sum(CASE WHEN pred=cls THEN 1 ELSE 0 END),0) AS f
 FROM classes JOIN (SELECT gt, pred, CASE WHEN l_partkey%3=0 THEN 0 ELSE 1 END AS v FROM pred) p ON p.gt=cls OR p.pred=cls GROUP BY 1,2) q ON q.cls=g.cls GROUP BY g.gesture""", "pred classes")
def per_class_table(spark, sf):
    from frameledger.operators import metrics
    split = F.when(C("l_partkey") % 3 == 0, "rs_val").otherwise("rs_test").alias("split")
    cm = I.pred(spark, sf).groupBy(split, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    f1 = metrics.class_scores(cm, "n", ("split",))
    wide = f1.groupBy("cls").pivot("split", ["rs_val", "rs_test"]).agg(F.round(F.max("f1"), 3))
    return wide.join(F.broadcast(I.classes(spark)), "cls").select("gesture", "rs_val", "rs_test")


@query("W12 T2", """
WITH f AS (SELECT o_orderkey AS id, CAST(o_custkey%10 AS INT) AS gt, CAST(CASE WHEN o_orderkey%4=0 THEN o_orderkey%10 ELSE o_custkey%10 END AS INT) AS pred FROM orders),
w AS (SELECT *, 'failure' AS kind FROM f WHERE gt<>pred ORDER BY id LIMIT 25),
r AS (SELECT id, gt, pred, 'fill' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY id) AS rn FROM f WHERE id NOT IN (SELECT id FROM w)) q LEFT JOIN (SELECT gt AS g, count(*) AS t FROM w GROUP BY gt) ON g=gt WHERE rn<=10-coalesce(t,0))
SELECT id, gt, pred, kind FROM w UNION ALL SELECT id, gt, pred, kind FROM r""")
def example_pick(spark, sf):
    key, cust = C("o_orderkey"), C("o_custkey")
    rows = I.table(spark, sf, "orders").select(key.alias("id"), (cust % 10).cast("int").alias("gt"), F.when(key % 4 == 0, key % 10).otherwise(cust % 10).cast("int").alias("pred"))
    return picking.stratified_examples(rows, 100, ["id"]).orderBy("gt", C("gt") == C("pred"), "id")
