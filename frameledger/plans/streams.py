"""Streaming queries, each run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameledger.operators import metrics
from frameledger.plans import inputs as I
from frameledger.plans.registry import query
from frameledger.sources import readers, writers
from frameledger.sources.durable import scratch_path
from frameledger.streaming import accumulators as A

C = F.col


def _events(spark, sf):
    return A.table_stream(spark, f"{sf.rstrip('/')}/events.parquet")


def _as_records(ev):
    """Events as evaluation records: clip, truth, prediction, confidence."""
    u, v = C("user_id"), C("event_id")
    return ev.select(u.alias("clip"), (u % 10).cast("int").alias("gt"), F.when(v % 4 == 0, v % 10).otherwise(u % 10).cast("int").alias("pred"),
                     ((v * 37 % 1000).cast("double") / 1000).alias("conf"))


@query("X1", """WITH r AS (SELECT user_id AS clip, CASE WHEN user_id%10=(CASE WHEN event_id%4=0 THEN event_id%10 ELSE user_id%10 END) THEN 1e0 ELSE 0e0 END AS ok, CAST(event_id*37%1000 AS DOUBLE)/1000 AS conf FROM events)
SELECT (SELECT count(*) FROM r) AS n_frames, count(*) AS n_clips, (SELECT round(avg(ok),6) FROM r) AS frame_top1, round(avg(t),6) AS clip_top1, (SELECT round(avg(conf),6) FROM r) AS mean_conf FROM (SELECT clip, avg(ok) AS t FROM r GROUP BY clip)""")
def stream_accumulator(spark, sf):
    out = A.summary(A.drain(A.clip_sums(_as_records(_events(spark, sf))), "complete", "accumulator"))
    return out.select("n_frames", "n_clips", *[F.round(c, 6).alias(c) for c in ("frame_top1", "clip_top1", "mean_conf")])


@query("X2", "SELECT event_type, round(sum(value*(event_id%5+1))/sum(event_id%5+1),6) AS avg, sum(event_id%5+1)::BIGINT AS n FROM events GROUP BY event_type")
def stream_meter(spark, sf):
    ev = _events(spark, sf).withColumn("w", C("event_id") % 5 + 1)
    return A.drain(A.running_meter(ev, "event_type", "value", "w"), "update", "meter", keys=["event_type"]).withColumn("avg", F.round("avg", 6))


def _epoch_files(spark, sf, cut: int = 15):
    """The epoch log as a folder of JSON files, appended in two steps."""
    path = scratch_path(spark, "epoch-log")
    e = I.epochs(spark, sf)
    writers.append_epochs(e.filter(C("epoch") <= cut), path)
    return path, e.filter(C("epoch") > cut)


_EPOCH = "run string, epoch int, score double, n long"


@query("X3 W2", "SELECT run, epoch, round(score,6) AS score FROM (SELECT *, score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS b FROM epochs) WHERE b", "epochs")
def stream_best_score(spark, sf):
    """Two runs of the same stream: the second starts from the saved state."""
    path, later = _epoch_files(spark, sf)
    sink, state = scratch_path(spark, "best-sink"), scratch_path(spark, "best-state")

    def run():
        return A.drain(A.best_so_far(spark.readStream.schema(_EPOCH).json(path), first=1), "append", "best", state, sink, provider=A.ROCKS)

    run()
    writers.append_epochs(later, path)
    return run().withColumn("score", F.round("score", 6))


@query("X4 X7 S7 K5", "SELECT run, count(*) AS n, max(epoch) AS last_epoch FROM epochs GROUP BY run", "epochs")
def stream_epoch_log(spark, sf):
    """New log files are picked up by a restarted stream; earlier ones are not read again."""
    path, later = _epoch_files(spark, sf)
    sink, state = scratch_path(spark, "log-sink"), scratch_path(spark, "log-state")

    def run():
        return A.drain(spark.readStream.schema(_EPOCH).json(path), "append", "log", state, sink)

    run()
    writers.append_epochs(later, path)
    return run().groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last_epoch"))


@query("X5", "SELECT count(*) AS n, count(DISTINCT sig) AS n_sig FROM (SELECT DISTINCT concat(user_id,'-',event_type) AS sig FROM events)")
def stream_deduplicate(spark, sf):
    ev = _events(spark, sf).select(F.concat_ws("-", "user_id", "event_type").alias("sig"))
    once = A.drain(ev.dropDuplicates(["sig"]), "append", "dedup")
    return once.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sig").alias("n_sig"))


# The sharpest row of a clip and day; of equally sharp ones that with the least id.
_BEST_PER_DAY = """SELECT clip, day, event_id, sharp FROM (SELECT user_id AS clip, strftime(ts,'%Y-%m-%d') AS day, event_id, value AS sharp,
  row_number() OVER (PARTITION BY user_id, strftime(ts,'%Y-%m-%d') ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn=1"""


@query("X6", _BEST_PER_DAY)
def stream_best_per_day(spark, sf):
    """Best frame per clip and day, the least id of equally sharp ones (state: one row per clip and open day)."""
    day = F.to_date("ts").alias("day")
    ev = _events(spark, sf).select(C("user_id").alias("clip"), day, "event_id", C("value").alias("sharp"))
    best = ev.groupBy("clip", "day").agg(F.max_by("event_id", F.struct(C("sharp"), -C("event_id"))).alias("event_id"), F.max("sharp").alias("sharp"))
    return A.drain(best, "complete", "day").select("clip", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "sharp")


def _windowed(spark, sf):
    ev = _events(spark, sf).select(C("user_id").alias("clip"), "ts", "event_id", C("value").alias("sharp"))
    return A.drain_to_end(ev, lambda rows: A.best_per_day(rows, "clip", "event_id", "sharp"), "ts", "window")


@query("X6", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_late FROM events")
def stream_late_rows(spark, sf):
    """Rows of the windowed stream, and those behind its watermark that no day holds. (One file is one batch: none is late.)"""
    return A.late_rows(*_windowed(spark, sf))


@query("X6", _BEST_PER_DAY)
def stream_best_windowed(spark, sf):
    """The same with a watermark: closed days are final, emitted once and forgotten; the last ones close with the run."""
    return _windowed(spark, sf)[0].select("clip", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "event_id", "sharp")


def _scored(ev):
    """Events as full evaluation records: boxes and masks on four of five, with a time."""
    e = C("event_id")
    part = lambda k: (e * k % 1000).cast("double") / 1000
    known = e % 5 != 0
    return ev.select(
        C("user_id").alias("clip"), "ts", (C("user_id") % 10).cast("int").alias("gt"), F.when(e % 4 == 0, e % 10).otherwise(C("user_id") % 10).cast("int").alias("pred"),
        part(37).alias("conf"), part(29).alias("det_conf"), F.when(known, part(13)).alias("box_iou"),
        *[F.when(known, v).alias(n) for n, v in (("miou", (part(7) + part(11)) / 2), ("iou_hand", part(7)), ("iou_bg", part(11)), ("dice", part(17)))])


_SCORED_SQL = """r AS (SELECT user_id AS clip, CAST(user_id%10 AS INT) AS gt, CAST(CASE WHEN event_id%4=0 THEN event_id%10 ELSE user_id%10 END AS INT) AS pred, CAST(event_id*37%1000 AS DOUBLE)/1000 AS conf,
  CAST(event_id*29%1000 AS DOUBLE)/1000 AS det, CASE WHEN event_id%5<>0 THEN CAST(event_id*13%1000 AS DOUBLE)/1000 END AS iou, CASE WHEN event_id%5<>0 THEN CAST(event_id*7%1000+event_id*11%1000 AS DOUBLE)/2000 END AS miou,
  CASE WHEN event_id%5<>0 THEN CAST(event_id*17%1000 AS DOUBLE)/1000 END AS dice, 1e0/count(*) OVER (PARTITION BY user_id) AS w FROM events)"""


@query("X1 A30", f"""WITH {_SCORED_SQL},
c AS (SELECT clip, avg(iou) AS iou, avg(CASE WHEN iou>=0.5e0 THEN 1e0 WHEN iou<0.5e0 THEN 0e0 END) AS hit, avg(miou) AS miou, avg(dice) AS dice, avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END) AS t FROM r GROUP BY clip)
SELECT (SELECT count(*) FROM r) AS n_frames, (SELECT count(*) FROM c) AS n_clips, round(avg(CASE WHEN iou>=0.5e0 THEN 1e0 WHEN iou<0.5e0 THEN 0e0 END),9) AS frame_det_acc50, (SELECT round(avg(hit),9) FROM c) AS clip_det_acc50,
 round(avg(iou),9) AS frame_mean_box_iou, (SELECT round(avg(iou),9) FROM c) AS clip_mean_box_iou, round(avg(miou),9) AS frame_seg_miou, (SELECT round(avg(miou),9) FROM c) AS clip_seg_miou,
 round(avg(dice),9) AS frame_seg_dice, (SELECT round(avg(dice),9) FROM c) AS clip_seg_dice, round(avg(CASE WHEN gt=pred THEN 1e0 ELSE 0e0 END),9) AS frame_cls_top1, (SELECT round(avg(t),9) FROM c) AS clip_cls_top1,
 round(avg(conf),9) AS mean_cls_conf, round(avg(det),9) AS mean_det_conf FROM r""")
def stream_evaluation(spark, sf):
    """The whole evaluation document from a stream whose state goes with each clip."""
    cells, _ = A.drain_to_end(_scored(_events(spark, sf)), A.running_cells, "ts", "cells")
    d = metrics.from_cells(A.merged_cells(cells))
    return d.select("n_frames", "n_clips", *[F.round(C(f"{g}.{m}"), 9).alias(f"{g}_{m}") for m in ("det_acc50", "mean_box_iou", "seg_miou", "seg_dice", "cls_top1") for g in ("frame", "clip")],
                    F.round("mean_cls_conf", 9).alias("mean_cls_conf"), F.round("mean_det_conf", 9).alias("mean_det_conf"))


@query("X5", "SELECT strftime(ts,'%Y-%m-%d') AS day, count(DISTINCT concat(user_id,'-',event_type)) AS n FROM events GROUP BY 1")
def stream_first_seen(spark, sf):
    """Signatures seen once a day: repeats lie within the bound, so the bounded memory finds them all."""
    ev = _events(spark, sf).select("ts", F.concat_ws("-", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("sig"))
    once, _ = A.drain_to_end(ev, lambda rows: A.first_seen(rows, ["sig"]), "ts", "seen")
    return once.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
