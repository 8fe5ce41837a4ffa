"""The whole result document of a run: metrics at both grains, calibration, intervals and configuration in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameledger.functions.numeric import flag
from frameledger.operators import bootstrap, calibration, metrics

C = F.col


def interval_metrics(columns: list[str]) -> dict[str, Column]:
    """What the document gives intervals for: box metrics on annotated frames, mask metrics where there are any, and the class."""
    hits = {f"det_acc{int(t * 100)}": F.when(C("box_iou").isNotNull(), flag(C("box_iou") >= t)) for t in metrics.DETECTION_THRESHOLDS}
    masks = {f"seg_{k}": C(k) for k in metrics.SEG if k in columns}
    return {"cls_top1": flag(C("gt") == C("pred")), "mean_box_iou": C("box_iou"), **hits, **masks}


def result_document(records: DataFrame, config: dict[str, str] | None = None, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """One row: `metrics.evaluation_document` with cls_ece in the frame block, `reliability` (every bin), `ci` (metric to
    mean, lo, hi, n_clips; clips resampled) and `config`.

    Empty input gives zeros and empty bins, as the parts do.
    """
    doc = metrics.evaluation_document(records)
    curve = calibration.reliability(records).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n", "conf", "acc"))), lambda b: F.struct(*[b[n].alias(n) for n in ("lo", "hi", "n", "conf", "acc")])).alias("reliability"))
    ece = calibration.calibration_error(records).select("cls_ece")
    ci = bootstrap.clip_intervals(records, "clip", interval_metrics(records.columns), n_boot, seed)
    ci = ci.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "lo", "hi", "n_clips"))))).alias("ci"))     # a dozen rows
    given = F.create_map(*[F.lit(v) for pair in (config or {}).items() for v in pair]).cast("map<string,string>")
    one = doc.crossJoin(ece).crossJoin(curve).crossJoin(ci)                   # one row each
    return one.withColumn("frame", C("frame").withField("cls_ece", C("cls_ece"))).drop("cls_ece").withColumn("config", given)
