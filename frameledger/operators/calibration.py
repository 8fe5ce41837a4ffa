"""Confidence calibration over equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import CALIBRATION_BINS
from frameledger.functions.numeric import flag

C = F.col


def bin_index(conf: Column, n_bins: int = CALIBRATION_BINS) -> Column:
    """Bin of a confidence: the first closed at both ends, the others (lo, hi].

    Arithmetic finds the bin to within one; the exact edges then settle values that lie on an
    edge. No range join. Outside [0, 1] there is no bin.
    """
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(n_bins)] + [F.lit(1.0)])
    guess = F.least(F.greatest(F.ceil(conf * n_bins).cast("int") - 1, F.lit(0)), F.lit(n_bins - 1))
    lo, hi = F.element_at(edges, guess + 1), F.element_at(edges, guess + 2)
    settled = F.when((guess > 0) & (conf <= lo), guess - 1).when(conf > hi, guess + 1).otherwise(guess)
    return F.when((conf >= 0) & (conf <= 1), settled)


def reliability(records: DataFrame, n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """One row per bin, empty ones included: lo, hi, n, mean conf, accuracy, share of all rows."""
    got = (records.groupBy(bin_index(C("conf"), n_bins).alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"),
                F.avg(flag(C("gt") == C("pred"))).alias("acc")))
    # Windows over at most n_bins + 1 rows; the total counts every row, binned or not.
    got = got.withColumn("_rows", F.sum("n").over(W.partitionBy()))
    bins = records.sparkSession.range(n_bins).select(C("id").cast("int").alias("bin"))
    joined = bins.join(got, "bin", "left").withColumn("_rows", F.max("_rows").over(W.partitionBy()))
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "bin", (C("bin") * (1.0 / n_bins)).alias("lo"), ((C("bin") + 1) * (1.0 / n_bins)).alias("hi"),
        n.alias("n"), "conf", "acc", F.coalesce(n / C("_rows"), F.lit(0.0)).alias("share"))


def calibration_error(records: DataFrame, keys: tuple = (), n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """sum(k/n * |acc - conf|); n counts all rows."""
    per = (records.groupBy(*keys, bin_index(C("conf"), n_bins).alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg(flag(C("gt") == C("pred"))).alias("acc")))
    gap = F.when(C("bin").isNotNull(), C("n") * F.abs(C("acc") - C("conf"))).otherwise(0.0)
    return per.groupBy(*keys).agg(F.coalesce(F.sum(gap) / F.sum("n"), F.lit(0.0)).alias("cls_ece"),
                                  F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
