"""Epoch series: best so far, averages, curves, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

C = F.col


def best_so_far(epochs: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score") -> DataFrame:
    """Strict improvement over all earlier epochs of the run (a run's log is one row per epoch)."""
    before = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    prev = F.coalesce(F.max(score).over(before), F.lit(-1e9))
    return epochs.withColumn("best_before", prev).withColumn("is_best", C(score) > prev)


def moving_average(epochs: DataFrame, decay: float = 0.999, ramp: float = 2000.0, run: str = "run", epoch: str = "epoch", score: str = "score") -> DataFrame:
    """Exponential average whose decay warms up: d = decay * (1 - exp(-k / ramp)) at update k."""
    g = epochs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(epoch, score))).alias("s"))
    start = F.struct(F.lit(0).alias("k"), C("s")[0][score].alias("v"))

    def step(acc, e):
        k = acc["k"] + 1
        d = F.lit(decay) * (F.lit(1.0) - F.exp(-k / F.lit(ramp)))
        return F.struct(k.alias("k"), (acc["v"] * d + e[score] * (F.lit(1.0) - d)).alias("v"))

    return g.select(run, F.size("s").alias("updates"), F.aggregate("s", start, step, lambda a: a["v"]).alias("ema"))


def curves(epochs: DataFrame, keys: list[str], prefixes: tuple = ("train/", "val/"), skip: tuple = ("train/n_annotated",)) -> DataFrame:
    """Prefixed columns to (keys, part, name, value), missing values skipped."""
    cols = [c for c in epochs.columns if c.startswith(prefixes) and c not in skip]
    ids = [C(k) for k in keys]
    long = epochs.select(*ids, *[C(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(keys, cols_quoted(cols), "key", "value")
    return long.filter(C("value").isNotNull()).select(
        *keys, F.split_part("key", F.lit("/"), F.lit(1)).alias("part"), F.split_part("key", F.lit("/"), F.lit(2)).alias("name"), "value")


def cols_quoted(cols: list[str]) -> list[Column]:
    return [C(f"`{c}`") for c in cols]


def learning_rate(step: Column, steps_per_epoch: int, epochs: int = 60, warmup_epochs: int = 3, lr: float = 3e-4, floor: float = 0.01) -> Column:
    """Linear warm-up, then a cosine down to floor * lr."""
    warm, total = warmup_epochs * steps_per_epoch, epochs * steps_per_epoch
    t = F.least((step - warm) / float(max(1, total - warm)), F.lit(1.0))
    cos = (F.lit(1.0) + F.cos(F.lit(math.pi) * t)) * 0.5
    return F.when(step < warm, (step + 1) * lr / float(max(1, warm))).otherwise(F.lit(lr) * (F.lit(floor) + F.lit(1 - floor) * cos))


def loss_totals(long: DataFrame, weights: dict[str, float], groups: dict[str, str] | None = None, log_var: dict[str, float] | None = None) -> DataFrame:
    """(run, total) from long losses (run, term, value).

    Fixed weights give sum(w * L); with `log_var` the terms are first summed into groups and the
    total is sum(exp(-s) * L + s).
    """
    w = F.create_map(*[F.lit(v) for k, x in weights.items() for v in (k, float(x))])
    weighted = long.withColumn("value", F.coalesce(F.try_element_at(w, C("term")), F.lit(0.0)) * C("value"))
    if log_var is None:
        return weighted.groupBy("run").agg(F.sum("value").alias("total"))
    g = F.create_map(*[F.lit(v) for k, x in groups.items() for v in (k, x)])
    s = F.create_map(*[F.lit(v) for k, x in log_var.items() for v in (k, float(x))])
    grouped = weighted.withColumn("grp", F.element_at(g, C("term"))).groupBy("run", "grp").agg(F.sum("value").alias("l"))
    sv = F.element_at(s, C("grp"))
    return grouped.groupBy("run").agg(F.sum(F.exp(-sv) * C("l") + sv).alias("total"))
