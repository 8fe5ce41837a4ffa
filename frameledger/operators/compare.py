"""Comparing runs. `runs` holds one row per run and split, so these tables are small by nature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import HEAD_METRICS

C = F.col


def comparison_table(parts: list[DataFrame], first: list[str]) -> DataFrame:
    """One table over runs of different shapes: fixed columns first, the others sorted."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.select(*first, *sorted(c for c in both.columns if c not in first))


def suppress_absent(runs: DataFrame, heads: str = "heads") -> DataFrame:
    """Metrics that a run has no head for become NULL (a run without a head list has them all)."""
    out = runs
    for head, names in HEAD_METRICS.items():
        for m in names:
            if m in runs.columns:
                out = out.withColumn(m, F.when(C(heads).isNull() | F.array_contains(heads, head), C(m)))
    return out


def run_families(runs: DataFrame, patterns: list[tuple[str, str, str]], split: str, run: str = "run") -> DataFrame:
    """Runs of one split matched to (title, pattern, base run) on the name without its suffix."""
    rows = runs.filter(F.endswith(C(run), F.lit("_" + split))).withColumn("name", F.regexp_replace(run, f"_{split}$", ""))
    hits = F.array_compact(F.array(*[F.when(F.regexp_like("name", F.lit(p)), F.struct(F.lit(t).alias("family"), F.lit(b).alias("base")))
                                     for t, p, b in patterns]))
    return rows.withColumn("_h", F.explode(hits)).select("_h.family", "_h.base", *rows.columns)


def headline_split(runs: DataFrame, wanted: Column) -> DataFrame:
    """The wanted rows, or all rows when there are none."""
    any_wanted = F.max(F.when(wanted, 1).otherwise(0)).over(W.partitionBy())
    return runs.withColumn("_any", any_wanted).filter(wanted | (C("_any") == 0)).drop("_any")


def base_deltas(families: DataFrame, runs: DataFrame, metrics: list[str], split: str) -> DataFrame:
    """Value minus the base run of its family; the value itself where the base has none."""
    base = runs.filter(C("split") == split).select(C("fam").alias("base"), *[C(m).alias(f"_b_{m}") for m in metrics])
    j = families.join(base, "base", "left")
    return j.withColumns({m: F.coalesce(C(m) - C(f"_b_{m}"), C(m)) for m in metrics}).drop(*[f"_b_{m}" for m in metrics])


def required_baseline(runs: DataFrame, baseline: str, metric: str, label: str = "run") -> DataFrame:
    """Delta against one required run; a missing baseline fails the job."""
    base = F.max(F.when(C(label) == baseline, C(metric))).over(W.partitionBy())
    checked = F.when(C("_base").isNull(), F.raise_error(F.lit(f"baseline {baseline} is missing")).cast("double")).otherwise(C("_base"))
    return runs.withColumn("_base", base).withColumn("delta", C(metric) - checked).drop("_base")


def fixed(v: Column, digits: int = 3) -> Column:
    """Fixed-decimal cell, '--' when missing."""
    return F.when(v.isNull(), F.lit("--")).otherwise(F.format_string(f"%.{digits}f", v))


def interval_cell(v: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    f = f"%.{digits}f"
    return F.when(v.isNull(), F.lit("--")).when(lo.isNull(), F.format_string(f, v)).otherwise(F.format_string(f"{f} [{f},{f}]", v, lo, hi))


def gain_cell(delta: Column, digits: int = 3) -> Column:
    """Signed change with an arrow; no sign when it rounds to zero."""
    r = F.round(delta, digits)
    return (F.when(delta.isNull(), F.lit("--")).when(r == 0, F.format_string(f"%.{digits}f", F.lit(0.0)))
            .otherwise(F.concat(F.format_string(f"%+.{digits}f", delta), F.when(r > 0, " up").otherwise(" down"))))


def skeleton_table(skeleton: DataFrame, runs: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Ordered report rows; a run that does not exist gives dashes."""
    return skeleton.join(runs, "run", "left").select(*skeleton.columns, *[c.alias(n) for n, c in cells.items()])


def unpivot(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return runs.unpivot(keys, metrics, "metric", "value")


def two_run_gain(runs: DataFrame, a: str, b: str, metrics: list[str], digits: int = 3) -> DataFrame:
    """Per metric: both values, b - a and its direction at the printed precision."""
    long = unpivot(runs.filter(C("run").isin(a, b)), ["run"], metrics)
    g = long.groupBy("metric").agg(F.max(F.when(C("run") == a, C("value"))).alias("a"), F.max(F.when(C("run") == b, C("value"))).alias("b"))
    d = C("b") - C("a")
    return g.select("metric", "a", "b", d.alias("delta"), F.signum(F.round(d, digits)).cast("int").alias("direction"))


def prioritised(runs: DataFrame, wanted: list[tuple[str, int, str]]) -> DataFrame:
    """First existing run of each (label, priority, run) list, labels without any run dropped."""
    spark = runs.sparkSession
    want = spark.createDataFrame(wanted, "label string, priority int, run string")
    j = want.join(runs, "run")
    best = j.groupBy("label").agg(F.min("priority").alias("priority"))
    return j.join(best, ["label", "priority"], "left_semi")


def named_numbers(runs: DataFrame, run_alias: DataFrame, metric_alias: DataFrame, metrics: list[str]) -> DataFrame:
    """(name, value) for every alias pair that exists."""
    long = unpivot(runs, ["run"], metrics).filter(C("value").isNotNull())
    return (long.join(run_alias, "run").join(metric_alias, "metric")
            .select(F.concat("run_alias", "metric_alias").alias("name"), "value"))


def extremes(runs: DataFrame, metric: str, max_rows: int, keep: list[str], label: str = "run") -> DataFrame:
    """Both ends of an over-long table plus runs always kept, one row per label."""
    kept = C(label).isin(*keep)
    w = W.partitionBy()
    r = runs.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.count_if(kept).over(w),
                          "_lo": F.row_number().over(w.orderBy(metric, label)), "_hi": F.row_number().over(w.orderBy(F.desc(metric), F.desc(label)))})
    ends = F.greatest(F.lit(1), F.floor((F.lit(max_rows) - C("_k")) / 2))
    use = (C("_n") <= max_rows) | kept | (C("_lo") <= ends) | (C("_hi") <= ends)
    return r.filter(use).drop("_n", "_k", "_lo", "_hi").dropDuplicates([label])


def strip_common_suffix(runs: DataFrame, suffixes: list[str], label: str = "run") -> DataFrame:
    """Remove the first suffix that every label carries."""
    w = W.partitionBy()
    out = C(label)
    for s in reversed(suffixes):
        every = F.bool_and(F.endswith(C(label), F.lit(s))).over(w)
        out = F.when(every, F.regexp_replace(label, s + "$", "")).otherwise(out)
    return runs.withColumn("short", out)


def error_arms(runs: DataFrame, v: str, lo: str, hi: str) -> DataFrame:
    """Interval arms clamped at zero (missing is zero), and whether either was clamped."""
    below, above = [F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) for x in (C(v) - C(lo), C(hi) - C(v))]
    zero = F.lit(0.0)
    return runs.withColumns({"below": F.greatest(below, zero), "above": F.greatest(above, zero),
                             "clamped": (below < 0).cast("int") + (above < 0).cast("int")})


def selection_score(runs: DataFrame, which: str = "combined") -> DataFrame:
    """Score a run is chosen by. An unknown name is an error rather than a silent zero."""
    if which == "combined":
        parts = [C(m) for m in ("cls_macro_f1", "seg_iou_hand", "det_acc50")]
        return runs.withColumn("score", sum(F.coalesce(p, F.lit(0.0)) for p in parts) / 3.0)
    if which not in runs.columns:
        raise ValueError(f"unknown selection metric {which!r}; known: combined, {', '.join(sorted(runs.columns))}")
    return runs.withColumn("score", C(which))
