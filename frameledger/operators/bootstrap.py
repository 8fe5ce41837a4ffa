"""Percentile bootstrap over clips for frame-weighted means.

The statistic is a ratio of sums, so a clip is reduced to (sum, count) per metric first. Two ways to draw:
`clip_intervals` gives every clip a Poisson weight in every draw, from a hash of the clip and the number of the draw;
weights are applied and added up inside each partition, so the shuffle carries partitions x draws rows and nothing is
joined. The number of clips in a draw then varies about their number, which cancels in a ratio of sums; any SQL engine
can repeat the draws. `split_intervals` draws exactly as many clips as there are, as a two-level multinomial split.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameledger.sources.durable import cut_lineage

C = F.col
_BUCKETS, _BUCKET_CLIPS = 1024, 4096
PRIME = (1 << 31) - 1


def poisson_steps() -> list[int]:
    """Least hash value (of PRIME) with weight 1, 2, ...: the distribution function of the Poisson law of mean 1, in whole steps."""
    inverse_e = sum(Fraction((-1) ** k, _factorial(k)) for k in range(30))
    out, total, k = [], Fraction(0), 0
    while True:
        total += inverse_e / _factorial(k)
        step = -int(-total * PRIME // 1)
        if step >= PRIME:
            return out
        out.append(step)
        k += 1


def _factorial(k: int) -> int:
    return 1 if k < 2 else k * _factorial(k - 1)


def clip_sums(records: DataFrame, clip: str, metrics: dict) -> DataFrame:
    """One row per clip: s_<m>, n_<m> for each metric column (NULLs do not count)."""
    return records.groupBy(clip).agg(*[
        a for name, col in metrics.items()
        for a in (F.coalesce(F.sum(col), F.lit(0.0)).alias(f"s_{name}"), F.count(col).alias(f"n_{name}"))])


def _summary(per_draw: DataFrame, sums: DataFrame, metrics: list[str], alpha: float) -> DataFrame:
    """Long (metric, mean, lo, hi, n_clips): intervals from the draws, points from the data."""
    def mean(m):
        return F.coalesce(C(f"s_{m}") / F.when(C(f"n_{m}") > 0, C(f"n_{m}")), F.lit(0.0))

    draws = per_draw.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), mean(m).alias("v")) for m in metrics])).alias("u")).select("u.*")
    # The buffer of percentile() holds one value per draw.
    ci = draws.groupBy("metric").agg(F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    totals = sums.groupBy().agg(*[F.sum(c).alias(c) for m in metrics for c in (f"s_{m}", f"n_{m}")],
                                *[F.sum(F.when(C(f"n_{m}") > 0, 1).otherwise(0)).alias(f"k_{m}") for m in metrics])
    points = totals.select(F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), mean(m).alias("mean"),
        F.coalesce(C(f"k_{m}"), F.lit(0)).cast("long").alias("n_clips")) for m in metrics])).alias("u")).select("u.*")
    zero = F.lit(0.0)
    return points.join(ci, "metric", "left").select(
        "metric", "mean", F.coalesce(F.element_at("q", 1), zero).alias("lo"),
        F.coalesce(F.element_at("q", 2), zero).alias("hi"), "n_clips")


def clip_intervals(records: DataFrame, clip: str, metrics: dict, n_boot: int = 1000, seed: int = 0,
                   alpha: float = 0.05) -> DataFrame:
    """All metrics from the same draws, each over the clips that have it: (metric, mean, lo, hi, n_clips).

    A clip weighs in with its own weight in each draw whatever the others do, so clips without a value of a metric (say
    on frames without annotation) do not touch that metric's interval, and are not counted for it.
    """
    sums = cut_lineage(clip_sums(records, clip, metrics))      # the only pass over the records
    cols = [f"{p}_{m}" for m in metrics for p in ("s", "n")]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), C(clip).cast("string")))
    keyed = sums.select(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_c{k}") for k in range(4)], *[C(c).cast("double") for c in cols])
    steps = np.array(poisson_steps())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, draw = np.zeros((n_boot, len(cols))), np.arange(1, n_boot + 1)[:, None]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                values = np.stack([part.column(c).to_numpy() for c in cols], 1)
                # A cubic in the number of the draw, its four coefficients from the clip: weights of any four draws are independent.
                h = np.zeros((n_boot, part.num_rows), np.int64)
                for k in range(4):
                    h = (h * draw + part.column(f"_c{k}").to_numpy() % PRIME) % PRIME
                total += np.searchsorted(steps, h, "right") @ values
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), *map(pa.array, total.T.copy())], names=["draw", *cols])

    per_draw = keyed.mapInArrow(add_up, "draw long, " + ", ".join(f"{c} double" for c in cols)).groupBy("draw").agg(*[F.sum(c).alias(c) for c in cols])
    return _summary(per_draw, sums, list(metrics), alpha)


def split_intervals(records: DataFrame, clip: str, metrics: dict, n_boot: int = 1000, seed: int = 0,
                    alpha: float = 0.05, buckets: int | None = None) -> DataFrame:
    """The same with exactly as many clips in each draw as there are.

    A multinomial over clips equals a multinomial over buckets of clips followed by independent
    ones inside each bucket. Each bucket is one task's group (clips / buckets rows); it emits n_boot
    partial sums, so the shuffle carries clips once plus buckets x n_boot rows. Their number follows
    that of the clips: one for each 4,096, 1,024 at most.
    """
    sums = cut_lineage(clip_sums(records, clip, metrics))      # the only pass over the records
    cols = [f"{p}_{m}" for m in metrics for p in ("s", "n")]
    buckets = buckets or min(_BUCKETS, sums.count() // _BUCKET_CLIPS + 1)
    tagged = sums.withColumn("bucket", F.pmod(F.xxhash64(clip), F.lit(buckets)).cast("int"))
    # At most `buckets` rows reach the driver, whatever the data size.
    sizes = sorted((r["bucket"], r["m"]) for r in tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).collect())
    share = np.array([m for _, m in sizes], dtype=float)
    place = {b: i for i, (b, _) in enumerate(sizes)}

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, members = int(pdf["bucket"].iloc[0]), pdf[cols].to_numpy(float)
        top = np.random.default_rng([seed, 7]).multinomial(int(share.sum()), share / share.sum(), size=n_boot)
        inner = np.random.default_rng([seed, 11, bucket])
        even = np.full(len(members), 1.0 / len(members))
        out = np.array([inner.multinomial(k, even) @ members for k in top[:, place[bucket]]])
        return pd.DataFrame(out, columns=cols).assign(draw=np.arange(n_boot))

    schema = ", ".join(f"{c} double" for c in cols) + ", draw long"
    per_draw = (tagged.groupBy("bucket").applyInPandas(lambda p: draw(p.sort_values(clip)), schema)
                .groupBy("draw").agg(*[F.sum(c).alias(c) for c in cols]))
    return _summary(per_draw, sums, list(metrics), alpha)
