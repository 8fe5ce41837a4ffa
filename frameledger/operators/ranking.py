"""Row numbers that never put a whole group, or a whole table, into one task.

A plain row_number over a hot group is a single-task sort. Here rows are first range-sorted over the cluster, or cut into
ordered buckets; counts of the parts give offsets, and only one part at a time is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.sources.durable import cut_lineage

C = F.col
_BUCKET_DIGITS = 4              # 16**4 = 65536 hash buckets


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column, order_by: list,
                        out: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based row number per key. `bucket` must be non-decreasing in `order_by`."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_key = W.partitionBy(*keys) if keys else W.partitionBy()
    before = per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(per_key).alias(total)] if total else []))
    local = rows.withColumn(
        "_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order_by)))
    return (local.join(offsets, [*keys, "_bucket"])
            .withColumn(out, F.col("_offset") + F.col("_local"))
            .drop("_bucket", "_offset", "_local"))


def hashed_row_number(df: DataFrame, digest: Column, ties: list, out: str = "rn", total: str | None = None) -> DataFrame:
    """Row number of the whole table in digest order (a seeded shuffle), in 65536 buckets."""
    rows = df.withColumn("_digest", digest)
    bucket = F.conv(F.substring("_digest", 1, _BUCKET_DIGITS), 16, 10).cast("int")
    return bucketed_row_number(rows, [], bucket, ["_digest", *ties], out, total).drop("_digest")


def _placed(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """Rows range-sorted over the cluster by bounds from a sample; `_at` is a row's place (partition and position), written once."""
    by = [*keys, *order_by]
    return cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def _offsets(placed: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(_k, _p, _low, _offset, _total) for each key and partition: a row for each partition a key reaches into."""
    w = W.partitionBy(*keys) if keys else W.partitionBy()
    parts = placed.groupBy(*keys, "_part").agg(size.alias("_n"), F.min("_at").alias("_low"))
    return parts.select(F.struct(*keys, F.lit(0).alias("_")).alias("_k"), C("_part").alias("_p"), "_low", F.sum("_n").over(w).alias("_total"),
                        F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))


def _with_offsets(placed: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    same = F.struct(*keys, F.lit(0).alias("_")).eqNullSafe(C("_k"))
    return placed.join(offsets, (C("_part") == C("_p")) & same).drop("_k", "_p")


def sorted_row_number(df: DataFrame, keys: list[str], order_by: list, out: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based row number per key in the given order, which should have few ties.

    One range sort; then only the rows per key and partition are counted. Task sizes follow the sample's bounds, so
    neither a hot key nor outlying values make a large task. Null keys are a key.
    """
    placed = _placed(df, keys, order_by)
    numbered = _with_offsets(placed, _offsets(placed, keys, F.count(F.lit(1))), keys).withColumn(out, C("_offset") + C("_at") - C("_low") + 1)
    return (numbered.withColumn(total, C("_total")) if total else numbered).drop("_at", "_part", "_low", "_offset", "_total")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, a column for each name in `shares`; nulls and NaNs do not count.

    Equal values are counted first; the distinct ones are range-sorted, and running counts find the two values about each
    quantile. No buffer grows with a key: every step holds a partition, and two values for each quantile.
    """
    counted = df.where(C(value).isNotNull() & ~F.isnan(C(value).cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = _placed(counted, keys, [value])
    offsets = _offsets(placed, keys, F.sum("_c"))
    local = placed.withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)))
    upto = _with_offsets(local, offsets, keys).withColumn("_upto", C("_upto") + C("_offset"))

    def at(share: float) -> Column:
        return (C("_total") - 1) * F.lit(float(share))

    def has(rank: Column) -> Column:
        return (rank >= C("_upto") - C("_c")) & (rank < C("_upto"))

    cells = {f"_{side}{i}": F.max(F.when(has(edge(at(share))), C(value).cast("double"))) for i, share in enumerate(shares.values()) for side, edge in (("l", F.floor), ("h", F.ceil))}
    near = reduce(lambda a, b: a | b, [has(edge(at(share))) for share in shares.values() for edge in (F.floor, F.ceil)])
    found = upto.where(near).groupBy(*keys).agg(*[v.alias(k) for k, v in cells.items()], F.max("_total").alias("_total"))
    return found.select(*keys, *[(C(f"_l{i}") + (C(f"_h{i}") - C(f"_l{i}")) * (at(share) - F.floor(at(share)))).alias(name) for i, (name, share) in enumerate(shares.items())])


def bounded_parts(df: DataFrame, keys: list[str], item: str, size: int, out: str = "part") -> DataFrame:
    """Hash part per row so that (keys, part) holds about `size` rows, however hot a key is."""
    if not keys:
        parts = max(1, -(-df.count() // size))
        return df.withColumn(out, F.pmod(F.xxhash64(item), F.lit(parts)).cast("int"))
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    return (df.join(n, keys)
            .withColumn(out, F.pmod(F.xxhash64(item), C("_parts")).cast("int")).drop("_parts"))


def best_per_group(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """First row per key in the given order, as a min aggregate (combines before the shuffle)."""
    pick = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *keep)).alias("_pick")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_pick.{k}") for k in keep])
