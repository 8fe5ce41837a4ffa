"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.sources.durable import cut_lineage

WIDTH = 5

_SHINGLES = "if(size(w) < 5, array(), transform(sequence(1, size(w) - 4), i -> xxhash64(w[i - 1], w[i], w[i + 1], w[i + 2], w[i + 3])))"
_SIMHASH = """aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
    2 * aggregate(h, 0, (ones, x) -> ones + cast(shiftright(x, b) & 1 AS int)) > size(h), shiftleft(1L, b), 0L))"""
_COMMON = "aggregate(array_distinct(h), 0, (n, x) -> n + least(size(filter(h, y -> y = x)), size(filter(item_h, y -> y = x))))"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = 20, broadcast_rows: int = 200_000,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): documents that hold a passage similar to an item.

    A window has as many words as an item and stands where one of the item's five-word shingles would fall into place,
    so every passage that shares a shingle with an item is covered. Windows of equal words are looked at once. A window's
    SimHash is compared with those of all items of its length by radius + 1 blocks of bits: two fingerprints
    within the radius agree in a block at least. What is within the radius is checked by the weighted Jaccard
    similarity of shingles (weights: occurrences). At a similarity of 0.8 fingerprints differ in 10 bits on average; 20 is
    more than three standard deviations above. One row per document and item, of the most similar window.

    Items of fewer than five words have no shingle and are not searched. Null texts have no words. A null id is a value
    of its own; repeated documents give a row each. Empty tables give no rows. Further columns are not read. Item
    shingles are broadcast up to `broadcast_rows` rows (counted first), else the join shuffles.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    goal = cut_lineage(items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col).cast("string")).alias("w")).where(f"size(w) >= {WIDTH}").select(
        "item_id", F.size("w").alias("m"), F.expr(_SHINGLES).alias("item_h")))
    seeds = goal.select("m", F.posexplode("item_h").alias("q", "x")).distinct()
    if seeds.limit(broadcast_rows + 1).count() <= broadcast_rows:
        seeds = F.broadcast(seeds)
    key = F.xxhash64("doc_id", "text").alias("key")
    hashed = texts.select(key, words(F.col("text")).alias("w")).select("key", F.size("w").alias("n"), F.expr(_SHINGLES).alias("h"))
    # The outer form: with the inner one Spark filters on the array first, and so computes it (and the words in it) again.
    spread = hashed.select("key", "n", F.posexplode_outer("h").alias("p", "x"))
    first = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m")))
    places = spread.join(seeds, "x").select("key", "m", first.alias("start")).distinct()
    windows = cut_lineage(texts.select("doc_id", "text", key).join(places, "key").select("doc_id", "key", "m", "start", F.slice(words(F.col("text")), F.col("start") + 1, F.col("m")).alias("w"))
               .select("doc_id", "key", "m", "start", F.size("w").alias("n_words"), F.xxhash64("w").alias("content"), "w"))
    # Read three times below, and few next to the documents: written once.
    distinct = windows.groupBy("m", "content").agg(F.first("w").alias("w")).select("m", "content", F.expr(_SHINGLES).alias("h"))
    prints = cut_lineage(distinct.select("m", "content", "h", F.expr(_SIMHASH).alias("fp")))
    item_prints = goal.withColumnRenamed("item_h", "h").select("item_id", "m", "h", F.expr(_SIMHASH).alias("item_fp"))
    item_prints = cut_lineage(item_prints)
    near = prints.select("m", "content", "fp", _blocks("fp", radius)).join(item_prints.select("item_id", "m", "item_fp", _blocks("item_fp", radius)), ["m", "block", "bits"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    found = near.select("m", "content", "item_id", distance.alias("distance")).where(f"distance <= {radius}").distinct()
    both = found.join(prints.select("m", "content", "h"), ["m", "content"]).join(item_prints.selectExpr("item_id as i", "m as im", "h as item_h"), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("m") == F.col("im")))
    checked = both.withColumn("common", F.expr(_COMMON)).select("m", "content", "item_id", "distance", (F.col("common") / (F.size("h") + F.size("item_h") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= similarity)
    hits = windows.drop("w").join(checked, ["m", "content"])
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    return hits.groupBy("key", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _blocks(fp: str, radius: int) -> Column:
    """Explodes a fingerprint to (block, bits), radius + 1 blocks of near-equal width."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.inline(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]))
