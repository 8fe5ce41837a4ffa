"""Near-duplicate groups by SimHash, linked by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import slices, texts
from frameledger.llm.graph import components
from frameledger.sources.durable import cut_lineage


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        hashes = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        hashes = np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, n)
    # Rows of 64 bits, summed in blocks of 255 so that the sums fit a byte.
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(bits)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint(t) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def correlated_parts(both: np.ndarray, total: float, m: int) -> list[list[int]]:
    """The 64 bits in m parts of near-equal size: each part grows by the bit most correlated with its bits.

    both[i][j]: fingerprints in which bits i and j are one. Bits that move together in one part leave the other
    parts closer to independent, so that fewer of them agree by chance alone.
    """
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    rho = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    free, parts = list(range(64)), []
    for k in range(m):
        size = (64 * (k + 1)) // m - (64 * k) // m
        part = [max(free, key=lambda b: (rho[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (rho[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def _probes(bits: int, t: int) -> int:
    return {-1: 0, 0: 1, 1: 1 + bits, 2: 1 + bits + bits * (bits - 1) // 2}[t]


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, one per part, that sum to the budget at the least cost, by dynamic programming.

    costs[i][t]: cost of part i at threshold t; -1 leaves a part out.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in part.items():
                if used + t not in new or cost + c < new[used + t][0]:
                    new[used + t] = (cost + c, [*chosen, t])
        best = new
    return best[budget]


def plan(prints: DataFrame, radius: int, pair_cost: float = 0.05) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every part that is probed, for a table of distinct fingerprints (fp).

    Counted over all rows: pairs of set bits, for the correlations, and the fingerprints that share each part's
    value. Pairs that differ by one or two bits in a part are estimated from those and the share of ones of each
    bit. By the general principle, fingerprints within `radius` are within the threshold in at least one of m
    parts if the thresholds sum to radius - m + 1. Tried with 2 to radius + 1 parts; the least expected work wins:
    probes plus `pair_cost` for each candidate.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = (fp[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel().astype(np.int64))], names=["cell", "n"])

    cells = prints.select("fp").mapInArrow(pairs, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in cells:
        both[r["cell"]] = r["n"]
    total = prints.count()
    both = both.reshape(64, 64)
    p = np.diag(both) / max(total, 1)
    flip = 2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9)      # odds of a differing bit to an equal one
    tried = {m: correlated_parts(both, total, m) for m in range(2, radius + 2)}
    keys = F.explode(F.array(*[F.struct(F.lit(m * 64 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("key"))
                               for m, parts in tried.items() for i, bits in enumerate(parts)]))
    same = {r["part"]: r["pairs"] for r in prints.select(keys.alias("k")).groupBy("k").count()
            .groupBy("k.part").agg(F.sum(F.col("count") * F.col("count").cast("double")).alias("pairs")).collect()}
    choices = []
    for m, parts in tried.items():
        costs = []
        for i, bits in enumerate(parts):
            s0 = same.get(m * 64 + i, 0.0)
            f = flip[bits]
            near = {0: s0, 1: s0 * (1 + f.sum()), 2: s0 * (1 + f.sum() + (f.sum() ** 2 - (f * f).sum()) / 2)}
            costs.append({-1: 0.0, **{t: total * _probes(len(bits), t) + pair_cost * near[t] for t in near}})
        cost, chosen = allocate(costs, radius - m + 1)
        choices.append((cost, m, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0]))
    return min(choices)[2]


def _flips(bits: list[int], t: int) -> list[int]:
    """The masks of up to t of the bits."""
    return [_signed(sum(1 << b for b in some)) for k in range(t + 1) for some in combinations(bits, k)]


def _keys(parts: list[tuple[list[int], int]], probe: bool) -> Column:
    def of(i: int, bits: list[int], t: int) -> Column:
        key = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        masks = _flips(bits, t if probe else 0)
        return F.transform(F.array(*map(F.lit, masks)), lambda x: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(x).alias("key")))

    return F.explode(reduce(F.concat, [of(i, bits, t) for i, (bits, t) in enumerate(parts)]))


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) by which all distinct fingerprints (fp) within two bits of each other hang together.

    Two such fingerprints share a value that each reaches by one flip at most. All that reach a value are linked to
    the smallest of them, so a dense group of n near copies costs 65 n rows, not n squared.
    """
    reach = prints.select("fp", F.explode(F.array(*map(F.lit, _flips(list(range(64)), 1)))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    first = reach.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("at", "b")
    return reach.join(first, "at").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def fingerprint_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root): the connected components of distinct fingerprints linked at `radius` or fewer differing bits.

    First the groups hanging together by two bits are merged (`near_links`). Then every fingerprint probes the
    parts that `plan` chose. Pairs of one merged group need no further link: in each bucket, its largest group
    meets the others only, so the work in a bucket does not grow with the square of a dense group. Fingerprints
    without a link are not returned.
    """
    if radius < 2:
        raise ValueError("radius must be 2 or more")
    near = components(near_links(prints))
    sized = cut_lineage(near.join(near.groupBy("root").agg(F.count("*").alias("size")), "root").selectExpr("node", "root", "size"))
    every = prints.join(sized, prints.fp == sized.node, "left").select("fp", F.coalesce("root", "fp").alias("grp"), F.coalesce("size", F.lit(1)).alias("size"))
    every = cut_lineage(every)
    parts = plan(prints, radius)
    held = every.select("fp", "grp", "size", _keys(parts, False).alias("k")).select("fp", "grp", "size", "k.part", "k.key")
    asked = every.select("fp", "grp", _keys(parts, True).alias("k")).select(F.col("fp").alias("fp2"), F.col("grp").alias("grp2"), "k.part", "k.key")
    top = held.groupBy("part", "key").agg(F.max(F.struct("size", "grp"))["grp"].alias("top"))
    held = held.join(top, ["part", "key"])
    asked = asked.join(top, ["part", "key"])
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    outside = asked.where("grp2 <> top").drop("top").join(held.drop("top"), ["part", "key"]).where(close & (F.col("grp") != F.col("grp2")))
    inside = asked.where("grp2 = top").drop("top").join(held.where("grp <> top").drop("top"), ["part", "key"]).where(close & (F.col("grp") != F.col("grp2")))
    far = outside.unionAll(inside).select(F.greatest("grp", "grp2").alias("a"), F.least("grp", "grp2").alias("b")).distinct()
    joined = components(far)
    grouped = every.join(joined, every.grp == joined.node, "left").select("fp", F.coalesce("root", "grp").alias("root"))
    return grouped


def group_near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part in links but
    never name a component; a component of null ids only has a null component_id. Repeated rows are kept. An empty
    table gives no rows. Further columns are not carried.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = fingerprint_groups(cut_lineage(prints.select("fp")), radius)
    named = groups.join(prints, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    names = groups.join(named, "root").select("fp", "component_id")
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all of a row's values; maps, which have no hash, are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()])


def representatives(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stand for their near-duplicate groups, one of each group, with all columns.

    It is the one of the smallest id (null last), then of the smallest hash of its values; of rows that are equal in all
    values one stays. Rows that share an id, or have none, are rows of their own: what counts is the text. Null and empty
    texts are one group with what links to them; texts of any length count whole. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array([fingerprint(t) for t in texts(part.column("text"))], pa.int64())], names=["id", "h", "fp"])

    light = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), row_hash(docs).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = cut_lineage(light.mapInArrow(run, "id bigint, h bigint, fp bigint"))
    first = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "h")).alias("first")
    prints = cut_lineage(rows.groupBy("fp").agg(first))
    chosen = prints.join(fingerprint_groups(prints.select("fp"), radius), "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    # All columns of docs go along in one, so that none can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").cast("bigint").alias("i"), row_hash(docs).alias("row"))
    kept = whole.join(chosen, (F.col("row") == F.col("h")) & F.col("i").eqNullSafe(F.col("id")), "left_semi")
    if not rows.groupBy("id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["row", "i"])
    return kept.select("doc.*")
