"""Merkle manifest of a dataset: a hash tree for each language and one over them, with proofs and tampered versions.

The tree is cut into aligned blocks of 2 ** bits leaves. A block's nodes are built in one task; its top is a leaf of the
next stretch, cut into blocks again, until one node is left. Versions are persistent: a version with another leaf copies
the ancestors of that leaf only and shares every other node with the tree it came from, first inside its block, then
along the block's path through the upper stretches, which the block is given as the siblings on that path.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameledger.llm.samples import remainder
from frameledger.llm.text_classes import stored

SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_NODES = "g string, place bigint, total bigint, node string"
_PATHS = "g string, place bigint, path array<string>, top string"


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the joined parts."""
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The nodes over an aligned run of nodes, level by level, as far as the whole tree has several nodes on a level.

    `first` is the place of the first node on its level of the whole tree, `total` that level's number of nodes.
    """

    def __init__(self, nodes: list[str], total: int, bits: int):
        self.levels = [nodes]
        while len(self.levels) <= bits and -(-total >> (len(self.levels) - 1)) > 1:
            low = self.levels[-1]
            self.levels.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[str]:
        """What stands beside node `i` and its ancestors: L or R and the node, or nothing where a node is alone."""
        out = []
        for low in self.levels[:-1]:
            j = i ^ 1
            out.append(("L" if j < i else "R") + low[j] if j < len(low) else "")
            i >>= 1
        return out

    def version(self, i: int, node: str) -> list[str]:
        """The nodes that differ from this tree's if node `i` is another: that node and its ancestors. All others are shared."""
        return copied(node, self.siblings(i))


def copied(node: str, path: list[str]) -> list[str]:
    """A node and its ancestors along a path of siblings."""
    out = [node]
    for s in path:
        out.append(digest(s[1:], out[-1]) if s[:1] == "L" else digest(out[-1], s[1:]))
    return out


def _ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Adds `place`, the rank in `g`, and `total`, the rows of `g`. One range sort; then only counts by partition move."""
    placed = stored(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))          # sorted: as many rows as partitions and groups
    by = Window.partitionBy("g")
    sizes = sizes.select("g", "part", (F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(by).alias("total"))
    return placed.join(sizes, ["g", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _tops(nodes: DataFrame, bits: int) -> DataFrame:
    """The top node of every block, as nodes of the next stretch."""
    def build(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        total = table.column("total")[0].as_py()
        block = Block(table.column("node").to_pylist(), total, bits)
        return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.string()), "place": pa.array([table.column("place")[0].as_py() >> bits], pa.int64()),
                         "total": pa.array([-(-total >> bits)], pa.int64()), "node": pa.array([block.top], pa.string())})

    return stored(nodes.select("g", "place", "total", "node").groupBy("g", F.shiftright("place", bits)).applyInArrow(build, _NODES), "nodes")


def _paths(nodes: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """The path of every node to the root, from the paths of the blocks' tops; `top` is handed down."""
    def extend(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _sorted(table)
        block = Block(table.column("node").to_pylist(), table.column("total")[0].as_py(), bits)
        rest, n = above.column("path")[0].as_py(), table.num_rows
        return pa.table({"g": table.column("g"), "place": table.column("place"), "path": pa.array([block.siblings(i) + rest for i in range(n)], pa.list_(pa.string())), "top": pa.array([above.column("top")[0].as_py()] * n, pa.string())})

    return nodes.groupBy("g", F.shiftright("place", bits)).cogroup(upper.groupBy("g", "place")).applyInArrow(extend, _PATHS)


def _stretches(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Stretch by stretch the nodes up to one for each `g`; the last is that one. `nodes` itself is the first."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(_tops(out[-1], bits))
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Hash of a row: of each value its bytes and a colon before it, `-` for null."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def manifest(docs: DataFrame, tamper: Callable[[], Column] | None = None, bits: int = 12) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A document's leaf covers doc_id, source, lang, n_chars and text. The leaves of a language, by doc_id, are one tree
    whose top is its subroot; the subroots by language (null first, bytewise) are the leaves of the tree of the root.
    proof_sha256 covers the siblings along a leaf's way to the root. Where `tamper` holds (by default: 7 divides the
    crc32 of the decimal doc_id) and n_chars is known, a version of the tree has the leaf of a row with n_chars one more,
    and folded_root is that version's root; else the root that the leaf's own proof gives. verified: it is the root.

    Null and equal ids: null first, then by leaf; rows that are equal in all have equal leaves, one after the other.
    Null values are `-` in a leaf, empty texts `0:`. Very long texts are hashed where they are read; only leaves move.
    An empty table gives no rows. Further columns neither count nor are carried.
    """
    spoilt = tamper() if tamper else remainder("doc_id", 7) == 0
    source, lang, text = (F.col(c).cast("string") for c in ("source", "lang", "text"))
    doc_id, n_chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    more = (n_chars.cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("g"), doc_id.alias("doc_id"), leaf([doc_id, source, lang, n_chars, text]).alias("node"),
                       F.when(spoilt & n_chars.isNotNull(), leaf([doc_id, source, lang, more, text])).alias("other"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("node").asc(), F.col("other").asc_nulls_first()]
    leaves = _ranked(stored(rows, "leaves"), order, "ranked")
    blocks = _tops(leaves, bits)
    below = _stretches(blocks, bits)
    roots = below[-1].select(F.lit("").alias("g"), F.col("g").alias("lang"), "node")
    subroots = _ranked(roots, [F.col("lang").asc()], "subroots")
    above = _stretches(subroots, bits)
    root = above[-1].select("node").first()
    root = root[0] if root else None

    # From the root down: each node's path is that of its block's top, with the siblings inside the block before it.
    paths = above[-1].select("g", "place", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("top"))
    for nodes in above[-2::-1]:
        paths = _paths(nodes, paths, bits)
    paths = subroots.join(paths.select("place", "path"), "place").select(F.col("lang").alias("g"), F.lit(0).cast("bigint").alias("place"), "path", F.col("node").alias("top"))
    for nodes in below[-2::-1]:
        paths = _paths(nodes, paths, bits)

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _sorted(table)
        mine, other = table.column("node").to_pylist(), table.column("other").to_pylist()
        block, upper = Block(mine, table.column("total")[0].as_py(), bits), above.column("path")[0].as_py()
        rest, proofs, folded = "".join(s[1:] for s in upper), [], []
        for i, (a, b) in enumerate(zip(mine, other)):
            beside = block.siblings(i)
            proofs.append(digest("".join(s[1:] for s in beside), rest))
            folded.append(copied(block.version(i, b or a)[-1], upper)[-1])
        n = len(mine)
        return pa.table({"doc_id": table.column("doc_id"), "leaf": table.column("node"), "subroot": pa.array([above.column("top")[0].as_py()] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    return leaves.groupBy("g", F.shiftright("place", bits)).cogroup(paths.groupBy("g", "place")).applyInArrow(prove, SCHEMA)
