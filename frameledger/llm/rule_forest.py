"""Quality rules with an isolation forest over their statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import Words, mixed, shingles, slices, texts
from frameledger.llm.text_classes import stored

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _per_row(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[at[1:]] - total[at[:-1]]


def _repeated(w: Words) -> np.ndarray:
    """Of each text, the words that lie in a 5-word window found twice or more in it."""
    h = shingles(w.hashes(), WINDOW)
    inside = w.row[: len(h)] == w.row[WINDOW - 1 :] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = h[at] ^ mixed(w.row[at].astype(np.uint64) + np.uint64(1))
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[which] > 1]
    edge = np.zeros(len(w.row) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return _per_row(np.cumsum(edge)[:-1] > 0, w.first)


def _repeat_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.split())
        else:
            seen.add(line)
    return n


def statistics(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rule counts of each text, in the order of BASE, and the features of the forest: ratios that no base rule bounds
    (word length, symbols per word, shares of capitals and of ASCII marks)."""
    w = Words(array, lower=False)
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.starts] += 1
    edge[w.ends] -= 1
    solid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    n = np.diff(w.first)
    base = np.stack([n, _per_row(solid & ((w.data & 0xC0) != 0x80), w.at), _per_row(_SYMBOL[w.data], w.at),
                     np.array([_repeat_lines(t) for t in texts(array)], np.int64), _repeated(w)], 1).astype(np.int64)
    chars, words = np.maximum(base[:, 1], 1), np.maximum(n, 1)
    x = np.stack([base[:, 1] / words, base[:, 2] / words, _per_row(_UPPER[w.data], w.at) / chars, _per_row(_MARK[w.data], w.at) / chars], 1)
    return base, x


def base_failed(base: np.ndarray, least_words: int, most_repeat: int) -> np.ndarray:
    return (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeat * base[:, 0])


@dataclass
class Forest:
    """Isolation trees as arrays: split feature (-1: leaf), split value, left child (right is the next), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    normal: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1: the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (x[rows, np.maximum(f, 0)] >= value[node])
                node = np.where(inner, step, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / self.normal)


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """Random splits of the rows, down to the depth of a balanced tree: split feature, value, left child and path length of each node."""
    depth = int(np.ceil(np.log2(max(len(x), 2))))
    feature, value, left, length = [-1], [0.0], [0], [0.0]
    todo = [(0, x, 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = rows.min(0), rows.max(0)
        free = np.flatnonzero(high > low)
        if level >= depth or len(rows) < 2 or not len(free):
            length[node] = level + _mean_path(len(rows))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        right = rows[:, f] >= cut
        feature[node], value[node], left[node] = f, cut, len(feature)
        for side in (rows[~right], rows[right]):
            todo.append((len(feature), side, level + 1))
            feature.append(-1), value.append(0.0), left.append(0), length.append(0.0)
        if not len(todo[-2][1]) or not len(todo[-1][1]):
            todo[-2:] = [t for t in todo[-2:] if len(t[1])]
    return feature, value, left, length


def grow(good: DataFrame, trees: int, size: int, seed: int) -> Forest | None:
    """A forest from rows (doc_id, x). Each tree draws `size` of all rows, those of the least hash of id and tree, and is grown in
    a task of its own; the driver gets the nodes only. None without rows."""
    n = good.count()
    if not n:
        return None
    size = min(size, n)
    # Many times the deviation above `size`, so that every tree has enough to take its least from; all rows where they are few.
    share = min(1.0, (size + 12 * np.sqrt(size) + 12) / n)
    drawn = good.withColumn("tree", F.explode(F.expr(f"filter(sequence(0, {trees - 1}), t -> pmod(xxhash64(doc_id, t, {seed}L), 1073741824) <= {int(share * (1 << 30))})")))
    drawn = drawn.withColumn("h", F.xxhash64("doc_id", "tree", F.lit(seed).cast("bigint")))

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        h, ids = rows.column("h").to_numpy(), rows.column("doc_id").to_numpy()
        x = np.array(rows.column("x").to_pylist())[np.lexsort((ids, h, h & ((1 << 30) - 1)))[:size]]
        nodes = _tree(x, np.random.default_rng([seed, key[0].as_py()]))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([v], k) for v, k in zip(nodes, (pa.list_(pa.int64()), pa.list_(pa.float64())) * 2))], names=["tree", "feature", "value", "left", "length"])

    grown = drawn.groupBy("tree").applyInArrow(one, "tree bigint, feature array<bigint>, value array<double>, left array<bigint>, length array<double>").orderBy("tree").collect()
    most = max(len(t.feature) for t in grown)
    pad = lambda k, fill, kind: np.array([[*t[k], *[fill] * (most - len(t[k]))] for t in grown], kind)
    return Forest(pad("feature", -1, np.int64), pad("value", 0, float), pad("left", 0, np.int64), pad("length", 0, float), max(_mean_path(size), 1e-9))


def best_cut(scored: DataFrame, keep: float) -> float | None:
    """The score that best separates good from bad rows (sum of both recalls) among those that keep at least `keep` of the good
    ones, the least of equals. Rows: (score, good). None unless there are both.

    Counts of each score are sorted over the cluster in ranges; a range adds up its own, and the totals of those before it.
    """
    counts = scored.groupBy("score").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    counts = stored(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    ranges = counts.groupBy("part").agg(F.sum("n_good").alias("g"), F.sum("n_bad").alias("b")).orderBy("part").collect()        # one row a range
    goods, bads = sum(r.g for r in ranges), sum(r.b for r in ranges)
    if not goods or not bads:
        return None
    before = [(r.part, sum(q.g for q in ranges[:i]), sum(q.b for q in ranges[:i])) for i, r in enumerate(ranges)]
    upto = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    offsets = F.broadcast(scored.sparkSession.createDataFrame(before, "part int, g bigint, b bigint"))
    rates = counts.join(offsets, "part").select("score", ((F.col("g") + F.sum("n_good").over(upto)) / goods).alias("kept"), (1 - (F.col("b") + F.sum("n_bad").over(upto)) / bads).alias("dropped"))
    worth = (F.col("kept") >= keep).cast("int") * 2 + F.col("kept") + F.col("dropped")
    return rates.agg(F.max_by("score", F.struct(worth, -F.col("score")))).first()[0]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", trees: int = 100, size: int = 1024, keep: float = 0.995,
        seed: int = 5, least_words: int = 10, most_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text") -> Forest | None:
    """Grow the forest from all labelled documents and calibrate its threshold on all of them.

    Only rows that pass the base rules count, since the others are decided. Trees see the good ones (label 1), so that a
    common kind of bad document stays rare to them; each tree draws its own `size` of all good rows. The threshold is the
    anomaly score that best separates all labels (sum of both recalls) among those that keep at least `keep` of the good
    rows. Without labels of both kinds nothing is anomalous. None where no good document is labelled. Null ids and labels
    are left out; an id with several labels counts once, with the largest, one with several texts once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                base, x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(np.concatenate([x, base], 1)), pa.list_(pa.float64()))], names=["doc_id", "x"])

    marks = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
             .groupBy("doc_id").agg((F.max("label") == 1).alias("good")))
    # Texts stay where they are: the labels meet their statistics.
    found = _rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, x array<double>").join(marks, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x"))
    wide = len(BASE)
    count = lambda name: F.element_at("x", BASE.index(name) - wide)
    failed = (count("n_words") < least_words) | (100 * count("n_repeat_words") > most_repeat * count("n_words"))
    passed = stored(found.where(~failed).select("doc_id", "good", F.slice("x", 1, F.size("x") - wide).alias("x")), "labelled")
    forest = grow(passed.where("good").select("doc_id", "x"), trees, size, seed)
    if forest is None:
        return None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.zeros(0)), batch.column("good")], names=["score", "good"])

    cut = best_cut(passed.select("x", "good").mapInArrow(score, "score double, good boolean"), keep)
    if cut is not None:
        forest.threshold = float(cut)
    return forest


def judge(docs: DataFrame, forest: Forest | None, least_words: int = 10, most_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts of BASE, base_failed, kept, anomaly.

    base_failed: fewer than `least_words` words, or more than `most_repeat` percent of words in repeated windows.
    kept: not failed, and the forest's anomaly score is not above its threshold. Null texts have no words and fail.
    Repeated rows are kept, an empty table gives no rows, further columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                base, x = statistics(part.column("text"))
                failed = base_failed(base, least_words, most_repeat)
                anomaly = forest.score(x) if forest else np.zeros(len(x))
                kept = ~failed & (anomaly <= (forest.threshold if forest else 1.0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, base.T), pa.array(failed), pa.array(kept), pa.array(anomaly)],
                                                 names=["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double")
