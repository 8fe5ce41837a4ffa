"""Exact repeated passages by a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.llm.arrow_text import Words, mixed, shingles, slices
from frameledger.llm.text_classes import copies, stored, text_classes

#: Words of the shingles that are compared to select positions; shingles of a selection window.
SHINGLE, SPAN = 5, 20


def anchors(w: Words, hashes: np.ndarray) -> np.ndarray:
    """Minimiser positions: in every SPAN consecutive shingles of a text, the one of least hash (the first of equals)."""
    h = shingles(hashes, SHINGLE)
    n = len(h)
    if n < SPAN:
        return np.zeros(0, np.int64)
    inside = np.flatnonzero(w.row[: n - SPAN + 1] == w.row[SPAN + SHINGLE - 2 :])
    packed = (h >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8, 4):                 # minima over 2, 4, 8, 16 and 20 shingles
        packed = np.minimum(packed[:-step], packed[step:])
    return np.unique(packed[inside] & np.uint64((1 << 28) - 1)).astype(np.int64)


def _context(values: np.ndarray, low: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of `width` word hashes from `low` on in direction `step`; zero outside a text."""
    at = low[:, None] + step * np.arange(width)
    ok = (at >= first[:, None]) & (at < last[:, None])
    return np.where(ok, values[np.clip(at, 0, len(values) - 1)], 0).astype(">u4")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row pair, the leading words that are equal and not outside a text."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(1)


def repeated_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of `least` or more words (ASCII letters compared in lower case) found in two different texts,
    and one per document whose whole text others have too.

    Columns: kind (`passage` or `copy`), doc_id, start and n_words (in words), other_doc_id, other_start. A passage stands
    for all copies of its document; `copy` rows name the document that represents them.

    A repeat of `least` words has a selected position among its first SPAN words, so it shares least - SPAN + 1 words to
    the right of it. Positions whose next words occur in one text only are dropped by their hash; the rest are
    sorted by their suffix over the cluster, ties and hot suffixes included, so no key gathers in a task. Sorted neighbours of
    different texts are compared word by word, right up to `least` words and left up to SPAN - 1. Where three or more
    suffixes share their head, a neighbour need not be the one with the longest common left side: there every `least`-word window
    around a position is matched by its hash, at each left extent. A window that two neighbours of other texts above already have
    is left out, since its position is settled by them and they are matched. Overlapping finds of a text are joined.

    Null and empty texts have no passage. Rows with equal id and text count once. An empty table gives no rows. Further columns are not carried.
    """
    if least <= SPAN + SHINGLE:
        raise ValueError(f"least must be over {SPAN + SHINGLE}")
    head, left = least - SPAN + 1, SPAN - 1
    members, texts = text_classes(docs, id_col, text_col)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                hashes = w.hashes()
                at = anchors(w, hashes)
                at = at[at + head <= w.first[w.row[at] + 1]]
                yield pa.RecordBatch.from_arrays([part.column("tid").take(pa.array(w.row[at])), pa.array(at - w.first[w.row[at]], pa.int32()), pa.array(_window_hash(hashes, at, head).view(np.int64))], names=["tid", "pos", "h"])

    every = stored(texts.select("tid", "text").mapInArrow(heads, "tid bigint, pos int, h bigint"), "anchors")
    shared = every.groupBy("h").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b").select("h")
    wanted = every.join(shared, "h").groupBy("tid").agg(F.collect_list("pos").alias("at"))      # bounded by the text

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                hashes = w.hashes()
                short = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)
                lists = part.column("at")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                pos = lists.flatten().to_numpy().astype(np.int64)
                at, first, last = pos + w.first[row], w.first[row], w.first[row + 1]
                right, before = _context(short, at, first, last, least, 1), _context(short, at - 1, first, last, left, -1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("tid").take(pa.array(row)), pa.array(pos, pa.int32()), pa.array([x.tobytes() for x in right], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary())],
                    names=["tid", "pos", "suffix", "before"])

    found = stored(texts.select("tid", "text").join(wanted, "tid").mapInArrow(suffixes, "tid bigint, pos int, suffix binary, before binary").withColumn("h", F.xxhash64(F.substring("suffix", 1, 4 * head))), "suffixes")
    many = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").select("h", F.lit(True).alias("hot"))
    ordered = found.join(many, "h", "left").drop("h").repartitionByRange("suffix", "before", "tid", "pos").sortWithinPartitions("suffix", "before", "tid", "pos")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, carried, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([carried, batch] if carried is not None else [batch]).combine_chunks().to_batches()[0]
            yield _compare(rows, least, left)
            yield from _windows(rows, 0 if carried is None else carried.num_rows, least, left)
            if first:
                yield _edge(batch.slice(0, 1), part, "first")
                first = False
            # The last row, the last of another text, and the last above that of another, meet what follows.
            code = rows.column("tid").to_numpy()
            ends = [len(code) - 1, *np.flatnonzero(code[1:] != code[:-1])[::-1][:2].tolist()]
            carried = pa.Table.from_batches([rows.slice(i, 1) for i in ends[::-1]]).combine_chunks().to_batches()[0]
        if carried is not None:
            yield _edge(carried.slice(carried.num_rows - 1, 1), part, "last")

    pairs = stored(ordered.mapInArrow(neighbours, "tid bigint, pos int, start int, n int, other bigint, other_start int, part int, edge string, suffix binary, before binary, k bigint, k2 int"), "finds")
    # Two rows per range partition: neighbours across their bounds. One small task by nature.
    bounds = pairs.where("edge is not null").withColumn("i", F.lit(0))
    prior = Window.partitionBy("i").orderBy("part", F.col("edge") == "last")
    held = bounds.withColumn("prev", F.lag(F.struct("tid", "pos", "suffix", "before")).over(prior)).where("edge = 'first' and prev is not null")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = pa.RecordBatch.from_pylist([r["prev"], {k: r[k] for k in ("tid", "pos", "suffix", "before")}], pa.schema([("tid", pa.int64()), ("pos", pa.int32()), ("suffix", pa.binary()), ("before", pa.binary())]))
                yield _compare(rows, least, left).select(["tid", "pos", "start", "n", "other", "other_start"])

    near = pairs.where("edge is null and k is null").select("tid", "pos", "start", "n", "other", "other_start").unionAll(
        held.select("tid", "pos", "suffix", "before", "prev").mapInArrow(across, "tid bigint, pos int, start int, n int, other bigint, other_start int"))

    # Windows of the positions whose head stands three times or more: those of two texts or more are finds. Counted before the shuffle.
    keys = pairs.where("k is not null").select("tid", "start", "k", "k2")
    low = keys.groupBy("k", "k2").agg(F.min(F.struct("tid", "start")).alias("low"), F.max(F.struct("tid", "start")).alias("high")).where("low.tid <> high.tid")
    more = keys.join(low, ["k", "k2"]).select("tid", "start", F.lit(least).alias("n"), F.when(F.col("tid") == F.col("low.tid"), F.col("high")).otherwise(F.col("low")).alias("o")).select("tid", "start", "n", F.col("o.tid").alias("other"), F.col("o.start").alias("other_start"))
    spans = near.select("tid", "start", "n", "other", "other_start").unionAll(more).distinct()

    # Join overlapping finds of a text; a text's finds are bounded by its length.
    by_text = Window.partitionBy("tid").orderBy("start", F.desc("n"), "other", "other_start")
    islands = (spans.withColumn("end", F.col("start") + F.col("n")).withColumn("before", F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("island", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(by_text)))
    joined = islands.groupBy("tid", "island").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n_words"), F.min(F.struct("start", "other", "other_start")).alias("o"))
    named = texts.select("tid", "doc_id")
    passages = (joined.join(named, "tid").join(named.withColumnsRenamed({"tid": "other", "doc_id": "other_doc_id"}), F.col("o.other") == F.col("other"))
                .select(F.lit("passage").alias("kind"), "doc_id", "start", "n_words", "other_doc_id", F.col("o.other_start").alias("other_start")))
    sizes = texts.select("cls", F.size(F.array_remove(F.split(F.regexp_replace("text", "[\\x09-\\x0D]", " "), " "), "")).alias("n_words")).distinct().where(F.col("n_words") >= least)
    whole = copies(members, sizes).select(F.lit("copy").alias("kind"), "doc_id", F.lit(0).alias("start"), "n_words", F.col("rep_doc_id").alias("other_doc_id"), F.lit(0).alias("other_start"))
    return passages.unionAll(whole)


def _window_hash(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out = (out + hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mixed(out)


def _windows(rows: pa.RecordBatch, known: int, least: int, left: int) -> Iterator[pa.RecordBatch]:
    """Keys of the `least`-word windows around the hot rows from place `known` on, at each left extent.

    Left out is a window that the nearest row above of another text has, and the nearest above that of another text than
    its own: the first rows of two texts of every run of equal windows are keyed, the others have a find by `_compare`.
    """
    n = rows.num_rows
    hot = np.array(rows.column("hot").fill_null(False))
    hot[:known] = False
    mine = np.flatnonzero(hot)
    if not len(mine):
        return
    code = rows.column("tid").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    above = np.repeat(begins, np.diff(np.concatenate([begins, [n]]))) - 1
    second = np.where(above >= 0, above[np.maximum(above, 0)], -1)
    right = np.frombuffer(b"".join(rows.column("suffix").to_pylist()), ">u4").reshape(n, least)
    before = np.frombuffer(b"".join(rows.column("before").to_pylist()), ">u4").reshape(n, left)
    far_right, far_left = (np.where(second[mine] >= 0, np.minimum(_agree(x[mine], x[above[mine]]), _agree(x[mine], x[second[mine]])), 0) for x in (right, before))
    line = np.concatenate([before[:, ::-1], right], 1)[mine].astype(np.uint64)
    solid = np.concatenate([np.zeros((len(mine), 1), np.int64), np.cumsum(line != 0, axis=1)], 1)
    pos, tid = rows.column("pos").to_numpy()[mine], code[mine]
    for o in range(left + 1):
        a = left - o
        whole = solid[:, a + least] - solid[:, a] == least
        at = np.flatnonzero(whole & ~((far_left >= o) & (far_right >= least - o)))
        if not len(at):
            continue
        k, k2 = np.zeros(len(at), np.uint64), np.ones(len(at), np.uint64)
        for i in range(a, a + least):
            k = (k + line[at, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
            k2 = (k2 ^ line[at, i]) * np.uint64(0xD6E8FEB86659FD93)
            k2 ^= k2 >> np.uint64(32)
        none = lambda kind: pa.nulls(len(at), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tid[at]), pa.array(pos[at], pa.int32()), pa.array(pos[at] - o, pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.string()),
             none(pa.binary()), none(pa.binary()), pa.array(mixed(k).view(np.int64)), pa.array((mixed(k2) >> np.uint64(32)).astype(np.uint32).view(np.int32))],
            names=_NAMES)


_NAMES = ["tid", "pos", "start", "n", "other", "other_start", "part", "edge", "suffix", "before", "k", "k2"]


def _compare(rows: pa.RecordBatch, least: int, left: int) -> pa.RecordBatch:
    """Finds of each row with the nearest row above of another text, for both of the two."""
    n = rows.num_rows
    code = rows.column("tid").to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    above = np.repeat(begins, np.diff(np.concatenate([begins, [n]]))) - 1
    at = np.flatnonzero(above >= 0)
    above = above[at]
    right = np.frombuffer(b"".join(rows.column("suffix").to_pylist()), ">u4").reshape(n, least)
    before = np.frombuffer(b"".join(rows.column("before").to_pylist()), ">u4").reshape(n, left)
    r, b = _agree(right[at], right[above]), _agree(before[at], before[above])
    ok = r + b >= least
    at, above, r, b = at[ok], above[ok], r[ok], b[ok]
    pos = rows.column("pos").to_numpy().astype(np.int64)
    one, two = np.concatenate([at, above]), np.concatenate([above, at])
    b2, total = np.concatenate([b, b]), np.concatenate([r + b, r + b])
    take = lambda i: rows.column("tid").take(pa.array(i))
    nothing = lambda kind: pa.nulls(len(one), kind)
    return pa.RecordBatch.from_arrays(
        [take(one), pa.array(pos[one], pa.int32()), pa.array(pos[one] - b2, pa.int32()), pa.array(total, pa.int32()), take(two), pa.array(pos[two] - b2, pa.int32()),
         nothing(pa.int32()), nothing(pa.string()), nothing(pa.binary()), nothing(pa.binary()), nothing(pa.int64()), nothing(pa.int32())],
        names=_NAMES)


def _edge(row: pa.RecordBatch, part: int, edge: str) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int32())
    return pa.RecordBatch.from_arrays([row.column("tid"), row.column("pos"), none, none, pa.nulls(1, pa.int64()), none, pa.array([part], pa.int32()), pa.array([edge]), row.column("suffix"), row.column("before"), pa.nulls(1, pa.int64()), none],
                                      names=_NAMES)
