"""Alignment of two tokenizers over a corpus: which tokens stand for the same bytes, and in how many documents.

The counts come from external spill counting. Each block of documents is sorted into runs of (pair, document) records,
radix-partitioned by a hash of the pair and compressed with zstd. A merge over the runs of a partition, by a heap of
their frames, counts each pair in the order of the first side's ids, so that the largest count of an id is seen as its
pairs pass. The counts go back to the runs they came from, in the runs' own order, and each block adds up its documents.
A run holds a pair once however many of its documents have it, so no pair and no id gathers rows in one task.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameledger.llm.arrow_text import mixed, slices, texts
from frameledger.llm.text_classes import stored

COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTED], T.StructField("groups_sha256", T.StringType())])

_RUNS = "block bigint, digit int, head binary, body binary"
_COUNTS = "block bigint, digit int, totals binary"
_TOPS = "a int, top bigint"
#: Links expanded at once, and from how many links on a group is expanded by distinct ids.
_CHUNK, _WIDE = 1 << 22, 1 << 10


def _pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays in the least width that holds them, compressed."""
    parts = [np.array([len(arrays)], "<u4").tobytes()]
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        parts += [np.array([width, len(x)], "<u8").tobytes(), x.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 4
    for _ in range(int(np.frombuffer(data, "<u4", 1)[0])):
        width, n = np.frombuffer(data, "<u8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16))
        at += 16 + width * n
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens.

    `ranks_path` may name the first vocabulary as ranks: texts of Latin letters and marks only (under U+0250) are then
    encoded by them, which gives the same ids in less time.
    """

    def __init__(self, a_path: str, b_path: str, ranks_path: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.shift = len(self.b_bytes).bit_length()
        if len(self.a_bytes).bit_length() + self.shift > 32:
            raise ValueError("ids of a pair must fit 32 bits together")
        self.fast = None
        if ranks_path:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as lines:
                ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Each id with what follows it in a digest: "," inside a side, "|" after the first one, ";" after the second.
        cells = [f"{i}{mark}" for size, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(size) for mark in (",", last)]
        self.cell_length = np.array(list(map(len, cells)), np.int64)
        wide = int(self.cell_length.max())
        self.cells = np.array([c.encode() for c in cells], f"S{wide}").view(np.uint8).reshape(-1, wide)

    def encode(self, rows: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides for each text; none where a side does not give back the text."""
        strings = [r.decode("utf-8", "replace") for r in rows]
        second = self.b.encode(strings, num_threads=1)
        first = []
        for k, (raw, s) in enumerate(zip(rows, strings)):
            if not raw:
                first.append([])
                second[k] = []
                continue
            # A very long run of letters is left to the first library, whose merges do not slow down with length.
            if self.fast is not None and max(s) < "ɐ" and len(s) < 1 << 20:
                ids = self.fast.encode_ordinary(" " + s)
            else:
                ids = self.a.encode(" " + s, add_special_tokens=False).ids
            whole = b" " + raw
            if b"".join(map(self.a_bytes.__getitem__, ids)) != whole or b"".join(map(self.b_bytes.__getitem__, second[k])) != whole:
                ids, second[k] = [], []
            first.append(ids)
        return first, second


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), sizes


def _merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


def align(pair: Pair, rows: list[bytes]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Of each text n_a, n_b, n_groups, n_links and its digest; and the sorted (pair << 32 | text) keys with their links."""
    first, second = pair.encode(rows)
    (a, n_a), (b, n_b) = _flat(first), _flat(second)
    a_end, b_end = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
    borders = np.intersect1d(a_end, b_end, assume_unique=True)
    a_group, b_group = np.searchsorted(borders, a_end), np.searchsorted(borders, b_end)
    in_a, in_b = np.bincount(a_group, minlength=len(borders)), np.bincount(b_group, minlength=len(borders))
    a_to, b_to = np.cumsum(in_a), np.cumsum(in_b)                       # tokens up to the end of each group
    a_row = np.repeat(np.arange(len(rows)), n_a)
    row_end = np.searchsorted(a_to, np.cumsum(n_a), "right")            # groups up to the end of each text
    groups = np.diff(row_end, prepend=0)
    links = np.diff(np.concatenate([[0], np.cumsum(in_a * in_b)])[row_end], prepend=0)

    # Digests: the tokens of both sides in the order of groups, first side first.
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + (b_to - in_b)[a_group]] = 2 * a + (np.arange(1, len(a) + 1) == a_to[a_group])
    code[np.arange(len(b)) + a_to[b_group]] = 2 * (len(pair.a_bytes) + b) + (np.arange(1, len(b) + 1) == b_to[b_group])
    letters = pair.cells[code].reshape(-1)
    flat = letters[letters != 0].tobytes()
    ends = np.concatenate([[0], np.cumsum(pair.cell_length[code])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    digests = [hashlib.sha256(flat[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]

    keys, weights = [], []
    wide = in_a * in_b > _WIDE
    each = np.where(wide[a_group], 0, in_b[a_group])
    total = np.cumsum(each)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _CHUNK, "right")))
        n = each[start:stop]
        token = np.repeat(np.arange(start, stop), n)
        place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        other = b[(b_to - in_b)[a_group[token]] + place]
        key, count = np.unique((a[token] << pair.shift | other).astype(np.uint64) << np.uint64(32) | a_row[token].astype(np.uint64), return_counts=True)
        keys.append(key), weights.append(count)
        start = stop
    for g in np.flatnonzero(wide):
        row = np.uint64(a_row[a_to[g] - 1])
        (x, nx), (y, ny) = (np.unique(ids[to[g] - size[g] : to[g]], return_counts=True) for ids, to, size in ((a, a_to, in_a), (b, b_to, in_b)))
        keys.append((((x[:, None] << pair.shift) | y[None, :]).astype(np.uint64) << np.uint64(32) | row).ravel()), weights.append((nx[:, None] * ny[None, :]).ravel())
    key, weight = (keys[0], weights[0]) if len(keys) == 1 else _merged(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(weights) if weights else np.zeros(0, np.int64))
    return {"n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links}, digests, key, weight


def spill(key: np.ndarray, weight: np.ndarray, digits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Runs by radix digit of the pair's hash: (digit, pairs and their numbers of texts, texts and their links), in order of pairs."""
    if not len(key):
        return
    of = key >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    pairs, many = of[at], np.diff(at, append=len(of))
    digit = (mixed(pairs) % np.uint64(digits)).astype(np.int64)
    order = np.argsort(digit, kind="stable")
    pairs, many, at, digit = pairs[order], many[order], at[order], digit[order]
    cut = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1], [True]]))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        n = many[lo:hi]
        record = np.repeat(at[lo:hi] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        yield int(digit[lo]), _pack(np.diff(pairs[lo:hi], prepend=np.uint64(0)), n), _pack(key[record] & np.uint64(0xFFFFFFFF), weight[record])


class _Run:
    """A run's pairs and numbers of texts, read frame by frame; `totals` collects what the merge finds for them."""

    def __init__(self, head: bytes, frame: int):
        delta, self.many = _unpack(head)
        self.pairs = np.cumsum(delta.astype(np.uint64))
        self.frame, self.at = frame, 0
        self.totals = np.zeros(len(self.pairs), np.int64)

    def next(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs and numbers of the next frame, and where it starts."""
        lo, self.at = self.at, min(self.at + self.frame, len(self.pairs))
        return self.pairs[lo : self.at], self.many[lo : self.at], lo


def merge(heads: list[bytes], pending: int = 1 << 22) -> tuple[list[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """k-way merge of runs: the totals of each run's pairs, filled as the returned steps of (pairs, totals) are taken.

    A heap holds the last pair of each run's open frame. No unread pair is under the least of them, so all open pairs up
    to it are counted and that run's next frame is opened. Frames are cut so that about `pending` pairs are open at once.
    """
    runs = [_Run(h, max(1024, pending // max(len(heads), 1))) for h in heads]

    def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heap: list[tuple[int, int]] = []
        pair, many, run, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = list(range(len(runs)))
        while waiting or len(pair):
            opened = [(r, *runs[r].next()) for r in waiting]
            for r, p, _, _ in opened:
                if runs[r].at < len(runs[r].pairs):          # a run that is read to its end holds nothing back
                    heapq.heappush(heap, (int(p[-1]), r))
            pair = np.concatenate([pair, *[p for _, p, _, _ in opened]])
            many = np.concatenate([many, *[m.astype(np.int64) for _, _, m, _ in opened]])
            run = np.concatenate([run, *[np.full(len(p), r, np.int64) for r, p, _, _ in opened]])
            place = np.concatenate([place, *[np.arange(lo, lo + len(p)) for _, p, _, lo in opened]])
            waiting = []
            done = np.ones(len(pair), bool)
            if heap:
                least = heap[0][0]
                while heap and heap[0][0] == least:
                    waiting.append(heapq.heappop(heap)[1])
                done = pair <= np.uint64(least)
            order = np.argsort(pair[done], kind="stable")
            found = pair[done][order]
            if len(found):
                at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                total = np.add.reduceat(many[done][order], at)
                each = np.repeat(total, np.diff(at, append=len(found)))
                which, where = run[done][order], place[done][order]
                by = np.argsort(which, kind="stable")
                bounds = np.searchsorted(which[by], np.arange(len(runs) + 1))
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = by[bounds[r] : bounds[r + 1]]
                    runs[r].totals[where[mine]] = each[mine]
                # A pair that ends this step may go on in the next frames of the waiting runs only if it is `least` itself,
                # and runs hold each pair once: all its records are open by now.
                yield found[at], total
            pair, many, run, place = pair[~done], many[~done], run[~done], place[~done]

    return [r.totals for r in runs], steps()


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, ranks_path: str | None = None, block_bytes: int = 2 << 20,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Offsets where tokens of both sides end cut a text into groups; every pair of tokens in a group is linked, each
    occurrence for itself. A pair's count is the number of documents that hold it linked; n_best is the number of links
    whose count is the highest of their first id (ties included), count_sum adds the counts of all links.

    Rows are what counts as documents: repeated rows, also under one id, count each, and null ids stay null. Texts that
    are null, empty, or not given back by the bytes of a side have zeros and an empty digest. Very long texts are blocks
    of their own; a group of many tokens is linked by its distinct ids. An empty table gives no rows. Further columns are
    not carried. The tokenizers' files must be readable on the executors.

    The number of radix partitions follows the bytes of text (128 MB each, 64 at least). The highest counts are gathered
    on the driver: one number for each id of the first vocabulary.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    digits = 1 << max(6, math.ceil(math.log2(max(size, 1) / (128 << 20))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        pair = None
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                pair = pair or Pair(a_path, b_path, ranks_path)
                counts, digests, key, weight = align(pair, texts(part.column("text")))
                about = pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(counts[c]) for c in COUNTED[:4]], pa.array(digests)], names=["doc_id", *COUNTED[:4], "groups_sha256"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, about.schema) as out:
                    out.write_batch(about)
                made = [(-1, sink.getvalue().to_pybytes(), b""), *spill(key, weight, digits)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(made), pa.int64()), pa.array([m[0] for m in made], pa.int32()), *[pa.array([m[k] for m in made], pa.binary()) for k in (1, 2)]], names=["block", "digit", "head", "body"])
                block += 1

    runs = stored(rows.mapInArrow(cut, _RUNS), "runs")
    shift = _pieces(b_path).bit_length()

    def count(table: pa.Table) -> pa.Table:
        heads = table.column("head").to_pylist()
        totals, steps = merge(heads)
        ids, best = [], []
        for pairs, total in steps:                          # in order of the first side's ids
            first = (pairs >> np.uint64(shift)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            ids.append(first[at]), best.append(np.maximum.reduceat(total, at))
        top = _pack(np.concatenate(ids).astype(np.uint64), np.concatenate(best).astype(np.uint64)) if ids else _pack(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        block = table.column("block").to_pylist()
        return pa.table({"block": pa.array([*block, None], pa.int64()), "digit": pa.array([table.column("digit")[0].as_py()] * (len(block) + 1), pa.int32()),
                         "totals": pa.array([*[_pack(t.astype(np.uint64)) for t in totals], top], pa.binary())})

    counts = stored(runs.where("digit >= 0").select("block", "digit", "head").groupBy("digit").applyInArrow(count, _COUNTS), "counts")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("totals").to_pylist():
                ids, top = (x.astype(np.int64) for x in _unpack(raw))
                if len(ids):
                    if ids.max() >= len(most):
                        most = np.concatenate([most, np.zeros(int(ids.max()) + 1 - len(most), np.int64)])
                    np.maximum.at(most, ids, top)
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at])], names=["a", "top"])

    found = counts.where("block is null").select("totals").mapInArrow(tops, _TOPS).groupBy("a").agg(F.max("top").alias("top")).collect()
    highest = np.zeros(max((r["a"] for r in found), default=0) + 1, np.int64)
    for r in found:
        highest[r["a"]] = r["top"]

    def add_up(mine: pa.Table, totals: pa.Table) -> pa.Table:
        about, heads = None, {}
        for digit, head, body in zip(*(mine.column(c).to_pylist() for c in ("digit", "head", "body"))):
            if digit < 0:
                about = pa.ipc.open_stream(head).read_all()
            else:
                heads[digit] = (head, body)
        links, best = np.zeros(about.num_rows, np.int64), np.zeros(about.num_rows, np.int64)
        for digit, raw in zip(totals.column("digit").to_pylist(), totals.column("totals").to_pylist()):
            (delta, many), (row, weight) = map(_unpack, heads[digit])
            total = _unpack(raw)[0].astype(np.int64)
            is_top = total == highest[(np.cumsum(delta.astype(np.uint64)) >> np.uint64(shift)).astype(np.int64)]
            row, weight = row.astype(np.int64), weight.astype(np.int64)
            np.add.at(links, row, np.repeat(total, many) * weight)
            np.add.at(best, row, np.repeat(is_top, many) * weight)
        columns = {c: about.column(c) for c in ("doc_id", *COUNTED[:4], "groups_sha256")} | {"n_best": pa.array(best), "count_sum": pa.array(links)}
        return pa.table({c: columns[c] for c in SCHEMA.names})

    return runs.groupBy("block").cogroup(counts.where("block is not null").groupBy("block")).applyInArrow(add_up, SCHEMA)


def _pieces(b_path: str) -> int:
    """How many pieces the second vocabulary has."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
