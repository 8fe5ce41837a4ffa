"""Token packing: Karmarkar-Karp multiway differencing over the pieces of each task's documents."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameledger.llm.arrow_text import slices, texts

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def near_equal(sizes: list[int], k: int) -> list[list[int]]:
    """Items dealt to k windows with near-equal sums, by largest differencing.

    Each item starts as a partition with one filled window. The two partitions with the largest spread merge,
    the fullest window of one with the emptiest of the other, until one partition is left. Sums are kept less
    their minimum, and only those over it, so that early merges are short.
    """
    if not sizes:
        return [[] for _ in range(k)]
    # Of each partition: sums over its minimum, ascending, of its upper windows; a tree says which items they hold.
    sums: list[np.ndarray] = [np.array([s], np.int64) for s in sizes]
    tree: list[tuple | None] = [None] * len(sizes)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        n = min(k, len(x) + len(y))
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left[n - len(x):] = x
        right[: len(y)] = y[::-1]
        total = left + right
        order = np.argsort(total, kind="stable")
        total = total[order]
        if n == k:
            total -= total[0]
        node = len(sums)
        sums.append(total)
        tree.append((a, b, len(x), len(y), n, order))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(total[-1]), node))
    windows: list[list[int]] = [[] for _ in range(k)]
    root = heap[0][1]
    width = len(sums[root])
    todo = [(root, np.arange(k - width, k))]
    while todo:
        node, slots = todo.pop()            # slots: the window of each upper sum of the node, ascending
        if tree[node] is None:
            windows[slots[-1]].append(node)
            continue
        a, b, nx, ny, n, order = tree[node]
        back = np.empty(n, np.int64)
        back[order] = slots[len(slots) - n:]
        todo.append((a, back[n - nx:]))
        todo.append((b, back[:ny][::-1]))
    return windows


def packed(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece, for documents of the given token counts.

    Whole windows are cut off long documents first; what is left of each is one item. Differencing deals the
    items to as many windows as their tokens fill, near-equally. What a window then holds beyond the capacity
    is cut off its last item and fills the room of others; what finds no room raises the window count: it is
    cut to powers of two, the lengths that need no padding.
    """
    out, items, window = [], [], 0
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((doc, at, capacity, window, 0))
            at, window = at + capacity, window + 1
        if n > at:
            items.append((doc, at, n - at))
    k = sum(x[2] for x in items) // capacity
    spare: list[tuple[int, int, int]] = []
    room: list[list[int]] = []
    if k == 0:
        spare = items
    else:
        for members in near_equal([x[2] for x in items], k):
            used = 0
            for i in sorted(members, key=lambda i: (-items[i][2], i)):
                doc, at, n = items[i]
                take = min(n, capacity - used)
                if take:
                    out.append((doc, at, take, window, used))
                    used += take
                if take < n:
                    spare.append((doc, at + take, n - take))
            if used < capacity:
                room.append([window, used])
            window += 1
    queue = [[w, u, capacity] for w, u in room]
    left = sum(x[2] for x in spare) - sum(capacity - u for _, u in room)
    for bit in range(left.bit_length() - 1, -1, -1) if left > 0 else ():
        if left >> bit & 1:
            queue.append([window, 0, 1 << bit])
            window += 1
    queue.reverse()
    for doc, at, n in spare:
        while n:
            w, used, full = queue[-1]
            take = min(n, full - used)
            out.append((doc, at, take, w, used))
            at, n, used = at + take, n - take, used + take
            if used == full:
                queue.pop()
            else:
                queue[-1][1] = used
    return out


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


class _Pieces(dict):
    """Token ids (little-endian bytes) of runs of text without white space, which no token of this kind crosses.

    A run not seen yet is split once more where a token always ends: before closing marks, which no rule of the
    tokenizer joins to letters. A word of Latin letters is one run of letters to the tokenizer, so its lower-case
    form goes to the vocabulary straight; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [t.split() for t in texts]
        if len(self) > self.most:
            self.clear()
        for run in [x for x in set().union(*split) if x not in self]:
            core = run.rstrip(b".,!;:?*%$&#")
            if core and core is not run and b"<" not in core and core[-1:].isalpha():
                if core not in self:
                    self[core] = self._ids(core)
                close = run[len(core):]
                if close not in self:
                    self[close] = self._ids(close)
                self[run] = self[core] + self[close]
            else:
                self[run] = self._ids(run)
        get = self.__getitem__
        return [b"".join(map(get, runs)) for runs in split]

    def _ids(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and (low := text.lower()).isalpha():
            ids = [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.table))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group: int = 4096,
         cache: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens.

    A task tokenises its documents and packs them `group` documents at a time, so nothing is shuffled and
    memory is bounded by the group. Sequence ids join the task's number and a running number. The tokenizer must
    drop white space, since texts are tokenised by runs between ASCII white space (kept in a memory of `cache` runs);
    its file must be readable on the executors.

    Null and empty texts are one piece with the end id. Null ids stay null. Repeated rows are packed each. An empty
    table gives no rows. Further columns are not carried.
    """
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        runs = _Pieces(tokenizer_path, cache)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        tail = np.array([end_id], "<u4").tobytes()
        ids, tokens = [], []
        serial = 0

        def flush():
            nonlocal ids, tokens, serial
            made = packed([len(t) // 4 for t in tokens], capacity)
            if made:
                doc, start, length, window, offset = (np.array(x, np.int64) for x in zip(*made))
                crc = [zlib.crc32(memoryview(tokens[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
                which = base + serial + window
                serial += int(window.max()) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array([len(tokens[d]) // 4 for d in doc.tolist()], pa.int64()), pa.array(which), pa.array(offset)], names=SCHEMA.names)
            ids, tokens = [], []

        for batch in batches:
            for part in slices(batch, "text"):
                for i, found in zip(part.column("id").to_pylist(), runs.of(texts(part.column("text")))):
                    ids.append(i)
                    tokens.append(found + tail)
                    if len(ids) == group:
                        yield from flush()
        yield from flush()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)
