"""Token alignment against a plain count of all links, and the merge against a dictionary."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from frameledger.llm import token_alignment as ta

A, B, RANKS = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(A, B)


def brute(pair, rows):
    """Token by token, link by link."""
    out, held = [], defaultdict(set)
    for n, text in enumerate(rows):
        groups = []
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                i = j = p = q = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if p <= q and i < len(a):
                        p += len(x[i])
                        ga.append(a[i])
                        i += 1
                    else:
                        q += len(y[j])
                        gb.append(b[j])
                        j += 1
                    if p == q:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = [(u, v) for ga, gb in groups for u in ga for v in gb]
        for link in links:
            held[link].add(n)
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((groups, links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    count = {k: len(v) for k, v in held.items()}
    top = defaultdict(int)
    for (u, _), c in count.items():
        top[u] = max(top[u], c)
    return [(sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
             sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), digest) for groups, links, digest in out]


def rows_of(frame):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in (*ta.COUNTED, "groups_sha256")]) for r in frame.collect())


AWKWARD = ["", "a", " leading", "two  spaces   three\n\n\ttab", "naïve café 😀 日本語 текст", "<s> </s> <unk> <|endoftext|>", "▁ lower", "x" * 3000, "ab" * 900 + "é" * 700,
           "\x00 nul", "don't I'll we've 12345 67,890.12", "½²³ ﬁ ǅ ٣٤", " ", "    ", "\n", "日" * 800, "!?" * 900]


def test_awkward_texts(spark, pair):
    frame = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id bigint, text string").repartition(3)
    want = sorted((False, i, *w) for i, w in enumerate(brute(pair, AWKWARD)))
    assert rows_of(ta.align_tokenizers(frame, A, B, RANKS)) == want
    assert rows_of(ta.align_tokenizers(frame, A, B, None, block_bytes=100)) == want


def test_documents(spark, small, pair):
    frame = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = frame.collect()
    want = sorted((False, r["doc_id"], *w) for r, w in zip(rows, brute(pair, [r["text"] for r in rows])))
    assert rows_of(ta.align_tokenizers(frame, A, B, RANKS, block_bytes=200_000)) == want


def test_odd_rows(spark, odd, odd_rows, nothing, pair):
    want = sorted((r[0] is None, r[0] or 0, *w) for r, w in zip(odd_rows, brute(pair, [r[1] for r in odd_rows])))
    assert rows_of(ta.align_tokenizers(odd, A, B, RANKS)) == want
    assert ta.align_tokenizers(nothing, A, B, RANKS).count() == 0


def test_ranks_give_the_same_ids(pair):
    fast = ta.Pair(A, B, RANKS)
    letters = [chr(c) for c in range(1, 0x250)]
    texts = [f"{x}{y}" for x in letters[::7] for y in letters[::5]] + [f"a{c}b 1{c} {c}{c} \n{c}'s" for c in letters]
    raw = [t.encode() for t in texts]
    assert fast.encode(raw) == pair.encode(raw)


@pytest.mark.parametrize("pending", [1, 1 << 22])
def test_merge_counts_every_pair(pending):
    rng = np.random.default_rng(3)
    heads, want, all_pairs = [], Counter(), []
    for _ in range(7):
        pairs = np.unique(rng.integers(0, 6000, 5000)).astype(np.uint64)
        many = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), many.tolist())))
        heads.append(ta._pack(np.diff(pairs, prepend=np.uint64(0)), many))
        all_pairs.append(pairs)
    totals, steps = ta.merge(heads, pending)
    seen = [(p, t) for pairs, total in steps for p, t in zip(pairs.tolist(), total.tolist())]
    assert seen == sorted(want.items())
    for pairs, total in zip(all_pairs, totals):
        assert total.tolist() == [want[p] for p in pairs.tolist()]
