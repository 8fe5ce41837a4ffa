import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameledger.llm.packing import _Pieces, near_equal, pack, packed

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_differencing_deals_every_item_once_and_near_equally():
    rng = random.Random(1)
    sizes = [rng.randint(1, 4000) for _ in range(900)]
    windows = near_equal(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(900))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) < 0.02 * max(sums)
    assert near_equal([], 3) == [[], [], []]
    assert sorted(map(len, near_equal([5, 5], 4))) == [0, 0, 1, 1]


@pytest.mark.parametrize("lengths", [[], [1], [64], [200] * 3, [1] * 100, [random.Random(2).randint(1, 400) for _ in range(500)]])
def test_pieces_cover_documents_without_padding(lengths):
    cover, windows = defaultdict(list), defaultdict(list)
    for doc, start, n, window, offset in packed(lengths, 64):
        cover[doc].append((start, n))
        windows[window].append((offset, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(cover[doc]):
            assert start == at and n > 0
            at += n
        assert at == length
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert sorted(windows) == list(range(len(windows)))


def test_ids_are_those_of_the_tokenizer(tokenizer):
    texts = ["", "It's <|endoftext|> x", "ΣΑΣ İstanbul naïve naïve ﬁ H̱x", "can't. they're!! 12a3½ \x1cq ß Straße. é. d'accord", "日本語 🎉🎉 x\x00y 'S 's"]
    for text, found in zip(texts, _Pieces(PATH, 10).of([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pack(docs, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id] += r.length
    assert max(by_sequence.values()) <= 4096
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)


def test_odd_rows(odd, nothing, odd_rows):
    rows = pack(odd, PATH, capacity=128).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert [r.doc_tokens for r in rows if r.doc_id == 0] == [1] and [r.doc_tokens for r in rows if r.doc_id == 1] == [1]
    assert sum(r.start == 0 for r in rows) == len(odd_rows)
    assert pack(nothing, PATH).count() == 0
