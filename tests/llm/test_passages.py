"""Repeated and similar passages, and benchmark passages, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from frameledger.llm.compact_windows import _passages, compact_windows, similar_passages
from frameledger.llm.decontaminate import contaminated
from frameledger.llm.queries import QUERIES
from frameledger.llm.sparse_suffixes import repeated_passages

from .conftest import words


def lowered(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def slow_cover(texts, least=50):
    """Words of each text (by id, distinct texts) that lie in a passage of `least` words that another text has."""
    where, cover = defaultdict(set), defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(k)
    for k, w in texts.items():
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                cover[k] |= set(range(i, i + least))
    return cover


def representatives(rows):
    least = {}
    for i, t in rows:
        if t:
            least[t] = min(i, least.get(t, i))
    return {i: t for t, i in least.items()}


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        if r.kind == "passage":
            out[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    return out


@pytest.fixture(scope="module")
def tangled():
    """Texts whose repeats share heads with others: every mix of left and right sides around common middles."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    middles, lefts, rights = [fresh(35) for _ in range(3)], [fresh(12) for _ in range(3)], [fresh(30) for _ in range(3)]
    texts = []
    for _ in range(60):
        body = []
        for _ in range(rng.randint(1, 3)):
            cut, end = rng.randint(0, 12), rng.randint(0, 30)
            body += fresh(rng.randint(0, 40)) + rng.choice(lefts)[cut:] + rng.choice(middles) + rng.choice(rights)[:end]
        texts.append(" ".join(body + fresh(rng.randint(0, 40))))
    return texts + texts[:5] + ["", "short text", " ".join(["again"] * 300), " ".join(["again"] * 200), " ".join(fresh(49)), " ".join(fresh(50))]


def test_repeats_of_the_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op8_sparse_suffixes"](spark, small).collect()
    reps = representatives(docs)
    assert covered(rows) == slow_cover({i: lowered(t) for i, t in reps.items()})
    by_text = defaultdict(list)
    for i, t in docs:
        by_text[t].append(i)
    assert sorted((r.doc_id, r.other_doc_id) for r in rows if r.kind == "copy") == sorted((i, min(v)) for t, v in by_text.items() if len(v) > 1 and len(lowered(t)) >= 50 for i in v)


def test_repeats_with_shared_heads(spark, tangled):
    docs = list(enumerate(tangled))
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    texts = {i: lowered(t) for i, t in representatives(docs).items()}
    assert covered(rows) == slow_cover(texts)
    for r in rows:
        if r.kind == "passage":
            assert texts[r.doc_id][r.start : r.start + 50] == texts[r.other_doc_id][r.other_start : r.other_start + 50]


def test_compact_windows_are_the_nodes_of_the_trees():
    h = np.array([random.Random(i).getrandbits(64) for i in range(200)], np.uint64)
    h[50:60] = h[20]

    def nodes(a, b):
        if b - a < 10:
            return []
        m = min(range(a, b), key=lambda i: (int(h[i]) >> 28, i))
        return [(a, m, b), *nodes(a, m), *nodes(m + 1, b)]

    got = compact_windows(h, np.array([0, 70, 90]), np.array([70, 75, 200]), 10)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(nodes(0, 70) + nodes(90, 200))
    assert all(len(x) == 0 for x in compact_windows(h[:0], np.zeros(0, int), np.zeros(0, int), 10))


def test_similar_passages(spark, small, tangled):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op3_compact_windows"](spark, small).collect()
    texts = {i: lowered(t) for i, t in representatives(docs).items()}
    found = {(r.doc_id, r.other_doc_id) for r in rows if r.kind == "passage"}
    for r in rows:
        if r.kind == "passage":
            a, b = shingle_set(texts[r.doc_id][r.start : r.start + r.n_words]), shingle_set(texts[r.other_doc_id][r.other_start : r.other_start + r.other_words])
            assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8 and min(r.n_words, r.other_words) >= 50
    assert set(slow_cover(texts)) <= {a for a, _ in found}            # every document with an exact repeat
    big = {i: shingle_set(w) for i, w in texts.items() if len(w) >= 50}
    names = sorted(big)
    near = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(big[a] & big[b]) >= 0.8 * len(big[a] | big[b])}
    assert near and near <= found                                     # every pair of similar documents

    rows = similar_passages(spark.createDataFrame(list(enumerate(tangled)), "doc_id bigint, text string")).collect()
    assert set(slow_cover({i: lowered(t) for i, t in representatives(enumerate(tangled)).items()})) <= {r.doc_id for r in rows}


def test_passages_of_two_texts():
    x, y = np.arange(100, dtype=np.uint64), np.arange(500, 700, dtype=np.uint64)
    y[60:130] = x[20:90]
    assert _passages(x, y, 46, 0.8) == [(20, 90, 60, 130, 1.0)]
    assert _passages(x, y[:0], 46, 0.8) == _passages(x[:0], y, 46, 0.8) == _passages(x, np.arange(500, 700, dtype=np.uint64), 46, 0.8) == []


def test_benchmark_passages(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    wanted = {(d.doc_id, i.item_id) for d in docs for p in [plain(d.text)] for i in items if plain(i.text) in p}
    rows = QUERIES["op9_hamming_windows"](spark, small).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == wanted and len(rows) == len(wanted)


def test_edited_benchmark_passages(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh(rng.randint(20, 70)) for _ in range(30)] + [fresh(3)]
    docs, wanted = [], set()
    for d in range(90):
        i = d % 30
        w = list(items[i])
        for _ in range(rng.randint(0, 2)):
            w[rng.choice([0, 1, len(w) - 1, len(w) // 2])] = "edited"
        docs.append((d, ", ".join(fresh(rng.randint(0, 30))) + " " + " ".join(w).upper() + "\n" + " ".join(fresh(rng.randint(0, 30)))))
        a, b = shingle_set([x.lower() for x in w]), shingle_set(items[i])
        if len(a & b) / len(a | b) >= 0.8:
            wanted.add((d, i))
    assert 30 < len(wanted) < 90
    frame = spark.createDataFrame(docs + [(90, " ".join(items[30])), (91, None), (None, " ".join(items[0])), (92, ""), (0, docs[0][1])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "")], "item_id bigint, text string")
    rows = contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == wanted | {(None, 0)}
    assert {(r.doc_id, r.item_id) for r in contaminated(frame, bench, broadcast_rows=1).collect()} == wanted | {(None, 0)}
    assert contaminated(frame.limit(0), bench).count() == contaminated(frame, bench.limit(0)).count() == 0


def test_native_plan(spark, small):
    plan = QUERIES["op9_hamming_windows"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, odd, nothing):
    for operator in (repeated_passages, similar_passages):
        rows = operator(odd).collect()
        assert all(r.doc_id is None or r.doc_id in (5, 7, 8) for r in rows)
        assert sum(r.kind == "copy" for r in rows) == 0                # the copied text is shorter than a passage
        assert operator(nothing).count() == 0
    long = " ".join(f"w{i}" for i in range(120))
    twice = spark.createDataFrame([(1, long), (1, long), (2, long + " more"), (None, long)], "doc_id bigint, text string")
    for operator in (repeated_passages, similar_passages):
        rows = sorted((r.kind, r.doc_id, r.start, r.n_words, r.other_doc_id) for r in operator(twice).where("doc_id is not null").collect())
        assert rows == [("copy", 1, 0, 120, 1), ("copy", 1, 0, 120, 1), ("passage", 1, 0, 120, 2), ("passage", 2, 0, 120, 1)]
