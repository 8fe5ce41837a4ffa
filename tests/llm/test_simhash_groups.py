import random

import numpy as np
from xxhash import xxh64_intdigest

from frameledger.llm.graph import components
from frameledger.llm.simhash_groups import allocate, correlated_parts, fingerprint, fingerprint_groups, group_near_duplicates

from .conftest import words


def slow_print(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints, radius):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in prints}


def expected(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    root = slow_groups({f for _, f in prints}, 4)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in prints), key=str)


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(map(tuple, group_near_duplicates(docs).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_dense_and_chained_groups(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:8]:                                        # chains of 3 and 4 bits, and a ball of near copies
        at = b
        for _ in range(12):
            at ^= sum(1 << k for k in rng.sample(range(64), rng.choice([3, 4])))
            prints.add(at)
    prints |= {base[9] ^ sum(1 << k for k in rng.sample(range(64), rng.choice([1, 2, 4]))) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in prints}
    got = {signed[r.fp]: r.root for r in fingerprint_groups(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    want = slow_groups(prints, 4)
    assert set(got) == prints
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[f], want[f]) for f in prints}) == len(set(want.values()))


def test_plan_covers_the_radius():
    cost, chosen = allocate([{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 7.0, 1: 30.0}], 1)
    assert sum(chosen) == 1 and cost == min(c1 + c2 + c3 for t1, c1 in {-1: 0, 0: 5, 1: 9}.items() for t2, c2 in {-1: 0, 0: 1, 1: 2}.items()
                                            for t3, c3 in {-1: 0, 0: 7, 1: 30}.items() if t1 + t2 + t3 == 1)
    both = np.full((64, 64), 5.0) + np.eye(64) * 5
    both[3, 60] = both[60, 3] = 10
    parts = correlated_parts(both, 20, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and any({3, 60} <= set(p) for p in parts)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_fingerprint_of_many_words():
    text = " ".join(f"w{i % 700}" for i in range(3000))
    assert fingerprint(text.encode()) & (1 << 64) - 1 == slow_print(text)


def test_odd_rows(odd, nothing, odd_rows):
    got = sorted(map(tuple, group_near_duplicates(odd).collect()), key=str)
    assert got == expected([(r[0], r[1]) for r in odd_rows])
    assert group_near_duplicates(nothing).count() == 0
