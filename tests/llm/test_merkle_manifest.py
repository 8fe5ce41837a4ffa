"""The manifest against a plain tree over all rows in memory, and versions against trees built anew."""

import zlib
from hashlib import sha256

import pytest

from frameledger.llm import merkle_manifest as mm


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, i):
    """(top, siblings of node i)"""
    beside = []
    while len(nodes) > 1:
        beside.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        i >>= 1
    return nodes[0], beside


def fold(node, beside):
    for right, other in beside:
        node = h(node) if other is None else h(other, node) if right else h(node, other)
    return node


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = []
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        tops.append(climb([x[2] for x in groups[name]], 0)[0])
    out = []
    for k, name in enumerate(names):
        nodes = [x[2] for x in groups[name]]
        root, upper = climb(tops, k)
        for i, (_, _, own, r) in enumerate(groups[name]):
            beside = climb(nodes, i)[1] + upper
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if bad else own, beside)
            out.append((r[0], own, tops[k], root, h(*(s for _, s in beside if s)), folded, folded == root))
    return out


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_documents(spark, small, bits):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sort(mm.manifest(docs.repartition(5), bits=bits).collect())
    assert got == sort(brute(rows))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("bits", [1, 12])
def test_odd_rows(spark, odd, odd_rows, nothing, bits):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows]
    assert sort(mm.manifest(odd, bits=bits).collect()) == sort(brute(rows))
    assert mm.manifest(nothing, bits=bits).count() == 0


def test_many_languages_and_lone_leaves(spark):
    rows = [(i, "s", None if i % 11 == 0 else f"l{i % 37}", 9_223_372_036_854_775_807 if i == 5 else i, "é" * i) for i in range(60)] + [(7, None, "alone", None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(4)
    for bits in (1, 2, 12):
        assert sort(mm.manifest(docs, bits=bits).collect()) == sort(brute(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_versions_share_all_but_the_ancestors(n):
    nodes = [h(str(i)) for i in range(n)]
    tree = mm.Block(nodes, n, 12)
    before = [list(level) for level in tree.levels]
    for i in range(n):
        changed = mm.Block([h("other") if k == i else v for k, v in enumerate(nodes)], n, 12)
        version = tree.version(i, h("other"))
        assert tree.levels == before and len(version) == len(tree.levels)
        for k, level in enumerate(changed.levels):
            assert [version[k] if j == i >> k else v for j, v in enumerate(tree.levels[k])] == level
