"""Learnt operators: held-out accuracy, the rule counts against brute force, and awkward rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from frameledger.llm import language_id, quality_rank, rule_forest
from frameledger.llm.queries import QUERIES

from .conftest import ids, words


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def labels(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}


def test_quality_is_right_on_held_out_rows(spark, small, labels):
    rows = QUERIES["op1_bradley_terry"](spark, small).collect()
    assert len(rows) == 1000 and all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].quality for r in held) >= 0.95 * len(held)


def test_languages_are_right_on_held_out_rows(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op2_subword_language"](spark, small).collect()
    assert len(rows) == 1000 and all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 5


def slow_counts(text):
    w, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(words(line))
        seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_counts_and_verdict(spark, small, labels):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_rule_forest"](spark, small).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)


def test_forest_keeps_good_and_drops_bad_documents(spark):
    large = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    passed = [r for r in QUERIES["op5_rule_forest"](spark, large).collect() if not r.base_failed and r.doc_id in quality]
    good = [r.kept for r in passed if quality[r.doc_id] == 1]
    bad = [r.kept for r in passed if quality[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(spark, odd, nothing, odd_rows):
    every = sorted((r[0] for r in odd_rows), key=lambda x: (x is None, x))
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(5, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    model = quality_rank.fit(odd, labels)
    rated = quality_rank.rate(odd, model)
    assert ids(rated) == every and all(0 <= r.score <= 1 for r in rated.collect())
    assert {r.score for r in quality_rank.rate(odd, quality_rank.fit(odd, labels.limit(0))).collect()} == {0.5}

    language = language_id.identify(odd, language_id.fit(odd, odd))
    assert ids(language) == every
    assert {r.lang_pred for r in language.collect() if r.doc_id in (0, 1, 2, 4)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}

    judged = rule_forest.judge(odd, rule_forest.fit(odd, labels))
    assert ids(judged) == every
    for r in judged.where("doc_id is not null").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(dict((x[0], x[1]) for x in odd_rows)[r.doc_id])
    assert rule_forest.fit(nothing, labels) is None
    for frame in (quality_rank.rate(nothing, model), language_id.identify(nothing, language_id.fit(nothing, nothing)), rule_forest.judge(nothing, None)):
        assert frame.count() == 0


def test_forest_threshold_is_the_best_of_all_labelled_rows(spark):
    """More labelled rows than any sample once held, with scores that overlap: no cut over all of them is better."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(6600):
        bad = i % 3 == 0
        size = rng.integers(2, 12 if bad else 9, 14)
        text = " ".join("".join(rng.choice(list("abcdefgh#!XYZ" if bad else "abcdefghijkl#!X"), n)) for n in size)
        rows.append((i, text)), marks.append((i, 0 if bad else 1))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int")
    forest = rule_forest.fit(docs, labels, trees=20, size=256)
    judged = rule_forest.judge(docs, forest).where("not base_failed").collect()
    s, good = np.array([r.anomaly for r in judged]), np.array([dict(marks)[r.doc_id] == 1 for r in judged])
    kept, dropped = (lambda c: (s[good] <= c).mean()), (lambda c: (s[~good] > c).mean())
    best = max(np.unique(s), key=lambda c: (kept(c) >= 0.995) * 2 + kept(c) + dropped(c))
    assert len(s) == 6600 and forest.threshold == pytest.approx(best, abs=1e-12)
