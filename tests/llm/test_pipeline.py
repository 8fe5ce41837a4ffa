"""The stages and run() against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from frameledger.llm.credential_scan import redact_text
from frameledger.llm.queries import QUERIES

from .conftest import ids
from .test_simhash_groups import expected


def test_stages_are_whole_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "secrets", "pack"]


def test_run_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(ids(corpus_pipeline.drop_unknown_language(spark, docs, small)))
    assert len(kept) >= 0.995 * len(texts)                            # clean documents stay
    kept = {i for i, _, c in expected([(i, texts[i]) for i in sorted(kept)]) if i == c}
    leaked = {r.doc_id for r in QUERIES["op9_hamming_windows"](spark, small).collect()}      # itself held against brute force
    kept -= leaked
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = defaultdict(list)
    for r in corpus_pipeline.run(spark, small).collect():
        rows[r.doc_id].append(r)
    assert set(rows) == kept
    for i, pieces in rows.items():
        text = redact_text(texts[i].encode()) or texts[i]
        tokens = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and zlib.crc32(tokens[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(tokens)


def test_stages_take_odd_rows(spark, odd, nothing, small, odd_rows):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.pack_tokens(spark, docs, small).where("start = 0").count() == docs.count()
    near = corpus_pipeline.drop_near_copies(spark, odd, small).collect()
    assert len(near) == len({c for _, _, c in expected([(i, r[1]) for i, r in enumerate(odd_rows)])})      # one row of each group
    least = {i for i, _, c in expected([(r[0], r[1]) for r in odd_rows]) if i is not None and i == c}
    assert sorted(r.doc_id for r in near) == sorted(least)
    bare = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "quite another text of words"), (4, "the text with an id")], "doc_id bigint, text string")
    assert corpus_pipeline.drop_near_copies(spark, bare, small).count() == 3


CLASH = "doc_id bigint, text string, found string, root int, fingerprint string, fp long, h long, id int, key string, doc int"


def test_unlike_texts_of_one_id_stay(spark, small):
    words = ["harbour lights and gulls over the cold pier at dawn", "seven bakers bake their bread before the town is up", "a ledger kept by hand holds every coin that left",
             "no rain fell on the vineyard from june until october", "the violin was built by a carpenter who could not play", "glass cools slowly or it cracks along a hidden line", "wolves came down to the village in that winter"]
    rows = [(1 if i < 4 else None, t, "x", 1, "y", 2, 3, 4, "z", 5) for i, t in enumerate(words)]
    docs = spark.createDataFrame(rows, CLASH)
    out = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert sorted(out.collect(), key=str) == sorted(docs.collect(), key=str) and out.columns == docs.columns
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(0, words[0], *rows[0][2:])], CLASH))
    kept = corpus_pipeline.drop_near_copies(spark, twice, small).collect()
    assert len(kept) == 7 and {r.doc_id for r in kept if r.text == words[0]} == {0}


def test_only_texts_that_hold_a_passage_go(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("text").where("size(split(text, ' ')) > 20").first()[0]
    clean = [f"clean words number {i} about gardens and slow rivers in the north of the country" for i in range(5)]
    rows = [(None if i < 3 else 7, t, "x", 1, "y", 2, 3, 4, "z", 5) for i, t in enumerate(clean)]
    bad = [(None, "before it " + item + " after it", *rows[0][2:]), (7, item, *rows[0][2:])]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows + bad, CLASH), small)
    assert sorted(r.text for r in out.collect()) == clean
