"""Exact repeats whose heads have several endings and several lead-ins, against brute force."""

import itertools
import random

from frameledger.llm.sparse_suffixes import repeated_passages

from .test_passages import covered, lowered, slow_cover


def test_heads_with_crossed_sides(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        # One head; A and B share an ending, C and D another, A and C the 15 words before: 50 words from there on.
        middle, ends, leads = fresh(35), [fresh(30), fresh(30)], [fresh(15), fresh(15), fresh(15)]
        for lead, end in ((0, 0), (1, 0), (0, 1), (2, 1)):
            texts.append(fresh(9) + leads[lead] + middle + ends[end] + fresh(9))
    # Boilerplate with many endings and lead-ins, each pair of them once or not at all, and copies of some.
    middle, ends, leads = fresh(33), [fresh(18) for _ in range(9)], [fresh(18) for _ in range(9)]
    for a, b in itertools.product(range(9), range(9)):
        if rng.random() < 0.6:
            for _ in range(rng.choice([1, 1, 3])):
                texts.append(fresh(5) + leads[a][rng.randint(0, 4):] + middle + ends[b][: rng.randint(9, 18)] + fresh(5))
    rng.shuffle(texts)
    docs = list(enumerate(map(" ".join, texts)))
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)).collect()
    held = {i: lowered(t) for i, t in docs}
    assert covered(rows) == slow_cover(held)
    for r in rows:
        if r.kind == "passage":
            assert held[r.doc_id][r.start : r.start + 50] == held[r.other_doc_id][r.other_start : r.other_start + 50]
