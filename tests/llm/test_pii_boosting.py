"""Base spans against Python's regular expressions, places of many matches, the trees' two forms, and what is added."""

import hashlib
import re

import numpy as np
import pytest

from frameledger.llm import pii_boosting as pb

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def brute(text):
    """Counts, digest and list of the base spans."""
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    joined = ",".join(f"{pb.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*[sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest(), joined)


def values(row):
    return (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"], row["base_sha256"], row["spans"])


CASES = [
    None, "", "a@b.c", "a@b.c_d@e.f", "a@b.c.@d.e x@y@z.q", "é@b.c ab@cd. ab@.cd @b.c a@b", "x.y%z+1@mail-2.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111x 41111111111111111111111 4111 1111  1111 1111", "+1 (605) 555-9305 4078918989542222", "+49 30 901820 and +1.2 ++44 (20) 7946-0958)", "+1((((((((((((((",
    "😀 +1 (605) 555-9305 日本 a@b.co 10.0.0.1", "7" * 50_000, "1 " * 30_000, "a" * 20_000, "a." * 6000 + "@b.c", "a@" + "b." * 30_000, "+" * 5000 + "1" * 12, "1.1.1.1 " * 5000 + "a@b.c",
]


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: values(r) for r in pb.find_personal_data(frame, None).collect()}
    for i, text in enumerate(CASES):
        assert got[i] == brute(text), (text or "")[:60]


@pytest.fixture(scope="module")
def model(spark, small):
    return pb.fit(spark.read.parquet(f"{small}/documents.parquet"))


def test_documents_keep_their_base_spans(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pb.find_personal_data(docs, model).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert values(r)[:5] == want[:5] and set(filter(None, want[5].split(","))) <= set(r["spans"].split(","))
        assert len(list(filter(None, r["spans"].split(",")))) == sum(want[:4]) + r["n_added"]


def test_looser_spellings_are_added_and_look_alikes_are_not(spark, model):
    loose = ["please write to mail jane.doe (at) example (dot) org today", "call (415) 555-2671 before noon", "ssn 219-09-9999 on file", "phone: 04155552671 is hers"]
    plain = ["look at this. Then go", "on 2019-03-12 11 it rained", "isbn 978-12-345-67-0 is out", "at 10:20:30:40 it ended", "rain 12/03/1998 2044 fell"]
    frame = spark.createDataFrame(list(enumerate(loose + plain)), "doc_id int, text string")
    added = {r["doc_id"]: r["n_added"] for r in pb.find_personal_data(frame, model).collect()}
    assert sum(added[i] > 0 for i in range(len(loose))) >= 3
    assert sum(added[i] > 0 for i in range(len(loose), len(loose + plain))) == 0


def test_most_documents_without_personal_data_stay_clean(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = pb.find_personal_data(docs, model).where("n_email + n_ip + n_card + n_phone = 0").select("n_added").collect()
    assert sum(r["n_added"] > 0 for r in rows) <= 0.01 * len(rows)


def test_overlap_is_found_by_search(spark):
    base = [{"a": 5 * i, "b": 5 * i + 3, "v": ""} for i in range(37)]
    probes = [(a, a + n) for a in range(0, 190, 1) for n in (1, 2, 9)]
    frame = spark.createDataFrame([(base, [{"a": a, "b": b} for a, b in probes]), ([], [{"a": 1, "b": 2}])], "email array<struct<a:bigint,b:bigint,v:string>>, c array<struct<a:bigint,b:bigint>>")
    got = [list(r[0]) for r in frame.selectExpr(f"transform(c, e -> {pb._overlaps('email')})").collect()]
    want = [any(s["a"] < b and a < s["b"] for s in base) for a, b in probes]
    assert sorted(got, key=len) == [[False], want]


def test_trees_score_alike_in_sql_and_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (800, 5)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 3)).astype(float)
    start, trees = pb.grow(x, y, 12, 3, 0.3)
    model = pb.Boosted({"number": start}, {"number": trees}, {"number": 0.0})
    score = model.score("number", x)
    assert ((score > 0) == (y > 0)).mean() > 0.97
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, f array<double>").selectExpr("i", "struct(f) as e").selectExpr("i", f"{model.sql('number')} as s")
    assert np.allclose([r["s"] for r in frame.orderBy("i").collect()], score)


def test_odd_rows(spark, odd, odd_rows, nothing, model):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r["doc_id"], *values(r)) for r in pb.find_personal_data(odd, model).collect()), key=key)
    assert [g[:6] for g in got] == [w[:6] for w in sorted(((r[0], *brute(r[1])) for r in odd_rows), key=key)]
    assert pb.find_personal_data(nothing, model).count() == 0
    assert pb.fit(nothing) is None and pb.find_personal_data(odd, None).count() == len(odd_rows)


def test_runs_without_python(spark, small, model):
    plan = pb.find_personal_data(spark.read.parquet(f"{small}/documents.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
