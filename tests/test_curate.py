import pytest
from pyspark.sql import Window as W, functions as F

from frameledger.operators import curate, ranking

C = F.col


def test_tree_paths(spark):
    good = ["/a/31_lee/data/set/G01_call/clip01/rgb/frame_007.png", "/a/s2/G10_three/clip02/annotation/FRAME_012.JPG"]
    bad = ["/a/s2/G10_three/clip02/rgb/.DS_Store", "/a/s2/G11_no/clip02/rgb/frame_001.png", "/a/s2/G01_call/take1/rgb/frame_001.png",
           "/a/s2/G01_call/clip01/rgb/frame_1.gif"]
    rows = curate.parse_tree_path(spark.createDataFrame([(p,) for p in good + bad], "path string"), "/a").orderBy("frame").collect()
    assert [(r.subject, r.gesture, r.clip, r.kind, r.frame) for r in rows] == [
        ("31_lee", "G01_call", "clip01", "rgb", 7), ("s2", "G10_three", "clip02", "annotation", 12)]


def test_subject_below_the_root_and_long_numbers(spark):
    paths = [f"file:/root/{s}/dataset/G01_call/clip01/rgb/frame_{n}.png" for s in ("s1", "s2") for n in ("1", "12345678901", "170000000000000000")]
    got = curate.parse_tree_path(spark.createDataFrame([(p,) for p in paths], "path string"), "file:///root/")
    assert sorted((r.subject, r.frame) for r in got.collect()) == [(s, n) for s in ("s1", "s2") for n in (1, 12345678901, 170000000000000000)]
    long = spark.createDataFrame([("/r/s/G01_call/clip01/rgb/frame_" + "9" * 30 + ".png",), ("/r/s/G01_call/clip01/rgb/frame_2.png",), ("/r/s/x.txt",)], "path string")
    assert [r.frame for r in curate.parse_tree_path(long, "/r").collect()] == [2]
    assert [r.problem for r in curate.rejected_frames(long).collect()] == ["frame number beyond 64 bits"]


def test_video_names(spark):
    names = ["G01_call_clip02.mov", "G01_callclip03.MP4", "G02_call.MOV", "G12_ROCK.mov", "G01_wave_clip02.mov", "G02_wave.mov", "notes.txt"]
    got = {r.name: (r.gesture, r.clip) for r in curate.parse_video_name(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {"G01_call_clip02.mov": ("G01_call", "clip02"), "G01_callclip03.MP4": ("G01_call", "clip03"),
                   "G02_call.MOV": ("G01_call", "clip02"), "G12_ROCK.mov": ("G08_rock", "clip12")}


def test_keys_and_labels(spark):
    k = curate.record_keys(F.lit("s"), F.lit("G02_dislike"), F.lit("c"), F.lit(7))
    r = spark.range(1).select(*[v.alias(n) for n, v in k.items()], curate.encode_label(F.lit("G02_dislike")).alias("a"), curate.encode_label(F.lit("x")).alias("b")).first()
    assert (r.id, r.stem, r.clip_key, r.a, r.b) == ("s/G02_dislike/c/007", "s__G02_dislike__c__f007", "s/G02_dislike/c", 1, None)


@pytest.fixture(scope="module")
def frames(spark):
    return spark.range(600).selectExpr("id AS oid", "concat('s', id % 12) AS subject", "cast(id % 10 AS int) AS cls")


def test_holdout_keeps_contributors_whole(frames):
    s = curate.holdout_splits(frames, 3, 1)
    rows = {r.subject: r.split for r in s.collect()}
    assert len(rows) == 12 and list(rows.values()).count("val") == 3
    assert rows == {r.subject: r.split for r in curate.holdout_splits(frames.repartition(7), 3, 1).collect()}
    assert rows != {r.subject: r.split for r in curate.holdout_splits(frames, 3, 2).collect()}
    both = frames.join(s, "subject").groupBy("subject").agg(F.count_distinct("split").alias("n"))
    assert both.filter("n > 1").count() == 0
    assert curate.holdout_splits(frames, 0, 1).filter("split = 'val'").count() == 0
    with pytest.raises(ValueError, match="no contributor"):
        curate.holdout_splits(frames, 12, 1)


def test_strict_and_lenient(spark, frames):
    some = spark.createDataFrame([("s1", "train"), ("s2", "val")], "subject string, split string")
    assert curate.strict_split(frames, some, "train").count() == 50
    assert curate.lenient_split(frames, some, "train").count() == 550
    with pytest.raises(ValueError, match=r"'test' is empty; the index holds \['train', 'val'\]"):
        curate.strict_split(frames, some, "test")
    with pytest.raises(ValueError, match="no split"):
        curate.dispatch_splits({"train": None}, {})


def test_signature_is_order_free_and_sees_every_file(spark):
    files = [("a", "x", 1), ("a", "y", 2), ("b", "y", 2), ("b", "x", 1), ("c", "x", 1), ("d", "x", 1), ("d", "y", 3), ("b", ".DS_Store", 9)]
    df = spark.createDataFrame(files, "subject string, path string, size long")
    sig = {r.subject: r.signature for r in curate.subject_signature(df, "subject", "path", "size").collect()}
    assert sig["a"] == sig["b"] and len(set(sig.values())) == 3
    d = {r.subject: (r.identical_to, r.kept) for r in curate.duplicate_contributors(curate.subject_signature(df, "subject", "path", "size")).collect()}
    assert d["b"] == ("a", False) and d["a"] == ("a", True) and d["c"][1]


def test_content_option_tells_equal_sizes_apart(spark):
    df = spark.createDataFrame([("a", "x", 1, b"1"), ("b", "x", 1, b"2")], "subject string, path string, size long, body binary")
    by_size = curate.subject_signature(df, "subject", "path", "size").select("signature").distinct().count()
    by_body = curate.subject_signature(df, "subject", "path", "size", "body").select("signature").distinct().count()
    assert (by_size, by_body) == (1, 2)


def test_batches(frames):
    b = curate.batches(frames, 64, 3, "oid", drop_last=True).groupBy("batch").count().collect()
    assert len(b) == 9 and {r["count"] for r in b} == {64}
    assert curate.batches(frames, 64, 3, "oid", drop_last=False).select("batch").distinct().count() == 10
    one = {r.oid: r.batch for r in curate.batches(frames, 64, 3, "oid", False).collect()}
    assert one == {r.oid: r.batch for r in curate.batches(frames.repartition(3), 64, 3, "oid", False).collect()}


def test_corrections_and_layers(spark):
    f = spark.range(5).selectExpr("id AS frame_id")
    c = spark.createDataFrame([(0, "drop"), (1, "mask"), (2, "point")], "frame_id long, kind string")
    got = {r.frame_id: (r.source, r.backend) for r in curate.apply_corrections(f, c, "frame_id", "bgsub").collect()}
    assert got == {1: ("mask", "manual"), 2: ("point", "bgsub"), 3: ("backend", "bgsub"), 4: ("backend", "bgsub")}
    lay = spark.createDataFrame([("e", 0, "lr", "1"), ("e", 1, "lr", None), ("e", 0, "p", "a"), ("e", 2, "p", "b"), ("e", 2, "odd", "1")], "run string, layer int, k string, v string")
    assert {r.k: r.v for r in curate.resolve_layers(lay).collect()} == {"lr": "1", "p": "b", "odd": "1"}
    assert [r.k for r in curate.unknown_keys(lay, ("lr", "p")).collect()] == ["odd"]


def test_configuration_chain_and_cycle(spark):
    cfg = spark.createDataFrame([("base", None), ("e1", "base"), ("e3", "e1")], "name string, extends string")
    got = {(r.name, r.ancestor, r.depth) for r in curate.extends_chain(cfg).collect()}
    assert ("e3", "base", 2) in got and len(got) == 6
    deep = spark.createDataFrame([(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(151)], "name string, extends string")
    assert curate.extends_chain(deep).where("name = 'c150'").agg(F.max("depth"), F.count("*")).first()[:] == (150, 151)
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, extends string")
    with pytest.raises(Exception, match="extends itself"):
        curate.extends_chain(loop).collect()


def test_row_numbers_of_a_hot_group_equal_the_window(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 40) END AS k", "(id * 7919) % 5000 AS v", "id")
    got = ranking.bucketed_row_number(df, ["k"], F.floor(C("v") / 500), ["v", "id"], "rn", "total")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("v", "id"))).withColumn("t", F.count("*").over(W.partitionBy("k")))
    j = got.join(want.select("id", "w", "t"), "id")
    assert j.count() == 5000 and j.filter("rn <> w OR total <> t").count() == 0


def test_bounded_parts_cut_a_hot_key(spark):
    df = spark.range(10000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 30) END AS k", "cast(id AS string) AS id")
    sizes = [r["count"] for r in ranking.bounded_parts(df, ["k"], "id", 500).groupBy("k", "part").count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 10000
