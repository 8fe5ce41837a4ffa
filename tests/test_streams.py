import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import metrics, series
from frameledger.plans import CHECKS, QUERIES, streams
from frameledger.sources.durable import scratch_path
from frameledger.streaming import accumulators as A

C = F.col


def test_accumulator_equals_the_batch_document(spark, tiny):
    rows = streams._as_records(spark.read.parquet(f"{tiny}/events.parquet")).selectExpr("*", "0.5d det_conf", "cast(null AS double) box_iou")
    doc = metrics.evaluation_document(rows.withColumn("clip", C("clip").cast("string"))).first()
    got = streams.stream_accumulator(spark, tiny).first()
    assert got.n_frames == doc.n_frames and got.n_clips == doc.n_clips
    assert got.frame_top1 == pytest.approx(doc.frame.cls_top1, abs=1e-6) and got.clip_top1 == pytest.approx(doc.clip.cls_top1, abs=1e-6)


def test_running_totals_over_many_batches(spark):
    path = scratch_path(spark, "in")
    spark.range(100).selectExpr("id % 3 AS k", "cast(id AS double) v", "1 w").repartition(5).write.parquet(path)
    src = spark.readStream.schema("k long, v double, w int").option("maxFilesPerTrigger", 1).parquet(path)
    out = {r.k: (r.avg, r.n) for r in A.drain(A.running_meter(src, "k", "v", "w"), "complete", "m").collect()}
    assert out[0] == (pytest.approx(49.5), 34) and out[1][1] == 33


def test_windowed_best_is_whole(spark, tiny):
    exact = streams.stream_best_per_day(spark, tiny)
    whole = streams.stream_best_windowed(spark, tiny)
    assert exact.exceptAll(whole).count() == whole.exceptAll(exact).count() == 0


@pytest.mark.parametrize("name", ["stream_best_per_day", "stream_best_windowed"])
def test_best_of_large_ids_matches_sql(spark, tmp_path, name):
    """Ids far above the steps of the values: the sharpest row wins, then the least id."""
    rows = [(k * 3_000_000_000 + i, f"2024-01-0{1 + i % 3} 05:00:00", i % 2, round(7.0 + k * 0.01 + (i % 5 == k) * 0.01, 2) if i else None) for k in range(4) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", C("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    best = {}
    for e, ts, u, v in rows:
        if v is not None:
            best.setdefault((u, ts[:10]), []).append((-v, e))
    want = sorted((*k, min(v)[1], -min(v)[0]) for k, v in best.items())
    cols = ("clip", "day", "event_id", "sharp")
    assert sorted(tuple(r[c] for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
    assert sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({CHECKS[name]})").fetchall()) == want


def folder(spark, steps):
    """One file a step, in order of time, as a stream source of one file a batch."""
    path = scratch_path(spark, "steps")
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(steps[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_counted(spark):
    steps = [["2024-01-01 05:00:00", "2024-01-09 05:00:00"], ["2024-01-10 05:00:00"], ["2024-01-01 06:00:00", "2024-01-10 07:00:00"]]
    rows = [spark.createDataFrame([(1, t, 10 * k + i, 1.0 + k) for i, t in enumerate(step)], "clip long, ts string, idx long, sharp double") for k, step in enumerate(steps)]
    days, read = A.drain_to_end(folder(spark, rows), lambda r: A.best_per_day(r, "clip", "idx", "sharp"), "ts", "late")
    assert A.late_rows(days, read).first() == (5, 1)
    assert sorted(r.idx for r in days.collect()) == [0, 1, 21]


@pytest.mark.parametrize("seed", range(3))
def test_improvements_in_any_order_of_arrival(spark, seed):
    """Shuffled epochs over many files and small Arrow batches, some sent twice, give what the ordered run gives; a gap holds the rest back."""
    rng = np.random.default_rng(seed)
    scores = {run: np.round(rng.normal(size=60), 3).tolist() for run in "abc"}
    rows = [(run, e, s) for run, v in scores.items() for e, s in enumerate(v) if (run, e) != ("c", 40)]
    rows = [rows[i] for i in rng.permutation(len(rows))] + rows[:7]
    schema = "run string, epoch int, score double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        out = A.drain(A.best_so_far(folder(spark, [spark.createDataFrame(rows[i : i + 40], schema) for i in range(0, len(rows), 40)])), "append", "any", provider=A.ROCKS).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    want = []
    for run, v in scores.items():
        best = float("-inf")
        for e, s in enumerate(v[:40] if run == "c" else v):
            if s > best:
                best = s
                want.append((run, e, s))
    assert sorted((r.run, r.epoch, r.score) for r in out) == sorted(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_streamed_document_equals_the_batch_one(spark, tiny):
    rows = streams._scored(spark.read.parquet(f"{tiny}/events.parquet"))
    want = metrics.evaluation_document(rows).first().asDict(True)
    parts = [rows.where(C("ts") < "2024-01-05"), rows.where("ts >= '2024-01-05' AND day(ts) % 2 = 0"), rows.where("ts >= '2024-01-05' AND day(ts) % 2 = 1")]
    stream = folder(spark, parts)
    cells, read = A.drain_to_end(stream, lambda r: A.running_cells(r, late="400 days"), "ts", "doc")
    got = metrics.from_cells(A.merged_cells(cells)).first().asDict(True)

    def same(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == pytest.approx(b) if isinstance(a, float) else a == b

    assert same(got, want) and read["rows"] == rows.count()


def test_memory_of_signatures_is_bounded(spark):
    """Repeats within the bound go; a repeat beyond it is new again, since its first row is forgotten."""
    at = lambda *rows: spark.createDataFrame([(s, t) for s, t in rows], "sig string, ts string")
    steps = [at(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:00:00")), at(("a", "2024-01-01 20:00:00"), ("c", "2024-01-05 00:00:00")),
             at(("d", "2024-01-05 01:00:00")), at(("a", "2024-01-05 02:00:00"), ("c", "2024-01-05 03:00:00"))]
    once, read = A.drain_to_end(folder(spark, steps), lambda r: A.first_seen(r, ["sig"]), "ts", "seen")
    assert sorted(r.sig for r in once.collect()) == ["a", "a", "b", "c", "d"]
    assert read["state"] < 5


def test_series(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("a", 2, 0.3), ("a", 3, 0.4)], "run string, epoch int, score double")
    assert [r.is_best for r in series.best_so_far(df).orderBy("epoch").collect()] == [True, True, False, True]
    lr = [r[0] for r in spark.range(0, 6000).select(series.learning_rate(C("id"), 100)).collect()]
    assert lr[0] == pytest.approx(1e-6) and max(lr) == pytest.approx(3e-4) and lr[-1] == pytest.approx(3e-6, rel=1e-2)
    log = spark.createDataFrame([(0, 1.0, None, 5), (1, 0.5, 0.7, 5)], "epoch int, `train/loss` double, `val/top1` double, `train/n_annotated` int")
    assert {(r.epoch, r.part, r.name, r.value) for r in series.curves(log, ["epoch"]).collect()} == {
        (0, "train", "loss", 1.0), (1, "train", "loss", 0.5), (1, "val", "top1", 0.7)}
