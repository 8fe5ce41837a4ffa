"""Running metrics with Structured Streaming.

Streams are read from files, keep only sums, counts, short waiting lists or one best row per key as state, and write to
files. State that belongs to a stretch of time goes when the watermark passes it; a bounded run is brought to its end by
one closing row behind all others in time, which the watermark follows and no result holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from frameledger.functions.numeric import flag, ratio_or_zero
from frameledger.operators import metrics
from frameledger.sources.durable import scratch_path

C = F.col


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream over a Parquet file or folder with the schema it already has.

    The path is passed as a pattern, because a streaming source takes a single file only that way.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


#: Later than every row; the time of the row that closes a bounded run.
END = "9999-01-01 00:00:00"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_store(spark: SparkSession, name: str | None):
    """Streams that start inside use this state store; the session's own choice stands again afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    if name:
        spark.conf.set(_PROVIDER, name)
    try:
        yield
    finally:
        if name:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, mode: str, sink: str, checkpoint: str, provider: str | None = None) -> dict[str, int]:
    """Run a stream over everything available into files. Returns rows read, and the most rows of state held at once.

    Append output is a plain file sink (exactly once). Other output is written per batch, under its number.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", sink)
    else:
        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")      # a retried batch replaces itself

        writer = writer.foreachBatch(store)
    with _state_store(stream.sparkSession, provider):
        query = writer.start()
        query.awaitTermination()
    done = query.recentProgress
    return {"rows": sum(p.numInputRows for p in done), "state": max((o.numRowsTotal for p in done for o in p.stateOperators), default=0)}


def drain(stream: DataFrame, mode: str, label: str, checkpoint: str | None = None, sink: str | None = None, keys: Iterable[str] = (), provider: str | None = None) -> DataFrame:
    """Run a stream over everything available and read the result back. Passing an old `checkpoint` and `sink` resumes.

    Complete output: the highest batch is the current result. Update output: the latest row of each of `keys`.
    """
    spark = stream.sparkSession
    sink = sink or scratch_path(spark, f"{label}-sink")
    run(stream, mode, sink, checkpoint or scratch_path(spark, f"{label}-state"), provider)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(sink)
    every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(sink)
    if mode == "update":
        rest = [c for c in stream.columns if c not in set(keys)]
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_now")).select(*keys, "_now.*")
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch", "left_semi").drop("batch")    # one row


def drain_to_end(rows: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str, label: str) -> tuple[DataFrame, dict[str, int]]:
    """Run `build(rows)` over everything available and then close what it holds open: (result, rows read and most state).

    `build` gets the rows with one more source behind them and must set a watermark on `ts` and keep only rows before END.
    First the rows alone are drained; then a row at END moves the watermark past all state, which leaves as it would have
    with later data.
    """
    spark = rows.sparkSession
    folder, sink, state = (scratch_path(spark, f"{label}-{part}") for part in ("close", "sink", "state"))
    schema = rows.schema
    spark.createDataFrame([], schema).coalesce(1).write.parquet(folder)
    out = build(rows.unionByName(spark.readStream.schema(schema).parquet(folder)))
    first = run(out, "append", sink, state)
    last = spark.range(1).select(*[F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema])
    last.write.mode("append").parquet(folder)
    run(out, "append", sink, state)
    return spark.read.schema(out.schema).parquet(sink), first


def clip_sums(records: DataFrame, clip: str = "clip") -> DataFrame:
    """Streaming state of the metric accumulator: sums and counts per clip."""
    return records.groupBy(clip).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(C("gt") == C("pred"))).alias("ok"), F.sum("conf").alias("conf"))


def summary(sums: DataFrame) -> DataFrame:
    """Both grains from the per-clip sums, at any moment of the stream."""
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_frames"), F.count(F.lit(1)).alias("n_clips"),
                    ratio_or_zero(F.sum("ok"), F.sum("n")).alias("frame_top1"),
                    F.coalesce(F.avg(C("ok") / C("n")), F.lit(0.0)).alias("clip_top1"),
                    ratio_or_zero(F.sum("conf"), F.sum("n")).alias("mean_conf"))


def running_meter(values: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return values.groupBy(key).agg((F.sum(C(value) * C(weight)) / F.sum(weight)).alias("avg"), F.sum(weight).alias("n"))


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows with a watermark; the closing row moves it, but goes no further."""
    return rows.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, late).filter(C(ts) < F.lit(END).cast("timestamp"))


def running_cells(records: DataFrame, ts: str = "ts", gap: str = "1 day", late: str = "1 day") -> DataFrame:
    """The metric accumulator as a stream: sums and counts of box, mask, class and detector scores per clip, truth and prediction.

    A clip's rows make sessions that merge when rows come between them; a session is final, and its state goes, once the
    watermark is `gap` past its last row. `metrics.from_cells` of `merged_cells` is the evaluation document.
    """
    return metrics.cells(_timed(records, ts, late), (F.session_window(ts, gap),)).drop("session_window")


def merged_cells(cells: DataFrame) -> DataFrame:
    """One row per clip, truth and prediction from those of all its sessions."""
    keys = ("clip", "gt", "pred")
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cells.columns if c not in keys])


def first_seen(rows: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first row of each key; a key is remembered for `within` after its first row, so that state does not grow for ever.

    Repeats further apart than that count as new.
    """
    return _timed(rows, ts, within).dropDuplicatesWithinWatermark(keys)


def best_per_day(frames: DataFrame, clip: str, idx: str, sharp: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Best frame per clip and day, one row of state each; rows that come after their day is closed are dropped.

    `n_rows` is the number of rows of the clip and day.
    """
    return (_timed(frames, ts, late).groupBy(C(clip), F.window(ts, "1 day").alias("day"))
            .agg(F.max_by(idx, F.struct(C(sharp), -C(idx))).alias(idx), F.max(sharp).alias(sharp), F.count(F.lit(1)).alias("n_rows")))


def late_rows(days: DataFrame, read: dict[str, int]) -> DataFrame:
    """(n_rows, n_late) in one row: what the stream read, and how much of it no day holds (late, or without a time)."""
    return days.agg(F.lit(read["rows"]).cast("long").alias("n_rows"), (F.lit(read["rows"]) - F.coalesce(F.sum("n_rows"), F.lit(0))).cast("long").alias("n_late"))


class BestScore(StatefulProcessor):
    """Emits a row for every strict improvement of a run, in the order of epochs whatever order they come in.

    Epochs are numbered without gaps from `first` on. One whose predecessors are not all in waits in the state; an epoch
    that was already counted, or already waits, is ignored.
    """

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "epoch int, score double")          # the next epoch, the best score so far
        self.waiting = handle.getListState("waiting", "epoch int, score double")

    def handleInputRows(self, key, rows, timerValues):
        # Only what waits is kept over chunks of a batch; each list is bounded by the epochs that are out of order.
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["epoch", "score"])
        now, best = self.at.get() if self.at.exists() else (self.first, float("-inf"))
        for chunk in rows:
            held = pd.concat([held, chunk[["epoch", "score"]]], ignore_index=True) if len(held) else chunk[["epoch", "score"]]
            held = held[held["epoch"] >= now].drop_duplicates("epoch").sort_values("epoch", ignore_index=True)
            ready = held["epoch"].to_numpy() == now + held.index.to_numpy()
            part, held = held[ready], held[~ready]
            if len(part):
                before = part["score"].cummax().shift(fill_value=float("-inf")).clip(lower=best)
                better = part[part["score"] > before]
                now, best = now + len(part), max(best, float(part["score"].max()))
                yield better.assign(run=key[0])[["run", "epoch", "score"]]
        self.at.update((int(now), float(best)))
        if len(held):
            self.waiting.put([(int(e), float(s)) for e, s in held.itertuples(index=False)])
        elif self.waiting.exists():
            self.waiting.clear()

    def close(self) -> None:
        pass


def best_so_far(epochs: DataFrame, first: int = 0) -> DataFrame:
    """Improvements as a stream, epochs in any order. Run it with `provider=ROCKS`."""
    return epochs.groupBy("run").transformWithStateInPandas(
        BestScore(first), outputStructType="run string, epoch int, score double", outputMode="Append", timeMode="None")
