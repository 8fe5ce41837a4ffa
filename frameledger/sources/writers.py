"""Writers. Spark's committer makes each write all-or-nothing; partial output is never visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from frameledger.constants import FILE_METRIC_NAMES, GESTURES
from frameledger.operators.ranking import bounded_parts

C = F.col


def write_index(records: DataFrame, splits: DataFrame, summary: DataFrame, path: str) -> None:
    """Records by split (so that a split filter prunes files), the split map and the summary."""
    placed = records.join(splits, "subject", "left").hint("rebalance", "split")     # even files, hot splits cut
    placed.sortWithinPartitions("id").write.mode("overwrite").partitionBy("split").parquet(f"{path}/records")
    splits.write.mode("overwrite").json(f"{path}/splits")
    summary.write.mode("overwrite").json(f"{path}/meta")


def write_index_document(records: DataFrame, splits: DataFrame, root: str, path: str, per_document: int = 5000) -> None:
    """The index as JSON documents of bounded size, for readers that expect documents.

    A subject's records may take several documents: part tells them apart. Records of subjects without a split stay,
    with a NULL split.
    """
    parts = bounded_parts(records, ["subject"], "id", per_document)
    per = parts.groupBy("subject", "part").agg(
        F.array_sort(F.collect_list(F.struct("id", *[c for c in records.columns if c != "id"]))).alias("records"))
    doc = per.join(splits, "subject", "left").select(
        F.lit(root).alias("root"), F.create_map("subject", "split").alias("split_map"), "part", "records")
    doc.write.mode("overwrite").json(path)


def strict_numbers(df: DataFrame) -> DataFrame:
    """Not-a-number becomes 0.0 at any depth, so that the JSON is strict."""
    return df.select(*[_strict(C(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _strict(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.nanvl(value, F.lit(0.0).cast(kind))
    if isinstance(kind, StructType):
        inner = F.struct(*[_strict(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _strict(x, kind.valueType))
    return value


def write_documents(df: DataFrame, path: str) -> None:
    strict_numbers(df).write.mode("overwrite").json(path)


def write_results(documents: DataFrame, path: str) -> None:
    """Evaluation documents under the metric names that `readers.result_set` reads."""
    def named(block: str) -> Column:
        fields = documents.schema[block].dataType.fieldNames()
        return F.struct(*[C(f"{block}.`{n}`").alias(FILE_METRIC_NAMES.get(n, n)) for n in fields]).alias(block)

    write_documents(documents.withColumns({b: named(b) for b in ("frame", "clip") if b in documents.columns}), path)


def prediction_table(p: DataFrame) -> DataFrame:
    """The 27 per-image columns from scored records; blank where there is no ground truth."""
    names = F.array(*[F.lit(g) for g in GESTURES])
    known = C("has_mask")

    def r(c, digits, only_known=False):
        v = F.round(C(c).cast("double"), digits)
        return F.when(known, v) if only_known else v

    return p.select(
        "id", "rgb", "clip", "subject", "gesture", C("frame").cast("int").alias("frame"), C("gt").alias("gt_class"),
        F.element_at(names, C("gt") + 1).alias("gt_class_name"), C("pred").alias("pred_class"),
        F.element_at(names, C("pred") + 1).alias("pred_class_name"), r("conf", 6).alias("cls_conf"),
        (C("gt") == C("pred")).cast("int").alias("correct"), r("det_conf", 6).alias("det_conf"),
        r("px1", 2).alias("pred_xmin"), r("py1", 2).alias("pred_ymin"), r("px2", 2).alias("pred_xmax"), r("py2", 2).alias("pred_ymax"),
        r("mask_area", 6).alias("pred_mask_area_frac"), known.cast("int").alias("has_gt_mask"),
        r("gx1", 2, True).alias("gt_xmin"), r("gy1", 2, True).alias("gt_ymin"), r("gx2", 2, True).alias("gt_xmax"), r("gy2", 2, True).alias("gt_ymax"),
        r("box_iou", 6, True).alias("box_iou"), r("iou_hand", 6, True).alias("seg_iou_hand"), r("miou", 6, True).alias("seg_miou"),
        r("dice", 6, True).alias("seg_dice"))


def write_predictions(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("emptyValue", "").option("nullValue", "").csv(path, header=True)


def write_comparison(table: DataFrame, path: str) -> None:
    """One CSV file; a comparison has one row per run."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_epochs(epochs: DataFrame, path: str) -> None:
    epochs.write.mode("append").json(path)


def box_documents(index: DataFrame, per_document: int = 5000) -> DataFrame:
    """Boxes by frame id, as map documents of bounded size."""
    return map_documents(index.select("id", "box"), "id", "box", "boxes", per_document)


def map_documents(df: DataFrame, key: str, value: str, out: str, per_document: int = 5000) -> DataFrame:
    """(part, n, map): key/value rows folded into maps of about `per_document` entries."""
    return bounded_parts(df, [], key, per_document).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))


def write_images(images: DataFrame, path: str) -> None:
    """Image bytes pass through unchanged, placed by split and subject part."""
    images.write.mode("overwrite").partitionBy("split").parquet(path)
