"""Readers. Every schema is explicit: result files vary, so nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameledger.constants import FILE_METRIC_NAMES
from frameledger.operators.curate import parse_tree_path

C = F.col

RECORD = ("id string, subject string, gesture string, clip string, frame int, rgb string, ann string, cls int, "
          "box array<double>, src_size array<int>")
_METRICS = ["det_acc@0.5", "det_acc@0.75", "det_acc@0.9", "mean_box_iou", "seg_miou", "seg_iou_hand", "seg_iou_bg",
            "seg_dice", "cls_top1", "cls_macro_f1", "cls_ece"]
_BLOCK = ("struct<" + ", ".join(f"`{m}`: double" for m in _METRICS) + ", n_boxes_scored: bigint, n_boxes_skipped: bigint, "
          "n_seg_scored: bigint, n_seg_skipped: bigint, per_class_f1: map<string,double>, per_class_support: map<string,double>>")
RESULT_SCHEMA = (
    f"n_frames bigint, n_clips bigint, frame {_BLOCK}, clip {_BLOCK}, confusion_matrix array<array<bigint>>, "
    "confusion_matrix_clip array<array<double>>, mean_cls_conf double, mean_det_conf double, cls_conf_correct double, "
    "cls_conf_incorrect double, class_names array<string>, iou_thresh double, "
    "reliability array<struct<lo: double, hi: double, n: bigint, conf: double, acc: double>>, "
    "ci map<string, struct<mean: double, lo: double, hi: double, n_clips: bigint>>, "
    "config struct<split: string, train_cfg: struct<heads: array<string>, photometric: string>>, method string, "
    "eval_seconds double, pseudo_target boolean, n_example_failures bigint, _corrupt string")
PREDICTION_SCHEMA = (
    "id string, rgb string, clip string, subject string, gesture string, frame int, gt_class int, gt_class_name string, "
    "pred_class int, pred_class_name string, cls_conf double, correct int, det_conf double, pred_xmin double, pred_ymin double, "
    "pred_xmax double, pred_ymax double, pred_mask_area_frac double, has_gt_mask int, gt_xmin double, gt_ymin double, "
    "gt_xmax double, gt_ymax double, box_iou double, seg_iou_hand double, seg_miou double, seg_dice double")
CORRECTION = "struct<point: array<int>, mask: string, box: array<int>, drop: boolean>"


def _index_schema() -> str:
    record = ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in RECORD.split(", "))
    return (f"root string, packed_size array<int>, split_map map<string,string>, records array<struct<{record}>>, meta map<string,string>")


def frame_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Frame files under a tree. Without `content` only names and sizes are listed, no bytes read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length", *(["content"] if content else [])))
    return parse_tree_path(files, root)


def packed_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Index documents to one row per record, with the split of its subject (NULL if unmapped).

    A file is one document, or with `lines` one document per line (which Spark can split).
    """
    doc = spark.read.schema(_index_schema()).json(path, multiLine=not lines)
    rows = doc.select("root", "split_map", F.explode("records").alias("r"))
    return rows.select("root", "r.*", F.try_element_at("split_map", C("r.subject")).alias("split"))


def result_set(spark: SparkSession, path: str | list[str], run: Column | None = None, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(results keyed by run, unreadable files). A bad file never stops the others.

    The run is the file stem unless another expression over `_metadata` is given.
    """
    key = run if run is not None else F.regexp_replace(C("_metadata.file_name"), r"\.json$", "")
    raw = (spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", glob).json(path).withColumn("run", key))
    # The second test is never true; Spark refuses a scan of the corrupt-record column alone.
    bad = C("_corrupt").isNotNull() | C("n_frames").eqNullSafe(F.lit(-1).cast("long"))
    return raw.filter(~bad).drop("_corrupt"), raw.filter(bad).select("run", "_corrupt")


def result_headlines(results: DataFrame) -> DataFrame:
    """Flat headline columns of result documents; a placeholder calibration error becomes NULL."""
    names = {"det_acc50": FILE_METRIC_NAMES["det_acc50"], "det_acc75": FILE_METRIC_NAMES["det_acc75"], **{m: m for m in _METRICS if "@" not in m}}
    flat = results.select(
        "run", C("config.split").alias("split"), C("config.train_cfg.heads").alias("heads"), "pseudo_target", "n_frames", "n_clips",
        *[C(f"frame.`{src}`").alias(dst) for dst, src in names.items()],
        *[F.try_element_at("ci", F.lit(src))[end].alias(f"{dst}_{end}") for dst, src in names.items() for end in ("lo", "hi")],
        "reliability")
    return flat.withColumn("cls_ece", F.when(C("reliability").isNotNull(), C("cls_ece"))).drop("reliability")


def run_configs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Configuration of every run, keyed by its folder."""
    return (spark.read.schema(schema).json(path, multiLine=True)
            .withColumn("run", F.element_at(F.split(C("_metadata.file_path"), "/"), -2)))


def epoch_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an epoch log; blank lines are ignored, an empty log is an error."""
    rows = spark.read.schema(schema).json(path).filter(C("epoch").isNotNull())
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} is empty")
    return rows


def prediction_rows(spark: SparkSession, path: str) -> DataFrame:
    """Per-image predictions; blanks (no ground truth) are NULL."""
    return spark.read.schema(PREDICTION_SCHEMA).csv(path, header=True, nullValue="", emptyValue="")


def correction_map(spark: SparkSession, path: str) -> DataFrame:
    """One row per corrected frame from a JSON map; the kind with the highest precedence counts."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {CORRECTION}>").alias("m"))
    rows = doc.select(F.explode("m").alias("id", "c"))
    kind = (F.when(C("c.drop"), "drop").when(C("c.mask").isNotNull(), "mask").when(C("c.box").isNotNull(), "box")
            .when(C("c.point").isNotNull(), "point"))
    return rows.select("id", kind.alias("kind"), "c.point", "c.mask", "c.box").filter(C("kind").isNotNull())


def readable(files: DataFrame, content: str = "content", image: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejects with a reason). A broken file never stops the job.

    With `image` the first bytes must be those of a PNG or JPEG file. Spark's file source does not
    list files of zero bytes: an empty mask shows up as an image without a mask instead.
    """
    head = F.hex(F.substring(content, 1, 4))
    ok = C(content).isNotNull() & (F.length(content) > 0)
    if image:
        ok = ok & (head.startswith("89504E47") | head.startswith("FFD8FF"))
    ok = F.coalesce(ok, F.lit(False))
    return files.filter(ok), files.filter(~ok).withColumn("error", F.lit("empty, missing or not an image")).drop(content)
