import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.constants import GESTURES
from frameledger.operators import metrics

C = F.col
SCHEMA = ("clip string, gt int, pred int, conf double, det_conf double, box_iou double, "
          "iou_hand double, iou_bg double, dice double")


# The scores asserted below follow from these rows. Clip A: 8 of 10 right, B: all, C: 5 of 10.
RECORDS = [
    ("A", 0, 0, 0.9, 0.5, 0.6, None, None, None),
    ("A", 0, 0, 0.9, 0.5, 0.4, 0.31, 0.9, 0.51),
    ("A", 0, 0, 0.9, 0.5, None, 0.32, 0.9, 0.52),
    ("A", 0, 0, 0.9, 0.5, 0.6, 0.33, 0.9, 0.53),
    ("A", 0, 0, 0.9, 0.5, 0.4, 0.34, 0.9, 0.54),
    ("A", 0, 0, 0.9, 0.5, None, None, None, None),
    ("A", 0, 0, 0.9, 0.5, 0.6, 0.36, 0.9, 0.56),
    ("A", 0, 0, 0.9, 0.5, 0.4, 0.37, 0.9, 0.57),
    ("A", 0, 1, 0.4, 0.5, None, 0.38, 0.9, 0.58),
    ("A", 0, 1, 0.4, 0.5, 0.6, 0.39, 0.9, 0.59),
    ("B", 1, 1, 0.9, 0.5, 0.4, None, None, None),
    ("B", 1, 1, 0.9, 0.5, None, 0.41, 0.9, 0.61),
    ("B", 1, 1, 0.9, 0.5, 0.6, 0.42, 0.9, 0.62),
    ("B", 1, 1, 0.9, 0.5, 0.4, 0.43, 0.9, 0.63),
    ("B", 1, 1, 0.9, 0.5, None, 0.44, 0.9, 0.64),
    ("B", 1, 1, 0.9, 0.5, 0.6, None, None, None),
    ("B", 1, 1, 0.9, 0.5, 0.4, 0.46, 0.9, 0.66),
    ("B", 1, 1, 0.9, 0.5, None, 0.47, 0.9, 0.67),
    ("B", 1, 1, 0.9, 0.5, 0.6, 0.48, 0.9, 0.68),
    ("B", 1, 1, 0.9, 0.5, 0.4, 0.49, 0.9, 0.69),
    ("C", 2, 2, 0.9, 0.5, None, None, None, None),
    ("C", 2, 2, 0.9, 0.5, 0.6, 0.51, 0.9, 0.71),
    ("C", 2, 2, 0.9, 0.5, 0.4, 0.52, 0.9, 0.72),
    ("C", 2, 2, 0.9, 0.5, None, 0.53, 0.9, 0.73),
    ("C", 2, 2, 0.9, 0.5, 0.6, 0.54, 0.9, 0.74),
    ("C", 2, 0, 0.4, 0.5, 0.4, None, None, None),
    ("C", 2, 0, 0.4, 0.5, None, 0.56, 0.9, 0.76),
    ("C", 2, 0, 0.4, 0.5, 0.6, 0.57, 0.9, 0.77),
    ("C", 2, 0, 0.4, 0.5, 0.4, 0.58, 0.9, 0.78),
    ("C", 2, 0, 0.4, 0.5, None, 0.59, 0.9, 0.79),
]


@pytest.fixture(scope="module")
def document(spark):
    rec = metrics.coerce_seg(spark.createDataFrame(RECORDS, SCHEMA))
    return metrics.evaluation_document(rec).first()


def test_known_values(document):
    f, c = document.frame, document.clip
    assert (document.n_frames, document.n_clips) == (30, 3)
    assert (f.n_boxes_scored, f.n_boxes_skipped, f.n_seg_scored, f.n_seg_skipped) == (20, 10, 24, 6)
    assert f.det_acc50 == pytest.approx(0.5) and f.mean_box_iou == pytest.approx(0.5)
    assert f.cls_top1 == pytest.approx(23 / 30) and f.cls_macro_f1 == pytest.approx(0.22714097497)
    assert [f.per_class_f1[g] for g in GESTURES[:4]] == pytest.approx([16 / 23, 20 / 22, 10 / 15, 0])
    assert c.cls_top1 == pytest.approx((0.8 + 1 + 0.5) / 3)
    assert (c.n_boxes_scored, c.n_seg_scored) == (3, 3)
    assert sum(map(sum, document.confusion_matrix)) == 30
    assert sum(map(sum, document.confusion_matrix_clip)) == pytest.approx(3)
    assert document.cls_conf_correct == pytest.approx(0.9) and document.cls_conf_incorrect == pytest.approx(0.4)
    seg = [r[6] for r in RECORDS if r[6] is not None]
    assert f.seg_iou_hand == pytest.approx(np.mean(seg)) and f.seg_miou == pytest.approx(np.mean([(s + 0.9) / 2 for s in seg]))


def test_unequal_clips_differ_by_grain(spark):
    rows = [("X", 0, 0)] * 2 + [("Y", 1, 1)] * 3 + [("Y", 1, 0)] * 3
    df = spark.createDataFrame(rows, "clip string, gt int, pred int").selectExpr("*", "0.5d conf", "0.5d det_conf", "cast(null AS double) box_iou")
    d = metrics.evaluation_document(df).first()
    assert d.frame.cls_top1 == pytest.approx(5 / 8) and d.clip.cls_top1 == pytest.approx(0.75)


def test_empty_input_is_zero_never_null(spark):
    d = metrics.evaluation_document(metrics.coerce_seg(spark.createDataFrame([], SCHEMA))).first()
    assert d.n_frames == 0 and d.frame.cls_top1 == 0.0 and d.clip.det_acc50 == 0.0 and d.cls_conf_correct == 0.0
    assert d.confusion_matrix == [[0] * 10] * 10


def test_bad_class_and_half_filled_segmentation_fail(spark):
    bad = spark.createDataFrame([("A", 10, 0)], "clip string, gt int, pred int")
    with pytest.raises(Exception, match="outside the class range"):
        metrics.checked_classes(bad).collect()
    half = spark.createDataFrame([("A", 0.5, None, 0.5)], "clip string, iou_hand double, iou_bg double, dice double")
    with pytest.raises(Exception, match="missing scores"):
        metrics.coerce_seg(half).collect()


# A published ten-class confusion matrix with its own top-1 and macro F1.
MATRIX = [
    [298, 7, 0, 4, 0, 4, 1, 6, 15, 10],
    [0, 317, 2, 7, 1, 0, 1, 1, 16, 0],
    [13, 2, 269, 16, 24, 0, 0, 5, 16, 0],
    [0, 1, 0, 293, 2, 7, 3, 5, 18, 16],
    [0, 0, 4, 17, 288, 0, 5, 3, 28, 0],
    [0, 0, 0, 9, 0, 319, 0, 0, 17, 0],
    [0, 0, 0, 15, 2, 0, 305, 1, 15, 7],
    [12, 1, 1, 9, 0, 4, 1, 287, 15, 15],
    [0, 0, 0, 10, 0, 1, 1, 3, 329, 1],
    [0, 0, 0, 16, 0, 0, 10, 0, 15, 304],
]


def test_published_matrix_reproduces_its_scores(spark):
    rows = [(g, p, n, float(n)) for g, row in enumerate(MATRIX) for p, n in enumerate(row)]
    cm = spark.createDataFrame(rows, "gt int, pred int, n long, w double")
    r = metrics.overall_scores(cm).first()
    assert r.cls_top1 == pytest.approx(0.8721739130434782) and r.cls_macro_f1 == pytest.approx(0.8747285484377615)
    cell = spark.createDataFrame([(f"{g}", g, p, n) for g, p, n, _ in rows if n], "clip string, gt int, pred int, n long").selectExpr(
        "*", "0L n_box", "0d s_iou", "0d s_conf", "0d s_det", "0d hit50", "0d hit75", "0d hit90")
    assert metrics.block_values(cell).first().frame_cls_macro_f1 == pytest.approx(0.8747285484377615)


def test_row_shares_and_meter(spark):
    cm = spark.createDataFrame([(0, 0, 3, 1.0), (0, 1, 1, 1.0)], "gt int, pred int, n long, w double")
    dense = metrics.row_normalised(metrics.dense_confusion(cm))
    assert dense.filter("gt = 0").agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert dense.filter("gt = 5").agg(F.sum("share")).first()[0] == 0
    m = metrics.weighted_mean(spark.sql("SELECT 1 k, 2d v, 3 n UNION ALL SELECT 1, 5d, 1 UNION ALL SELECT 2, 1d, 0"), ["k"], "v", "n")
    assert {r.k: r.avg for r in m.collect()} == {1: pytest.approx(11 / 4), 2: 0.0}


def test_a_hot_clip_changes_nothing(spark):
    """One clip with most rows gives the same document as the definition."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('c', id % 50) END AS clip", "cast(id % 10 AS int) gt",
                                      "cast(CASE WHEN id % 7 = 0 THEN 3 ELSE id % 10 END AS int) pred", "0.5d conf", "0.5d det_conf",
                                      "CASE WHEN id % 4 = 0 THEN null ELSE (id % 100) / 100d END box_iou")
    p = df.toPandas()
    d = metrics.evaluation_document(df).first()
    assert d.clip.mean_box_iou == pytest.approx(p.dropna().groupby("clip").box_iou.mean().mean())
    assert d.clip.cls_top1 == pytest.approx((p["gt"] == p["pred"]).groupby(p["clip"]).mean().mean())
