import math

import pytest
from pyspark.sql import functions as F

from frameledger.functions import boxes

C = F.col


def pair_table(spark, rows):
    cols = [f"{t}{i}" for t in "ab" for i in range(4)]
    return spark.createDataFrame([tuple(map(float, a + b)) for a, b in rows], ", ".join(f"{c} double" for c in cols))


def box(t):
    return [C(f"{t}{i}") for i in range(4)]


def test_overlap_by_hand(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (5, 0, 15, 10)), ((0, 0, 10, 10), (5, 5, 15, 15)),
            ((0, 0, 10, 10), (20, 20, 30, 30)), ((5, 5, 5, 5), (0, 0, 10, 10))]
    got = [r[0] for r in pair_table(spark, rows).select(boxes.iou(box("a"), box("b"))).collect()]
    assert got == pytest.approx([1, 1 / 3, 1 / 7, 0, 0])


def test_generalised_loss_by_hand(spark):
    rows = [((0, 0, 10, 10), (0, 0, 10, 10)), ((0, 0, 10, 10), (2, 2, 8, 8)), ((0, 0, 1, 1), (2, 2, 3, 3))]
    got = [r[0] for r in pair_table(spark, rows).select(boxes.giou_loss(box("a"), box("b"))).collect()]
    assert got == pytest.approx([0, 0.64, 16 / 9])


def test_null_box_gives_null(spark):
    df = spark.sql("SELECT cast(null AS double) AS a0, 0d a1, 1d a2, 1d a3, 0d b0, 0d b1, 1d b2, 1d b3")
    assert df.select(boxes.iou(box("a"), box("b"))).first()[0] is None


def test_radius_keeps_the_overlap(spark):
    df = spark.createDataFrame([(100.0, 100.0), (20.0, 50.0), (0.0, 5.0)], "h double, w double")
    r = [x[0] for x in df.select(boxes.gaussian_radius(C("h"), C("w"))).collect()]
    assert r[0] == pytest.approx(8.17, abs=0.01) and r[2] == 0
    for (h, w), v in zip([(100, 100), (20, 50)], r):
        shifted = (h - v) * (w - v)
        assert shifted / (2 * h * w - shifted) >= 0.7 - 1e-9
        assert (h - 2 * v) * (w - 2 * v) / (h * w) >= 0.7 - 1e-9
        assert h * w / ((h + 2 * v) * (w + 2 * v)) >= 0.7 - 1e-9


def test_decode_by_hand(spark):
    b = boxes.decode_box(*[F.lit(float(v)) for v in (7, 5, 0.25, 0.5)], F.lit(math.log(40.0)), F.lit(math.log(30.0)), 128, 96)
    assert list(spark.range(1).select(*b).first()) == pytest.approx([9, 7, 49, 37])


def test_rotation_by_zero_is_identity_and_clips(spark):
    df = pair_table(spark, [((10, 10, 50, 40), (0, 0, 0, 0))])
    assert list(df.select(*boxes.rotate_corners(box("a"), F.lit(0.0), 100.0, 80.0)).first()) == pytest.approx([10, 10, 50, 40])
    out = list(df.select(*boxes.rotate_corners(box("a"), F.lit(90.0), 100.0, 80.0)).first())
    assert out[0] >= 0 and out[2] <= 100 and out[2] - out[0] >= 1
