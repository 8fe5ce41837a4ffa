"""Rows that are expanded are placed by what they expand to, however small their file is."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import frames, masks
from frameledger.plans import QUERIES
from frameledger.plans import inputs as I
from frameledger.sources.durable import shared_root

FRAMES = 60_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("placement"))
    spark.range(FRAMES).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size", *[f"'a' AS p_{c}" for c in ("name", "brand", "type", "container")]).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/part.parquet")
    return path


def test_a_small_file_of_many_frames_is_spread(spark, folder):
    for rows, expand in ((I.px(spark, folder), 256), (I.heat(spark, folder), 108)):
        parts = rows.select("frame_id").rdd.getNumPartitions()
        assert FRAMES * expand * 64 / parts <= 32 << 20


@pytest.mark.parametrize("name", ["wrist_cut", "gather_cells"])
def test_one_row_a_frame_is_joined_in_its_task(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_no_join_of_components_goes_through_the_driver(spark, folder, monkeypatch):
    """Pixels that come from a small file are expected to be few; still no table of them is broadcast."""
    plans, cut = [], masks.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(masks, "cut_lineage", noted)
    px = I.grid(I.table(spark, folder, "part").where("p_partkey < 500").selectExpr("p_partkey AS frame_id"), 4, 4)
    out = masks.components_by_joins(px, (F.col("frame_id") + F.col("x") * 3 + F.col("y")) % 4 < 2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.select("frame_id").distinct().count() == 500
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_components_store_parts_and_neither_runs_nor_pixels(spark, folder):
    """The shared folder gets a few bytes a frame, however many runs its mask has and however many rounds there are."""
    def size():
        root = shared_root(spark).removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)

    before, frames = size(), 3000
    px = I.grid(I.table(spark, folder, "part").where(f"p_partkey < {frames}").selectExpr("p_partkey AS frame_id"), 16, 16)
    out = masks.components_by_joins(px, (F.col("frame_id") + F.col("x") * 3 + F.col("y") * 5) % 7 < 4)
    assert out.select("frame_id").distinct().count() == frames
    assert size() - before < 400 * frames


def test_slices_of_frames_do_not_grow_with_the_rows_of_a_task(spark, folder):
    """What the kernels of orientation_features, skin_bands and camera_policy hold follows from the pixels of a slice."""
    def size(f):
        return {"frame_id": f.ids, "n_px": np.full(len(f.ids), len(f.ids) * f.w * f.h)}

    for side in (8, 16):
        got = frames.over(I.image_rows(spark, folder, side, side).coalesce(1), size, "frame_id bigint, n_px bigint").agg(F.max("n_px"), F.count("*")).first()
        assert got[0] <= 1 << 17 and got[1] == FRAMES
