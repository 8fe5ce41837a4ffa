import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from frameledger.operators import compare
from frameledger.sources import readers, writers
from frameledger.sources.durable import cut_lineage, scratch_path, shared_root

C = F.col


@pytest.fixture()
def folder(spark):
    path = f"/tmp/spark-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_frame_tree(spark, folder):
    n = 0
    for s in ("s1", "s2", "s3/wrap/inner"):
        for g in ("G01_call", "G02_dislike", "other"):
            for c in ("clip01", "clip02"):
                for k in (1, 2, 3):
                    put(f"{folder}/{s}/{g}/{c}/rgb/frame_{k:03d}.png", b"\x89PNG image")
                    if n % 5:
                        put(f"{folder}/{s}/{g}/{c}/annotation/frame_{k:03d}.png", b"\xff\xd8\xff mask" if n % 7 else "broken")
                    n += 1
    put(f"{folder}/s1/G01_call/clip01/rgb/.DS_Store", "x")
    t = readers.frame_tree(spark, folder, content=True)
    assert t.filter("kind = 'rgb'").count() == 36 and "s3" in {r.subject for r in t.select("subject").distinct().collect()}
    good, bad = readers.readable(t, image=True)
    assert bad.count() > 0 and good.count() + bad.count() == t.count() and "content" not in bad.columns
    assert "content" not in readers.frame_tree(spark, folder).columns


def test_index_document(spark, folder):
    rec = {"id": "a/G01_call/clip01/001", "subject": "a", "gesture": "G01_call", "clip": "clip01", "frame": 1, "rgb": "r", "ann": None, "cls": 0, "box": None, "src_size": [640, 480]}
    put(f"{folder}/index.json", json.dumps({"root": "/d", "packed_size": [512, 384], "split_map": {"a": "val"}, "meta": {"n": 1},
                                            "records": [rec, {**rec, "id": "b", "subject": "b", "ann": "m", "box": [1.0, 2.0, 3.0, 4.0]}]}, indent=1))
    rows = {r.subject: r for r in readers.packed_index(spark, f"{folder}/index.json").collect()}
    assert rows["a"].split == "val" and rows["b"].split is None and rows["a"].box is None and rows["b"].box == [1, 2, 3, 4]


def test_result_set_survives_a_broken_file(spark, folder):
    full = {"n_frames": 3, "n_clips": 1, "frame": {"det_acc@0.5": 0.5, "cls_top1": 0.7, "cls_ece": 0.1}, "ci": {"cls_top1": {"mean": 0.7, "lo": 0.6, "hi": 0.8, "n_clips": 1}},
            "reliability": [{"lo": 0, "hi": 1, "n": 3, "conf": 0.5, "acc": 0.7}], "config": {"split": "test", "train_cfg": {"heads": ["cls"]}}}
    put(f"{folder}/e1_rs_test.json", json.dumps(full, indent=1))
    put(f"{folder}/b0_rs_test.json", json.dumps({"n_frames": 3, "frame": {"cls_top1": 0.1, "cls_ece": 0.0}, "method": "classical"}, indent=1))
    put(f"{folder}/bad.json", "{ not json")
    good, bad = readers.result_set(spark, folder)
    assert [r.run for r in bad.collect()] == ["bad"]
    flat = {r.run: r for r in compare.suppress_absent(readers.result_headlines(good)).collect()}
    assert flat["e1_rs_test"].cls_top1_lo == 0.6 and flat["e1_rs_test"].det_acc50 is None      # no detection head
    assert flat["b0_rs_test"].cls_ece is None and flat["b0_rs_test"].cls_top1_lo is None       # placeholder, no interval


def test_epoch_log(spark, folder):
    put(f"{folder}/log.jsonl", '{"epoch": 0, "train/loss": 2.0}\n\n{"epoch": 1, "train/loss": 1.0, "val/top1": 0.5}\n')
    schema = "epoch int, `train/loss` double, `val/top1` double"
    assert readers.epoch_log(spark, f"{folder}/log.jsonl", schema).count() == 2
    put(f"{folder}/empty.jsonl", "\n")
    with pytest.raises(ValueError, match="is empty"):
        readers.epoch_log(spark, f"{folder}/empty.jsonl", schema)


def test_corrections(spark, folder):
    put(f"{folder}/c.json", json.dumps({"a": {"point": [1, 2]}, "b": {"drop": True, "mask": "m"}, "c": {"box": [1, 2, 3, 4]}, "d": {"mask": "m.png", "box": [0, 0, 1, 1]}}))
    assert {r.id: r.kind for r in readers.correction_map(spark, f"{folder}/c.json").collect()} == {"a": "point", "b": "drop", "c": "box", "d": "mask"}


def test_prediction_blanks_and_strict_numbers(spark, folder):
    base = ("SELECT 'i' id, 'r' rgb, 'c' clip, 's' subject, 'g' gesture, 1 frame, 3 gt, 4 pred, 0.12345678d conf, 0.5d det_conf, {m} has_mask, 0.1d mask_area, "
            "1.005d px1, 2d py1, 3d px2, 4d py2, 1d gx1, 2d gy1, 3d gx2, 4d gy2, 0.5d box_iou, 0.4d iou_hand, 0.3d miou, 0.2d dice")
    t = writers.prediction_table(spark.sql(base.format(m="true") + " UNION ALL " + base.format(m="false")))
    assert len(t.columns) == 27
    writers.write_predictions(t, f"{folder}/p")
    rows = readers.prediction_rows(spark, f"{folder}/p").orderBy("has_gt_mask").collect()
    assert rows[0].gt_xmin is None and rows[0].box_iou is None and rows[1].box_iou == 0.5 and rows[1].cls_conf == 0.123457
    nan = spark.sql("SELECT double('NaN') a, 1 b")
    writers.write_documents(nan, f"{folder}/d")
    assert spark.read.json(f"{folder}/d").first().a == 0.0


def test_shared_root_and_checkpoints(spark):
    root = shared_root(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root.rstrip("/"))
    assert cut_lineage(spark.range(5)).count() == 5
