import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import frames, heatmaps, masks, picking

C = F.col


def pixels(spark, images, name="v"):
    rows = [(i, y, x, int(v)) for i, im in images.items() for y, line in enumerate(im) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"frame_id long, y int, x int, {name} int")


def test_mask_to_box(spark):
    block = np.zeros((10, 12), int)
    block[2:5, 3:8] = 255
    dot = np.zeros((10, 12), int)
    dot[4, 6] = 255
    weak = np.zeros((10, 12), int)
    weak[1, 1] = 60
    px = pixels(spark, {1: block, 2: np.zeros((10, 12)), 3: dot, 4: weak})
    got = {r.frame_id: (r.x1, r.y1, r.x2, r.y2) for r in masks.stats(px, "v").collect()}
    assert got == {1: (3, 2, 8, 5), 2: (None,) * 4, 3: (6, 4, 7, 5), 4: (None,) * 4}
    low = {r.frame_id: r.x1 for r in masks.stats(px, "v", 50).collect()}
    assert low[4] == 1


def test_overlap_scores_with_empty_masks(spark):
    def at(y, x):
        m = np.zeros((4, 4), int)
        m[y:y + 2, x:x + 2] = 255
        return m

    none, full = np.zeros((4, 4), int), np.full((4, 4), 255)
    cases = {0: (at(0, 0), at(1, 1)), 1: (none, none), 2: (none, at(0, 0)), 3: (at(0, 0), none), 4: (full, full)}
    g, p = pixels(spark, {k: v[0] for k, v in cases.items()}, "g"), pixels(spark, {k: v[1] for k, v in cases.items()}, "p")
    st = masks.pair_stats(g.join(p, ["frame_id", "y", "x"]), "g", "p")
    sc = masks.overlap_scores(C("inter"), C("n_gt"), C("n_pr"), C("n_px"))
    rows = st.select("frame_id", *[v.alias(k) for k, v in sc.items()]).orderBy("frame_id").collect()
    assert [r.iou_hand for r in rows] == pytest.approx([1 / 7, 1, 0, 0, 1])
    assert [r.dice for r in rows] == pytest.approx([0.25, 1, 0, 0, 1])
    assert [r.iou_bg for r in rows] == pytest.approx([9 / 15, 1, 12 / 16, 12 / 16, 1])


def flood(m):
    seen, out = np.zeros(m.shape, bool), []
    for y, x in zip(*np.nonzero(m)):
        if seen[y, x]:
            continue
        stack, size = [(y, x)], 0
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            size += 1
            for ny in range(max(cy - 1, 0), min(cy + 2, m.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, m.shape[1])):
                    if m[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        out.append(size)
    return sorted(out)


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(5)
    images = {i: (rng.random((14, 17)) < d) * 255 for i, d in enumerate((0.1, 0.3, 0.45, 0.6, 0.9, 0.0, 1.0))}
    comb = np.zeros((14, 17), int)
    comb[:, ::2] = 255
    comb[13, :] = 255                                   # teeth that meet only in the last row
    spiral = np.zeros((14, 17), int)
    spiral[0, :] = spiral[:, 16] = spiral[13, 2:] = spiral[2:, 2] = spiral[2, 2:15] = 255
    images.update({7: comb, 8: spiral})
    px = pixels(spark, images)
    want = {i: flood(m) for i, m in images.items()}
    got = {i: [] for i in images}
    for r in masks.components_by_joins(px, masks.foreground("v")).collect():
        got[r.frame_id].append(r.area)
    assert {i: sorted(v) for i, v in got.items()} == want
    found = frames.components(np.array(list(images)), np.stack([m > 0 for m in images.values()]))
    assert {i: sorted(found["area"][found["frame_id"] == i].tolist()) for i in images} == want
    for i, label, x1, y1, x2, y2 in zip(*(found[c].tolist() for c in ("frame_id", "label", "x1", "y1", "x2", "y2"))):
        assert images[i][label // 17, label % 17] and y1 == label // 17 and (images[i][y1:y2, x1:x2] > 0).any((0, 1))


def test_parts_of_bands_are_joined(spark):
    """Labels, areas and boxes do not depend on the bands that an image is cut into, nor on where its rows are counted from."""
    rng = np.random.default_rng(8)
    images = {i: (rng.random((21, 19)) < d) * 255 for i, d in enumerate((0.2, 0.4, 0.5, 0.6, 0.0, 1.0))}
    comb = np.zeros((21, 19), int)
    comb[:, ::2] = 255
    comb[20, :] = 255
    spiral = np.zeros((21, 19), int)
    for k in range(0, 10, 2):
        spiral[k, max(k - 1, 0) : 19 - k] = spiral[k : 21 - k, 18 - k] = spiral[20 - k, k : 19 - k] = spiral[k + 2 : 21 - k, k] = 255
    images.update({6: comb, 7: spiral})
    found = frames.components(np.array(list(images)), np.stack([m > 0 for m in images.values()]))
    want = sorted(zip(found["frame_id"].tolist(), *(found[c].tolist() for c in ("area", "x1", "y1", "x2", "y2")), (found["label"] // 19).tolist(), (found["label"] % 19).tolist()))
    for band, up in ((1, 0), (4, 9), (64, 0)):
        px = pixels(spark, images).withColumn("y", F.col("y") - up)
        got = [(r.frame_id, r.area, r.x1, r.y1 + up, r.x2, r.y2 + up, (r.label >> 32) + up, r.label & 0xFFFFFFFF) for r in masks.components_by_joins(px, masks.foreground("v"), band).collect()]
        assert sorted(got) == want


def test_otsu_separates_two_levels(spark):
    rng = np.random.default_rng(0)
    im = rng.integers(0, 256, (12, 12))
    px = pixels(spark, {1: im, 2: np.where(rng.random((12, 12)) < 0.3, 200, 40)})
    got = {r.frame_id: r.threshold for r in masks.otsu(px, "v").collect()}

    def best(im):
        v = im.ravel()
        scores = {}
        for t in np.unique(v):
            a, b = v[v <= t], v[v > t]
            scores[int(t)] = 0 if not len(b) else len(a) * len(b) * (a.mean() - b.mean()) ** 2 / len(v) ** 2
        top = max(round(s, 9) for s in scores.values())
        return min(t for t, s in scores.items() if round(s, 9) == top)

    assert got[1] == best(im) and 40 <= got[2] < 200


def test_laplacian_variance_with_mirrored_borders():
    im = np.random.default_rng(2).integers(0, 256, (7, 9))
    p = np.pad(im, 1, mode="reflect").astype(float)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * im
    assert frames.laplacian_variance(im[None]) == pytest.approx([lap.var()])


def test_qc_flags(spark):
    good = np.zeros((40, 40), int)
    good[15:25, 16:24] = 255
    corner = np.zeros((40, 40), int)
    corner[0:30, 0:29] = 255
    sh = masks.qc_flags(masks.shape(masks.stats(pixels(spark, {1: good, 2: corner, 3: np.zeros((40, 40))}), "v")))
    got = {r.frame_id: r.flags for r in sh.collect()}
    assert got[1] == [] and got[3] == ["EMPTY_MASK"]
    assert got[2] == ["TOO_LARGE(54.4%)", "TOUCHES_BORDER"]
    prior = {r.frame_id: r.prior for r in masks.hand_prior(sh).collect()}
    assert prior[3] == -10 and prior[1] > prior[2]


def test_wide_and_narrow_are_both_penalised(spark):
    wide, square = np.zeros((60, 60), int), np.zeros((60, 60), int)
    wide[28:31, 5:50] = 255
    square[24:35, 22:34] = 255
    sh = masks.shape(masks.stats(pixels(spark, {1: wide, 2: square}), "v"))
    p = {r.frame_id: r.prior for r in masks.hand_prior(sh).collect()}
    assert p[1] < p[2]


def test_splat(spark):
    pts = spark.createDataFrame([(1, 10, 10, 3), (2, 0, 0, 3), (3, 10, 10, 3), (3, 12, 10, 1), (4, 25, 3, 2)], "frame_id long, cx int, cy int, r int")
    h = {(r.frame_id, r.y, r.x): r.heat for r in heatmaps.splat(pts, "cx", "cy", "r", 21, 21).collect()}
    assert h[1, 10, 10] == 1 and h[1, 10, 12] == pytest.approx(h[1, 12, 10]) and h[1, 8, 10] == pytest.approx(h[1, 10, 12])
    assert h[1, 10, 12] == pytest.approx(math.exp(-4 / (2 * (7 / 6) ** 2)))
    assert h[2, 0, 0] == 1 and min(k[1] for k in h if k[0] == 2) == 0
    assert h[3, 10, 10] == 1 and h[3, 10, 12] == 1 and not [k for k in h if k[0] == 4]


def test_peaks_and_decoding(spark):
    logit = np.full((24, 32), -6.0)
    logit[5, 7], logit[5, 8], logit[15, 20] = 2, 1.5, 1
    rows = [(1, y, x, float(logit[y, x]), 0.25, 0.5, math.log(40), math.log(30)) for y in range(24) for x in range(32)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, heat double, off_x double, off_y double, log_w double, log_h double")
    got = heatmaps.decode(heatmaps.top_peaks(df.filter("heat > -6"), 2), 128, 96).orderBy("rank").collect()
    assert [(r.y, r.x) for r in got] == [(5, 7), (15, 20)]
    assert [got[0].x1, got[0].y1, got[0].x2, got[0].y2] == pytest.approx([9, 7, 49, 37])


def test_ladders(spark):
    rows = [(1, 0, 0.2), (1, 1, 0.05), (1, 2, 0.03), (2, 0, 0.2), (2, 1, 0.09), (2, 2, 0.09), (3, 0, 0.5), (3, 1, 0.4)]
    df = spark.createDataFrame(rows, "f long, rk int, frac double")
    assert {r.f: r.rk for r in picking.ladder_pick(df, "f", "rk", "frac").collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.f: r.rk for r in picking.first_below(df, "f", "rk", "frac").collect()} == {1: 1, 2: 2, 3: 1}


def test_plate_needs_enough_frames(spark):
    px = pixels(spark, {i: [[10 * i]] for i in range(5)}).withColumn("scene", F.lit(1))
    assert masks.background_plate(px, "scene", ["v"]).first().v == 20
    assert masks.background_plate(px.filter("frame_id < 4"), "scene", ["v"]).first().v is None
