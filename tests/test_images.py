import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.constants import CAMERA_STAGES
from frameledger.operators import frames as K
from frameledger.operators import images
from frameledger.plans import CHECKS, QUERIES, inputs

C = F.col


def of(rgb=None, mask=None, **p):
    some = rgb if rgb is not None else mask
    return K.Frames(np.arange(len(some)), some.shape[2], some.shape[1], rgb, mask, {k: np.asarray(v) for k, v in p.items()})


def pictures(rows, **kw):
    """{frame_id: (h, w, 3) levels} of a policy's result."""
    return {r.frame_id: np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in images.policy(rows, **kw).collect()}


def raw(rows):
    return {r.frame_id: np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in rows.collect()}


@pytest.fixture(scope="module")
def few(spark, tiny):
    return inputs.image_rows(spark, tiny).filter("frame_id < 20")


def test_identity_maps(spark):
    got = spark.range(1).select(*[c for row in images.hue_matrix(0.0) for c in row], *[c for row in images.saturation_matrix(1.0) for c in row]).first()
    assert list(got) == pytest.approx(list(np.eye(3).ravel()) * 2, abs=1e-12)


def test_grey_stays_grey(spark):
    m = images.matmul(images.hue_matrix(0.13), images.saturation_matrix(0.4))
    row = spark.range(1).select(*[sum(cell * 0.5 for cell in line) for line in m]).first()
    assert list(row) == pytest.approx([0.5] * 3, abs=2e-3)


@pytest.mark.parametrize("shape, sigma", [((6, 9), 1.1), ((5, 4), 0.4), ((3, 7), 1.9), ((1, 6), 1.0)])
def test_blur_against_direct_sum(shape, sigma):
    im = np.random.default_rng(1).random((*shape, 3))
    r = max(1, min(int(2.5 * sigma), 4))
    d = np.arange(-r, r + 1)
    k = np.exp(-d * d / (2 * sigma ** 2))
    k /= k.sum()

    def mirror(i, n):
        if n == 1:
            return 0
        i = abs(i) % (2 * (n - 1))
        return i if i < n else 2 * (n - 1) - i

    want = np.zeros_like(im)
    h, w = shape
    for y in range(h):
        for x in range(w):
            for i, a in zip(d, k):
                for j, b in zip(d, k):
                    want[y, x] += a * b * im[mirror(y + i, h), mirror(x + j, w)]
    got = K.gaussian(np.stack([im, im]), np.array([sigma, 0.4]), 4)
    assert got[0] == pytest.approx(want)


def test_missing_sigma_leaves_the_image():
    im = np.random.default_rng(1).random((2, 4, 4, 3))
    f = of(im.copy(), sigma=[np.nan, 1.0], amount=[np.nan, np.nan])
    K.blur_or_sharpen(f)
    assert (f.rgb[0] == im[0]).all() and not np.allclose(f.rgb[1], im[1])


def test_policy_errors_and_identity(few):
    with pytest.raises(ValueError, match="no such photometric mode"):
        images.policy(few, "sepia")
    with pytest.raises(ValueError, match="not offered as camera stages"):
        images.policy(few, "cpr", stages=["wb", "typo"])
    same, before = pictures(few, photometric="cpr", strength=0.0), raw(few)
    assert len(same) == len(before) and all((same[i] == before[i]).all() for i in before)


def test_camera_stages_off_is_the_round_trip(few):
    """With every stage off only the gamma-2 quantisation is left."""
    off, before = pictures(few, photometric="cpr", stages=[]), raw(few)
    assert max(np.abs(off[i].astype(int) - before[i]).max() for i in before) <= 3


def test_every_single_stage_runs_in_range(few):
    def ends(f):
        return {"frame_id": f.ids, "lo": f.rgb.min((1, 2, 3)), "hi": f.rgb.max((1, 2, 3))}

    for stage in CAMERA_STAGES:
        rows = images.policy(few, "cpr", stages=[stage], seed=3, finish=ends, schema="frame_id bigint, lo double, hi double").collect()
        assert len(rows) == few.count() and min(r.lo for r in rows) >= -1e-9 and max(r.hi for r in rows) <= 1 + 1e-9, stage


@pytest.mark.parametrize("mode", ["jitter", "cpr", "randconv", "augmix"])
def test_results_do_not_depend_on_partitioning(few, mode):
    a, b = pictures(few, photometric=mode, seed=5), pictures(few.repartition(3), photometric=mode, seed=5)
    assert a.keys() == b.keys() and all((a[i] == b[i]).all() for i in a)


@pytest.mark.parametrize("pixels", [1, 70, 1 << 19])
def test_slices_and_mixed_sizes(spark, pixels):
    """Frames of several sizes in one batch; a frame larger than a slice is not cut."""
    rng = np.random.default_rng(0)
    ims = {i: rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for i, (h, w) in enumerate([(8, 8), (3, 5), (8, 8), (1, 1), (5, 3), (40, 50)])}
    rows = spark.createDataFrame([(i, v.shape[1], v.shape[0], bytearray(v.tobytes())) for i, v in ims.items()], "frame_id long, w int, h int, rgb binary").coalesce(1)

    def both(f):
        K.to_unit(f)
        return K.planes(f)

    got = {r.frame_id: np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in K.over(rows, both, K.PLANES, pixels).collect()}
    assert got.keys() == ims.keys() and all((got[i] == ims[i]).all() for i in ims)


def test_level_steps_against_direct_code():
    v = np.random.default_rng(4).integers(20, 200, 3000)
    level, n = np.unique(v, return_counts=True)
    hist = np.bincount(v, minlength=256).reshape(1, 1, 256)
    start = np.arange(256).reshape(1, 1, 256)

    def run(op):
        table = K.level_step(start, hist, np.array([op]), np.array([3]), np.array([100]))[0, 0]
        return {int(a): int(table[a]) for a in level}

    lo, hi = level.min(), level.max()
    assert run(0) == {int(a): int(np.floor(round((a - lo) * 255 / (hi - lo), 9))) for a in level}
    step, below, table = (len(v) - n[-1]) // 255, 0, {}
    for a, k in zip(level, n):
        table[int(a)] = min((step // 2 + below) // step, 255)
        below += k
    assert run(1) == table
    assert run(2) == {int(a): int(a) // 32 * 32 for a in level}
    assert run(3) == {int(a): int(a if a < 100 else 255 - a) for a in level}
    assert run(-1) == {int(a): int(a) for a in level}


def test_noise_streams_are_normal_and_apart():
    x = K.counted_normal(np.array([1, 2, 1]), 200_000)
    assert (x[0] == x[2]).all() and abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.01
    assert abs(x[0].mean()) < 0.01 and abs(x[0].std() - 1) < 0.01 and np.isfinite(x).all()


@pytest.mark.parametrize("factor", [1.0, 1.3, 2.0])
def test_resampling_keeps_the_mean_of_cells(factor):
    im = np.random.default_rng(2).random((1, 12, 12, 3))
    f = of(im.copy(), factor=[factor])
    K.resample_mismatch(f, 2)
    assert f.rgb.mean() == pytest.approx(im.mean(), abs=0.05) and (factor > 1 or np.allclose(f.rgb, im))
    if factor == 2.0:
        assert f.rgb[0, :2, :2] == pytest.approx(np.broadcast_to(im[0, :2, :2].mean((0, 1)), (2, 2, 3)))


def test_curves_rise(spark, tiny):
    p = images.camera_params(inputs.frame_rows(spark, tiny), "t", strength=3.0)
    falling = F.greatest(*[C(f"ty{k}") - C(f"ty{k + 1}") for k in range(4)])
    assert p.agg(F.max(falling)).first()[0] <= 0


def test_geometry_moves_image_and_mask_together(spark, tiny):
    """An image that is its own mask stays that: the bright part lies where the mask says, and half of it is kept."""
    def own(f):
        before = (f.mask >= 128).sum((1, 2))
        f.rgb = np.repeat(np.where(f.mask >= 128, 255.0, 0.0)[..., None], 3, 3)
        f.mask = np.where(f.mask >= 128, 255, 0)
        K.geometry(f)
        apart = ((f.rgb[..., 0] >= 128) != (f.mask >= 128)).sum((1, 2))
        x1, y1, x2, y2 = f.p["box"].T
        inside = np.array([(m[b:d, a:c] >= 128).sum() for m, a, b, c, d in zip(f.mask, x1, y1, x2, y2)])
        after = (f.mask >= 128).sum((1, 2))
        return {"frame_id": f.ids, "before": before, "after": after, "apart": apart, "inside": inside, "fits": (f.p["x0"] + f.p["cw"] <= f.w) & (f.p["y0"] + f.p["ch"] <= f.h)}

    rows = K.over(images.geometry_params(inputs.image_rows(spark, tiny, 16, 16), "g", 16, 16), own, "frame_id bigint, before bigint, after bigint, apart bigint, inside bigint, fits boolean").collect()
    assert all(r.fits and r.after == r.inside for r in rows)
    assert all(2 * r.after >= r.before for r in rows)
    touching = sum(r.apart > 0 for r in rows)              # an image repeats its edge where a mask ends at it
    assert touching < len(rows) / 2


def test_null_numbers_and_planes(spark):
    rows = spark.createDataFrame([(1, 2, 1, None, None), (2, 2, 1, bytearray(b"\x01\x02\x03\x04\x05\x06"), 3.0)], "frame_id long, w int, h int, rgb binary, v double")
    got = {r.frame_id: (r.s, r.v) for r in K.over(rows, lambda f: {"frame_id": f.ids, "s": f.rgb.astype(np.int64).sum((1, 2, 3)), "v": np.nan_to_num(f.p["v"], nan=-1.0)}, "frame_id bigint, s bigint, v double").collect()}
    assert got == {1: (0, -1.0), 2: (21, 3.0)}


def test_proposers_by_name(spark, tiny):
    from frameledger.operators import scoring

    rows = inputs.image_rows(spark, tiny, 16, 16).filter("frame_id < 30")
    with pytest.raises(ValueError, match="unknown backend"):
        scoring.propose(rows, "segmenter")
    own = {"halves": lambda f: np.stack([np.ones_like(f.mask, bool), np.zeros_like(f.mask, bool)], 1)}
    got = scoring.propose(rows, "halves", own).collect()
    assert {(r.rk, r.frac, r.x1, r.x2, len(r.mask)) for r in got} == {(0, 1.0, 0, 16, 256), (1, 0.0, None, None, 256)}
    assert scoring.propose(rows, "skin").count() == 4 * rows.count()


def test_means_on_the_edge_of_rounding_match_sql(spark, tmp_path):
    """Means of these frames end exactly in half a unit of the fifth digit."""
    spark.read.parquet("/root/testdata/sf0.01/part.parquet").where("p_partkey IN (313, 467, 1611)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(f"SELECT frame_id, r, g, b FROM ({CHECKS['colour_matrices']}) ORDER BY frame_id").fetchall()
    assert [tuple(r) for r in QUERIES["colour_matrices"](spark, str(tmp_path)).select("frame_id", "r", "g", "b").orderBy("frame_id").collect()] == want
