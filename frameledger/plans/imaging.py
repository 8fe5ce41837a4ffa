"""Batch image transforms, each reduced to position-weighted channel means for the check: they change when a pixel moves."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frameledger.constants import (
    CHANNEL_MEAN, CHANNEL_STD, LUM_B, LUM_G, LUM_R, SHIFT_TONE_X, SHIFT_TONE_Y, SKIN_LOOSE, SKIN_TIGHT)
from frameledger.functions import boxes
from frameledger.functions.numeric import clip, interp
from frameledger.operators import frames as K
from frameledger.operators import images, masks
from frameledger.plans import inputs as I
from frameledger.plans.inputs_sql import u01
from frameledger.plans.registry import query

C = F.col
RGB = images.RGB


_PLACE = "(x+1)*(y+2)"


def _weighted(rows, *kernels):
    return K.applied(rows, *kernels, finish=K.weighted, schema=K.WEIGHTED)


def _means_sql(src: str, digits=5) -> str:
    return "SELECT frame_id, " + ", ".join(f"round(avg({c}*{_PLACE}),{digits}) AS {c}" for c in RGB) + f" FROM {src} GROUP BY frame_id"


def _u(tag, lo=0, hi=1, cols="frame_id"):
    return f"({lo!r}+{hi - lo!r}*{u01(f'concat(' + repr(tag + '|') + f', {cols})')})"


def _n(tag, cols="frame_id"):
    text = f"md5(concat('{tag}|', {cols}))"
    u1 = f"((CAST(CAST('0x'||substr({text},1,13) AS BIGINT) AS DOUBLE)+1)/4503599627370497e0)"
    u2 = f"(CAST(CAST('0x'||substr({text},14,13) AS BIGINT) AS DOUBLE)/4503599627370496e0)"
    return f"(sqrt(-2*ln({u1}))*cos(2*pi()*{u2}))"


_M64 = "18446744073709551616::UHUGEINT"


def _stream(key, k):
    """Normal number k of the counter-based stream of `key`."""
    def half(i):
        z = f"((({key})::UHUGEINT+(2*({k})+{i})::UHUGEINT*11400714819323198485::UHUGEINT)%{_M64})::UBIGINT"
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = f"(xor({z},{z}>>{shift})::UHUGEINT*{factor}::UHUGEINT%{_M64})::UBIGINT"
        return f"CAST(xor({z},{z}>>31)>>12 AS DOUBLE)"
    return f"(sqrt(-2*ln(({half(1)}+1)/4503599627370497e0))*cos(2*pi()*({half(2)}/4503599627370496e0)))"


def _key(tag, cols="frame_id"):
    return f"CAST('0x'||substr(md5(concat('{tag}|', {cols})),1,13) AS BIGINT)"


def _place_sums(levels):
    """Per channel the sum of level x (x + 1) x (y + 2)."""
    h, w = levels.shape[1:3]
    return np.tensordot(levels.astype(np.int64), np.outer(np.arange(h) + 2, np.arange(w) + 1), ([1, 2], [0, 1])).T


def _affine_sql(src, m, bias=("0", "0", "0")):
    """3x3 SQL expressions applied to r, g, b of a subquery."""
    out = [f"({m[i][0]})*r+({m[i][1]})*g+({m[i][2]})*b+({bias[i]}) AS {c}" for i, c in enumerate(RGB)]
    return f"(SELECT * EXCLUDE (r,g,b), {', '.join(out)} FROM {src})"


def _sat_sql(s):
    lum = (LUM_R, LUM_G, LUM_B)
    return [[f"{lum[j]}e0*(1-({s}))" + (f"+({s})" if i == j else "") for j in range(3)] for i in range(3)]


def _hue_sql(t):
    c, s = f"cos(2*pi()*({t}))", f"sin(2*pi()*({t}))"
    return [[f"0.213e0+{c}*0.787e0-{s}*0.213e0", f"0.715e0*(1-{c})-{s}*0.715e0", f"0.072e0*(1-{c})+{s}*0.928e0"],
            [f"0.213e0*(1-{c})+{s}*0.143e0", f"0.715e0+{c}*0.285e0+{s}*0.14e0", f"0.072e0*(1-{c})-{s}*0.283e0"],
            [f"0.213e0*(1-{c})-{s}*0.787e0", f"0.715e0*(1-{c})+{s}*0.715e0", f"0.072e0+{c}*0.928e0+{s}*0.072e0"]]


def _diag_sql(a, b, c):
    v = (a, b, c)
    return [[v[i] if i == j else "0" for j in range(3)] for i in range(3)]


def _each_sql(src, expr):
    return f"(SELECT * EXCLUDE (r,g,b), {', '.join(expr.format(c=c) + ' AS ' + c for c in RGB)} FROM {src})"


_UNIT = _each_sql("rgb", "{c}/255e0")
_CLIP = "least(greatest({c},0e0),1e0)"


@query("I1", "SELECT frame_id, " + ", ".join(f"round(avg(({c}/255e0-{m})/{s}*{_PLACE}),5) AS {c}" for c, m, s in zip(RGB, CHANNEL_MEAN, CHANNEL_STD)) + ", 0 AS changed FROM rgb GROUP BY frame_id", "rgb")
def normalise_round_trip(spark, sf):
    def finish(f):
        raw = f.rgb
        f.rgb = (raw / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
        back = np.floor(np.clip(f.rgb * np.array(CHANNEL_STD) + np.array(CHANNEL_MEAN), 0, 1) * 255 + 0.5)
        return {**K.weighted(f), "changed": (back != raw).any((1, 2, 3)).astype(np.int32)}

    return K.over(I.image_rows(spark, sf), finish, K.WEIGHTED + ", changed int")


@query("I2 I3 I4 I9", _means_sql(_each_sql(_affine_sql(_affine_sql(_UNIT, _sat_sql("0.6e0+(frame_id%8)/10e0")), _hue_sql("((frame_id%11)-5)/100e0")), _CLIP)), "rgb")
def colour_matrices(spark, sf):
    """Saturation then hue, one after the other in the SQL's order of sums: some means lie exactly on the edge of rounding."""
    rows = images.store_matrix(I.image_rows(spark, sf), "s", images.saturation_matrix(F.lit(0.6) + (C("frame_id") % 8) / 10.0))
    rows = images.store_matrix(rows, "h", images.hue_matrix((C("frame_id") % 11 - 5) / 100.0))
    return K.applied(rows, K.to_unit, K.colour_maps_in_turn("s", "h"), finish=K.weighted_in_turn, schema=K.WEIGHTED)


def _jitter_sql():
    ops = [_diag_sql(*["jb"] * 3), _diag_sql(*["jc"] * 3), _sat_sql("js"), _hue_sql("jh")]
    params = (f"1+{_u('j-brightness', -0.4, 0.4)} AS jb, 1+{_u('j-contrast', -0.4, 0.4)} AS jc, 1+{_u('j-saturation', -0.4, 0.4)} AS js, {_u('j-hue', -0.1, 0.1)} AS jh, "
              + ", ".join(f"{_u(f'j-order{i}')} AS o{i}" for i in range(4)))
    ranks = ", ".join("+".join(f"CASE WHEN o{k}<o{i} THEN 1 ELSE 0 END" for k in range(4)) + f" AS r{i}" for i in range(4))
    src = f"""(SELECT u.*, p.* EXCLUDE (frame_id), 0.213e0*avg(r) OVER (PARTITION BY u.frame_id)+0.715e0*avg(g) OVER (PARTITION BY u.frame_id)+0.072e0*avg(b) OVER (PARTITION BY u.frame_id) AS grey
      FROM {_UNIT} u JOIN (SELECT *, {ranks} FROM (SELECT p_partkey AS frame_id, {params.replace('frame_id', 'p_partkey')} FROM part)) p ON p.frame_id=u.frame_id)"""
    for step in range(4):
        out = []
        for i, c in enumerate(RGB):
            arms = " ".join(f"WHEN r{k}={step} THEN ({ops[k][i][0]})*r+({ops[k][i][1]})*g+({ops[k][i][2]})*b" + ("+grey*(1-jc)" if k == 1 else "") for k in range(4))
            out.append(f"CASE {arms} END AS {c}")
        src = f"(SELECT * EXCLUDE (r,g,b), {', '.join(out)} FROM {src})"
    return _means_sql(_each_sql(src, _CLIP))


@query("I5 I21 F17", _jitter_sql(), "rgb")
def color_jitter(spark, sf):
    """Whole policy path: per-frame draws, one composed map, contrast about the luma mean."""
    return images.policy(I.image_rows(spark, sf), "jitter", seed="j", finish=K.weighted, schema=K.WEIGHTED)


def _camera_sql(stage, seed="c"):
    cc = [[f"({1 if i == j else 0}+0.05e0*{_n(f'{seed}-ccm{i}{j}', 'p_partkey')})" for j in range(3)] for i in range(3)]
    p = ", ".join(f"{cc[i][j]} AS q{i}{j}" for i in range(3) for j in range(3))
    u = lambda tag, lo=0, hi=1: _u(f"{seed}-{tag}", lo, hi, "p_partkey")
    extra = (f"{u('wbr', 0.8, 1.25)} AS wr, {u('wbb', 0.8, 1.25)} AS wb, pow(2e0,{u('ev', -0.6, 0.6)}) AS ev, "
             f"CASE WHEN {u('noise')}<0.5 THEN exp({u('na', math.log(1e-5), math.log(1e-3))}) ELSE 0 END AS na, "
             f"CASE WHEN {u('noise')}<0.5 THEN exp({u('nb', math.log(1e-6), math.log(1e-4))}) ELSE 0 END AS nb, {u('gamma', 1.8, 2.6)} AS gamma, "
             + ", ".join(f"least(greatest({k}/4e0+{u(f'tone{k}', -0.1, 0.1)},0),1) AS k{k}" for k in range(5)))
    src = f"(SELECT a.*, p.* EXCLUDE (frame_id) FROM {_each_sql('rgb', 'pow({c}/255e0,2.2e0)')} a JOIN (SELECT p_partkey AS frame_id, {p}, {extra} FROM part) p ON p.frame_id=a.frame_id)"
    w = ["wr", "1e0", "wb"]
    rows = [f"(CASE WHEN abs(q{i}0+q{i}1+q{i}2)<1e-3 THEN 1 ELSE q{i}0+q{i}1+q{i}2 END)" for i in range(3)]
    src = _affine_sql(src, [[f"q{i}{j}/{rows[i]}*{w[j]}*ev" for j in range(3)] for i in range(3)])
    if stage == "linear":
        return _means_sql(_each_sql(src, _CLIP))
    keyed = ", ".join(f"{_key(f'{seed}-nk{k}')} AS nk{k}" for k in range(3))
    src = f"(SELECT *, {keyed} FROM {src})"
    noisy = [f"least(greatest(CASE WHEN na>0 THEN {c}+sqrt(greatest({c},0)*na+nb)*{_stream(f'nk{k}', 'y*8+x')} ELSE {c} END,0e0),1e0) AS {c}" for k, c in enumerate(RGB)]
    src = f"(SELECT * EXCLUDE (r,g,b), {', '.join(noisy)} FROM {src})"
    if stage == "noise":
        return _means_sql(src)
    ty = ["k0"]
    for k in range(1, 5):
        ty.append(f"{ty[-1]}+greatest(k{k}-k{k - 1},0)")
    src = f"(SELECT * EXCLUDE (k0,k1,k2,k3,k4), {', '.join(f'least(greatest({t},0),1) AS t{k}' for k, t in enumerate(ty))} FROM {src})"
    v = "pow(floor(sqrt({c})*255+0.5)/255e0,2/gamma)"
    curve = "CASE " + " ".join(f"WHEN {v}<={(k + 1) / 4} THEN t{k}+(t{k + 1}-t{k})*({v}*4-{k})" for k in range(4)) + " ELSE t4 END"
    src = _each_sql(src, curve)
    return src if stage == "raw" else _means_sql(src)


@query("I6", _camera_sql("linear"), "rgb")
def linear_light_stage(spark, sf):
    def clipped(f):
        f.rgb = np.clip(f.rgb, 0, 1)

    return _weighted(images.camera_params(I.image_rows(spark, sf), "c"), K.linear_stage, clipped)


@query("I7 F17", _camera_sql("noise"), "rgb")
def sensor_noise(spark, sf):
    return _weighted(images.camera_params(I.image_rows(spark, sf), "c"), K.linear_stage, K.sensor_noise)


@query("I8 W15", _camera_sql("display"), "rgb")
def display_tone_stage(spark, sf):
    return _weighted(images.camera_params(I.image_rows(spark, sf), "c"), K.linear_stage, K.sensor_noise, K.display_stage)


@query("W15", "SELECT frame_id, k, round(ty,6) AS ty FROM tone", "tone")
def tone_curve(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("frame_id").orderBy("k")          # five rows per frame
    rise = F.coalesce(F.greatest(C("ky") - F.lag("ky").over(w), F.lit(0.0)), F.lit(0.0))
    k = I.knots(spark, sf).withColumn("rise", rise)
    level = F.first("ky").over(w) + F.sum("rise").over(w.rowsBetween(W.unboundedPreceding, 0))
    return k.select("frame_id", "k", F.round(clip(level, 0.0, 1.0), 6).alias("ty"))


def _interp_sql(v, xs, ys):
    arms = " ".join(f"WHEN {v}<={x1} THEN {y0}+({y1}-{y0})/({x1}-{x0})*({v}-{x0})"
                    for x0, x1, y0, y1 in zip([f"{x}e0" for x in xs[:-1]], [f"{x}e0" for x in xs[1:]], [f"{y}e0" for y in ys[:-1]], [f"{y}e0" for y in ys[1:]]))
    return f"CASE WHEN {v}<={xs[0]}e0 THEN {ys[0]}e0 {arms} ELSE {ys[-1]}e0 END"


@query("M17 F8", f"""
WITH p AS (SELECT frame_id, max(CASE WHEN k=0 THEN ty END) AS t0, max(CASE WHEN k=1 THEN ty END) AS t1, max(CASE WHEN k=2 THEN ty END) AS t2, max(CASE WHEN k=3 THEN ty END) AS t3, max(CASE WHEN k=4 THEN ty END) AS t4 FROM tone GROUP BY frame_id),
g AS (SELECT frame_id, v, {_interp_sql('v', SHIFT_TONE_X, SHIFT_TONE_Y)} AS target, CASE WHEN v<=0.25 THEN t0+(t1-t0)*v*4 WHEN v<=0.5 THEN t1+(t2-t1)*(v*4-1) WHEN v<=0.75 THEN t2+(t3-t2)*(v*4-2) ELSE t3+(t4-t3)*(v*4-3) END AS got
  FROM p CROSS JOIN (SELECT i/255e0 AS v FROM range(256) t(i)))
SELECT round(min(gap),6) AS closest, round(avg(gap),6) AS mean_gap FROM (SELECT frame_id, max(abs(got-target)) AS gap FROM g GROUP BY frame_id)""", "tone")
def transfer_distance(spark, sf):
    """Largest gap of each drawn curve to the held-out curve over all levels; the nearest one."""
    raw = I.knots(spark, sf).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ky"))), lambda s: s["ky"]).alias("ky"))
    level = C("ky")[0]
    knots = [level]
    for k in range(1, 5):
        level = level + F.greatest(C("ky")[k] - C("ky")[k - 1], F.lit(0.0))
        knots.append(clip(level, 0.0, 1.0))
    curves = raw.select("frame_id", *[v.alias(f"t{k}") for k, v in enumerate(knots)])
    v = C("v")
    grid = curves.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255)))).withColumn("v", C("v") / 255.0)
    gap = F.abs(images.tone_value(v, [C(f"t{k}") for k in range(5)]) - interp(v, SHIFT_TONE_X, SHIFT_TONE_Y))
    per = grid.groupBy("frame_id").agg(F.max(gap).alias("gap"))
    return per.agg(F.round(F.min("gap"), 6).alias("closest"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def _blur_sql(src, sigma, half, w, h, keep=""):
    """Two passes of a mirrored Gaussian over r, g, b of `src` (frame_id, y, x, r, g, b)."""
    def one(src, axis, size):
        other = "x" if axis == "y" else "y"
        m = f"((a.{axis}+d)%{2 * (size - 1)}+{2 * (size - 1)})%{2 * (size - 1)}"
        at = f"CASE WHEN {m}<{size} THEN {m} ELSE {2 * (size - 1)}-{m} END"
        k = f"exp(-(d*d)/(2e0*({sigma})*({sigma})))"
        vals = ", ".join(f"sum({k}*s.{c})/sum({k}) AS {c}" for c in RGB)
        return f"(SELECT a.frame_id, a.y, a.x{keep}, {vals} FROM {src} a JOIN range(-4,5) t(d) ON abs(d)<={half} JOIN {src} s ON s.frame_id=a.frame_id AND s.{other}=a.{other} AND s.{axis}={at} GROUP BY a.frame_id, a.y, a.x{keep})".replace("@f", "a.frame_id")
    return one(one(src, "x", w), "y", h)


_BASE = "(SELECT frame_id, y, x, r/255e0 AS r, g/255e0 AS g, b/255e0 AS b FROM rgb)"
_SIGMA = "(0.4e0+(@f%10)/8e0)"
_HALF = "greatest(1,least(CAST(floor(2.5e0*(0.4e0+(@f%10)/8e0)) AS INT),4))"


@query("I10", f"""
WITH base AS {_BASE}, soft AS (SELECT * FROM {_blur_sql('base', _SIGMA, _HALF, 8, 8)})
SELECT b.frame_id, {', '.join(f"round(avg(CASE WHEN b.frame_id%2=0 THEN s.{c} ELSE least(greatest(1.8e0*b.{c}-0.8e0*s.{c},0e0),1e0) END*(b.x+1)*(b.y+2)),5) AS {c}" for c in RGB)}
FROM base b JOIN soft s USING (frame_id,y,x) GROUP BY b.frame_id""", "rgb")
def blur_or_sharpen(spark, sf):
    f = C("frame_id")
    rows = I.image_rows(spark, sf, sigma=F.lit(0.4) + (f % 10) / 8.0, amount=F.when(f % 2 == 1, F.lit(0.8)))
    return _weighted(rows, K.to_unit, K.blur_or_sharpen)


def _resample_sql():
    """Each pixel takes the mean of its cell, cells being w / factor (rounded, 2 at least) along each side."""
    def one(src, axis):
        a, b = f"floor((a.{axis}+0.5e0)*a.k/8)*8/a.k", f"(floor((a.{axis}+0.5e0)*a.k/8)+1)*8/a.k"
        other = "x" if axis == "y" else "y"
        share = f"greatest(0e0,least({b},s.{axis}+1)-greatest({a},s.{axis}))"
        return (f"(SELECT a.frame_id, a.y, a.x, a.k, {', '.join(f'sum({share}*s.{c})/sum({share}) AS {c}' for c in RGB)} FROM {src} a JOIN {src} s ON s.frame_id=a.frame_id AND s.{other}=a.{other} "
                f"GROUP BY 1,2,3,4)")
    return f"WITH b AS (SELECT *, least(greatest(floor(8/(1+(frame_id%9)/8e0)+0.5),2),8) AS k FROM rgb), c AS {one('b', 'x')} {_means_sql(one('c', 'y'))}"


@query("I11", _resample_sql(), "rgb")
def resample_mismatch(spark, sf):
    """Factors 1 to 2 in steps of an eighth, whole and not."""
    return _weighted(I.image_rows(spark, sf, factor=F.lit(1.0) + (C("frame_id") % 9) / 8.0), lambda f: K.resample_mismatch(f, 2))


@query("I12", """
WITH q AS (SELECT *, CAST(frame_id%3 AS INT)-1 AS dx, CAST(frame_id%5 AS INT)%3-1 AS dy FROM rgb)
SELECT q.frame_id, sum(a.r*(q.x+1)*(q.y+2))::BIGINT AS r, sum(c.b*(q.x+1)*(q.y+2))::BIGINT AS b FROM q
JOIN rgb a ON a.frame_id=q.frame_id AND a.x=least(greatest(q.x-q.dx,0),7) AND a.y=least(greatest(q.y-q.dy,0),7)
JOIN rgb c ON c.frame_id=q.frame_id AND c.x=least(greatest(q.x+q.dx,0),7) AND c.y=least(greatest(q.y+q.dy,0),7) GROUP BY q.frame_id""", "rgb")
def chroma_shift(spark, sf):
    f = C("frame_id")

    def sums(f):
        place = np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
        return {"frame_id": f.ids, **{c: (f.rgb[..., i].astype(np.int64) * place).sum((1, 2)) for c, i in (("r", 0), ("b", 2))}}

    rows = I.image_rows(spark, sf, dx=(f % 3).cast("int") - 1, dy=(f % 5).cast("int") % 3 - 1)

    def writable(f):
        f.rgb = f.rgb.copy()

    return K.applied(rows, writable, K.chroma_shift, finish=sums, schema="frame_id bigint, r bigint, b bigint")


def _half_even(e):
    """Round half to even, as SQL."""
    return f"CAST(round_even({e},0) AS INT)"


@query("I14 I22", f"""
WITH p AS (SELECT frame_id, attempt, {_half_even("sqrt(a*ar)")} AS cw, {_half_even("sqrt(a/ar)")} AS ch FROM (SELECT p_partkey AS frame_id, attempt,
   256*{_u('crop-area', 0.5, 1.0, "p_partkey,'|',attempt")} AS a, exp({_u('crop-ratio', math.log(3 / 4), math.log(4 / 3), "p_partkey,'|',attempt")}) AS ar FROM part CROSS JOIN range(10) t(attempt))),
q AS (SELECT *, CAST(floor({_u('crop-x', 0, 1, "frame_id,'|',attempt")}*(17-cw)) AS INT) AS x0, CAST(floor({_u('crop-y', 0, 1, "frame_id,'|',attempt")}*(17-ch)) AS INT) AS y0 FROM p WHERE cw BETWEEN 1 AND 16 AND ch BETWEEN 1 AND 16),
fg AS (SELECT frame_id, y, x FROM px WHERE gt_v>=128), n AS (SELECT frame_id, count(*) AS fg FROM fg GROUP BY 1),
s AS (SELECT q.frame_id, attempt, cw, ch, x0, y0, count(*) FILTER (WHERE x>=x0 AND x<x0+cw AND y>=y0 AND y<y0+ch) AS vis FROM q JOIN fg USING (frame_id) GROUP BY ALL),
ok AS (SELECT s.*, row_number() OVER (PARTITION BY s.frame_id ORDER BY attempt) AS rn FROM s JOIN n USING (frame_id) WHERE vis>=greatest(1,ceil(0.5e0*fg))),
e AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY attempt) AS rn FROM q WHERE frame_id NOT IN (SELECT frame_id FROM n))
SELECT p_partkey AS frame_id, coalesce(ok.cw,e.cw,16) AS cw, coalesce(ok.ch,e.ch,16) AS ch, coalesce(ok.x0,e.x0,0) AS x0, coalesce(ok.y0,e.y0,0) AS y0,
 CASE WHEN fg IS NULL THEN NULL ELSE round(coalesce(CAST(vis AS DOUBLE)/fg,1),6) END AS visible
FROM part LEFT JOIN ok ON ok.frame_id=p_partkey AND ok.rn=1 LEFT JOIN e ON e.frame_id=p_partkey AND e.rn=1 LEFT JOIN n ON n.frame_id=p_partkey""", "px")
def random_crop(spark, sf):
    """The upright case of the geometric block: no turn, no flip."""
    rows = images.geometry_params(I.image_rows(spark, sf, 16, 16), "crop", 16, 16, max_angle=0.0, flip=0.0)

    def finish(f):
        fg = (f.mask >= 128).sum((1, 2))
        K.geometry(f)
        seen = (f.mask >= 128).sum((1, 2))
        return {"frame_id": f.ids, **{c: f.p[c].astype(np.int32) for c in ("cw", "ch", "x0", "y0")},
                "visible": pa.array(np.round(seen / np.maximum(fg, 1), 6), mask=fg == 0)}

    return K.over(rows, finish, "frame_id bigint, cw int, ch int, x0 int, y0 int, visible double")


@query("I15", """
SELECT frame_id, min(x) AS x1, max(x)+1 AS x2, CASE WHEN frame_id%2=0 THEN 16-max(ox)-1 ELSE min(ox) END AS bx1, CASE WHEN frame_id%2=0 THEN 16-min(ox) ELSE max(ox)+1 END AS bx2
FROM (SELECT frame_id, x AS ox, CASE WHEN frame_id%2=0 THEN 15-x ELSE x END AS x FROM px WHERE gt_v>=128) GROUP BY frame_id""", "px")
def horizontal_flip(spark, sf):
    """The flipped box equals the box of the flipped mask."""
    def finish(f):
        when = f.ids % 2 == 0
        box, some = K.mask_boxes(f.mask)
        flipped = K.mask_boxes(np.where(when[:, None, None], f.mask[:, :, ::-1], f.mask))[0]
        x1, x2 = np.where(when, f.w - box[:, 2], box[:, 0]), np.where(when, f.w - box[:, 0], box[:, 2])
        return {"frame_id": f.ids[some], **{n: v[some].astype(np.int32) for n, v in (("x1", flipped[:, 0]), ("x2", flipped[:, 2]), ("bx1", x1), ("bx2", x2))}}

    return K.over(I.image_rows(spark, sf, 16, 16), finish, "frame_id bigint, x1 int, x2 int, bx1 int, bx2 int")


def _rot_box_sql():
    a = "radians((l_partkey%21)-10)"
    pts = [("gx1", "gy1"), ("gx2", "gy1"), ("gx2", "gy2"), ("gx1", "gy2")]
    xs = ",".join(f"cos({a})*({x}-200)+sin({a})*({y}-150)+200" for x, y in pts)
    ys = ",".join(f"-sin({a})*({x}-200)+cos({a})*({y}-150)+150" for x, y in pts)
    return f"""SELECT clip, frame, l_partkey, l_suppkey, round(x1,6) AS x1, round(y1,6) AS y1, round(greatest(x2,x1+1),6) AS x2, round(greatest(y2,y1+1),6) AS y2 FROM (
SELECT *, least(greatest(least({xs}),0),399) AS x1, least(greatest(greatest({xs}),1),400) AS x2, least(greatest(least({ys}),0),299) AS y1, least(greatest(greatest({ys}),1),300) AS y2 FROM pred)"""


@query("I16", _rot_box_sql(), "pred")
def rotate_box(spark, sf):
    b = boxes.rotate_corners(I.gt_box(), (C("l_partkey") % 21 - 10).cast("double"), 400.0, 300.0)
    return I.pred(spark, sf).select("clip", "frame", "l_partkey", "l_suppkey", *[F.round(v, 6).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])


@query("I16 M3", """
WITH q AS (SELECT frame_id, y, x, radians((frame_id%21)-10e0) AS a FROM px),
m AS (SELECT frame_id, y, x, CAST(floor(cos(a)*(x-8)-sin(a)*(y-8)+8+0.5) AS INT) AS sx, CAST(floor(sin(a)*(x-8)+cos(a)*(y-8)+8+0.5) AS INT) AS sy FROM q)
SELECT m.frame_id, count(*) FILTER (WHERE gt_v>=128) AS n_fg, min(m.x) FILTER (WHERE gt_v>=128) AS x1, max(m.y) FILTER (WHERE gt_v>=128)+1 AS y2, CAST(sum(coalesce(gt_v,0)*(m.x+1)*(m.y+2)) AS BIGINT) AS placed
FROM m LEFT JOIN px ON px.frame_id=m.frame_id AND px.y=m.sy AND px.x=m.sx GROUP BY m.frame_id""", "px")
def rotate_mask(spark, sf):
    def finish(f):
        m = K.rotated_nearest(f.mask, f.p["angle"])
        box, some = K.mask_boxes(m)
        place = np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
        return {"frame_id": f.ids, "n_fg": (m >= 128).sum((1, 2)), "x1": pa.array(box[:, 0].astype(np.int32), mask=~some), "y2": pa.array(box[:, 3].astype(np.int32), mask=~some),
                "placed": (m.astype(np.int64) * place).sum((1, 2))}

    rows = I.image_rows(spark, sf, 16, 16, angle=(C("frame_id") % 21 - 10).cast("double"))
    return K.over(rows, finish, "frame_id bigint, n_fg bigint, x1 int, y2 int, placed bigint")


def _geometry_sql():
    """The same turn, crop choice and flip pixel by pixel: bilinear reads of four neighbours, edges repeated for the image."""
    p = "p_partkey"
    turn = "round(cos(a)*({x}-8)-sin(a)*({y}-8)+8,9) AS sx, round(sin(a)*({x}-8)+cos(a)*({y}-8)+8,9) AS sy"

    def corner(v, dy, dx):
        return f"(CASE WHEN {dx}=1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END)*(CASE WHEN {dy}=1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END)*{v}"

    return f"""
WITH scene AS (SELECT *, (x*16+frame_id)%256 AS r, (y*16+p_size*3)%256 AS g, (x*y+frame_id*5)%256 AS b FROM px),
f AS (SELECT {p} AS frame_id, radians({_u('geo-geo-angle', -10.0, 10.0, p)}) AS a, {_u('geo-geo-flip', 0, 1, p)}<0.5 AS flip FROM part),
d AS (SELECT CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM range(2) u(dy), range(2) v(dx)),
tm AS (SELECT s.frame_id, s.y, s.x, sum({corner('coalesce(n.gt_v,0)', 'dy', 'dx')}) AS v FROM (SELECT frame_id, y, x, {turn.format(x='x', y='y')} FROM px JOIN f USING (frame_id)) s CROSS JOIN d
  LEFT JOIN px n ON n.frame_id=s.frame_id AND n.y=CAST(floor(sy) AS INT)+dy AND n.x=CAST(floor(sx) AS INT)+dx GROUP BY 1,2,3),
turned AS (SELECT frame_id, y, x, round(v,9)>=128 AS fg FROM tm),
need AS (SELECT frame_id, ceil(0.5e0*count(*) FILTER (WHERE gt_v>=128)) AS need FROM px GROUP BY 1),
q0 AS (SELECT frame_id, attempt, {_half_even("sqrt(a*ar)")} AS cw, {_half_even("sqrt(a/ar)")} AS ch FROM (SELECT {p} AS frame_id, attempt,
   256*{_u('geo-geo-area', 0.5, 1.0, "p_partkey,'|',attempt")} AS a, exp({_u('geo-geo-ratio', math.log(3 / 4), math.log(4 / 3), "p_partkey,'|',attempt")}) AS ar FROM part CROSS JOIN range(10) t(attempt))),
q AS (SELECT *, CAST(floor({_u('geo-geo-x', 0, 1, "frame_id,'|',attempt")}*(17-cw)) AS INT) AS x0, CAST(floor({_u('geo-geo-y', 0, 1, "frame_id,'|',attempt")}*(17-ch)) AS INT) AS y0 FROM q0 WHERE cw BETWEEN 1 AND 16 AND ch BETWEEN 1 AND 16),
s AS (SELECT q.frame_id, attempt, cw, ch, x0, y0, count(*) FILTER (WHERE fg AND x>=x0 AND x<x0+cw AND y>=y0 AND y<y0+ch) AS vis FROM q JOIN turned USING (frame_id) GROUP BY ALL),
ok AS (SELECT s.*, row_number() OVER (PARTITION BY s.frame_id ORDER BY attempt) AS rn FROM s JOIN need USING (frame_id) WHERE need=0 OR vis>=greatest(1,need)),
c AS (SELECT f.*, coalesce(cw,16) AS cw, coalesce(ch,16) AS ch, coalesce(x0,0) AS x0, coalesce(y0,0) AS y0 FROM f LEFT JOIN ok ON ok.frame_id=f.frame_id AND rn=1),
o AS (SELECT frame_id, y, x, CASE WHEN flip THEN cw-1-x ELSE x END+x0 AS ox, y+y0 AS oy, a, cw, ch FROM (SELECT c.*, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM c, range(16) u(y), range(16) v(x)) WHERE x<cw AND y<ch),
w AS (SELECT *, {turn.format(x='ox', y='oy')} FROM o),
im AS (SELECT w.frame_id, w.y, w.x, {', '.join(f"sum({corner('n.' + c, 'dy', 'dx')}) AS {c}" for c in RGB)} FROM w CROSS JOIN d
  JOIN scene n ON n.frame_id=w.frame_id AND n.y=least(greatest(CAST(floor(sy) AS INT)+dy,0),15) AND n.x=least(greatest(CAST(floor(sx) AS INT)+dx,0),15) GROUP BY 1,2,3),
mk AS (SELECT w.frame_id, w.y, w.x FROM w JOIN turned t ON t.frame_id=w.frame_id AND t.y=w.oy AND t.x=w.ox WHERE fg),
mb AS (SELECT frame_id, CAST(sum((x+1)*(y+2)) AS BIGINT) AS mask_placed, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2 FROM mk GROUP BY 1)
SELECT c.frame_id, cw, ch, {', '.join(f'{c} AS {c}' for c in RGB)}, coalesce(mask_placed,0) AS mask_placed, x1, y1, x2, y2 FROM c
JOIN (SELECT frame_id, {', '.join(f"CAST(sum(floor(round({c},9)+0.5)*{_PLACE}) AS BIGINT) AS {c}" for c in RGB)} FROM im GROUP BY 1) i USING (frame_id) LEFT JOIN mb USING (frame_id)"""


@query("I14 I15 I16 I21 I22", _geometry_sql(), "px")
def geometry_in_step(spark, sf):
    """The policy's geometric block: one turn, crop and flip for image, mask and box; the box is that of the new mask."""
    def finish(f):
        place = np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
        levels = np.round(f.rgb * 255).astype(np.int64)
        box, some = f.p["box"], f.p["boxed"]
        return {"frame_id": f.ids, "cw": f.p["cw"].astype(np.int32), "ch": f.p["ch"].astype(np.int32), **dict(zip(RGB, _place_sums(levels))),
                "mask_placed": ((f.mask >= 128) * place).sum((1, 2)), **{n: pa.array(box[:, i].astype(np.int32), mask=~some) for i, n in enumerate(("x1", "y1", "x2", "y2"))}}

    schema = "frame_id bigint, cw int, ch int, r bigint, g bigint, b bigint, mask_placed bigint, x1 int, y1 int, x2 int, y2 int"
    return images.policy(I.image_rows(spark, sf, 16, 16), "none", seed="geo", geometry=(16, 16), finish=finish, schema=schema)


@query("I17", f"SELECT frame_id, {', '.join(f'sum(({c}-{c}%(1<<(8-bits)))*{_PLACE})::BIGINT AS p{c}, sum((CASE WHEN {c}<thr THEN {c} ELSE 255-{c} END)*{_PLACE})::BIGINT AS s{c}' for c in RGB)} FROM (SELECT *, CAST(frame_id%4+1 AS INT) AS bits, 128+frame_id%100 AS thr FROM rgb) GROUP BY frame_id", "rgb")
def posterise_solarise(spark, sf):
    f = C("frame_id")

    def finish(f):
        tables = {"p": K.posterise_table(f.p["bits"]), "s": K.solarise_table(f.p["thr"])}
        out = {f"{t}{c}": v for t, table in tables.items() for c, v in zip(RGB, _place_sums(K.look_up(np.broadcast_to(table[:, None], (len(table), 3, 256)), f.rgb)))}
        return {"frame_id": f.ids, **out}

    return K.over(I.image_rows(spark, sf, bits=(f % 4 + 1).cast("int"), thr=f % 100 + 128), finish, "frame_id bigint, " + ", ".join(f"{t}{c} bigint" for t in "ps" for c in RGB))


@query("I17", f"SELECT frame_id, {', '.join(f'sum((CASE WHEN hi{c}>lo{c} THEN floor(round(({c}-lo{c})*255e0/(hi{c}-lo{c}),9)) ELSE {c} END)*{_PLACE})::BIGINT AS {c}' for c in RGB)} FROM (SELECT *, {', '.join(f'min({c}) OVER w AS lo{c}, max({c}) OVER w AS hi{c}' for c in RGB)} FROM rgb WINDOW w AS (PARTITION BY frame_id)) GROUP BY frame_id", "rgb")
def autocontrast(spark, sf):
    def finish(f):
        return {"frame_id": f.ids, **dict(zip(RGB, _place_sums(K.look_up(K.autocontrast_table(K.histograms(f.rgb)), f.rgb))))}

    return K.over(I.image_rows(spark, sf), finish, "frame_id bigint, r bigint, g bigint, b bigint")


@query("I17", """
WITH l AS (SELECT frame_id, 'r' AS channel, r//32 AS level FROM rgb UNION ALL SELECT frame_id, 'g', g//32 FROM rgb UNION ALL SELECT frame_id, 'b', b//32 FROM rgb),
h AS (SELECT frame_id, channel, level, count(*)*64 AS n FROM l GROUP BY 1,2,3),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY frame_id,channel ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, sum(n) OVER w AS total, count(*) OVER w AS levels, arg_max(n,level) OVER w AS lastn FROM h WINDOW w AS (PARTITION BY frame_id,channel))
SELECT frame_id, channel, level, CAST(CASE WHEN levels>1 AND (total-lastn)//255>0 THEN least((((total-lastn)//255)//2+before)//((total-lastn)//255),255) ELSE level END AS INT) AS out FROM c""", "rgb")
def equalise_levels(spark, sf):
    """Levels coarsened and every pixel counted 64 times, so that the integer step is not zero."""
    def finish(f):
        hist = K.histograms(f.rgb // 32) * 64
        table = K.equalise_table(hist)
        row, channel, level = np.nonzero(hist)
        return {"frame_id": f.ids[row], "channel": pa.array(list("rgb")).take(pa.array(channel)), "level": level.astype(np.int32), "out": table[row, channel, level].astype(np.int32)}

    return K.over(I.image_rows(spark, sf), finish, "frame_id bigint, channel string, level int, out int")


def _mix_sql():
    """Chains on the levels of each frame and channel, weighted by how many pixels have them."""
    key = "frame_id,'|',br"
    src = f"""(SELECT frame_id, channel, level, n, br, level AS value, CAST(floor({_u('mix-depth', 0, 1, key)}*3) AS INT)+1 AS depth FROM
      (SELECT frame_id, channel, level, count(*) AS n FROM long GROUP BY 1,2,3) CROSS JOIN (SELECT CAST(i AS INT) AS br FROM range(3) t(i)))"""
    for step in range(3):
        src = f"""(SELECT frame_id, channel, level, n, br, depth, CAST(CASE
          WHEN op=0 THEN CASE WHEN hi>lo THEN least(greatest(floor(round((value-lo)*255e0/(hi-lo),9)),0),255) ELSE value END
          WHEN op=1 THEN CASE WHEN hi>lo AND (total-top)//255>0 THEN least((((total-top)//255)//2+below)//((total-top)//255),255) ELSE value END
          WHEN op=2 THEN value-value%(1<<(8-(4-CAST(floor(lvl*0.4e0) AS INT)))) WHEN op=3 THEN CASE WHEN value<256-floor(lvl*25.6e0) THEN value ELSE 255-value END ELSE value END AS INT) AS value
          FROM (SELECT *, sum(CASE WHEN value=hi THEN n ELSE 0 END) OVER (PARTITION BY frame_id,channel,br) AS top FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, sum(n) OVER w AS total,
            coalesce(sum(n) OVER (PARTITION BY frame_id,channel,br ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below,
            CASE WHEN depth>{step} THEN CAST(floor({_u(f'mix-op{step}', 0, 1, key)}*4) AS INT) ELSE -1 END AS op, {_u(f'mix-level{step}', 0.1, 3.0, key)} AS lvl FROM {src} WINDOW w AS (PARTITION BY frame_id,channel,br))))"""
    return f"""
WITH long AS (SELECT frame_id, 'r' AS channel, r AS level FROM rgb UNION ALL SELECT frame_id, 'g', g FROM rgb UNION ALL SELECT frame_id, 'b', b FROM rgb),
m AS (SELECT frame_id, channel, level, sum(value*wt)/sum(wt)/255e0 AS mix FROM (SELECT *, -ln(greatest({_u('mix-weight', 0, 1, key)},1e-12)) AS wt FROM {src}) GROUP BY 1,2,3),
o AS (SELECT u.frame_id, y, x, {', '.join(f"(1-bl)*u.{c}/255e0+bl*m{c}.mix AS {c}" for c in RGB)} FROM (SELECT *, {_u('mix-blend')} AS bl FROM rgb) u {' '.join(f"JOIN m m{c} ON m{c}.frame_id=u.frame_id AND m{c}.channel='{c}' AND m{c}.level=u.{c}" for c in RGB)})
{_means_sql('o')}"""


@query("I18 I17 I21", _mix_sql(), "rgb")
def chain_mix(spark, sf):
    return images.policy(I.image_rows(spark, sf), "augmix", seed="mix", finish=K.weighted, schema=K.WEIGHTED)


def _randconv_sql():
    k3 = f"{_u('rc-k')}>=0.5"
    m = lambda e: f"CASE WHEN ({e}+14)%14<8 THEN ({e}+14)%14 ELSE 14-({e}+14)%14 END"
    sd = "CASE WHEN k3 THEN sqrt(2e0/27) ELSE sqrt(2e0/3) END"
    wts = ", ".join(f"{_stream('rk', f'(({o}*3+dy+1)*3+dx+1)*3+{i}')}*{sd} AS w{o}{i}" for o in range(3) for i in range(3))
    ys = ", ".join(f"sum(w{o}0*s.r+w{o}1*s.g+w{o}2*s.b) AS y{o}" for o in range(3))
    return f"""
WITH u AS {_BASE}, f AS (SELECT p_partkey AS frame_id, {k3.replace('frame_id', 'p_partkey')} AS k3, {_u('rc-alpha', 0, 1, 'p_partkey')} AS al, {_key('rc-rc', 'p_partkey')} AS rk FROM part),
o AS (SELECT frame_id, k3, rk, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx FROM f JOIN range(-1,2) a(dy) ON k3 OR dy=0 JOIN range(-1,2) b(dx) ON k3 OR dx=0),
w AS (SELECT frame_id, dy, dx, {wts} FROM o),
y AS (SELECT a.frame_id, a.y, a.x, {ys} FROM u a JOIN w ON w.frame_id=a.frame_id JOIN u s ON s.frame_id=a.frame_id AND s.y={m('a.y+w.dy')} AND s.x={m('a.x+w.dx')} GROUP BY 1,2,3),
j AS (SELECT u.*, y0, y1, y2, al, avg((r+g+b)/3) OVER q AS mx, sqrt(greatest(avg((r*r+g*g+b*b)/3) OVER q - pow(avg((r+g+b)/3) OVER q,2),0))+1e-6 AS sx,
  avg((y0+y1+y2)/3) OVER q AS my, sqrt(greatest(avg((y0*y0+y1*y1+y2*y2)/3) OVER q - pow(avg((y0+y1+y2)/3) OVER q,2),0))+1e-6 AS sy
  FROM u JOIN y USING (frame_id,y,x) JOIN f USING (frame_id) WINDOW q AS (PARTITION BY frame_id))
SELECT frame_id, {', '.join(f"round(avg(least(greatest((1-al)*{c}+al*((y{o}-my)/sy*sx+mx),0),1)*{_PLACE}),5) AS {c}" for o, c in enumerate(RGB))} FROM j GROUP BY frame_id"""


@query("I19", _randconv_sql(), "rgb")
def random_convolution(spark, sf):
    return images.policy(I.image_rows(spark, sf), "randconv", seed="rc", finish=K.weighted, schema=K.WEIGHTED)


@query("I20", f"""
WITH base AS (SELECT frame_id, y, x, {', '.join(_interp_sql(f'({c}/255e0)', SHIFT_TONE_X, SHIFT_TONE_Y) + f' AS {c}' for c in RGB)} FROM rgb), soft AS (SELECT * FROM {_blur_sql('base', '1.2e0', '3', 8, 8)}),
sharp AS (SELECT b.frame_id, b.y, b.x, {', '.join(f'2.5e0*b.{c}-1.5e0*s.{c} AS {c}' for c in RGB)} FROM base b JOIN soft s USING (frame_id,y,x))
{_means_sql(_each_sql(_affine_sql('sharp', _sat_sql('1.4e0')), _CLIP))}""", "rgb")
def held_out_shift(spark, sf):
    return _weighted(I.image_rows(spark, sf), K.held_out_shift)


def _policy_sql():
    """Every stage in order. Cells of the resampling are never under 8 a side, so at 8 x 8 pixels that stage changes nothing."""
    u = lambda tag, lo=0, hi=1: _u(f"cam-{tag}", lo, hi, "p_partkey")
    blur = f"{u('side')}<0.5"
    p = (f"SELECT p_partkey AS frame_id, 1+({u('sat', 0.6, 1.3)}-1) AS sat, {u('hue', -0.05, 0.05)} AS hue, CASE WHEN {blur} THEN 0.3e0+{u('blur', 0.1, 1.2)} ELSE 0.5e0+{u('unsharp', 0.0, 1.0)} END AS sg, "
         f"CASE WHEN {blur} THEN NULL ELSE {u('amount', 0.3, 1.5)} END AS amt, CASE WHEN {u('chroma')}<0.2 THEN CAST(floor({u('dx')}*3) AS INT)-1 ELSE 0 END AS dx, CASE WHEN {u('chroma')}<0.2 THEN CAST(floor({u('dy')}*3) AS INT)-1 ELSE 0 END AS dy FROM part")
    toned = _each_sql(_affine_sql(_affine_sql("d", _sat_sql("sat")), _hue_sql("hue")), _CLIP)
    soft = _blur_sql("c", "a.sg", "a.hf", 8, 8, ", a.sg, a.hf")
    shifted = ", ".join(f"a{c}.{c} AS {c}" for c in RGB)
    at = {"r": ("-", "-"), "b": ("+", "+")}
    joins = " ".join(f"JOIN e a{c} ON a{c}.frame_id=e.frame_id AND a{c}.x=least(greatest(e.x{at[c][0]}e.dx,0),7) AND a{c}.y=least(greatest(e.y{at[c][1]}e.dy,0),7)" if c in at else
                     f"JOIN e a{c} ON a{c}.frame_id=e.frame_id AND a{c}.x=e.x AND a{c}.y=e.y" for c in RGB)
    return f"""
WITH p AS ({p}), d AS MATERIALIZED (SELECT v.frame_id, v.y, v.x, r, g, b, p.* EXCLUDE (frame_id), greatest(1,least(CAST(floor(2.5e0*sg) AS INT),4)) AS hf FROM {_camera_sql('raw', 'cam')} v JOIN p ON p.frame_id=v.frame_id),
c AS MATERIALIZED (SELECT * FROM {toned}), soft AS (SELECT * FROM {soft}),
e AS MATERIALIZED (SELECT c.frame_id, c.y, c.x, c.dx, c.dy, {', '.join(f"CASE WHEN amt IS NULL THEN soft.{k} ELSE least(greatest((1+amt)*c.{k}-amt*soft.{k},0e0),1e0) END AS {k}" for k in RGB)} FROM c JOIN soft USING (frame_id,y,x)),
z AS (SELECT e.frame_id, e.y, e.x, {shifted} FROM e {joins})
{_means_sql('z')}"""


@query("I21 I6 I7 I8 I9 I10 I11 I12", _policy_sql(), "rgb")
def camera_policy(spark, sf):
    return images.policy(I.image_rows(spark, sf), "cpr", seed="cam", finish=K.weighted, schema=K.WEIGHTED)


def _skin_sql(band):
    return (f"count(*) FILTER (WHERE floor((r-(0.299e0*r+0.587e0*g+0.114e0*b))*0.713e0+128.5e0) BETWEEN {band[0]} AND {band[1]} "
            f"AND floor((b-(0.299e0*r+0.587e0*g+0.114e0*b))*0.564e0+128.5e0) BETWEEN {band[2]} AND {band[3]})")


@query("M7", f"SELECT frame_id, {_skin_sql(SKIN_TIGHT)} AS tight, {_skin_sql(SKIN_LOOSE)} AS loose FROM rgb GROUP BY frame_id", "rgb")
def skin_bands(spark, sf):
    def finish(f):
        return {"frame_id": f.ids, **{n: K.skin(f.rgb, b).sum((1, 2)) for n, b in (("tight", SKIN_TIGHT), ("loose", SKIN_LOOSE))}}

    return K.over(I.image_rows(spark, sf), finish, "frame_id bigint, tight bigint, loose bigint")


@query("M7 M8 M18 L6")
def skin_mask(spark, sf):
    """Band, open 3, close 3, largest component: one box per frame that has any."""
    def finish(f):
        m = np.where(K.skin(f.rgb, SKIN_LOOSE), 255, 0)
        return K.components(f.ids, K.closed(K.opened(m, 3), 3) >= 128)

    comp = K.over(I.image_rows(spark, sf), finish, K.COMPONENTS)
    best = F.max(F.struct(C("area").alias("area"), (-C("label")).alias("o"), "x1", "y1", "x2", "y2")).alias("t")
    return comp.groupBy("frame_id").agg(best).select("frame_id", "t.area", "t.x1", "t.y1", "t.x2", "t.y2")
