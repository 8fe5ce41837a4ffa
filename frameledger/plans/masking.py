"""Masks, heat maps and frame picking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frameledger.constants import MASK_THRESHOLD
from frameledger.functions import boxes
from frameledger.functions.numeric import bce_with_logits, flag, mean_or_zero, sigmoid
from frameledger.operators import frames as K
from frameledger.operators import heatmaps, masks, picking
from frameledger.plans import inputs as I
from frameledger.plans.registry import query

C = F.col


@query("M1 M3", """SELECT p_partkey AS frame_id, x1, y1, x2, y2 FROM part LEFT JOIN maskstats ON frame_id = p_partkey""", "maskstats")
def mask_boxes(spark, sf):
    return masks.stats(I.px(spark, sf), "gt_v").select("frame_id", "x1", "y1", "x2", "y2")


@query("M2 M1", "SELECT frame_id, round(avg(CASE WHEN pr_v>=128 THEN 1e0 ELSE 0e0 END),6) AS area FROM px GROUP BY frame_id", "px")
def mask_area(spark, sf):
    return I.px(spark, sf).groupBy("frame_id").agg(F.round(F.avg(flag(masks.foreground("pr_v"))), 6).alias("area"))


@query("M4", """SELECT frame_id, round(CASE WHEN g+p-i>0 THEN i/(g+p-i) ELSE 1 END,6) AS iou_hand, round(CASE WHEN n-i>0 THEN (n-(g+p-i))/(n-i) ELSE 1 END,6) AS iou_bg,
 round((CASE WHEN g+p-i>0 THEN i/(g+p-i) ELSE 1 END + CASE WHEN n-i>0 THEN (n-(g+p-i))/(n-i) ELSE 1 END)/2,6) AS miou, round(CASE WHEN g+p>0 THEN 2*i/(g+p) ELSE 1 END,6) AS dice FROM maskpair""", "maskpair")
def segmentation_scores(spark, sf):
    s = masks.overlap_scores(C("inter"), C("n_gt"), C("n_pr"), C("n_px"))
    return I.maskpair(spark, sf).select("frame_id", *[F.round(v, 6).alias(k) for k, v in s.items()])


_SHAPE = """
WITH q AS (SELECT m.*, g/n AS area, greatest(gx2-gx1,1) AS bw, greatest(gy2-gy1,1) AS bh, (gx1+gx2)/2e0/16 AS cx, (gy1+gy2)/2e0/16 AS cy FROM maskpair m),
s AS (SELECT *, bw/CAST(bh AS DOUBLE) AS aspect, g/(bw*bh) AS fill, gx1<=1 OR gy1<=1 OR gx2>=15 OR gy2>=15 AS edge FROM q) """


@query("M5 F3", _SHAPE + "SELECT frame_id, round(area,6) AS area, round(aspect,6) AS aspect, round(cx,6) AS cx, round(cy,6) AS cy, round(fill,6) AS fill FROM s WHERE g>0", "maskpair")
def mask_shape(spark, sf):
    sh = masks.shape(masks.stats(I.px(spark, sf), "gt_v")).filter("n_fg > 0")
    return sh.select("frame_id", *[F.round(c, 6).alias(c) for c in ("area", "aspect", "cx", "cy", "fill")])


def _flags_sql(multi: str = "") -> str:
    """Printed values are rounded first, halves up, since engines print halves differently."""
    return _SHAPE + f""", f AS (SELECT frame_id, CASE WHEN g=0 THEN 'EMPTY_MASK' ELSE concat_ws(';',
  CASE WHEN area<0.01 THEN printf('TOO_SMALL(%.1f%%)', round(area*100,1)) END, CASE WHEN area>0.075 THEN printf('TOO_LARGE(%.1f%%)', round(area*100,1)) END,
  CASE WHEN NOT aspect BETWEEN 0.35 AND 1.6 THEN printf('ASPECT(%.2f)', round(aspect,2)) END,
  CASE WHEN NOT (cx BETWEEN 0.15 AND 0.85 AND cy BETWEEN 0.15 AND 0.85) THEN printf('OFF_CENTRE(%.2f,%.2f)', round(cx,2), round(cy,2)) END,
  CASE WHEN edge THEN 'TOUCHES_BORDER' END, {multi} CASE WHEN fill<0.3 THEN printf('LOW_FILL(%.2f)', round(fill,2)) END) END AS flags FROM s) """


def _names_only(flags):
    """Flag names without their printed values (print rounding of halves differs by engine)."""
    return F.array_join(F.transform(flags, lambda f: F.regexp_replace(f, r"\(.*\)", "")), ";")


@query("P18 F11", _flags_sql() + "SELECT frame_id, flags FROM f", "maskpair")
def mask_qc_flags(spark, sf):
    sh = masks.qc_flags(masks.shape(masks.stats(I.px(spark, sf), "gt_v")))
    return sh.select("frame_id", F.array_join("flags", ";").alias("flags"))


@query("P19", _SHAPE + """SELECT frame_id, CASE WHEN g=0 THEN 'NO_HAND_DETECTED' ELSE concat_ws(';', CASE WHEN NOT area*100 BETWEEN 1.59 AND 4.73 THEN 'AREA_OUT_OF_BAND' END,
 CASE WHEN gx1=0 OR gy1=0 OR gx2=16 OR gy2=16 THEN 'TOUCHES_BORDER' END) END AS flags FROM s""", "maskpair")
def mask_band_flags(spark, sf):
    sh = masks.band_flags(masks.shape(masks.stats(I.px(spark, sf), "gt_v")))
    return sh.select("frame_id", _names_only(C("flags")).alias("flags"))


@query("P20", _SHAPE + """SELECT frame_id, round(CASE WHEN g=0 THEN -10 ELSE -(6*greatest(0.01e0-area,0)/0.01e0 + 6*greatest(area-0.075e0,0)/0.075e0
 + 2*greatest(0.35e0-aspect,0) + 2*greatest(aspect-1.6e0,0) + 2*(abs(cx-0.45e0)+abs(cy-0.49e0)) + 2*greatest(0.3e0-fill,0)) END,6) AS prior FROM s""", "maskpair")
def hand_prior(spark, sf):
    return masks.hand_prior(masks.shape(masks.stats(I.px(spark, sf), "gt_v"))).select("frame_id", F.round("prior", 6).alias("prior"))


@query("A29 K9", _flags_sql() + "SELECT count(*) FILTER (WHERE flags<>'') AS n_flagged, count(*) FILTER (WHERE flags='EMPTY_MASK') AS n_empty, count(*) AS n FROM f", "maskpair")
def flagged_rows(spark, sf):
    sh = masks.qc_flags(masks.shape(masks.stats(I.px(spark, sf), "gt_v")))
    return sh.agg(F.count_if(F.size("flags") > 0).alias("n_flagged"),
                  F.count_if(F.array_contains("flags", "EMPTY_MASK")).alias("n_empty"), F.count(F.lit(1)).alias("n"))


@query("P8", "SELECT frame_id, g=0 AS dropped, CASE WHEN g=0 THEN NULL ELSE concat('ann/', frame_id) END AS ann FROM maskpair", "maskpair")
def empty_mask_demotion(spark, sf):
    """A blank mask loses its supervision; the frame stays."""
    st = masks.stats(I.px(spark, sf), "gt_v")
    return st.select("frame_id", (C("n_fg") == 0).alias("dropped"),
                     F.when(C("n_fg") > 0, F.concat(F.lit("ann/"), C("frame_id").cast("string"))).alias("ann"))


_RESIZED = """
WITH s AS (SELECT frame_id, y//4 AS y, x//4 AS x, CASE WHEN avg(CASE WHEN pr_v>=128 THEN 255e0 ELSE 0 END)>=128 THEN 255 ELSE 0 END AS v FROM px GROUP BY 1,2,3) """


@query("I13 P7", _RESIZED + "SELECT frame_id, max(v)=255 AS has_mask, count(*) FILTER (WHERE v=255) AS n_fg FROM s GROUP BY frame_id", "px")
def resized_mask_demotion(spark, sf):
    small = masks.stats(masks.resize_mask(I.px(spark, sf), "pr_v", 4), "pr_v")
    return small.select("frame_id", (C("n_fg") > 0).alias("has_mask"), "n_fg")


@query("I13", "SELECT frame_id, y//2 AS y, x//2 AS x, round(avg(gt_v),6) AS gt_v FROM px GROUP BY 1,2,3", "px")
def area_resize(spark, sf):
    return masks.block_mean(I.px(spark, sf), "gt_v", 2).withColumn("gt_v", F.round("gt_v", 6))


_NB = """(SELECT frame_id, y, x, gt_v AS v, coalesce(lag(gt_v) OVER r, lead(gt_v) OVER r) + coalesce(lead(gt_v) OVER r, lag(gt_v) OVER r)
 + coalesce(lag(gt_v) OVER c, lead(gt_v) OVER c) + coalesce(lead(gt_v) OVER c, lag(gt_v) OVER c) - 4*gt_v AS lap
 FROM px WINDOW r AS (PARTITION BY frame_id,y ORDER BY x), c AS (PARTITION BY frame_id,x ORDER BY y))"""


@query("M6", f"SELECT frame_id, CAST(round(var_pop(lap)*65536) AS BIGINT) AS sharpness FROM {_NB} GROUP BY frame_id", "px")
def sharpness(spark, sf):
    """Scaled by the squared pixel count, where the variance of whole numbers is whole."""
    def finish(f):
        return {"frame_id": f.ids, "sharpness": np.round(K.laplacian_variance(f.mask) * 65536).astype(np.int64)}

    return K.over(I.image_rows(spark, sf, 16, 16).drop("rgb"), finish, "frame_id bigint, sharpness bigint")


def _slide_sql(steps):
    """Nested separable min/max windows of radius 1 as SQL."""
    src = "(SELECT frame_id, y, x, CASE WHEN gt_v>=60 THEN 255 ELSE 0 END AS v FROM px)"
    for fn in steps:
        for part, order in (("y", "x"), ("x", "y")):
            src = f"(SELECT frame_id, y, x, {fn}(v) OVER (PARTITION BY frame_id,{part} ORDER BY {order} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src})"
    return src


@query("M8", f"SELECT 'opened' AS op, frame_id, count(*) FILTER (WHERE v=255) AS n, CAST(sum(v*(x+1)*(y+2)) AS BIGINT) AS placed FROM {_slide_sql(['min', 'max'])} GROUP BY frame_id UNION ALL SELECT 'closed', frame_id, count(*) FILTER (WHERE v=255), CAST(sum(v*(x+1)*(y+2)) AS BIGINT) FROM {_slide_sql(['max', 'min'])} GROUP BY frame_id", "px")
def morphology(spark, sf):
    def finish(f):
        m, place = np.where(f.mask >= 60, 255, 0), np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
        both = {"opened": K.opened(m, 3), "closed": K.closed(m, 3)}
        return {"op": np.repeat(list(both), len(f.ids)), "frame_id": np.tile(f.ids, 2), "n": np.concatenate([(v == 255).sum((1, 2)) for v in both.values()]),
                "placed": np.concatenate([(v * place).sum((1, 2)) for v in both.values()])}

    return K.over(I.image_rows(spark, sf, 16, 16).drop("rgb"), finish, "op string, frame_id bigint, n bigint, placed bigint")


_PLATE = "(SELECT scene, y, x, count(*) AS n, CAST(floor(quantile_cont(r,0.5)) AS INT) AS r, CAST(floor(quantile_cont(g,0.5)) AS INT) AS g, CAST(floor(quantile_cont(b,0.5)) AS INT) AS b FROM rgb GROUP BY scene, y, x)"


@query("M9 J13", f"SELECT scene, y, x, n, CASE WHEN n>=5 THEN r END AS r, CASE WHEN n>=5 THEN g END AS g, CASE WHEN n>=5 THEN b END AS b FROM {_PLATE}", "rgb")
def background_plate(spark, sf):
    return masks.background_plate(I.rgb(spark, sf), "scene", ["r", "g", "b"])


@query("M10", f"SELECT frame_id, round(avg(least(sqrt(0.25e0*(a.r-p.r)*(a.r-p.r)+(a.g-p.g)*(a.g-p.g)+(a.b-p.b)*(a.b-p.b)),255)),6) AS dist FROM rgb a JOIN {_PLATE} p USING (scene,y,x) GROUP BY frame_id", "rgb")
def plate_distance(spark, sf):
    px = I.rgb(spark, sf)
    d = masks.plate_distance(px, masks.background_plate(px, "scene", ["r", "g", "b"]), "scene", "r", "g", "b")
    return d.groupBy("frame_id").agg(F.round(F.avg("dist"), 6).alias("dist"))


@query("M11", """
WITH h AS (SELECT frame_id, gt_v AS level, count(*) AS n FROM px GROUP BY 1,2),
c AS (SELECT frame_id, level, CAST(sum(n) OVER w AS DOUBLE) AS n0, CAST(sum(n*level) OVER w AS DOUBLE) AS s0, CAST(sum(n) OVER f AS DOUBLE) AS nt, CAST(sum(n*level) OVER f AS DOUBLE) AS st FROM h
  WINDOW w AS (PARTITION BY frame_id ORDER BY level ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY frame_id)),
b AS (SELECT frame_id, level, CASE WHEN nt>n0 THEN round(n0*(nt-n0)*(s0/n0-(st-s0)/(nt-n0))*(s0/n0-(st-s0)/(nt-n0))/(nt*nt),9) ELSE 0 END AS v FROM c)
SELECT frame_id, min(level) AS threshold FROM b WHERE v = (SELECT max(v) FROM b b2 WHERE b2.frame_id=b.frame_id) GROUP BY frame_id""", "px")
def otsu_threshold(spark, sf):
    return masks.otsu(I.px(spark, sf), "gt_v")


@query("M12", "SELECT frame_id, count(*) FILTER (WHERE gt_v>=128) AS before, count(*) FILTER (WHERE gt_v>=128 AND (x-frame_id%7)*(p_size%3-1)+(y-frame_id%5)*(frame_id%2)>=0) AS after FROM px GROUP BY frame_id", "px")
def wrist_cut(spark, sf):
    f, s = C("frame_id"), C("p_size")
    marks = I.frame_rows(spark, sf).select("frame_id", (f % 7).alias("wx"), (f % 5).alias("wy"), (s % 3 - 1).alias("dx"), (f % 2).alias("dy"))
    px = I.px(spark, sf)
    cut = masks.half_plane(px.withColumn("cut", C("gt_v")), marks, "cut")
    return cut.groupBy("frame_id").agg(F.count_if(masks.foreground("gt_v")).alias("before"), F.count_if(masks.foreground("cut")).alias("after"))


@query("M13", """SELECT frame_id, round(greatest(0,x0-0.12e0*(x1-x0)),6) AS x1, round(greatest(0,y0-0.12e0*(y1-y0)),6) AS y1, round(least(640,x1+0.12e0*(x1-x0)),6) AS x2, round(least(480,y1+0.12e0*(y1-y0)),6) AS y2
FROM (SELECT frame_id, min((frame_id*7+rk*53)%640) AS x0, max((frame_id*7+rk*53)%640) AS x1, min((frame_id*3+rk*31)%480) AS y0, max((frame_id*3+rk*31)%480) AS y1 FROM cands GROUP BY frame_id)""", "cands")
def landmark_box(spark, sf):
    c = I.cands(spark, sf).select("frame_id", ((C("frame_id") * 7 + C("rk") * 53) % 640).alias("lx"), ((C("frame_id") * 3 + C("rk") * 31) % 480).alias("ly"))
    hull = c.groupBy("frame_id").agg(F.min("lx").alias("x0"), F.min("ly").alias("y0"), F.max("lx").alias("x9"), F.max("ly").alias("y9"))
    b = boxes.pad_clamp([C("x0"), C("y0"), C("x9"), C("y9")], 0.12, 640, 480)
    return hull.select("frame_id", *[F.round(v, 6).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])


@query("M14", "SELECT frame_id, count(*) FILTER (WHERE x>=frame_id%6 AND x<frame_id%6+5 AND y>=p_size%6 AND y<p_size%6+4) AS n FROM px GROUP BY frame_id", "px")
def box_mask(spark, sf):
    f, s = C("frame_id") % 6, C("p_size") % 6
    return masks.paint_box(I.px(spark, sf), f, s, f + 5, s + 4).groupBy("frame_id").agg(F.count_if(C("mask") == 255).alias("n"))


@query("M15", """
WITH p AS (SELECT p_partkey AS frame_id, CAST(p_partkey % 24 AS INT)-1 AS cx, CAST(p_size % 22 AS INT) AS cy, CAST(p_partkey % 4 AS INT) AS r FROM part
 UNION ALL SELECT p_partkey, CAST(p_size % 21 AS INT), CAST(p_partkey % 21 AS INT), 2 FROM part),
s AS (SELECT frame_id, cy+dy AS y, cx+dx AS x, exp(-(dx*dx+dy*dy)/(2e0*((2*r+1)/6e0)*((2*r+1)/6e0))) AS h FROM p JOIN range(-3,4) a(dx) ON abs(dx)<=r JOIN range(-3,4) b(dy) ON abs(dy)<=r WHERE cx BETWEEN 0 AND 20 AND cy BETWEEN 0 AND 20)
SELECT frame_id, count(*) AS cells, round(sum(m),6) AS mass, round(max(m),6) AS peak FROM (SELECT frame_id, y, x, max(h) AS m FROM s WHERE x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20 AND h>=1.1920928955078125e-07 GROUP BY 1,2,3) GROUP BY frame_id""")
def gaussian_splat(spark, sf):
    rows = I.frame_rows(spark, sf)
    f, s = C("frame_id"), C("p_size")
    both = F.array(F.struct((f % 24 - 1).cast("int").alias("cx"), (s % 22).cast("int").alias("cy"), (f % 4).cast("int").alias("r")),
                   F.struct((s % 21).cast("int").alias("cx"), (f % 21).cast("int").alias("cy"), F.lit(2).alias("r")))
    h = heatmaps.splat(rows.select("frame_id", F.explode(both).alias("p")).select("frame_id", "p.*"), "cx", "cy", "r", 21, 21)
    return h.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("heat"), 6).alias("mass"), F.round(F.max("heat"), 6).alias("peak"))


@query("M16", "SELECT frame_id, round(sum(gt_v*(CASE WHEN pr_v>=128 THEN 1e0 ELSE 0e0 END))/(sum(CASE WHEN pr_v>=128 THEN 1e0 ELSE 0e0 END)+1e-6),5) AS masked, round(avg(gt_v),5) AS whole FROM px GROUP BY frame_id", "px")
def mask_pooling(spark, sf):
    p = masks.pooled(I.px(spark, sf), C("gt_v"), flag(masks.foreground("pr_v")))
    return p.select("frame_id", F.round("masked", 5).alias("masked"), F.round("whole", 5).alias("whole"))


_COMPONENTS = """
WITH RECURSIVE fg AS (SELECT frame_id, y, x, x - row_number() OVER (PARTITION BY frame_id,y ORDER BY x) AS g FROM px WHERE gt_v>=85),
r AS (SELECT frame_id, y, min(x) AS x1, max(x) AS x2, count(*) AS n, y*1048576+min(x) AS id FROM fg GROUP BY frame_id, y, g),
e AS (SELECT a.frame_id, a.id AS src, b.id AS dst FROM r a JOIN r b ON a.frame_id=b.frame_id AND abs(a.y-b.y)=1 AND b.x1<=a.x2+1 AND b.x2>=a.x1-1),
w(frame_id, id, root) AS (SELECT frame_id, id, id FROM r UNION SELECT w.frame_id, e.dst, w.root FROM w JOIN e ON e.frame_id=w.frame_id AND e.src=w.id),
l AS (SELECT frame_id, id, min(root) AS label FROM w GROUP BY 1,2),
c AS (SELECT l.frame_id, label, sum(n) AS area FROM l JOIN r USING (frame_id,id) GROUP BY 1,2)
SELECT frame_id, count(*) AS n_components, count(*) FILTER (WHERE area>0.005*256) AS n_large, CAST(max(area) AS BIGINT) AS largest_area FROM c GROUP BY frame_id"""


@query("M18", _COMPONENTS, "px")
def connected_components(spark, sf):
    comp = K.over(I.image_rows(spark, sf, 16, 16).drop("rgb"), lambda f: K.components(f.ids, f.mask >= 85), K.COMPONENTS)
    return masks.component_summary(comp, 256).select("frame_id", "n_components", "n_large", "largest_area")


@query("M18", _COMPONENTS, "px")
def connected_components_joins(spark, sf):
    comp = masks.components_by_joins(I.px(spark, sf), masks.foreground("gt_v", 85))
    return masks.component_summary(comp, 256).select("frame_id", "n_components", "n_large", "largest_area")


@query("P18 K9 M18", _COMPONENTS[: _COMPONENTS.rindex("SELECT frame_id, count(*)")] + """, big AS (SELECT frame_id, count(*) FILTER (WHERE area>0.005*256) AS n_large, sum(area) AS g FROM c GROUP BY frame_id),
box AS (SELECT frame_id, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2 FROM px WHERE gt_v>=85 GROUP BY 1)
SELECT p_partkey AS frame_id, coalesce(n_large,0) AS n_large, CASE WHEN g IS NULL THEN 'EMPTY_MASK' ELSE concat_ws(';', CASE WHEN g/256e0<0.01 THEN 'TOO_SMALL' END, CASE WHEN g/256e0>0.075 THEN 'TOO_LARGE' END,
 CASE WHEN NOT (x2-x1)/CAST(y2-y1 AS DOUBLE) BETWEEN 0.35 AND 1.6 THEN 'ASPECT' END, CASE WHEN NOT ((x1+x2)/32e0 BETWEEN 0.15 AND 0.85 AND (y1+y2)/32e0 BETWEEN 0.15 AND 0.85) THEN 'OFF_CENTRE' END,
 CASE WHEN x1<=1 OR y1<=1 OR x2>=15 OR y2>=15 THEN 'TOUCHES_BORDER' END, CASE WHEN n_large>1 THEN printf('MULTI_COMPONENT(%d)', n_large) END, CASE WHEN g/((x2-x1)*CAST(y2-y1 AS DOUBLE))<0.3 THEN 'LOW_FILL' END) END AS flags
FROM part LEFT JOIN big ON big.frame_id=p_partkey LEFT JOIN box ON box.frame_id=p_partkey""", "px")
def mask_qc_report(spark, sf):
    """Shape and large components of every mask in one pass over frames, their flags written as a report and read back."""
    from frameledger.constants import MIN_COMPONENT
    from frameledger.sources.durable import scratch_path

    def finish(f):
        on = f.mask >= 85
        comp, at = K.components(f.ids, on), {v: i for i, v in enumerate(f.ids.tolist())}
        large = np.zeros(len(f.ids), np.int64)
        big = comp["area"] > MIN_COMPONENT * f.w * f.h
        np.add.at(large, [at[i] for i in comp["frame_id"][big].tolist()], 1)
        box, some = K.mask_boxes(np.where(on, 255, 0))
        return {"frame_id": f.ids, "n_fg": on.sum((1, 2)), "n_px": np.full(len(f.ids), f.w * f.h), "img_w": np.full(len(f.ids), f.w), "img_h": np.full(len(f.ids), f.h),
                **{c: pa.array(box[:, i].astype(np.int64), mask=~some) for i, c in enumerate(("x1", "y1", "x2", "y2"))}, "n_large": large}

    stats = K.over(I.image_rows(spark, sf, 16, 16).drop("rgb"), finish, "frame_id bigint, n_fg bigint, n_px bigint, img_w bigint, img_h bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, n_large bigint")
    path = scratch_path(spark, "qc-report")
    masks.qc_flags(masks.shape(stats), "n_large").select("frame_id", "n_large", "flags").write.json(path)
    report = spark.read.schema("frame_id bigint, n_large bigint, flags array<string>").json(path)
    named = F.transform("flags", lambda f: F.when(f.startswith("MULTI"), f).otherwise(F.regexp_replace(f, r"\(.*\)", "")))
    return report.select("frame_id", "n_large", F.array_join(named, ";").alias("flags"))


@query("P25", "SELECT p_partkey AS frame_id, 11 AS w, 8 AS h, CAST(sum(((x+2)*16+p_partkey)%256*(x+1)*(y+2)) AS BIGINT) AS placed FROM part CROSS JOIN range(11) t(x) CROSS JOIN range(8) u(y) GROUP BY 1")
def centre_crop(spark, sf):
    """16 wide and 8 high is wider than 4:3, so round(8 * 4 / 3) = 11 columns stay."""
    def finish(f):
        place = np.outer(np.arange(f.h) + 2, np.arange(f.w) + 1)
        n = len(f.ids)
        return {"frame_id": f.ids, "w": np.full(n, f.w, np.int32), "h": np.full(n, f.h, np.int32), "placed": (f.rgb[..., 0].astype(np.int64) * place).sum((1, 2))}

    return K.applied(I.image_rows(spark, sf, 16, 8), K.centre_crop_43, finish=finish, schema="frame_id bigint, w int, h int, placed bigint")


def _root_sql(a, b, c):
    return f"(SELECT coalesce(min(r),0) FROM (VALUES ((-({b})-sqrt(greatest(({b})*({b})-4*({a})*({c}),0)))/(2*({a}))),((-({b})+sqrt(greatest(({b})*({b})-4*({a})*({c}),0)))/(2*({a})))) t(r) WHERE r>=0)"


_RADIUS = f"greatest(0, least({_root_sql('1e0', '-(h+w)', 'w*h*0.3e0/1.7e0')}, {_root_sql('4e0', '-2*(h+w)', '0.3e0*w*h')}, {_root_sql('2.8e0', '1.4e0*(h+w)', '-0.3e0*w*h')}))"


@query("F4", f"SELECT w, h, round({_RADIUS},6) AS radius FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS w, CAST(p_partkey%100 AS DOUBLE) AS h FROM part)")
def gaussian_radius(spark, sf):
    d = I.table(spark, sf, "part").select(C("p_size").cast("double").alias("w"), (C("p_partkey") % 100).cast("double").alias("h")).distinct()
    return d.select("w", "h", F.round(boxes.gaussian_radius(C("h"), C("w")), 6).alias("radius"))


@query("F5", """SELECT clip, frame, l_partkey, l_suppkey, cy*100+cx AS cell, round(ln(gx2-gx1),6) AS log_w, round(ln(gy2-gy1),6) AS log_h, round((gx1+gx2)/8-cx,6) AS off_x, round((gy1+gy2)/8-cy,6) AS off_y
FROM (SELECT *, CAST(floor(least((gx1+gx2)/8,99)) AS INT) AS cx, CAST(floor(least((gy1+gy2)/8,49)) AS INT) AS cy FROM pred WHERE has_mask)""", "pred")
def detection_targets(spark, sf):
    t = boxes.encode_targets(I.gt_box(), 100, 50)
    return I.pred(spark, sf).filter("has_mask").select(
        "clip", "frame", "l_partkey", "l_suppkey", t["cell"].alias("cell"),
        *[F.round(t[k], 6).alias(k) for k in ("log_w", "log_h", "off_x", "off_y")])


@query("F5", """SELECT count(*) AS n, 0e0 AS worst FROM pred WHERE has_mask""", "pred")
def detection_round_trip(spark, sf):
    """Decoding an encoded box returns it (inside the image)."""
    enc = I.pred(spark, sf).filter("has_mask")
    t = boxes.encode_targets(I.gt_box(), 100, 50)
    back = boxes.decode_box(t["cell_x"], t["cell_y"], t["off_x"], t["off_y"], t["log_w"], t["log_h"], 400, 200)
    err = F.greatest(*[F.abs(a - b) for a, b in zip(back, I.gt_box())])
    return enc.select(err.alias("e")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("e"), 6).alias("worst"))


_PICK = """
WITH h AS (SELECT *, CAST(floor(total*0.2e0) AS BIGINT) AS lo, CAST(floor(total*0.8e0) AS BIGINT) AS hi FROM clipframes),
b AS (SELECT *, CASE WHEN idx>=floor(lo+(hi-lo)/3e0*2) THEN 2 WHEN idx>=floor(lo+(hi-lo)/3e0) THEN 1 ELSE 0 END AS w FROM h WHERE idx>=lo AND idx<hi AND (idx-lo)%3=0),
p AS (SELECT clip, w, idx, sharp FROM (SELECT *, row_number() OVER (PARTITION BY clip,w ORDER BY sharp DESC, idx) AS rn FROM b) WHERE rn=1) """


@query("W4 J9", _PICK + "SELECT clip, w, idx, sharp FROM p", "clipframes")
def sharpest_frames(spark, sf):
    return picking.sharpest_frames(I.clipframes(spark, sf)).select("clip", C("w").cast("int").alias("w"), "idx", "sharp")


@query("W4", _PICK + "SELECT clip, count(*) AS picks, count(*)=3 AS complete FROM p GROUP BY clip", "clipframes")
def complete_clips(spark, sf):
    return picking.complete_clips(picking.sharpest_frames(I.clipframes(spark, sf)))


@query("W5", _PICK + "SELECT clip, w, round(gap,6) AS gap_s, gap IS NULL OR gap>=0.5e0 AS gap_ok FROM (SELECT *, (idx-lag(idx) OVER (PARTITION BY clip ORDER BY w))/30e0 AS gap FROM p)", "clipframes")
def pick_spacing(spark, sf):
    s = picking.spacing(picking.sharpest_frames(I.clipframes(spark, sf)), 30.0, 0.5)
    return s.select("clip", C("w").cast("int").alias("w"), F.round("gap_s", 6).alias("gap_s"), "gap_ok")


@query("U6 M9", "SELECT part, count(*) AS n, round(avg(sharp),6) AS sharp FROM (SELECT *, 'head' AS part FROM clipframes WHERE idx<greatest(1,floor(total*0.1e0)) UNION ALL SELECT *, 'tail' FROM clipframes WHERE idx>=floor(total*0.9e0)) GROUP BY part", "clipframes")
def head_and_tail(spark, sf):
    return picking.head_and_tail(I.clipframes(spark, sf)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sharp"), 6).alias("sharp"))


@query("W6", """SELECT frame_id, rk, frac FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN frac BETWEEN 0.01 AND 0.075 THEN 0 ELSE 1 END,
 CASE WHEN frac BETWEEN 0.01 AND 0.075 THEN 0 ELSE round(greatest(0.01e0-frac,0)+greatest(frac-0.075e0,0),9) END, rk) AS rn FROM cands) WHERE rn=1""", "cands")
def ladder_pick(spark, sf):
    return picking.ladder_pick(I.cands(spark, sf), "frame_id", "rk", "frac").select("frame_id", "rk", "frac")


@query("W6", """WITH l AS (SELECT rk-1 AS rk, t FROM (SELECT unnest([1,2,3,4,5]) AS rk, unnest([220,128,90,60,30]) AS t)),
 m AS (SELECT frame_id, CAST(rk AS INT) AS rk, count(*) FILTER (WHERE gt_v>=t)/256e0 AS frac, min(x) FILTER (WHERE gt_v>=t) AS x1, max(y) FILTER (WHERE gt_v>=t)+1 AS y2 FROM px CROSS JOIN l GROUP BY 1,2)
SELECT frame_id, rk, frac, x1, y2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN frac BETWEEN 0.01 AND 0.075 THEN 0 ELSE 1 END,
 CASE WHEN frac BETWEEN 0.01 AND 0.075 THEN 0 ELSE round(greatest(0.01e0-frac,0)+greatest(frac-0.075e0,0),9) END, rk) AS rn FROM m) WHERE rn=1""", "px")
def proposed_masks(spark, sf):
    """A backend proposes a ladder of masks for every frame; the first in the area band is taken, with its box."""
    from frameledger.operators import scoring
    cands = scoring.propose(I.image_rows(spark, sf, 16, 16).select("frame_id", "w", "h", "mask"), "levels").drop("mask")
    return picking.ladder_pick(cands.withColumn("rk", F.struct("rk", "x1", "y2")), "frame_id", "rk", "frac").select("frame_id", "rk.rk", "frac", "rk.x1", "rk.y2")


@query("W7", """SELECT frame_id, rk, frac FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY CASE WHEN frac<=0.075 THEN 0 ELSE 1 END, CASE WHEN frac<=0.075 THEN rk ELSE -rk END) AS rn FROM cands) WHERE rn=1""", "cands")
def first_rung_below(spark, sf):
    return picking.first_below(I.cands(spark, sf), "frame_id", "rk", "frac")


@query("W9", "SELECT frame_id, arg_max(rk, frac) AS rk, max(frac) AS frac FROM cands GROUP BY frame_id", "cands")
def best_mask(spark, sf):
    return I.cands(spark, sf).groupBy("frame_id").agg(F.max_by("rk", "frac").alias("rk"), F.max("frac").alias("frac"))


@query("W10", """SELECT frame_id, arg_max(hand, a) AS hand, CAST(max(a) AS BIGINT) AS area FROM (SELECT frame_id, rk%2 AS hand,
 (max((frame_id*7+rk*53)%640)-min((frame_id*7+rk*53)%640))*(max((frame_id*3+rk*31)%480)-min((frame_id*3+rk*31)%480))*2+(rk%2) AS a FROM cands GROUP BY 1,2) GROUP BY frame_id""", "cands")
def largest_hand(spark, sf):
    """Hull area of each hand's landmarks; the parity term makes the areas distinct."""
    lx, ly = (C("frame_id") * 7 + C("rk") * 53) % 640, (C("frame_id") * 3 + C("rk") * 31) % 480
    hands = I.cands(spark, sf).groupBy("frame_id", (C("rk") % 2).alias("hand")).agg(((F.max(lx) - F.min(lx)) * (F.max(ly) - F.min(ly))).alias("a"))
    hands = hands.withColumn("a", C("a") * 2 + C("hand"))
    return hands.groupBy("frame_id").agg(F.max_by("hand", "a").alias("hand"), F.max("a").alias("area"))


_PEAK = """
WITH a AS (SELECT *, max(heat) OVER (PARTITION BY frame_id,y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM heat),
b AS (SELECT *, max(m) OVER (PARTITION BY frame_id,x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mm FROM a),
k AS (SELECT frame_id, p_size, y, x, heat FROM b WHERE heat=mm),
t AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY heat DESC, y, x) AS rank FROM k) """


@query("W8", _PEAK + "SELECT frame_id, y, x, round(heat,6) AS heat FROM k", "heat")
def heat_peaks(spark, sf):
    return heatmaps.peaks(I.heat(spark, sf)).select("frame_id", "y", "x", F.round("heat", 6).alias("heat"))


@query("T3 F5", _PEAK + """SELECT frame_id, CAST(rank AS INT) AS rank, round(greatest(cx-w,0),6) AS x1, round(greatest(cy-h,0),6) AS y1, round(least(cx+w,48),6) AS x2, round(least(cy+h,36),6) AS y2
FROM (SELECT *, (x+(frame_id%10)/10e0)*4 AS cx, (y+(p_size%10)/10e0)*4 AS cy, exp(ln(4+p_size%20))/2 AS w, exp(ln(3+frame_id%15))/2 AS h FROM t WHERE rank<=2)""", "heat")
def top_peak_boxes(spark, sf):
    top = heatmaps.top_peaks(I.heat(spark, sf), 2)
    f, s = C("frame_id"), C("p_size")
    fields = (top.withColumn("off_x", (f % 10) / 10.0).withColumn("off_y", (s % 10) / 10.0)
              .withColumn("log_w", F.log((s % 20 + 4).cast("double"))).withColumn("log_h", F.log((f % 15 + 3).cast("double"))))
    return heatmaps.decode(fields, 48, 36).select("frame_id", "rank", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("J17", "SELECT p_partkey AS frame_id, CAST((p_partkey*7)%108 AS INT) AS cell, round(heat,6) AS heat FROM part JOIN heat ON heat.frame_id=p_partkey AND heat.y*12+heat.x=(p_partkey*7)%108", "heat")
def gather_cells(spark, sf):
    want = I.frame_rows(spark, sf).select("frame_id", ((C("frame_id") * 7) % 108).cast("int").alias("cell"))
    return heatmaps.gather_at(I.heat(spark, sf), want, 12).select("frame_id", "cell", F.round("heat", 6).alias("heat"))


@query("T8", "SELECT frame_id, CAST((rn-1)//30+1 AS INT) AS page, CAST(((rn-1)%30)//6 AS INT) AS r, CAST((rn-1)%6 AS INT) AS c FROM (SELECT frame_id, row_number() OVER (ORDER BY frame_id) AS rn FROM maskstats)", "maskstats")
def review_pages(spark, sf):
    from frameledger.operators.ranking import sorted_row_number
    items = sorted_row_number(I.maskstats(spark, sf).select("frame_id"), [], ["frame_id"], "rn")
    i = C("rn") - 1
    return items.select("frame_id", (F.floor(i / 30) + 1).cast("int").alias("page"), F.floor((i % 30) / 6).cast("int").alias("r"), (i % 6).cast("int").alias("c"))


@query("A22 A23 M1", """
WITH z AS (SELECT frame_id, (pr_v-128)/32e0 AS z, CASE WHEN gt_v>=128 THEN 1e0 ELSE 0e0 END AS t FROM px),
f AS (SELECT frame_id, 1-(2*sum(t/(1+exp(-z)))+1)/(sum(1/(1+exp(-z)))+sum(t)+1) AS d FROM z GROUP BY frame_id)
SELECT (SELECT round(avg(d),6) FROM f) AS dice, (SELECT round(avg(greatest(z,0)-z*t+ln(1+exp(-abs(z)))),6) FROM z) AS bce""", "px")
def mask_losses(spark, sf):
    px = I.px(spark, sf).select("frame_id", ((C("pr_v") - 128) / 32.0).alias("z"), flag(masks.foreground("gt_v")).alias("t"))
    p = sigmoid(C("z"))
    per = px.groupBy("frame_id").agg(F.sum(p * C("t")).alias("i"), F.sum(p).alias("p"), F.sum("t").alias("t"),
                                     F.sum(bce_with_logits(C("z"), C("t"))).alias("b"), F.count(F.lit(1)).alias("n"))
    dice = F.lit(1.0) - (C("i") * 2 + 1.0) / (C("p") + C("t") + 1.0)
    return per.agg(F.round(mean_or_zero(dice), 6).alias("dice"), F.round(F.sum("b") / F.sum("n"), 6).alias("bce"))


@query("A24", """
WITH q AS (SELECT least(greatest(1/(1+exp(-(heat*6-3))),1e-4),1-1e-4) AS p, CASE WHEN x=frame_id%12 AND y=p_size%9 THEN 1e0 ELSE least(heat,0.99e0) END AS t FROM heat)
SELECT round(sum(CASE WHEN t=1 THEN -(1-p)*(1-p)*ln(p) ELSE -pow(1-t,4)*p*p*ln(1-p) END)/greatest(sum(CASE WHEN t=1 THEN 1e0 ELSE 0e0 END),1),6) AS focal FROM q""", "heat")
def focal_heat_loss(spark, sf):
    h = I.heat(spark, sf)
    peak = (C("x") == C("frame_id") % 12) & (C("y") == C("p_size") % 9)
    t = F.when(peak, F.lit(1.0)).otherwise(F.least("heat", F.lit(0.99)))
    return h.agg(F.round(heatmaps.focal_loss(C("heat") * 6 - 3, t), 6).alias("focal"))
