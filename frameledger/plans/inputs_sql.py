"""The input views as SQL text for the checking engine: name -> (views it reads, SQL)."""

_H = "CAST(CAST('0x'||substr(md5({s}),1,13) AS BIGINT) AS DOUBLE)/4503599627370496e0"


def u01(expr: str) -> str:
    """SQL for the hashed uniform of functions.numeric.uniform over the digest text `expr`."""
    return "(" + _H.format(s=expr) + ")"


INPUT_SQL: dict[str, tuple[str, str]] = {
    "pred": ("", """
SELECT l_orderkey AS clip, l_linenumber AS frame, l_partkey, l_suppkey, l_quantity,
  CAST(l_suppkey % 10 AS INT) AS gt,
  CAST(CASE WHEN l_quantity > 10 THEN l_suppkey % 10 ELSE l_partkey % 10 END AS INT) AS pred,
  CAST((l_partkey*37 + l_suppkey*11 + l_linenumber*101) % 1000 AS DOUBLE)/1000 AS conf,
  CAST((l_partkey*13 + l_linenumber*7) % 1000 AS DOUBLE)/1000 AS det_conf,
  l_returnflag <> 'N' AS has_mask,
  CAST(l_partkey % 200 AS DOUBLE) AS gx1, CAST(l_suppkey % 100 AS DOUBLE) AS gy1,
  CAST(l_partkey % 200 AS DOUBLE)+40+l_quantity AS gx2, CAST(l_suppkey % 100 AS DOUBLE)+60 AS gy2,
  CAST(l_partkey % 200 AS DOUBLE)+l_linenumber*3 AS px1, CAST(l_suppkey % 100 AS DOUBLE)+l_linenumber*2 AS py1,
  CAST(l_partkey % 200 AS DOUBLE)+40+l_quantity+l_linenumber*3 AS px2,
  CAST(l_suppkey % 100 AS DOUBLE)+60+l_linenumber*2 AS py2
FROM lineitem"""),
    "pred_iou": ("pred", """
SELECT *, it/greatest((gx2-gx1)*(gy2-gy1)+(px2-px1)*(py2-py1)-it, 1e-7) AS iou
FROM (SELECT *, greatest(least(gx2,px2)-greatest(gx1,px1),0)*greatest(least(gy2,py2)-greatest(gy1,py1),0) AS it FROM pred)"""),
    "classes": ("", """
SELECT * FROM (VALUES (0,'G01_call'),(1,'G02_dislike'),(2,'G03_like'),(3,'G04_ok'),(4,'G05_one'),
  (5,'G06_palm'),(6,'G07_peace'),(7,'G08_rock'),(8,'G09_stop'),(9,'G10_three')) AS t(cls, gesture)"""),
    "frames": ("", """
SELECT o_orderkey AS oid, concat('s', CAST(o_custkey % 23 AS VARCHAR)) AS subject,
  CAST(o_orderkey % 10 AS INT) AS cls, concat('clip0', CAST(o_custkey % 5 AS VARCHAR)) AS clip,
  CAST(floor(o_orderkey / 10e0) AS BIGINT) AS frame,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('ann/', CAST(o_orderkey AS VARCHAR)) END AS ann
FROM orders"""),
    "px": ("", """
SELECT p_partkey AS frame_id, p_size, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  CAST(CASE WHEN x >= p_partkey % 5 AND x < p_partkey % 5 + p_size % 11
             AND y >= p_partkey % 4 AND y < p_partkey % 4 + 6
       THEN 255 ELSE (x*7+y*13+p_partkey) % 100 END AS INT) AS gt_v,
  CAST(CASE WHEN x >= p_partkey % 5 + 1
             AND x < p_partkey % 5 + 1 + CASE WHEN p_size % 11 = 0 AND p_partkey % 2 = 0 THEN 0 ELSE p_size % 9 END
             AND y >= p_partkey % 4 + 1 AND y < p_partkey % 4 + 7
       THEN 220 ELSE (x*3+y*5+p_partkey) % 100 END AS INT) AS pr_v
FROM part CROSS JOIN range(16) AS ty(y) CROSS JOIN range(16) AS tx(x)"""),
    "rgb": ("", """
SELECT p_partkey AS frame_id, CAST(p_partkey % 10 AS INT) AS scene, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  CAST((x*16 + p_partkey) % 256 AS INT) AS r, CAST((y*16 + p_size*3) % 256 AS INT) AS g,
  CAST((x*y + p_partkey*5) % 256 AS INT) AS b
FROM part CROSS JOIN range(8) AS ty(y) CROSS JOIN range(8) AS tx(x)"""),
    "heat": ("", """
SELECT p_partkey AS frame_id, p_size, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
  round(exp(-(((x - p_partkey % 12)*(x - p_partkey % 12)) + ((y - p_size % 9)*(y - p_size % 9))) / 4e0)
  + 0.5e0 * exp(-(((x - p_size % 12)*(x - p_size % 12)) + ((y - p_partkey % 9)*(y - p_partkey % 9))) / 4e0), 9) AS heat
FROM part CROSS JOIN range(9) AS ty(y) CROSS JOIN range(12) AS tx(x)"""),
    "maskpair": ("px", """
SELECT frame_id, min(p_size) AS p_size, CAST(count(*) AS DOUBLE) AS n,
  CAST(count(*) FILTER (WHERE gt_v>=128 AND pr_v>=128) AS DOUBLE) AS i,
  CAST(count(*) FILTER (WHERE gt_v>=128) AS DOUBLE) AS g,
  CAST(count(*) FILTER (WHERE pr_v>=128) AS DOUBLE) AS p,
  min(x) FILTER (WHERE gt_v>=128) AS gx1, min(y) FILTER (WHERE gt_v>=128) AS gy1,
  max(x) FILTER (WHERE gt_v>=128)+1 AS gx2, max(y) FILTER (WHERE gt_v>=128)+1 AS gy2,
  min(x) FILTER (WHERE pr_v>=128) AS px1, min(y) FILTER (WHERE pr_v>=128) AS py1,
  max(x) FILTER (WHERE pr_v>=128)+1 AS px2, max(y) FILTER (WHERE pr_v>=128)+1 AS py2
FROM px GROUP BY frame_id"""),
    "segrec": ("maskpair", """
SELECT frame_id, CAST(floor(frame_id / 15e0) AS BIGINT) AS clip,
  CASE WHEN frame_id % 5 = 0 THEN NULL WHEN g+p-i > 0 THEN i/(g+p-i) ELSE 1e0 END AS iou_hand,
  CASE WHEN frame_id % 5 = 0 THEN NULL WHEN n-i > 0 THEN (n-(g+p-i))/(n-i) ELSE 1e0 END AS iou_bg,
  CASE WHEN frame_id % 5 = 0 THEN NULL WHEN g+p > 0 THEN 2*i/(g+p) ELSE 1e0 END AS dice
FROM maskpair"""),
    "evals": ("maskpair", """
SELECT frame_id, CAST(floor(frame_id / 15e0) AS BIGINT) AS clip, CAST(frame_id % 10 AS INT) AS gt,
  CAST(CASE WHEN p_size > 10 THEN frame_id % 10 ELSE p_size % 10 END AS INT) AS pred,
  CAST((frame_id*37 + p_size*11) % 1000 AS DOUBLE)/1000 AS conf,
  CASE WHEN p > 0 THEN 1e0 ELSE 0e0 END AS det_conf,
  CASE WHEN g = 0 THEN NULL WHEN p = 0 THEN 0e0 ELSE it/((gx2-gx1)*(gy2-gy1)+(px2-px1)*(py2-py1)-it) END AS iou,
  CASE WHEN g = 0 THEN NULL ELSE i/(g+p-i) END AS iou_hand,
  CASE WHEN g = 0 THEN NULL WHEN n-i > 0 THEN (n-(g+p-i))/(n-i) ELSE 1e0 END AS iou_bg,
  CASE WHEN g = 0 THEN NULL ELSE 2*i/(g+p) END AS dice
FROM (SELECT *, CAST(greatest(least(gx2,px2)-greatest(gx1,px1),0)*greatest(least(gy2,py2)-greatest(gy1,py1),0) AS DOUBLE) AS it FROM maskpair)"""),
    "maskstats": ("px", """
SELECT frame_id, CAST(count(*) AS DOUBLE)/256 AS area, min(x) AS x1, min(y) AS y1, max(x)+1 AS x2, max(y)+1 AS y2
FROM px WHERE gt_v >= 128 GROUP BY frame_id"""),
    "clipframes": ("", """
SELECT user_id AS clip, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  count(*) OVER (PARTITION BY user_id) AS total, value AS sharp FROM events"""),
    "cands": ("", """
SELECT p_partkey AS frame_id, p_size, CAST(rk AS INT) AS rk, CAST((p_partkey*31 + rk*17) % 200 AS DOUBLE)/1000 AS frac
FROM part CROSS JOIN range(7) AS t(rk)"""),
    "epochs": ("", """
SELECT event_type AS run, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch, round(avg(value)/100, 12) AS score, count(*) AS n
FROM events GROUP BY event_type, CAST(EXTRACT(DAY FROM ts) AS INT)"""),
    "runs": ("pred_iou", """
SELECT concat(fam, '_', split) AS run, fam, split, fam NOT IN ('b1','b4') AS has_det, n_frames, n_clips,
  round(cls_top1,9) AS cls_top1, round(mean_conf,9) AS mean_conf, round(det_acc50,9) AS det_acc50, round(mean_box_iou,9) AS mean_box_iou
FROM (SELECT CASE WHEN l_suppkey % 10 < 8 THEN concat('b', CAST(l_suppkey % 10 AS VARCHAR))
                  WHEN l_suppkey % 10 = 8 THEN 'e1' ELSE 'e3' END AS fam,
        CASE WHEN l_partkey % 3 = 0 THEN 'rs_val' ELSE 'rs_test' END AS split,
        count(*) AS n_frames, count(DISTINCT l_suppkey) AS n_clips,
        avg(CASE WHEN pred = gt THEN 1e0 ELSE 0e0 END) AS cls_top1, avg(conf) AS mean_conf,
        avg(CASE WHEN has_mask THEN CASE WHEN iou >= 0.5e0 THEN 1e0 ELSE 0e0 END END) AS det_acc50,
        avg(CASE WHEN has_mask THEN iou END) AS mean_box_iou
      FROM pred_iou GROUP BY 1, 2) AS q"""),
    "corrections": ("", """
SELECT p_partkey AS frame_id, CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'drop' WHEN 1 THEN 'mask' WHEN 2 THEN 'box' ELSE 'point' END AS kind
FROM part WHERE p_partkey % 10 < 4"""),
    "sig": ("", "SELECT doc_id, source AS subject, md5(text) AS sig, n_chars FROM documents"),
    "layers": ("", """
SELECT p_brand AS run, CAST(p_size % 3 AS INT) AS layer, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'lr' WHEN 1 THEN 'photometric' WHEN 2 THEN 'epochs' ELSE 'bogus' END AS k,
  max(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END) AS v
FROM part GROUP BY 1, 2, 3"""),
    "knots": ("", f"""
SELECT frame_id, k, k/4e0 AS kx, least(greatest(k/4e0 + (-0.1e0 + 0.2e0*{u01("concat('tone|', frame_id, '|', k)")}), 0e0), 1e0) AS ky
FROM (SELECT p_partkey AS frame_id, CAST(k AS INT) AS k FROM part CROSS JOIN range(5) AS t(k)) AS q"""),
    "tone": ("knots", """
SELECT frame_id, k, kx, least(greatest(first_value(ky) OVER w + sum(CASE WHEN prev IS NULL THEN 0e0 ELSE greatest(ky-prev,0e0) END) OVER w,0e0),1e0) AS ty
FROM (SELECT *, lag(ky) OVER (PARTITION BY frame_id ORDER BY k) AS prev FROM knots)
WINDOW w AS (PARTITION BY frame_id ORDER BY k ROWS UNBOUNDED PRECEDING)"""),
    "names": ("", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('G0', CAST(p_partkey % 9 + 1 AS VARCHAR), '_call_clip0', CAST(p_size % 3 + 1 AS VARCHAR), '.mov')
  WHEN 1 THEN concat('G', CAST(p_size % 3 + 1 AS VARCHAR), '_rock.MOV') WHEN 2 THEN '.DS_Store' ELSE concat('frame_', lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0'), '.png') END AS name
FROM part"""),
    "paths": ("", """
SELECT o_orderkey, concat('/root/s', CAST(o_custkey % 23 AS VARCHAR), CASE WHEN o_custkey % 7 = 0 THEN '/wrap' WHEN o_custkey % 5 = 0 THEN '/data/set' ELSE '' END,
  '/', CASE CAST(o_orderkey % 12 AS INT) WHEN 0 THEN 'G01_call' WHEN 1 THEN 'G02_dislike' WHEN 2 THEN 'G03_like' WHEN 3 THEN 'G04_ok' WHEN 4 THEN 'G05_one'
   WHEN 5 THEN 'G06_palm' WHEN 6 THEN 'G07_peace' WHEN 7 THEN 'G08_rock' WHEN 8 THEN 'G09_stop' WHEN 9 THEN 'G10_three' WHEN 10 THEN 'G11_x' ELSE 'notes' END,
  CASE WHEN o_custkey % 11 = 0 THEN '/misc0' ELSE '/clip0' END, CAST(o_custkey % 5 AS VARCHAR),
  CASE WHEN o_orderkey % 3 = 0 THEN '/annotation' ELSE '/rgb' END,
  CASE WHEN o_orderstatus = 'P' THEN '/.DS_Store' ELSE concat('/frame_', CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey + 1700000000000000 AS VARCHAR) ELSE lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END, '.png') END) AS path,
  CAST(o_totalprice AS BIGINT) AS size
FROM orders"""),
    "emb": ("", "SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "emb_scores": ("emb", """
SELECT e.vec_id, min(e.label) AS gt, c.k, round(sum(e.v * c.m), 9) AS z
FROM emb AS e JOIN (SELECT label AS k, pos, avg(v) AS m FROM emb GROUP BY label, pos) AS c ON e.pos = c.pos
GROUP BY e.vec_id, c.k"""),
    "emb_pred": ("emb_scores", """
SELECT vec_id, CAST(floor(vec_id / 15e0) AS BIGINT) AS clip, gt, k AS pred, p AS conf
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS rn,
        exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) AS p
      FROM emb_scores) AS r WHERE rn = 1"""),
}
