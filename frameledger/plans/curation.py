"""Dataset curation: parsing, pairing, duplicates, splits, batches, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameledger.operators import curate
from frameledger.plans import inputs as I
from frameledger.plans.registry import query
from frameledger.sources import readers, writers
from frameledger.sources.durable import scratch_path

C = F.col


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("S1 S2 S3 A28", r"""
SELECT subject, gesture, clip, kind, count(*) AS n, max(frame) AS last_frame FROM (
SELECT regexp_extract(path, '^/root/([^/]+)/(?:.*/)?(G\d{2}_[A-Za-z]+)/(clip[^/]*)/(rgb|annotation)/([^/]+)$', 1) AS subject, regexp_extract(path, '^/root/([^/]+)/(?:.*/)?(G\d{2}_[A-Za-z]+)/(clip[^/]*)/(rgb|annotation)/([^/]+)$', 2) AS gesture,
 regexp_extract(path, '^/root/([^/]+)/(?:.*/)?(G\d{2}_[A-Za-z]+)/(clip[^/]*)/(rgb|annotation)/([^/]+)$', 3) AS clip, regexp_extract(path, '^/root/([^/]+)/(?:.*/)?(G\d{2}_[A-Za-z]+)/(clip[^/]*)/(rgb|annotation)/([^/]+)$', 4) AS kind,
 TRY_CAST(regexp_extract(path, '/frame_(\d+)\.png$', 1) AS BIGINT) AS frame FROM paths)
WHERE frame IS NOT NULL AND gesture IN (SELECT gesture FROM classes) GROUP BY 1,2,3,4""", "paths classes")
def frame_tree_parse(spark, sf):
    t = curate.parse_tree_path(I.paths(spark, sf), "/root")
    return t.groupBy("subject", "gesture", "clip", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"))


_TREE_SQL = """(SELECT concat('s', s_nationkey) AS subject, CASE WHEN s_suppkey%4=0 THEN 'G01_call' WHEN s_suppkey%4=1 THEN 'G08_rock' WHEN s_suppkey%4=2 THEN 'G99_none' ELSE 'G04_ok' END AS gesture,
  CASE WHEN s_suppkey%3=0 THEN 'annotation' ELSE 'rgb' END AS kind, s_suppkey%7=0 AS empty, s_suppkey%11=0 AS long, s_suppkey%13=0 AS other, length(s_name) AS size, s_suppkey FROM supplier)"""


def _write_tree(spark, sf) -> str:
    """One file for each supplier: of known and unknown classes, some empty, some with numbers too long, some no frames."""
    import pyarrow as pa

    from frameledger.sources.durable import scratch_path
    from frameledger.sources.frame_tree import _place
    root, k = scratch_path(spark, "tree"), C("s_suppkey")
    gesture = F.when(k % 4 == 0, "G01_call").when(k % 4 == 1, "G08_rock").when(k % 4 == 2, "G99_none").otherwise("G04_ok")
    name = F.when(k % 13 == 0, F.format_string("notes_%d.txt", k)).when(k % 11 == 0, F.format_string("frame_%d99999999999999999999.png", k)).otherwise(F.format_string("frame_%03d.png", k))
    folder = F.concat_ws("/", F.lit(root), F.concat(F.lit("s"), C("s_nationkey").cast("string")), F.when(k % 5 == 0, "wrap/inner").otherwise("set"), gesture, F.lit("clip01"), F.when(k % 3 == 0, "annotation").otherwise("rgb"))
    rows = I.table(spark, sf, "supplier").select(folder.alias("folder"), name.alias("name"), F.when(k % 7 == 0, "").otherwise(C("s_name")).alias("bytes"))

    def write(batches):
        for batch in batches:
            n = 0
            for row in batch.to_pylist():
                system, base = _place(row["folder"])
                system.create_dir(base, recursive=True)
                with system.open_output_stream(f"{base}/{row['name']}") as out:
                    out.write(row["bytes"].encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()
    return root


@query("S1 S10 S13", f"SELECT subject, gesture, kind, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS frames, CAST(sum(size) AS BIGINT) AS bytes FROM {_TREE_SQL} WHERE NOT other AND NOT long AND NOT empty AND gesture <> 'G99_none' GROUP BY 1,2,3")
def frame_tree_scan(spark, sf):
    """A tree of files, written and scanned: subjects are partitions."""
    from frameledger.sources.frame_tree import frame_tree
    frames, _ = frame_tree(spark, _write_tree(spark, sf))
    return frames.groupBy("subject", "gesture", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("frames"), F.sum("length").alias("bytes"))


@query("S1 S3 S10 S13", f"SELECT subject, kind, CASE WHEN long THEN 'frame number beyond 64 bits' ELSE 'empty file' END AS problem, count(*) AS n FROM {_TREE_SQL} WHERE NOT other AND (long OR empty) AND gesture <> 'G99_none' GROUP BY 1,2,3")
def frame_tree_rejects(spark, sf):
    """What the scan does not take, empty masks included."""
    from frameledger.sources.frame_tree import frame_tree
    _, rejects = frame_tree(spark, _write_tree(spark, sf))
    return _count(rejects, "subject", "kind", "problem")


@query("S3", r"SELECT p_partkey, CAST(regexp_extract(name,'^frame_(\d+)\.(png|jpg|jpeg)$',1) AS BIGINT) AS frame FROM names WHERE regexp_matches(name,'^frame_(\d+)\.(png|jpg|jpeg)$')", "names")
def frame_name_filter(spark, sf):
    return I.names(spark, sf).withColumn("frame", curate.frame_number(C("name"))).filter("frame IS NOT NULL").select("p_partkey", "frame")


@query("S11 J16 F11", r"""
SELECT p_partkey, gesture, clip FROM (SELECT p_partkey, CASE WHEN name LIKE 'G0%_call_clip%' AND name LIKE 'G01%' THEN 'G01_call' WHEN name LIKE '%_rock.MOV' THEN 'G08_rock' END AS gesture,
 CASE WHEN name LIKE '%clip%' THEN regexp_extract(name,'(clip\d\d)',1) ELSE concat('clip0', regexp_extract(name,'^G(\d)',1)) END AS clip FROM names) WHERE gesture IS NOT NULL""", "names")
def video_name_parse(spark, sf):
    return curate.parse_video_name(I.names(spark, sf)).select("p_partkey", "gesture", "clip")


_ANN = "(SELECT subject, cls, clip, frame, concat('a', oid) AS mask FROM frames WHERE ann IS NOT NULL AND oid % 5 <> 0)"


def _annotations(spark, sf):
    return (I.frames(spark, sf).filter(C("ann").isNotNull() & (C("oid") % 5 != 0))
            .select("subject", "cls", "clip", "frame", F.concat(F.lit("a"), C("oid").cast("string")).alias("mask")))


@query("J1 S10", f"SELECT oid, mask FROM frames LEFT JOIN {_ANN} a USING (subject, cls, clip, frame)", "frames")
def image_annotation_join(spark, sf):
    return curate.pair_annotations(I.frames(spark, sf), _annotations(spark, sf), ["subject", "cls", "clip", "frame"]).select("oid", "mask")


@query("S10 S13", f"SELECT subject, count(*) AS n FROM frames ANTI JOIN {_ANN} a USING (subject, cls, clip, frame) GROUP BY subject", "frames")
def missing_masks(spark, sf):
    return _count(curate.unmatched(I.frames(spark, sf), _annotations(spark, sf), ["subject", "cls", "clip", "frame"]), "subject")


_SPLITS = "(SELECT subject, CASE WHEN row_number() OVER (ORDER BY md5(concat('7|', subject)), subject) <= 4 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT subject FROM frames))"


@query("T5 U1", f"SELECT subject, split FROM {_SPLITS}", "frames")
def holdout_split(spark, sf):
    return curate.holdout_splits(I.frames(spark, sf), 4, 7)


@query("P1 J2", f"SELECT subject, cls, count(*) AS n FROM frames JOIN {_SPLITS} s USING (subject) WHERE split='val' GROUP BY 1,2", "frames")
def strict_split(spark, sf):
    f = I.frames(spark, sf)
    return _count(curate.strict_split(f, curate.holdout_splits(f, 4, 7), "val"), "subject", "cls")


@query("P2 J2", f"SELECT subject, count(*) AS n FROM frames LEFT JOIN (SELECT CASE WHEN subject='s3' THEN 'renamed' ELSE subject END AS subject, split FROM {_SPLITS}) s USING (subject) WHERE coalesce(split,'train')='train' GROUP BY 1", "frames")
def lenient_split(spark, sf):
    f = I.frames(spark, sf)
    known = curate.holdout_splits(f, 4, 7).withColumn("subject", F.when(C("subject") == "s3", "renamed").otherwise(C("subject")))      # s3 is unknown
    return _count(curate.lenient_split(f, known, "train"), "subject")


@query("S14 T6", f"SELECT split, count(*) AS n FROM frames JOIN {_SPLITS} s USING (subject) GROUP BY 1 UNION ALL SELECT 'test', count(*) FROM frames", "frames")
def split_dispatch(spark, sf):
    f = I.frames(spark, sf)
    s = curate.holdout_splits(f, 4, 7)
    test = f.withColumn("subject", F.concat(F.lit("pack-"), C("subject")))          # a pack of its own
    every = test.select("subject").distinct().withColumn("split", F.lit("test"))
    out = curate.dispatch_splits({"train": f, "val": f, "test": test, "extra": None}, {"train": s, "val": s, "test": every})
    return _count(out, "split")


@query("P3 P4", "SELECT subject, clip, count(*) AS n FROM frames WHERE cls IN (0,1) AND clip IN ('clip02','clip03') GROUP BY 1,2", "frames")
def gesture_scene_filter(spark, sf):
    keep = [curate.scene_clip(F.lit(k)) for k in (2, 3)]
    return _count(I.frames(spark, sf).filter(C("cls").isin(0, 1) & C("clip").isin(*keep)), "subject", "clip")


@query("P5", "SELECT subject, count(*) AS n FROM frames WHERE subject IN (SELECT DISTINCT subject FROM frames ORDER BY subject LIMIT 5) GROUP BY 1", "frames")
def first_contributors(spark, sf):
    return _count(curate.first_contributors(I.frames(spark, sf), 5), "subject")


@query("P9 P10", """SELECT oid, CAST(cls AS INT) AS label, concat_ws('/', subject, gesture, clip, CASE WHEN length(CAST(frame AS VARCHAR))>=3 THEN CAST(frame AS VARCHAR) ELSE lpad(CAST(frame AS VARCHAR),3,'0') END) AS id,
 concat(subject,'__',gesture,'__',clip,'__f', CASE WHEN length(CAST(frame AS VARCHAR))>=3 THEN CAST(frame AS VARCHAR) ELSE lpad(CAST(frame AS VARCHAR),3,'0') END) AS stem, concat_ws('/', subject, gesture, clip) AS clip_key
FROM frames JOIN classes USING (cls)""", "frames classes")
def record_keys(spark, sf):
    f = I.frames(spark, sf).join(F.broadcast(I.classes(spark)), "cls")
    k = curate.record_keys(C("subject"), C("gesture"), C("clip"), C("frame"))
    return f.select("oid", curate.encode_label(C("gesture")).alias("label"), *[v.alias(n) for n, v in k.items()])


@query("P6", "SELECT cls, count(*) FILTER (WHERE ann IS NOT NULL) AS has_mask, count(*) AS n FROM frames GROUP BY cls", "frames")
def annotated_flag(spark, sf):
    return I.frames(spark, sf).groupBy("cls").agg(F.count("ann").alias("has_mask"), F.count(F.lit(1)).alias("n"))


@query("J10 X7", "SELECT cls, clip, count(*) AS n FROM frames ANTI JOIN (SELECT cls, clip FROM frames WHERE ann IS NULL GROUP BY 1,2 HAVING count(*) >= 100) d USING (cls, clip) GROUP BY 1,2", "frames")
def resume_unfinished(spark, sf):
    f = I.frames(spark, sf)
    return _count(curate.unfinished(f, f.filter("ann IS NULL"), ["cls", "clip"], 100), "cls", "clip")


@query("J11 U3", "SELECT gesture FROM classes WHERE cls NOT IN (SELECT cls % 7 FROM frames)", "frames classes")
def missing_classes(spark, sf):
    """Classes folded to seven, so that three are seen in no frame."""
    seen = I.frames(spark, sf).select((C("cls") % 7).alias("cls")).distinct()
    return curate.unmatched(I.classes(spark), seen, ["cls"]).select("gesture")


@query("U4 J16", "SELECT DISTINCT gesture FROM (SELECT p_partkey, 'G0'||(p_partkey%9+1)||'_call' AS gesture FROM part) WHERE gesture IN (SELECT gesture FROM classes)", "classes")
def known_folders(spark, sf):
    named = I.table(spark, sf, "part").select(F.format_string("G0%d_call", C("p_partkey") % 9 + 1).alias("gesture"))
    return named.intersect(I.classes(spark).select("gesture"))


_SIG = "(SELECT p_brand AS subject, md5(concat_ws('|', CAST(count(*) AS VARCHAR), " + ", ".join(
    f"CAST(CAST(sum(CAST('0x'||substr(md5(concat(p_name,'|',p_size)),{1 + i * 6},6) AS BIGINT)) AS BIGINT) AS VARCHAR)" for i in range(5)) + ")) AS signature, count(*) AS n_files FROM {src} GROUP BY p_brand)"


@query("A18", "SELECT subject, n_files, signature FROM " + _SIG.format(src="part"))
def subject_signature(spark, sf):
    files = I.table(spark, sf, "part").select(C("p_brand").alias("subject"), C("p_name").alias("path"), C("p_size").alias("size"))
    return curate.subject_signature(files, "subject", "path", "size")


@query("J12 W3 A18 X5", "WITH two AS (SELECT p_brand, p_name, p_size FROM part UNION ALL SELECT p_brand||' copy', p_name, p_size FROM part WHERE p_brand IN ('Brand#2','Brand#4')), s AS (SELECT * FROM "
       + _SIG.format(src="two") + ") SELECT subject, min(subject) OVER (PARTITION BY signature) AS identical_to, subject = min(subject) OVER (PARTITION BY signature) AS kept FROM s")
def duplicate_contributors(spark, sf):
    part = I.table(spark, sf, "part").select(C("p_brand").alias("subject"), C("p_name").alias("path"), C("p_size").alias("size"))
    copy = part.filter(C("subject").isin("Brand#2", "Brand#4")).withColumn("subject", F.concat("subject", F.lit(" copy")))
    s = curate.subject_signature(part.unionByName(copy), "subject", "path", "size")
    return curate.duplicate_contributors(s).select("subject", "identical_to", "kept")


@query("W3 J12", "SELECT doc_id, subject, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY subject, doc_id) AS rn FROM sig) WHERE rn=1", "sig")
def first_seen_content(spark, sf):
    """Duplicate content keeps its first row; whole texts are hashed."""
    return curate.first_seen(I.sig(spark, sf), "sig", ["subject", "doc_id"]).select("doc_id", "subject", "n_chars")


_HASH = "SELECT source, substr(sha256(md5(concat_ws('|', CAST(count(*) AS VARCHAR), " + ", ".join(
    f"CAST(CAST(sum(CAST('0x'||substr(md5(concat(doc_id,'|',sha256(text))),{1 + i * 6},6) AS BIGINT)) AS BIGINT) AS VARCHAR)" for i in range(5)) + "))),1,12) AS code_hash FROM documents GROUP BY source"


@query("A19 F15", _HASH)
def folder_hash(spark, sf):
    docs = I.table(spark, sf, "documents").select("source", C("doc_id").cast("string").alias("name"), "text")
    return curate.folder_hash(docs, "source", "name", "text")


@query("A15", "SELECT count(*) AS n_records, count(ann) AS n_annotated, count(DISTINCT subject) AS n_subjects, round(count(ann)*100e0/greatest(count(*),1),6) AS annotated_pct FROM frames", "frames")
def index_totals(spark, sf):
    t, _ = curate.index_summary(I.frames(spark, sf), I.classes(spark))
    return t.withColumn("annotated_pct", F.round("annotated_pct", 6))


@query("A15", "SELECT gesture, count(oid) AS n FROM classes LEFT JOIN (SELECT oid, CASE WHEN cls=4 THEN 5 ELSE cls END AS cls FROM frames) f USING (cls) GROUP BY gesture", "frames classes")
def frames_per_class(spark, sf):
    """Every frame counts; class 4 has none, since its frames go to class 5."""
    f = I.frames(spark, sf).withColumn("cls", F.when(C("cls") == 4, 5).otherwise(C("cls")))
    return curate.index_summary(f, I.classes(spark))[1]


@query("A28 U1", "SELECT count(DISTINCT cls) AS gestures, count(DISTINCT (cls, clip)) AS clips, count(DISTINCT subject) AS subjects FROM frames", "frames")
def distinct_counts(spark, sf):
    """Distinct over pre-grouped rows: the row table is shuffled once, already combined."""
    g = I.frames(spark, sf).groupBy("cls", "clip", "subject").agg(F.lit(1).alias("one"))
    return g.agg(F.count_distinct("cls").alias("gestures"), F.count_distinct("cls", "clip").alias("clips"), F.count_distinct("subject").alias("subjects"))


@query("T4", "SELECT oid, subject FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('5|',oid)), oid) AS rn FROM frames) WHERE rn <= 800", "frames")
def random_cap(spark, sf):
    return curate.random_cap(I.frames(spark, sf), 800, 5, "oid").select("oid", "subject")


@query("T7", "SELECT batch, count(*) AS n, sum(oid)::BIGINT AS s FROM (SELECT oid, (row_number() OVER (ORDER BY md5(concat('9|',oid)), oid)-1)//48 AS batch FROM frames) GROUP BY batch HAVING count(*)=48", "frames")
def training_batches(spark, sf):
    b = curate.batches(I.frames(spark, sf), 48, 9, "oid", drop_last=True)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("oid").alias("s"))


@query("T7", "SELECT batch, count(*) AS n FROM (SELECT oid, (row_number() OVER (ORDER BY md5(concat('9|',oid)), oid)-1)//48 AS batch FROM frames) GROUP BY batch", "frames")
def evaluation_batches(spark, sf):
    return _count(curate.batches(I.frames(spark, sf), 48, 9, "oid", drop_last=False), "batch")


@query("T1", "SELECT oid, subject, cls FROM frames ORDER BY subject, cls, oid", "frames")
def ordered_records(spark, sf):
    return I.frames(spark, sf).orderBy("subject", "cls", "oid").select("oid", "subject", "cls")


@query("P24 S9", "SELECT p_partkey AS frame_id, coalesce(kind,'backend') AS source, CASE WHEN kind IN ('mask','box') THEN 'manual' ELSE 'bgsub' END AS backend FROM part LEFT JOIN corrections ON frame_id=p_partkey WHERE coalesce(kind,'')<>'drop'", "corrections")
def corrections_applied(spark, sf):
    frames = I.table(spark, sf, "part").select(C("p_partkey").alias("frame_id"))
    return curate.apply_corrections(frames, I.corrections(spark, sf), "frame_id", "bgsub").select("frame_id", "source", "backend")


@query("S12", "SELECT run, k, arg_max(v, layer) FILTER (WHERE v IS NOT NULL) AS v FROM layers GROUP BY run, k", "layers")
def layered_config(spark, sf):
    return curate.resolve_layers(I.layers(spark, sf))


@query("S12 U3", "SELECT DISTINCT run, k FROM layers WHERE k NOT IN ('lr','photometric','epochs')", "layers")
def unknown_config_keys(spark, sf):
    return curate.unknown_keys(I.layers(spark, sf), ("lr", "photometric", "epochs"))


@query("S12", """WITH RECURSIVE c(name, ancestor, depth) AS (SELECT DISTINCT CAST(substr(p_brand,7) AS BIGINT), CAST(substr(p_brand,7) AS BIGINT), 0 FROM part UNION ALL SELECT name, ancestor//2, depth+1 FROM c WHERE ancestor>0)
SELECT CAST(name AS BIGINT) AS name, CAST(ancestor AS BIGINT) AS ancestor, CAST(depth AS INT) AS depth FROM c""")
def config_chain(spark, sf):
    n = F.substring("p_brand", 7, 9).cast("long")
    cfg = I.table(spark, sf, "part").select(n.alias("name")).distinct().withColumn("extends", F.when(C("name") > 0, F.floor(C("name") / 2)))
    return curate.extends_chain(cfg)


# -- sources and sinks: written from the tables, read back ------------------------------------------

_RECORDS = "SELECT subject, split, count(*) AS n, count(ann) AS n_ann FROM frames JOIN " + _SPLITS + " s USING (subject) GROUP BY 1,2"


def _records(spark, sf):
    f = I.frames(spark, sf).join(F.broadcast(I.classes(spark)), "cls")
    k = curate.record_keys(C("subject"), C("gesture"), C("clip"), C("frame"))
    return f.select(k["id"].alias("id"), "subject", "gesture", "clip", C("frame").cast("int").alias("frame"),
                    F.concat(F.lit("rgb/"), k["stem"], F.lit(".jpg")).alias("rgb"), "ann", "cls",
                    F.array(C("cls").cast("double"), F.lit(1.0), F.lit(9.0), F.lit(9.0)).alias("box"), F.array(F.lit(640), F.lit(480)).alias("src_size"))


@query("S4 K1 J2", _RECORDS, "frames")
def index_document(spark, sf):
    path = scratch_path(spark, "index")
    f = I.frames(spark, sf)
    writers.write_index_document(_records(spark, sf), curate.holdout_splits(f, 4, 7), "/data", path)
    back = readers.packed_index(spark, path, lines=True)
    return back.groupBy("subject", "split").agg(F.count(F.lit(1)).alias("n"), F.count("ann").alias("n_ann"))


@query("K1", _RECORDS, "frames")
def index_store(spark, sf):
    path = scratch_path(spark, "store")
    f = I.frames(spark, sf)
    totals, _ = curate.index_summary(f, I.classes(spark))
    writers.write_index(_records(spark, sf), curate.holdout_splits(f, 4, 7), totals, path)
    back = spark.read.parquet(path + "/records")
    return back.groupBy("subject", "split").agg(F.count(F.lit(1)).alias("n"), F.count("ann").alias("n_ann"))


@query("K3 S8", """SELECT clip, count(*) AS n, sum(CASE WHEN gt=pred THEN 1 ELSE 0 END)::BIGINT AS correct, count(CASE WHEN has_mask THEN 1 END) AS with_truth, round(sum(CASE WHEN has_mask THEN round(iou,6) END),6) AS iou
FROM pred_iou GROUP BY clip""", "pred_iou")
def prediction_file(spark, sf):
    """27 columns written as CSV and read back; blanks return as NULL."""
    p = I.pred_iou(spark, sf)
    rows = p.select("*", F.concat_ws("/", "clip", "frame").alias("id"), F.lit("rgb").alias("rgb"), F.lit("s1").alias("subject"), F.lit("G01_call").alias("gesture"),
                    F.lit(0.1).alias("mask_area"), *[F.lit(0.5).alias(c) for c in ("iou_hand", "miou", "dice")])
    path = scratch_path(spark, "predictions")
    writers.write_predictions(writers.prediction_table(rows), path)
    back = readers.prediction_rows(spark, path)
    return back.groupBy(C("clip").cast("long").alias("clip")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(C("correct").cast("long")).alias("correct"), F.count("gt_xmin").alias("with_truth"), F.round(F.sum("box_iou"), 6).alias("iou"))


@query("S7 K5 W14", "SELECT run, epoch, part, name, round(value,6) AS value FROM (SELECT run, epoch, 'train' AS part, 'loss' AS name, 1-score AS value FROM epochs UNION ALL SELECT run, epoch, 'val', 'cls_top1', score FROM epochs WHERE epoch % 2 = 0)", "epochs")
def epoch_log_curves(spark, sf):
    from frameledger.operators import series
    e = I.epochs(spark, sf).select("run", "epoch", (F.lit(1.0) - C("score")).alias("train/loss"), C("n").alias("train/n_annotated"),
                                   F.when(C("epoch") % 2 == 0, C("score")).alias("val/cls_top1"))
    path = scratch_path(spark, "epochs")
    writers.append_epochs(e.filter("epoch <= 15"), path)
    writers.append_epochs(e.filter("epoch > 15"), path)
    back = readers.epoch_log(spark, path, "run string, epoch int, `train/loss` double, `train/n_annotated` long, `val/cls_top1` double")
    return series.curves(back, ["run", "epoch"]).withColumn("value", F.round("value", 6))


@query("S9", "SELECT kind, count(*) AS n FROM corrections GROUP BY kind", "corrections")
def correction_file(spark, sf):
    """Correction maps written as JSON documents (one per hash part) and exploded again."""
    c = I.corrections(spark, sf)
    k = C("kind")
    body = F.struct(F.when(k == "point", F.array(F.lit(3), F.lit(4))).alias("point"), F.when(k == "mask", F.lit("m.png")).alias("mask"),
                    F.when(k == "box", F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("box"), F.when(k == "drop", F.lit(True)).alias("drop"))
    rows = c.select(C("frame_id").cast("string").alias("id"), body.alias("c"))
    docs = writers.map_documents(rows, "id", "c", "m", 100).select("part", F.to_json("m").alias("value"))
    path = scratch_path(spark, "corrections")
    docs.select("part", "value").write.partitionBy("part").text(path)
    return _count(readers.correction_map(spark, path + "/part=*"), "kind")


@query("S13 K10", "SELECT source, count(*) FILTER (WHERE doc_id % 7 <> 0) AS usable, count(*) FILTER (WHERE doc_id % 7 = 0) AS rejected FROM documents GROUP BY source")
def unreadable_files(spark, sf):
    """Image bytes pass through a store; broken ones go to the rejects with a reason."""
    raw = I.table(spark, sf, "documents").select(
        "doc_id", "source", F.lit("train").alias("split"), F.when(C("doc_id") % 7 != 0, F.encode("text", "UTF-8")).when(C("doc_id") % 2 == 0, F.encode(F.lit(""), "UTF-8")).alias("content"))
    path = scratch_path(spark, "images")
    writers.write_images(raw, path)
    good, bad = readers.readable(spark.read.parquet(path))
    g = good.groupBy("source").agg(F.count(F.lit(1)).alias("usable"))
    b = bad.groupBy("source").agg(F.count("error").alias("rejected"))
    return g.join(b, "source", "full").select("source", F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("K6 S10", "SELECT count(*) AS n, sum(x1+y1+x2+y2)::BIGINT AS total FROM maskstats", "maskstats")
def box_documents(spark, sf):
    """Derived boxes as JSON maps, rebuilt from what is on disk."""
    m = I.maskstats(spark, sf).select(C("frame_id").cast("string").alias("id"), F.array("x1", "y1", "x2", "y2").alias("box"))
    path = scratch_path(spark, "boxes")
    writers.write_documents(writers.box_documents(m), path)
    back = spark.read.schema("part int, n long, boxes map<string, array<int>>").json(path)
    boxes = back.select(F.explode("boxes").alias("id", "box"))
    return boxes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("box", F.lit(0), lambda a, v: a + v)).alias("total"))


@query("S6 A28", "SELECT run, lr, epochs FROM (SELECT concat('e', p_size) AS run, p_size * 1e-4 AS lr, CAST(count(*) AS INT) AS epochs FROM part GROUP BY p_size)")
def run_config_files(spark, sf):
    per = I.table(spark, sf, "part").groupBy("p_size").agg(F.count(F.lit(1)).cast("int").alias("epochs"))
    cfg = per.select(F.concat(F.lit("e"), C("p_size").cast("string")).alias("folder"), (C("p_size") * 1e-4).alias("lr"), "epochs")
    path = scratch_path(spark, "configs")
    cfg.repartition("folder").write.partitionBy("folder").json(path)
    back = readers.run_configs(spark, path + "/folder=*", "lr double, epochs int")
    return back.select(F.regexp_replace("run", "^folder=", "").alias("run"), "lr", "epochs")
