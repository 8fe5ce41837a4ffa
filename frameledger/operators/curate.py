"""Dataset curation: names and paths, pairing, duplicates, splits, batches, corrections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from frameledger.constants import CLIP_NAME_PATTERN, FRAME_PATTERN, GESTURES, SCENE_NAME_PATTERN
from frameledger.operators.ranking import hashed_row_number
from frameledger.sources.durable import cut_lineage

C = F.col
_LIMBS, _LIMB_HEX = 5, 6


def frame_number(name: Column) -> Column:
    """Frame number of a file name, NULL for anything else, also for a number beyond 64 bits (`rejected_frames` lists those)."""
    return F.nullif(F.regexp_extract(name, FRAME_PATTERN, 1), F.lit("")).try_cast("bigint")


def rejected_frames(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose file name is a frame's, but whose number no 64-bit integer holds, with a `problem`."""
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return paths.filter((F.regexp_extract(name, FRAME_PATTERN, 1) != "") & frame_number(name).isNull()).withColumn("problem", F.lit("frame number beyond 64 bits"))


def parse_tree_path(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """subject, gesture, clip, kind (rgb or annotation) and frame of a dataset path.

    The subject is the folder right below `root`; wrapper folders between it and the class folder do not matter.
    Only known classes, clip folders and frame files survive. A scheme (`file:`) before the root is ignored.
    """
    top = re.escape(re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root).rstrip("/"))
    under = rf"^(?:[a-z0-9]+:(?://[^/]*)?)?{top}/[^/]+/.*"
    # One pattern for the root; the parts are those of the split path, the last four from its end.
    steps = F.split(F.regexp_replace(path, rf"^(?:[a-z0-9]+:(?://[^/]*)?)?{top}/", ""), "/")
    part = {"subject": steps[0], **{n: F.try_element_at(steps, F.lit(-i)) for i, n in ((4, "gesture"), (3, "clip"), (2, "kind"), (1, "name"))}}
    out = paths.filter(C(path).rlike(under)).withColumn("_s", steps).withColumns(part).filter((F.size("_s") >= 5) & C("gesture").isin(*GESTURES) & C("clip").startswith("clip") & C("kind").isin("rgb", "annotation"))
    return out.drop("_s").withColumn("frame", frame_number(C("name"))).filter(C("frame").isNotNull())


def parse_video_name(df: DataFrame, name: str = "name") -> DataFrame:
    """gesture and clip of a video name in either naming scheme; others are dropped."""
    full = F.regexp_extract(name, CLIP_NAME_PATTERN, 1)
    first_ok = full.isin(*GESTURES)
    word = F.lower(F.regexp_extract(name, SCENE_NAME_PATTERN, 2))
    by_word = F.create_map(*[F.lit(v) for g in GESTURES for v in (g.split("_", 1)[1], g)])
    scene = F.regexp_extract(name, SCENE_NAME_PATTERN, 1)
    second = F.try_element_at(by_word, F.nullif(word, F.lit("")))
    return (df.withColumn("gesture", F.when(first_ok, full).otherwise(second))
            .withColumn("clip", F.when(first_ok, F.lower(F.regexp_extract(name, CLIP_NAME_PATTERN, 2)))
                        .otherwise(F.concat(F.lit("clip"), F.lpad(F.regexp_replace(scene, "^0+(?=.)", ""), 2, "0"))))
            .filter(C("gesture").isNotNull()))


def encode_label(gesture: Column) -> Column:
    """Position in the fixed class list; NULL when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(g) for g in GESTURES]), gesture) - 1, F.lit(-1).cast("long")).cast("int")


def record_keys(subject: Column, gesture: Column, clip: Column, frame: Column) -> dict[str, Column]:
    three = F.lpad(frame.cast("string"), 3, "0")
    number = F.when(F.length(frame.cast("string")) >= 3, frame.cast("string")).otherwise(three)
    return {"id": F.concat_ws("/", subject, gesture, clip, number),
            "stem": F.concat(F.concat_ws("__", subject, gesture, clip), F.lit("__f"), number),
            "clip_key": F.concat_ws("/", subject, gesture, clip)}


def scene_clip(n: Column) -> Column:
    return F.format_string("clip%02d", n)


# -- pairing and presence -------------------------------------------------------------------------

def pair_annotations(images: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Every image, with its annotation where one exists."""
    return images.join(annotations, keys, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def unfinished(frames: DataFrame, done: DataFrame, keys: list[str], need: int) -> DataFrame:
    """Drop groups that already have `need` finished rows (resume)."""
    ready = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(C("_n") >= need)
    return frames.join(ready, keys, "left_anti")


def first_contributors(frames: DataFrame, n: int, subject: str = "subject") -> DataFrame:
    """Rows of the first n contributors by name (a top-n of the distinct names)."""
    names = frames.select(subject).distinct().orderBy(subject).limit(n)
    return frames.join(F.broadcast(names), subject, "left_semi")       # n rows


# -- duplicates -----------------------------------------------------------------------------------

def set_signature(df: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """Signature of a group's multiset of items, equal exactly when the sets are equal.

    Item digests are added limb by limb, so a group of any size folds with partial sums: it is
    never collected or sorted.
    """
    d = F.md5(item)
    # 24-bit limbs: sums stay exact for more than 10**11 items.
    limbs = [F.sum(F.conv(F.substring(d, 1 + i * _LIMB_HEX, _LIMB_HEX), 16, 10).cast("long")).alias(f"_l{i}") for i in range(_LIMBS)]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), *limbs)
    text = F.concat_ws("|", C("n_files").cast("string"), *[C(f"_l{i}").cast("string") for i in range(_LIMBS)])
    return g.select(*keys, "n_files", F.md5(text).alias("signature"))


def subject_signature(files: DataFrame, subject: str, path: str, size: str, content: str | None = None) -> DataFrame:
    """Contributor signature over (relative path, size), or file bytes when `content` is given."""
    keep = ~F.endswith(C(path), F.lit(".DS_Store"))
    tail = F.sha2(content, 256) if content else C(size).cast("string")
    return set_signature(files.filter(keep), [subject], F.concat_ws("|", C(path), tail))


def folder_hash(files: DataFrame, group: str, name: str, content: str) -> DataFrame:
    """Twelve hex digits that change when any file of the folder does."""
    s = set_signature(files, [group], F.concat_ws("|", C(name), F.sha2(content, 256)))
    return s.select(group, F.substring(F.sha2("signature", 256), 1, 12).alias("code_hash"))


def duplicate_contributors(signatures: DataFrame, subject: str = "subject") -> DataFrame:
    """Each contributor with the first one that has the same signature."""
    first = signatures.groupBy("signature").agg(F.min(subject).alias("identical_to"))
    return signatures.join(first, "signature").withColumn("kept", C(subject) == C("identical_to"))


def first_seen(df: DataFrame, sig: str, order: list[str]) -> DataFrame:
    """First row per signature: a min aggregate, then a join on that row's own key."""
    first = df.groupBy(sig).agg(F.min(F.struct(*order)).alias("_f")).select(sig, "_f.*")
    return df.join(first, [sig, *order], "left_semi")


# -- splits ---------------------------------------------------------------------------------------

def holdout_splits(frames: DataFrame, holdout: int, seed, subject: str = "subject") -> DataFrame:
    """(subject, split): `holdout` contributors in hashed order go to val, the others to train.

    Whole contributors only, so near-copies of a clip never sit on both sides.
    """
    subjects = frames.select(subject).distinct()
    if holdout <= 0:
        return subjects.withColumn("split", F.lit("train"))
    if holdout >= subjects.limit(holdout + 1).count():
        raise ValueError(f"holdout={holdout} leaves no contributor for training")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), C(subject)))
    val = subjects.orderBy(order, subject).limit(holdout).withColumn("_v", F.lit(True))
    return subjects.join(val, subject, "left").select(subject, F.when(C("_v"), "val").otherwise("train").alias("split"))


def strict_split(frames: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rows of one split; unknown contributors are excluded, an empty result is an error."""
    out = frames.join(splits, "subject").filter(C("split") == split)
    if out.limit(1).count() == 0:
        have = [r[0] for r in splits.select("split").distinct().orderBy("split").collect()]
        raise ValueError(f"split {split!r} is empty; the index holds {have}")
    return out


def lenient_split(frames: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rows of one split; unknown contributors count as train."""
    return frames.join(splits, "subject", "left").withColumn("split", F.coalesce("split", F.lit("train"))).filter(C("split") == split)


def dispatch_splits(wanted: dict[str, DataFrame | None], splits: dict[str, DataFrame]) -> DataFrame:
    """All splits a configuration supports, in one table; missing or empty ones are skipped."""
    parts = [df.join(splits[name], "subject").filter(C("split") == name)
             for name, df in wanted.items() if df is not None]
    if not parts:
        raise ValueError("no split could be built")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if out.limit(1).count() == 0:
        raise ValueError("no split could be built")
    return out


# -- sampling and batches ---------------------------------------------------------------------------

def random_cap(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """n rows in seeded hash order."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), C(key).cast("string"))), key).limit(n)


def batches(df: DataFrame, size: int, seed, key: str, drop_last: bool) -> DataFrame:
    """Shuffled batch number per row; the last short batch is dropped for training."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), C(key).cast("string")))
    numbered = hashed_row_number(df, digest, [key], "_rn", "_total").withColumn("batch", F.floor((C("_rn") - 1) / size))
    if drop_last:
        numbered = numbered.filter(C("batch") < F.floor(C("_total") / size))
    return numbered.drop("_rn", "_total")


# -- corrections and configuration -----------------------------------------------------------------

def apply_corrections(frames: DataFrame, corrections: DataFrame, key: str, backend: str) -> DataFrame:
    """Precedence drop, mask, box, point, backend. Dropped rows vanish; hand-made ones are 'manual'."""
    k = F.coalesce("kind", F.lit("backend"))
    out = frames.join(corrections, key, "left").withColumn("source", k).filter(C("source") != "drop")
    return out.withColumn("backend", F.when(C("source").isin("mask", "box"), "manual").otherwise(backend)).drop("kind")


def resolve_layers(layers: DataFrame) -> DataFrame:
    """Last non-NULL value per (run, key): a NULL override never resets a value."""
    return layers.groupBy("run", "k").agg(F.max_by("v", F.when(C("v").isNotNull(), C("layer"))).alias("v"))


def unknown_keys(layers: DataFrame, known: tuple) -> DataFrame:
    return layers.filter(~C("k").isin(*known)).select("run", "k").distinct()


def extends_chain(configs: DataFrame) -> DataFrame:
    """(name, ancestor, depth): every configuration with all it inherits from, itself included; a cycle is an error.

    `configs` has (name, extends), names once each. Chains double their reach in every round, so a chain of any depth
    takes as many rounds as its depth has bits; a configuration that reaches itself is on a cycle.
    """
    own = configs.select("name", C("name").alias("ancestor"), F.lit(0).alias("depth"))
    chain = cut_lineage(own.unionAll(configs.where("extends is not null").select("name", C("extends").alias("ancestor"), F.lit(1).alias("depth"))))
    reach = 1
    while True:
        ends = chain.where(C("depth") == reach).select("name", C("ancestor").alias("middle"))
        onward = chain.where("depth > 0").select(C("name").alias("middle"), "ancestor", "depth")
        more = cut_lineage(ends.join(onward, "middle").select("name", "ancestor", (C("depth") + reach).alias("depth")))
        if not chain.where("depth > 0 and name = ancestor").isEmpty():
            raise ValueError("configuration extends itself")
        if more.isEmpty():
            return chain
        chain, reach = chain.unionAll(more), 2 * reach


def index_summary(frames: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, rows per class with zeros)."""
    per_subject = frames.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count("ann").alias("a"))
    totals = per_subject.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_annotated"),
                             F.count(F.lit(1)).alias("n_subjects"))
    totals = totals.withColumn("annotated_pct", C("n_annotated") * 100.0 / F.greatest("n_records", F.lit(1)))
    counts = frames.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    per_class = classes.join(counts, "cls", "left").select("gesture", F.coalesce("n", F.lit(0)).alias("n"))
    return totals, per_class
