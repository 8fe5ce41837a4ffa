"""Documents of equal text as one class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.sources.durable import stored


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, texts): (doc_id, cls) of every row with a text, and (tid, cls, doc_id, text) with one row per distinct text.

    A class is named by two hashes and the length of its text. Its doc_id is the smallest; rows with null ids count
    only where no other is there. Texts go through the shared folder once, without the copies; there they get `tid`, a
    short name for the steps that make many rows of each.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    cls = F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.hash("text")), F.length("text").cast("string")).alias("cls")
    members = rows.select("doc_id", cls)
    first = members.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    kept = rows.select("doc_id", "text", cls).join(first.withColumnsRenamed({"cls": "c", "doc_id": "d"}), F.expr("cls = c and doc_id <=> d"), "left_semi")
    texts = stored(kept.withColumn("tid", F.monotonically_increasing_id()), "texts")
    again = texts.groupBy("cls").agg(F.min("tid").alias("t"), F.count("*").alias("n")).where("n > 1").selectExpr("cls as c", "t")
    if not again.isEmpty():                 # rows that repeat id and text: one stays
        texts = texts.join(again, texts.cls == again.c, "left").where("t is null or t = tid").drop("c", "t")
    return members, texts


def copies(members: DataFrame, least_words: DataFrame) -> DataFrame:
    """(doc_id, rep_doc_id, n_words) of the documents that share their class with another, for classes of `least_words` (cls, n_words)."""
    sized = members.groupBy("cls").agg(F.min("doc_id").alias("rep_doc_id"), F.count("*").alias("n")).where("n > 1")
    return members.join(sized.join(least_words, "cls"), "cls").select("doc_id", "rep_doc_id", "n_words")
