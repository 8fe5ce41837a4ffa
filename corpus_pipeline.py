"""The corpus pipeline: stages over the documents table, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.sources.durable import scratch_path


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letter, or a probability under the calibrated bound.

    The model learns from the labelled rows of `docs`; texts keep their label. Every row is judged by its own text: null
    and empty ones are rejected, repeated rows are judged alike, and columns of any name are kept.
    """
    from frameledger.llm import language_id
    from frameledger.llm.arrow_text import slices, texts

    model = language_id.fit(docs, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rejected = language_id.predict(model, texts(part.column("text")))[2]
                yield part.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id.

    Rows are told apart by their values, not by their ids: unlike texts under one id, or under none, are kept each by its
    group. Null and empty texts are one group; of equal rows one stays; texts of any length count whole.
    """
    from frameledger.llm.simhash_groups import representatives

    return representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    A document is found by its text: rows of the same id with another text stay, and so do rows without an id. Null and
    empty texts hold nothing; repeated rows stay or go together; columns of any name are kept.
    """
    from frameledger.llm.decontaminate import contaminated

    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    # A text's id here is its hash and length, so that equal texts are searched as one.
    name = F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.hash("text")), F.octet_length("text").cast("string"))
    found = contaminated(docs.select(name.alias("doc_id"), F.col("text")), items).select("doc_id").distinct().withColumnRenamed("doc_id", "name of a found text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), name.alias("name of its text"))
    return rows.join(found, F.col("name of its text") == F.col("name of a found text"), "left_anti").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows. No document goes.

    Null and empty texts stay as they are, repeated rows are treated alike, texts of any length are scanned whole, and
    columns of any name are kept.
    """
    from frameledger.llm.arrow_text import slices, texts
    from frameledger.llm.credential_scan import redact_text

    where, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                changed = [redact_text(t) for t in texts(part.column("text"))]
                if any(c is not None for c in changed):
                    old = part.column("text").to_pylist()
                    columns = list(part.columns)
                    columns[where] = pa.array([o if c is None else c for o, c in zip(old, changed)], part.schema.field(where).type)
                    if count is not None:
                        sizes = part.column("n_chars").to_pylist()
                        columns[count] = pa.array([s if c is None else len(c) for s, c in zip(sizes, changed)], part.schema.field(count).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 4,096 tokens: a row for each piece of a document.

    Null and empty texts are one piece with the end id; repeated rows are packed each; further columns are not carried.
    """
    import public_tokenizers

    from frameledger.llm.packing import pack

    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("pack", pack_tokens),
]

#: No stage can be stated in SQL but the third (hashed models, component search, a cost model, a tokenizer);
#: tests/llm/test_pipeline.py checks run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
