"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.llm.registry import CHECKS, QUERIES, query, table
from frameledger.llm.samples import remainder

__all__ = ["CHECKS", "QUERIES"]


@query
def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from pairs of labelled ones outside the held-out third."""
    from frameledger.llm import quality_rank

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rank.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return quality_rank.rate(docs, model).select("doc_id", held, "score", "predicted", "rank")


@query
def op2_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out fifth."""
    from frameledger.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, docs.where(remainder("doc_id", 5) != 0))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return language_id.identify(docs, model).select("doc_id", held, "lang_pred", "score", "rejected")


@query
def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of 50 or more words in two documents."""
    from frameledger.llm.compact_windows import similar_passages

    return similar_passages(table(spark, sf_dir, "documents"))


@query
def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from frameledger.llm.page_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op5_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of all documents, and the verdict of rules and isolation forest."""
    from frameledger.llm import rule_forest

    docs = table(spark, sf_dir, "documents")
    return rule_forest.judge(docs, rule_forest.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in groups whose SimHash fingerprints link at 4 or fewer differing bits."""
    from frameledger.llm.simhash_groups import group_near_duplicates

    return group_near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    from frameledger.llm.credential_scan import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


@query
def op8_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that stand in two documents."""
    from frameledger.llm.sparse_suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op9_hamming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark."""
    from frameledger.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4,096 tokens."""
    import public_tokenizers

    from frameledger.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query
def op13_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers that stand for the same bytes of all documents, and how common each pair is."""
    import public_tokenizers

    from frameledger.llm.token_alignment import align_tokenizers

    a, b, ranks = (str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return align_tokenizers(table(spark, sf_dir, "documents"), a, b, ranks)


@query
def op11_path_copying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with proofs and the versions that tampered leaves make."""
    from frameledger.llm.merkle_manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query
def op12_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed patterns, and candidates that boosted trees select."""
    from frameledger.llm import pii_boosting

    docs = table(spark, sf_dir, "documents")
    return pii_boosting.find_personal_data(docs, pii_boosting.fit(docs))
