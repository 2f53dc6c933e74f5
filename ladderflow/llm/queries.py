"""The registered queries of this subpackage: one thin query for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderflow.llm import filter_audit, fingerprint, jaccard_join, knn, license_scan, line_dedup, nearest_tree, packing, pii, sentencepieces, token_count, toxicity, vector_codes
from ladderflow.llm.common import read


def piece_model_path() -> str:
    """Place of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(read(spark, sf_dir, "documents"), piece_model_path())


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), byte_bpe_path())


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.integer_vectors(read(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def byte_bpe_path() -> str:
    """Place of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), byte_bpe_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup(read(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(vector_codes.integer_rows(read(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_nearest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_tree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": op2_license_scan,
    "op3_token_count": op3_token_count,
    "op4_exact_topk": op4_exact_topk,
    "op5_pii": op5_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprint": op8_fingerprint,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_nearest_tree": op13_nearest_tree,
}
ORACLE: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op4_exact_topk": knn.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
