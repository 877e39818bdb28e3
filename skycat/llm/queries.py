"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, fuzzy_hash, html_text, language, line_dedup, merkle, nearest, packing, quality, sharding, simhash, token_files
from .common import fresh_dir
from .token_ids import shared_encoder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_encoder():
    """Called in a task: the encoder of word_bpe_49k.json."""
    import public_tokenizers

    return shared_encoder(public_tokenizers.path("word_bpe_49k.json")).encode


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), word_encoder, end_id=2, capacity=4096)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.weigh(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.filter("kept").select("doc_id", "log_weight", "gumbel_key")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_hash.fingerprint_documents(_table(spark, sf_dir, "documents"), with_edited=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "token-shards")
    token_files.write_token_shards(_table(spark, sf_dir, "documents"), folder, word_encoder, end_id=2)
    return token_files.read_token_shards(spark, folder, count_id=2)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("family", F.regexp_replace("source", "[0-9]+$", ""))
    return language.identify(docs, declared_col="lang", host_col="source", domain_col="family")


def op6_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with all the evidence: the markup's language, the address suffix, hosts smoothed by their domains."""
    pages = language.page_words(language.page_evidence(_table(spark, sf_dir, "pages")))
    return language.identify(pages, "page_id", "page_words", "declared", "suffix", "host", "domain").withColumnRenamed("doc_id", "page_id")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def byte_ranks() -> str:
    """Called in a task: where byte_bpe_multi_50k.tiktoken is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), byte_ranks, PATTERN, with_ids=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(_table(spark, sf_dir, "documents"), size=3, radius=3)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def tokenizer_pair() -> tuple[str, str]:
    """Called in a task: where byte_bpe_50k.json and piece_bpe_32k.model are."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summarize(_table(spark, sf_dir, "documents"), tokenizer_pair)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_fuzzy_hash": op4_fuzzy_hash,
    "op5_token_files": op5_token_files,
    "op6_language": op6_language,
    "op6_page_language": op6_page_language,
    "op7_nearest": op7_nearest,
    "op8_html_text": op8_html_text,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_sharding": op11_sharding,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLE = {"op3_line_dedup": line_dedup.ORACLE, "op12_merkle": merkle.ORACLE}
