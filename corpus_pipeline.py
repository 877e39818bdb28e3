"""A corpus pipeline of operators from skycat.llm; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.llm import language, line_dedup, packing, quality, simhash
from skycat.llm.common import cut, fresh_dir, small
from skycat.llm.token_ids import WordEncoder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; the others go."""
    kept = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept.select(docs.columns)


def _row_hash(docs: DataFrame):
    """128 bits of id, text and evidence. Nulls leave a hash as it is, so they are marked apart."""
    columns = [docs[c] for c in ("doc_id", "text", "lang", "source")]
    return F.md5(F.concat_ws("\u0001", *(F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), F.md5(c.cast("string")))) for c in columns)))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go.

    Rows are told apart by id, text and evidence: one without an id, or of a repeated id, goes by its own verdict alone.
    """
    marked = docs.withColumn("family", F.regexp_replace("source", "[0-9]+$", "")).withColumn("__row", _row_hash(docs))
    known = language.identify(marked, declared_col="lang", host_col="source", domain_col="family", keep_cols=("__row",))
    gone = small(cut(known.filter(~F.col("accepted")).select(F.col("__row").alias("__gone")).distinct()))
    return docs.join(gone, _row_hash(docs) == gone["__gone"], "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in one of them."""
    own = {f"__own_{c}": c for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = line_dedup.dedup_lines(docs.withColumnsRenamed({c: k for k, c in own.items()}))
    kept = kept.drop("n_lines", "n_dropped").withColumnsRenamed(own)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8)


def small_encoder():
    """An encoder for one task, with a small memo: workers that go on to other stages keep nothing of it."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path("word_bpe_49k.json"), memory=48 << 20).encode


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, small_encoder, end_id=2, capacity=4096)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_languages),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("packing", pack),
]

#: SQL can't express the models of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, through Parquet files in the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
