"""The text corpus operators applied to the supplied tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import anchored_pii as pii
from eventloom.llm import block_rules as blocks
from eventloom.llm import bwt_phrases as phrases
from eventloom.llm import compression_bands as bands
from eventloom.llm import decontaminate as clean
from eventloom.llm import forced_bpe as bpe
from eventloom.llm import markov_secrets as secrets
from eventloom.llm import minhash_join as minhash
from eventloom.llm import oracles
from eventloom.llm import pu_quality as quality
from eventloom.llm import spelling_variants as spelling
from eventloom.llm import token_records as records
from eventloom.llm import warc_salvage as warc
from eventloom.llm import weak_toxicity as toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.compression_bands(table(spark, sf_dir, "documents"))


def op2_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), bpe.tokenizer_path("word_bpe_49k.json"))


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(documents, secrets.train(documents))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha256("base_spans").alias("base_sha256"), "spans", "n_random")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = records.round_trip(table(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.tiktoken"))
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op8_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract_pages(table(spark, sf_dir, "pages"))


def op9_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha256("base_spans").alias("base_sha256"), "spans", "n_account", "n_address")


def op10_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op11_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score_documents(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op13_bwt_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_compression_bands": op1_compression_bands,
    "op2_forced_bpe": op2_forced_bpe,
    "op3_markov_secrets": op3_markov_secrets,
    "op4_token_records": op4_token_records,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_minhash_join": op6_minhash_join,
    "op7_fm_decontaminate": op7_fm_decontaminate,
    "op8_block_rules": op8_block_rules,
    "op9_anchored_pii": op9_anchored_pii,
    "op10_weak_toxicity": op10_weak_toxicity,
    "op11_partenum_spelling": op11_partenum_spelling,
    "op12_pu_quality": op12_pu_quality,
    "op13_bwt_phrases": op13_bwt_phrases,
}
ORACLES = oracles.ORACLES
