"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .counting import count_tokens
from .decontaminate import contaminated
from .language import identify
from .packing import pack_documents
from .quality import judge
from .repeats import remove_repeats
from .secrets import find_secrets
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .warc import derive_pages

#: Where the public vocabulary is; a parameter of the operators.
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_pack_swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), WORDS)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_pages(table(spark, sf_dir, "pages"))


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), WORDS)


def op6_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_pack_swap_search, op2_language_ecoc, op3_warc_derivatives, op4_quality_llr, op5_token_counts_resync, op6_qgram_lemma, op7_simhash_popcount_grid, op8_toxicity_gru, op9_blob_ledger, op10_radix_repeats)}
ORACLE_SQL: dict[str, str] = {}
