"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all rows that its predecessor kept; all but the last return
the columns of documents, and further columns of any name go through.  In every stage
an empty table gives an empty one, null and repeated keys are no trouble (rows are told
apart by what is in them), and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm.common import stage_table, table
from braidline.llm.decontaminate import drop_contaminated
from braidline.llm.packing import pack_documents
from braidline.llm.quality import keep_good
from braidline.llm.queries import WORDS
from braidline.llm.secrets import redact
from braidline.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts fail the rules and go; a score equal to the threshold is kept;
    repeated rows are judged each, and alike; without labels no score rejects any.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest key.

    Null keys come last; of rows that are equal in every column one stays; all null,
    empty and wordless texts are one group.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows go or stay alike; an item counts as a
    whole, within its budget of edits.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text.

    Null texts stay null; spans that overlap or begin at one place are masked once;
    repeated rows are masked alike.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, packed.

    Null and empty texts are one piece with the end token; repeated rows are packed
    each; pieces of equal length are taken in a fixed order; null keys stay null.
    """
    return pack_documents(docs, WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", packing),
]

#: SQL cannot express hashed language models, tokenizers or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
