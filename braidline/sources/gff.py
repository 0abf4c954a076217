"""GFF3 and GTF files: scan, row checks, attributes, rendering; FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import percent_decode, percent_encode

FIELDS = ["seqid", "source", "featuretype", "start_pos", "end_pos", "score", "strand", "frame", "attributes"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files (gzip too) before their ``##FASTA``, with a file and a line order.

    The order is that of the reader; where it matters across splits of one file, the
    file must be one split (gzip, or ``wholetext`` for small files).
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("file_order"))
    fasta = lines.filter(F.col("value").startswith("##FASTA")).groupBy("file").agg(F.min("file_order").alias("cut"))
    return lines.join(fasta, "file", "left").filter(F.col("cut").isNull() | (F.col("file_order") < F.col("cut"))).drop("cut")


def directives(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith("##")).select("file_order", F.col("value").alias("directive"))


def parse_rows(lines: DataFrame) -> DataFrame:
    """The nine columns of every feature line, and ``error_kind`` (null for good rows)."""
    own = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    # as a generated row, so that a filter on what is found does not split the line for each part
    own = own.select("*", F.explode(F.array(part)).alias("p")).select("file_order", "p", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)))
    start, end = (F.expr(f"try_cast({c} AS BIGINT)") for c in ("start_pos", "end_pos"))
    bad = (
        F.when(F.size("p") < 9, "TooFewFields").when(F.col("seqid") == "", "EmptySeqid").when(F.col("featuretype") == "", "EmptyFeaturetype")
        .when(F.col("featuretype").rlike(r"\s"), "InvalidFeaturetype")
        .when(((F.col("start_pos") != ".") & start.isNull()) | ((F.col("end_pos") != ".") & end.isNull()) | (start < 1) | (end < start), "InvalidCoordinate")
        .when(~F.col("strand").isin("+", "-", "?", "."), "InvalidStrand")
        .when(~F.col("frame").isin("0", "1", "2", ".") | ((F.col("featuretype") == "CDS") & (F.col("frame") == ".")), "InvalidPhase")
        .when(~F.col("score").isin("", ".") & F.expr("try_cast(score AS DOUBLE)").isNull(), "InvalidScore")
        .when(~F.trim("attributes").isin("", ".") & ~F.col("attributes").rlike(r'=|"[^"]*"'), "InvalidAttribute")
    )
    return own.withColumn("error_kind", bad).withColumn("start_pos", start).withColumn("end_pos", end).drop("p")


def attribute_rows(rows: DataFrame, key: str, attributes: str = "attributes") -> DataFrame:
    """(key, name, value, idx) of a GFF3 ninth column; values in file order."""
    pairs = rows.select(key, F.explode(F.split(attributes, ";")).alias("a")).filter(F.trim("a") != "")
    named = pairs.select(key, F.trim(F.substring_index("a", "=", 1)).alias("name"), F.regexp_extract("a", "=(.*)$", 1).alias("v"))
    return named.select(key, "name", F.posexplode(F.split("v", ",")).alias("idx", "value")).withColumn("value", percent_decode(F.col("value")))


class BadRows(ValueError):
    """A strict scan met rows that cannot be read."""


def scan(rows: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows of ``parse_rows``, and (file_order, error_kind) of the others.

    A strict scan raises BadRows if there are any, naming the first few.
    """
    bad = rows.filter("error_kind IS NOT NULL").select("file_order", "error_kind")
    if strict and (some := bad.orderBy("file_order").limit(5).collect()):
        raise BadRows(", ".join(f"{r['error_kind']} at {r['file_order']}" for r in some))
    return rows.filter("error_kind IS NULL").drop("error_kind"), bad


def gff_line(features: DataFrame, source: str = "braidline") -> DataFrame:
    """A line for each feature; ID and Parent first, reserved characters encoded."""
    attributes = F.concat_ws(";", F.concat(F.lit("ID="), percent_encode(F.col("id"))), F.concat(F.lit("Parent="), percent_encode(F.col("parent"))))
    text = F.concat_ws("\t", "seqid", F.lit(source), "featuretype", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), attributes)
    return features.select("id", text.alias("line"))


def write_gff(features: DataFrame, path: str) -> None:
    """Text files whose lines are in order of seqid and start, parents before children."""
    rank = F.when(F.col("featuretype") == "gene", 0).when(F.col("featuretype") == "mRNA", 1).otherwise(2)
    ordered = features.withColumn("rank", rank).repartitionByRange("seqid", "start_pos").sortWithinPartitions("seqid", "start_pos", "rank", "id")
    gff_line(ordered).select("line").write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, seq) of FASTA files: records are split by the reader, so none crosses a split."""
    raw = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    return raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("seqid"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
