"""The annotation view over the driver's star schema.

Customers are genes, their orders transcripts (mRNA), and line items exons.
Coordinates are 1-based and inclusive.  ``ANNOTATION_SQL`` is the same view for an
SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import staged, tasks

COLUMNS = ["id", "parent", "seqid", "featuretype", "start_pos", "end_pos", "strand"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffixed(base, n):
    """Ids of repeated rows: the first keeps the bare id, others get ``__N``."""
    return F.when(n > 1, F.concat(base, F.lit("__"), n.cast("string"))).otherwise(base)


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's exons, as a stage table: they are derived once for all queries of a session."""
    return staged(spark, f"exons of {sf_dir}", lambda: derived_exons(spark, sf_dir))


def derived_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out by order once: the window and the join with orders need no more
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(tasks(lines), "l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER))
    own = lines.select(
        "l_orderkey", F.concat(F.lit("e"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("base"), n.alias("copy"),
        (F.col("l_partkey") * 10 + 1).alias("start_pos"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long") * 3).alias("end_pos"), "l_returnflag",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    genes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(genes, F.col("o_custkey") == F.col("c_custkey"))
    joined = own.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    strand = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    return joined.select(
        suffixed(F.col("base"), F.col("copy")).alias("id"), F.concat(F.lit("t"), "o_orderkey").alias("parent"), F.concat(F.lit("chr"), "c_nationkey").alias("seqid"),
        F.lit("exon").alias("featuretype"), "start_pos", "end_pos", strand.alias("strand"), F.concat(F.lit("g"), "c_custkey").alias("gene"), "base", "copy", F.col("l_returnflag").alias("flag"),
    )


def envelope(children: DataFrame, key: str, parent: str, kind: str) -> DataFrame:
    """Parents that span their children."""
    spans = children.groupBy(key).agg(F.min("seqid").alias("seqid"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("strand").alias("strand"), F.min(parent).alias("up"))
    return spans.select(F.col(key).alias("id"), F.col("up").alias("parent"), "seqid", F.lit(kind).alias("featuretype"), "start_pos", "end_pos", "strand")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes, transcripts and exons with their parents: a stage table of each, so that who asks
    for one kind reads that alone, and exons are written once."""
    ex = exons(spark, sf_dir)
    mrna = staged(spark, f"transcripts of {sf_dir}", lambda: envelope(ex, "parent", "gene", "mRNA"))
    gene = staged(spark, f"genes of {sf_dir}", lambda: envelope(ex.withColumn("none", F.lit(None).cast("string")), "gene", "none", "gene"))
    kinds = [df.withColumn("featuretype", F.lit(kind)).select(*COLUMNS) for df, kind in ((ex, "exon"), (mrna, "mRNA"), (gene, "gene"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


ANNOTATION_SQL = """
WITH base AS (
  SELECT l_orderkey, 'e' || l_orderkey || '_' || l_linenumber AS base, l_partkey * 10 + 1 AS start_pos,
         l_partkey * 10 + CAST(l_quantity AS BIGINT) * 3 AS end_pos, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy
  FROM lineitem),
ex AS MATERIALIZED (
  SELECT CASE WHEN copy > 1 THEN base || '__' || copy ELSE base END AS id, 't' || o_orderkey AS parent, 'chr' || c_nationkey AS seqid, 'exon' AS featuretype,
         start_pos, end_pos, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || c_custkey AS gene, base, copy, l_returnflag AS flag
  FROM base JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
mrna AS MATERIALIZED (SELECT parent AS id, min(gene) AS parent, min(seqid) AS seqid, 'mRNA' AS featuretype, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(strand) AS strand FROM ex GROUP BY ex.parent),
gene AS MATERIALIZED (SELECT gene AS id, CAST(NULL AS VARCHAR) AS parent, min(seqid) AS seqid, 'gene' AS featuretype, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(strand) AS strand FROM ex GROUP BY ex.gene),
f AS MATERIALIZED (SELECT id, parent, seqid, featuretype, start_pos, end_pos, strand FROM ex UNION ALL SELECT * FROM mrna UNION ALL SELECT * FROM gene),
edges AS MATERIALIZED (SELECT parent, id AS child FROM f WHERE parent IS NOT NULL),
closure AS MATERIALIZED (
  SELECT parent AS ancestor, child AS descendant, CAST(1 AS BIGINT) AS depth FROM edges
  UNION ALL SELECT a.parent, b.child, CAST(2 AS BIGINT) FROM edges a JOIN edges b ON a.child = b.parent)
"""
