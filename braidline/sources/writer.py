"""Sinks: GFF3 with all attributes in hierarchy order, directives, FASTA, tables, manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import percent_encode
from ..store import FeatureStore
from .stage import spread

#: Directives that say something of the assembly they were written for.
BOUND = ("##sequence-region", "##genome-build", "##species", "#!genome-build", "#!genome-version", "#!genome-date", "#!genebuild")


def ninth_column(attrs: str = "attrs") -> Column:
    """ID, Parent, then the other names in order; values encoded and joined by commas."""
    rank = lambda k: F.when(k == "ID", 0).when(k == "Parent", 1).otherwise(2)
    keys = F.array_sort(F.transform(F.map_keys(attrs), lambda k: F.struct(rank(k).alias("r"), k.alias("k"))))
    one = lambda x: F.concat(percent_encode(x["k"]), F.lit("="), F.array_join(F.transform(F.col(attrs)[x["k"]], percent_encode), ","))
    return F.coalesce(F.nullif(F.array_join(F.transform(keys, one), ";"), F.lit("")), F.lit("."))


def full_line(features: DataFrame, source: str = "braidline") -> Column:
    """A line with all nine columns; a feature without a good place raises an error."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in features.columns else F.lit("." if c != "source" else source)
    good = F.coalesce((F.col("start_pos") >= 1) & (F.col("end_pos") >= F.col("start_pos")), F.lit(False))
    line = F.concat_ws("\t", "seqid", has("source"), "featuretype", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), has("score"), "strand", has("frame"), ninth_column())
    return F.when(good, line).otherwise(F.raise_error(F.concat(F.lit("no place to write: "), F.coalesce("id", F.lit("?")))))


def kind_rank(featuretype: str = "featuretype") -> Column:
    """Parents before children: genes, transcripts, then all exons, all CDS, all others."""
    f = F.col(featuretype)
    return F.when(f == "gene", 0).when(f.isin("mRNA", "transcript"), 1).when(f == "exon", 2).when(f == "CDS", 3).otherwise(4)


def output_order(features: DataFrame, tops: DataFrame) -> DataFrame:
    """Add the keys by which genes are written as blocks: the gene's place, the
    transcript's, the kind, the own place.  ``tops`` is (id, gene, transcript)."""
    place = features.select(F.col("id").alias("gene"), F.col("seqid").alias("gene_seqid"), F.col("start_pos").alias("gene_start"))
    tx = features.select(F.col("id").alias("transcript"), F.col("start_pos").alias("tx_start"))
    out = features.join(tops, "id").join(place, "gene").join(tx, "transcript", "left")
    return out.withColumn("kind_rank", kind_rank())


def block_order(features: DataFrame) -> DataFrame:
    """``output_order`` of features that have their gene and transcript as columns, where the
    rows of both are among them, once, and a transcript's rows are of one gene: these meet
    by gene, so one shuffle is all."""
    own = spread(features, "gene")
    gene, tx = Window.partitionBy("gene"), Window.partitionBy("gene", "transcript")
    is_gene, is_tx = F.col("id") == F.col("gene"), F.col("id") == F.col("transcript")
    own = own.withColumn("gene_seqid", F.max(F.when(is_gene, F.col("seqid"))).over(gene)).withColumn("gene_start", F.max(F.when(is_gene, F.col("start_pos"))).over(gene))
    return own.withColumn("tx_start", F.max(F.when(is_tx, F.col("start_pos"))).over(tx)).withColumn("kind_rank", kind_rank())


def hierarchy_sort(ordered: DataFrame) -> list[Column]:
    return [F.col("gene_seqid"), F.col("gene_start"), F.col("gene"), F.asc_nulls_first("tx_start"), F.asc_nulls_first("transcript"), F.col("kind_rank"), F.col("start_pos"), F.col("end_pos"), F.col("id")]


def write_hierarchy(features: DataFrame, tops: DataFrame, path: str) -> None:
    """Text files in hierarchy order; a gene's lines are never in two files."""
    ordered = output_order(features, tops)
    ordered.repartitionByRange("gene_seqid", "gene_start", "gene").sortWithinPartitions(*hierarchy_sort(ordered)).select(full_line(ordered).alias("line")).write.text(path)


def kept_directives(directives: DataFrame) -> DataFrame:
    """The directives that hold for any assembly, each once, the version first."""
    own = directives.filter(~F.lower("directive").rlike("^(" + "|".join(BOUND) + ")")).filter("directive <> '###'")
    once = own.groupBy("directive").agg(F.min("file_order").alias("file_order"))
    return once.orderBy(~F.lower("directive").startswith("##gff-version"), "file_order").select("directive")


def copy_ids(features: DataFrame) -> DataFrame:
    """Ids and parents of extra copies (copy_num over 0) get ``_copyN``."""
    mark = lambda c: F.when((F.col("copy_num") > 0) & F.col(c).isNotNull(), F.concat(c, F.lit("_copy"), F.col("copy_num").cast("string"))).otherwise(F.col(c))
    return features.withColumn("id", mark("id")).withColumn("parent", mark("parent"))


def fasta_record(name: str, seq: str, width: int = 0) -> Column:
    """``>name`` and the sequence, in lines of ``width`` letters if that is not 0."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    return F.concat(F.lit(">"), F.col(name), F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq", width: int = 0) -> None:
    df.select(fasta_record(name, seq, width).alias("value")).write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A side file of tab-separated values without a header."""
    df.write.option("sep", "\t").option("emptyValue", "").csv(path)


def run_manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n_rows, fingerprint): what a run wrote; the fingerprint does not depend on row order."""
    out = None
    for name, df in sorted(parts.items()):
        row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("fingerprint"))
        out = row if out is None else out.unionByName(row)
    return out


def publish(df: DataFrame, path: str, check: Callable[[DataFrame], bool] | None = None) -> None:
    """Write Parquet so that ``path`` has all of it or none: beside it first, then renamed.

    What fails, or does not pass ``check`` (given the written table), is left at
    ``path.partial`` for a look.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    beside, final = jvm.org.apache.hadoop.fs.Path(f"{path}.partial"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.partial")
    if check is not None and not check(spark.read.parquet(f"{path}.partial")):
        raise ValueError(f"{path}.partial does not pass its check")
    if not fs.rename(beside, final):
        raise OSError(f"cannot rename {path}.partial")


def export_sqlite(store: FeatureStore, path: str, batch: int = 50_000) -> None:
    """A SQLite file of the driver: features with their bins, and relations with levels.

    Rows are fetched partition by partition and written ``batch`` at a time.
    """
    import sqlite3

    from ..operators.interval import ucsc_bin

    names = ["id", "seqid", "featuretype", "start_pos", "end_pos", "strand"]
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE features (id TEXT, seqid TEXT, featuretype TEXT, start INT, end INT, strand TEXT, bin INT)")
        con.execute("CREATE TABLE relations (parent TEXT, child TEXT, level INT)")
        for sql, df in (("INSERT INTO features VALUES (?, ?, ?, ?, ?, ?, ?)", store.features.select(*names, ucsc_bin().alias("bin"))), ("INSERT INTO relations VALUES (?, ?, ?)", store.closure.select("ancestor", "descendant", "depth"))):
            rows: list[tuple] = []
            for row in df.toLocalIterator():
                rows.append(tuple(row))
                if len(rows) >= batch:
                    con.executemany(sql, rows)
                    rows = []
            con.executemany(sql, rows)
        con.execute("CREATE INDEX feature_bin ON features (seqid, bin, start, end)")
        con.execute("CREATE INDEX relation_parent ON relations (parent, level)")
    con.close()
