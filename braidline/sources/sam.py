"""SAM text: header check, alignments, and their ungapped blocks as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NoSequences(ValueError):
    """The file has no line that names a target sequence."""


def sequences(lines: DataFrame) -> DataFrame:
    """(seqid, length) of the header's targets (column value)."""
    own = lines.filter(F.col("value").startswith("@SQ"))
    return own.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("seqid"), F.expr(r"try_cast(regexp_extract(value, '\\tLN:([0-9]+)', 1) AS BIGINT)").alias("length"))


def alignments(lines: DataFrame, check: bool = True) -> DataFrame:
    """Alignment lines as columns; unmapped ones have a null target.

    With ``check``, a file without target lines raises NoSequences.
    """
    if check and sequences(lines).isEmpty():
        raise NoSequences("no @SQ line")
    p = F.split("value", "\t")
    own = lines.filter(~F.col("value").startswith("@")).select(p.alias("p")).filter(F.size("p") >= 11)
    flag = F.expr("try_cast(p[1] AS INT)")
    mapped = (flag.bitwiseAND(4) == 0) & (F.get("p", F.lit(2)) != "*")
    return own.select(
        F.get("p", F.lit(0)).alias("query"), flag.alias("flag"), F.when(mapped, F.get("p", F.lit(2))).alias("target"),
        F.when(mapped, F.expr("try_cast(p[3] AS BIGINT)")).alias("target_start"), F.when(mapped, F.get("p", F.lit(5))).alias("cigar"),
        F.when(flag.bitwiseAND(16) == 0, "+").otherwise("-").alias("strand"),
    )


def steps(cigar: Column) -> Column:
    """The steps (n, op) of a CIGAR string."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    pairs = F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"))
    return F.transform(pairs, lambda s: F.struct(s["n"].cast("long").alias("n"), s["op"].alias("op")))


def blocks(aligned: DataFrame) -> DataFrame:
    """A row for each ungapped run of columns: (query, target, query_start, query_end,
    target_start, target_end), 0-based and inclusive; a clip moves the query on."""
    def total(kinds: str, upto: Column) -> Column:
        return F.aggregate(F.filter(F.slice("s", F.lit(1), upto), lambda s: s["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, s: a + s["n"])

    own = aligned.filter("target IS NOT NULL").withColumn("s", steps(F.col("cigar")))
    own = own.select("*", F.posexplode("s").alias("i", "step"))
    last = F.get("s", F.col("i") - 1)["op"]
    own = own.filter(F.col("step.op").isin("M", "=", "X"))
    q, t = total("M=XIS", F.col("i")), total("M=XDN", F.col("i"))
    rows = own.select("query", "target", "strand", "target_start", F.col("i"), q.alias("q0"), (F.col("target_start") - 1 + t).alias("t0"), F.col("step.n").alias("n"),
                      (F.coalesce(last, F.lit("S")).isin("M", "=", "X")).alias("goes_on"), F.col("cigar"))
    # steps of one run (=, X, M side by side) become one block
    from pyspark.sql import Window

    w = Window.partitionBy("query", "target", "target_start", "cigar").orderBy("i")
    run = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w)
    return rows.withColumn("run", run).groupBy("query", "target", "strand", F.col("target_start").alias("at"), "cigar", "run").agg(
        F.min("q0").alias("query_start"), F.max(F.col("q0") + F.col("n") - 1).alias("query_end"), F.min("t0").alias("target_start"), F.max(F.col("t0") + F.col("n") - 1).alias("target_end"),
    ).drop("at", "cigar", "run")
