"""Coding parts in 5' to 3' order: boundaries, junctions, numbering, envelopes, spliced sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .interval import islands, length


def five_prime(key: str, tie: str = "id") -> Window:
    """Parts of each key in 5' to 3' order."""
    turned = lambda c: F.when(F.col("strand") == "-", -F.col(c)).otherwise(F.col(c))
    return Window.partitionBy(key).orderBy(turned("start_pos"), turned("end_pos"), tie)


def protein_boundaries(parts: DataFrame, key: str) -> DataFrame:
    """Where each part begins and ends in the protein: bases so far over three, as fractions."""
    w = five_prime(key)
    through = F.sum(length()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("aa_end", through / 3).withColumn("aa_start", (through - length()) / 3)


def junctions(parts: DataFrame, key: str) -> DataFrame:
    """(key, junctions): bases up to each inner boundary of a spliced transcript, in order."""
    through = F.sum(length()).over(five_prime(key).rowsBetween(Window.unboundedPreceding, 0))
    all_ = parts.select(key, through.alias("at")).groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return all_.select(key, F.slice("ats", F.lit(1), F.size("ats") - 1).alias("junctions"))


def junction_scores(reference: Column, lifted: Column) -> list[Column]:
    """Sensitivity and precision of boundaries as sets, and whether the lists are equal."""
    shared = F.size(F.array_intersect(reference, lifted))
    share = lambda of: F.when(F.size(of) == 0, F.lit(1.0)).otherwise(shared / F.size(F.array_distinct(of)))
    return [share(reference).alias("sensitivity"), share(lifted).alias("precision"), (reference == lifted).alias("exact")]


def renumbered(parts: DataFrame, key: str, prefix: str = "exon", order: str = "id") -> DataFrame:
    """Parts of keys with colliding ids get ids by number in 5' to 3' order; others keep theirs."""
    seen = F.count(F.lit(1)).over(Window.partitionBy("id"))
    own = parts.withColumn("_seen", seen)
    clash = F.max(F.col("_seen") > 1).over(Window.partitionBy(key))
    number = F.row_number().over(five_prime(key, order))
    new = F.concat(F.col(key), F.lit(f"-{prefix}-"), number.cast("string"))
    return own.withColumn("_new", F.when(clash, new).otherwise(F.col("id"))).withColumn("id", F.col("_new")).drop("_seen", "_new")


def exons_cover(exons: DataFrame, cds: DataFrame, key: str = "parent") -> DataFrame:
    """Exons stretched over the coding parts of their transcript that overlap them."""
    c = cds.select(key, F.col("start_pos").alias("c0"), F.col("end_pos").alias("c1"))
    e = exons.select("id", key, "start_pos", "end_pos").alias("e")
    hit = e.join(c, key).filter("c0 <= end_pos AND c1 >= start_pos").groupBy("id").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    out = exons.join(hit, "id", "left")
    return out.withColumn("start_pos", F.least("start_pos", "c0")).withColumn("end_pos", F.greatest("end_pos", "c1")).drop("c0", "c1")


def fit_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with the extent of their children; those without children stay."""
    span = children.groupBy(F.col("parent").alias("id")).agg(F.min("start_pos").alias("_a"), F.max("end_pos").alias("_b"))
    out = parents.join(span, "id", "left")
    return out.withColumn("start_pos", F.coalesce("_a", "start_pos")).withColumn("end_pos", F.coalesce("_b", "end_pos")).drop("_a", "_b")


def feature_sequence(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases start to end (1-based, inclusive) of a sequence, turned on the minus strand."""
    part = F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)


def spliced(parts: DataFrame, sequences: DataFrame, key: str = "parent", pad: bool = True) -> DataFrame:
    """(key, seq): overlapping parts joined, their bases in order, turned on the minus
    strand, and with ``pad`` filled with N to whole codons.  ``sequences`` is (seqid, seq)."""
    joined = islands(parts, [key, "seqid", "strand"], adjacent=False).join(sequences, "seqid")
    piece = F.struct("start_pos", F.substring(F.col("seq"), F.col("start_pos").cast("int"), length().cast("int")).alias("s"))
    all_ = joined.groupBy(key).agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min("strand").alias("strand"))
    dna = F.array_join(F.transform("p", lambda x: x["s"]), "")
    out = all_.select(key, F.when(F.col("strand") == "-", reverse_complement(dna)).otherwise(dna).alias("seq"))
    return out.withColumn("seq", F.concat("seq", F.repeat(F.lit("N"), (3 - F.length("seq") % 3) % 3))) if pad else out


def phase_findings(cds: DataFrame, key: str = "parent") -> DataFrame:
    """Coding parts after the first of their transcript whose phase is not what the
    bases before them ask for (column phase, text); other than whole numbers are passed over."""
    turned = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("start_pos"))
    w = Window.partitionBy(key).orderBy(turned, "id")
    before = F.sum(length()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = cds.withColumn("expected", (3 - before % 3) % 3).withColumn("number", F.row_number().over(w))
    actual = F.expr("try_cast(phase AS INT)")
    return own.filter((F.col("number") > 1) & (actual != F.col("expected"))).select("id", key, F.col("expected").cast("int").alias("expected"), actual.alias("actual"))


def relative_coordinate(place: Column, start: Column, end: Column, reverse: Column) -> Column:
    """A place within an interval, counted from its end where it is read in reverse."""
    return F.when(reverse, end - place).otherwise(place - start)


def reconciled(exons: DataFrame, cds: DataFrame, key: str = "parent") -> DataFrame:
    """(key, start_pos, end_pos, cds_start, cds_end): a transcript's exons rebuilt around new coding parts.

    Every coding part is in an exon of its own extent; the first one's exon begins where
    the exon that it overlaps does, if that is before it, and the last one's ends where
    the first exon that it overlaps does, if that is behind it.  Exons wholly before the
    first or behind the last coding part stay, without one.  A single coding part takes
    the extent of all exons that it overlaps (its own, if there is none).  A transcript
    without new coding parts keeps its exons.
    """
    place = Window.partitionBy(key).orderBy("start_pos", "end_pos")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    c = cds.select(key, F.col("start_pos").alias("c0"), F.col("end_pos").alias("c1"), F.row_number().over(place).alias("i"), n.alias("n"))
    e = exons.select(key, F.col("start_pos").alias("e0"), F.col("end_pos").alias("e1"))
    ends = c.groupBy(key).agg(F.min("c0").alias("a"), F.max("c1").alias("b"))
    # only the first and the last coding part look at exons
    outer = c.filter("i = 1 OR i = n").join(e, key).filter("e0 <= c1 AND e1 >= c0")
    span = outer.groupBy(key, "i").agg(F.min("e0").alias("s0"), F.max("e1").alias("s1"), F.min(F.struct("e0", "e1")).alias("f"))
    own = c.join(span, [key, "i"], "left")
    alone = F.col("n") == 1
    start = F.when(alone, F.coalesce("s0", "c0")).when(F.col("i") == 1, F.least("c0", "f.e0")).otherwise(F.col("c0"))
    end = F.when(alone, F.coalesce("s1", "c1")).when(F.col("i") == F.col("n"), F.greatest("c1", "f.e1")).otherwise(F.col("c1"))
    none = F.lit(None).cast("long")
    coded = own.select(key, start.alias("start_pos"), end.alias("end_pos"), F.col("c0").alias("cds_start"), F.col("c1").alias("cds_end"))
    plain = e.join(ends, key, "left").filter("a IS NULL OR e1 < a OR e0 > b")
    return coded.unionByName(plain.select(key, F.col("e0").alias("start_pos"), F.col("e1").alias("end_pos"), none.alias("cds_start"), none.alias("cds_end")))


def with_flank(genes: DataFrame, sequences: DataFrame, flank: float = 0.0) -> DataFrame:
    """(id, start_pos, end_pos, seq): each gene's bases with a share of its length more on
    both sides, within its sequence; ``sequences`` is (seqid, seq)."""
    more = F.floor(length() * flank)
    own = genes.join(sequences, "seqid").select(
        "id", F.greatest(F.lit(1), F.col("start_pos") - more).alias("start_pos"), F.least(F.length("seq"), F.col("end_pos") + more).alias("end_pos"), "seq")
    part = F.substring(F.col("seq"), F.col("start_pos").cast("int"), F.greatest(F.lit(0), length()).cast("int"))
    return own.select("id", "start_pos", "end_pos", part.alias("seq"))
