"""Lifted features: order of alignments, parents from children, conflicts and neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stage
from . import interval as iv


def signed_overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Bases that two intervals share; negative for those that lie apart."""
    return F.least(a1, b1) - F.greatest(a0, b0) + 1


def alignment_order(alignments: DataFrame, key: str) -> DataFrame:
    """Number a gene's alignments from 0: those on the sequence of the gene before it
    first, then by how far they lie from where it is expected; an alignment's blocks stay together.

    Needs aln_id, target, target_start, query_start, and of the gene: start, and of the
    one before it previous_target, previous_start, previous_ref_start.
    """
    off = F.abs((F.col("start") - F.col("previous_ref_start")) - (F.col("target_start") - F.col("query_start") - F.col("previous_start")))
    other = F.coalesce(F.col("target") != F.col("previous_target"), F.lit(True))
    best = alignments.groupBy(key, "aln_id").agg(F.min(F.struct(other.alias("other"), off.alias("off"))).alias("best"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("best", "aln_id")) - 1
    return alignments.join(best.select(key, "aln_id", place.alias("aln_order")), [key, "aln_id"])


def rebuild_parents(children: DataFrame, reference: DataFrame) -> DataFrame:
    """Features above lifted children, level by level: a parent spans its lifted children
    and takes its kind and own parent from the reference (id, parent, featuretype)."""
    out = None
    level = children.select("id", "parent", "seqid", "strand", "start_pos", "end_pos")
    while True:
        up = level.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.min("seqid").alias("seqid"), F.min("strand").alias("strand"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        made = stage(up.join(reference.select("id", "parent", "featuretype"), "id"), "parents")
        if made.isEmpty():
            return out if out is not None else made
        out = made if out is None else out.unionByName(made)
        level = made.drop("featuretype")


def lift_outcome(genes: DataFrame, coverage: float = 0.5, identity: float = 0.5) -> DataFrame:
    """Genes with their score, and whether coverage and identity let them count as mapped."""
    mapped = (F.col("coverage") >= coverage) & (F.col("sequence_id") >= identity)
    return genes.withColumn("mapped", F.coalesce(mapped, F.lit(False))).withColumn("score", 1 - F.col("sequence_id"))


def conflicts(lifted: DataFrame, max_overlap: float = 0.1) -> DataFrame:
    """(a, b): lifted genes of one sequence and strand that overlap by over ``max_overlap``
    of the shorter (by any base where one is a copy) but do not in the reference.

    Needs id, seqid, strand, start_pos, end_pos, is_copy, ref_seqid, ref_start, ref_end.
    """
    q = lifted.select(F.col("id").alias("a"), F.concat_ws("\t", "seqid", "strand").alias("q_seqid"), F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"),
                      F.col("is_copy").alias("a_copy"), F.col("ref_seqid").alias("a_seqid"), F.col("ref_start").alias("a0"), F.col("ref_end").alias("a1"))
    f = lifted.withColumnRenamed("id", "b").withColumn("seqid", F.concat_ws("\t", "seqid", "strand"))
    met = iv.overlap_join(q, f).filter("a < b")
    shorter = F.least(iv.length(), iv.length("q_start", "q_end"))
    limit = F.when(F.col("a_copy") | F.col("is_copy"), F.lit(0.0)).otherwise(F.lit(max_overlap))
    apart = (F.col("a_seqid") != F.col("ref_seqid")) | (signed_overlap("a0", "a1", "ref_start", "ref_end") <= 0)
    return met.filter(apart & (iv.overlap("q_start", "q_end", "start_pos", "end_pos") / shorter > limit)).select("a", "b")


def conflict_losers(pairs: DataFrame, lifted: DataFrame) -> DataFrame:
    """The loser of each pair: a copy loses to what is none, then the lower identity, the
    greater displacement from its neighbours, the shorter, and the second of the pair."""
    rank = F.struct((~F.col("is_copy")).cast("int").alias("r0"), F.col("identity").alias("r1"), (-F.col("displacement")).alias("r2"), iv.length().alias("r3"))
    own = lifted.select("id", rank.alias("r"))
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(own.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    return both.select("a", "b", F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("loser"))


def settle(lifted: DataFrame, again: Callable[[DataFrame], DataFrame], max_overlap: float = 0.1) -> DataFrame:
    """Resolve conflicts in rounds: losers go, and ``again`` may give them another place.

    A loser that ``again`` leaves out stays away, so the rounds end; the bound of ten
    rounds a gene is only for an ``again`` that keeps moving genes to and fro.
    """
    current = stage(lifted, "lifted")
    for _ in range(10 * max(1, current.count())):
        pairs = stage(conflicts(current, max_overlap), "conflicts")
        if pairs.isEmpty():
            break
        gone = conflict_losers(pairs, current).select(F.col("loser").alias("id")).distinct()
        out = current.join(gone, "id", "left_semi")
        current = stage(current.join(gone, "id", "left_anti").unionByName(again(out)), "lifted")
    return current


def upstream_apart(features: DataFrame) -> DataFrame:
    """(id, upstream): of the features that end before one starts, on its sequence, the
    last in order of start; null where there is none.  The window is over a sequence's
    features: those of genes, which are few beside their parts."""
    order = Window.partitionBy("seqid").orderBy("start_pos", "end_pos", "id")
    own = features.select("id", "seqid", "start_pos", "end_pos", F.row_number().over(order).alias("n"))
    ends = own.select("seqid", F.col("end_pos").alias("at"), F.lit(1).alias("side"), F.struct("n", "id").alias("seen"), F.lit(None).cast("string").alias("q"))
    starts = own.select("seqid", F.col("start_pos").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("struct<n:int,id:string>").alias("seen"), F.col("id").alias("q"))
    # a start comes before the ends at its place: what ends there does not end before it
    before = Window.partitionBy("seqid").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = ends.unionByName(starts).withColumn("best", F.max("seen").over(before))
    return found.filter("q IS NOT NULL").select(F.col("q").alias("id"), F.col("best.id").alias("upstream"))


def reciprocal_pairs(predictions: DataFrame, truths: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """(prediction, truth, share) within a group, where each covers at least that share of the other."""
    q = predictions.select(group, F.col("id").alias("prediction"), F.concat_ws("\t", group, "seqid").alias("q_seqid"), F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    f = truths.select(F.col("id").alias("truth"), F.concat_ws("\t", group, "seqid").alias("seqid"), "start_pos", "end_pos")
    shared = iv.overlap("q_start", "q_end", "start_pos", "end_pos")
    share = F.least(shared / iv.length("q_start", "q_end"), shared / iv.length())
    return iv.overlap_join(q, f).withColumn("share", share).filter(F.col("share") >= least).select("prediction", "truth", "share")


def half_open_probe(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs whose half-open intervals [start, end) share a place; empty intervals meet nothing."""
    q = left.filter("q_end > q_start").withColumn("q_end", F.col("q_end") - 1)
    f = right.filter("end_pos > start_pos").withColumn("end_pos", F.col("end_pos") - 1)
    return iv.overlap_join(q, f).withColumn("q_end", F.col("q_end") + 1).withColumn("end_pos", F.col("end_pos") + 1)


def converted(children: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Children (key, id, start_pos, end_pos in the query) in the coordinates of their
    chain's blocks (key, query_start, query_end, target_start, target_end): from the first
    to the last base that a block holds, with ``covered``, the bases that blocks hold, and
    ``coverage``, their share.  Children that no block touches are left out."""
    met = children.join(blocks, key).filter("query_start <= end_pos AND query_end >= start_pos")
    a = F.greatest("start_pos", "query_start") - F.col("query_start")
    b = F.least("end_pos", "query_end") - F.col("query_start")
    out = met.groupBy(key, "id", "start_pos", "end_pos").agg(F.min(F.col("target_start") + a).alias("lifted_start"), F.max(F.col("target_start") + b).alias("lifted_end"), F.sum(b - a + 1).alias("covered"))
    return out.withColumn("coverage", F.col("covered") / iv.length())


def chain_identity(total: Column, insertions: Column, mismatches: Column, deletions: Column) -> Column:
    """Identity of a lifted gene: aligned columns less insertions, mismatches and deletions."""
    columns = total + insertions
    return (columns - insertions - mismatches - deletions) / F.nullif(columns, F.lit(0))
