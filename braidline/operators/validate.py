"""Rule checks that give a table of findings (rule, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import graph


def _finding(rule: str, rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("id"))


def structure(features: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Findings over features (id, parent, seqid, featuretype, start_pos, end_pos, strand).

    Ids found twice, parents that are missing, children outside their parent or on
    another strand or sequence, genes without transcripts, transcripts without
    exons, bad coordinates and, with ``lengths`` (seqid, length), features that run
    over their sequence's end.  Counts are never capped.
    """
    pairs = graph.edges(features)
    up = features.select(F.col("id").alias("parent"), F.col("strand").alias("up_strand"), F.col("start_pos").alias("up_start"), F.col("end_pos").alias("up_end"), F.col("seqid").alias("up_seqid"))
    # one join for all rules on a child and its parent
    both = features.join(up, "parent")
    against = F.array_compact(F.array(
        F.when((F.col("start_pos") < F.col("up_start")) | (F.col("end_pos") > F.col("up_end")), "outside_parent"),
        F.when(F.col("strand") != F.col("up_strand"), "strand_differs"), F.when(F.col("seqid") != F.col("up_seqid"), "sequence_differs")))
    # a child's kind is that of its row; those whose id is found again have the others' kinds too
    again = features.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("child"))
    others = features.select(F.col("id").alias("child"), F.col("featuretype").alias("kind")).join(again, "child", "left_semi")
    kids = features.filter("parent IS NOT NULL AND id IS NOT NULL").select(F.col("parent").alias("id"), F.col("featuretype").alias("kind"))
    kids = kids.unionByName(pairs.join(again, "child", "left_semi").join(others, "child").select(F.col("parent").alias("id"), "kind"))
    out = [
        _finding("duplicate_id", features.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")),
        _finding("parent_missing", graph.orphans(pairs, features), "child"),
        both.select(F.explode(against).alias("rule"), F.col("id").cast("string").alias("id")),
        _finding("gene_without_transcript", features.filter("featuretype = 'gene'").join(kids.filter("kind = 'mRNA'"), "id", "left_anti")),
        _finding("transcript_without_exon", features.filter("featuretype = 'mRNA'").join(kids.filter("kind = 'exon'"), "id", "left_anti")),
        _finding("bad_coordinates", features.filter("start_pos < 1 OR end_pos < start_pos")),
    ]
    if lengths is not None:
        out.append(_finding("beyond_sequence", features.join(lengths, "seqid").filter("end_pos > length")))
    return reduce(DataFrame.unionByName, out)


#: The kinds that the rules tell apart.
GENES = ("gene", "pseudogene", "ncRNA_gene", "transposable_element_gene")
TRANSCRIPTS = ("mRNA", "transcript", "ncRNA", "lnc_RNA", "lncRNA", "rRNA", "tRNA", "snRNA", "snoRNA", "miRNA", "primary_transcript", "pseudogenic_transcript")


def hierarchy(features: DataFrame) -> DataFrame:
    """Findings on who stands below whom, over features (id, parent, featuretype, start_pos, end_pos).

    Parents that are missing; genes with a parent; transcripts, exons and CDS without
    a parent, or below a kind that cannot hold them (what holds children and has no
    parent can); transcripts without exon and CDS; mRNA without CDS; CDS within no exon
    of their transcript.  A feature with the id of another counts on its own.
    """
    pairs = graph.edges(features)
    kids = features.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.bool_or(F.col("featuretype") == "exon").alias("has_exon"), F.bool_or(F.col("featuretype") == "CDS").alias("has_cds"))
    root = F.col("parent").isNull() & F.col("has_exon").isNotNull() & ~F.col("featuretype").isin("exon", "CDS")
    own = features.join(kids, "id", "left").withColumn("root", root)
    up = own.groupBy(F.col("id").alias("parent")).agg(F.min("featuretype").alias("up_kind"), F.bool_or("root").alias("up_root"))
    both = own.join(up, "parent")
    kind, up_kind = F.col("featuretype"), F.col("up_kind")
    is_tx, none = kind.isin(*TRANSCRIPTS), F.col("parent").isNull()
    parts = [("exon", "exon"), ("CDS", "cds")]
    # a transcript by name or by the form of its name; and what holds exons without one
    holds = up_kind.isin(*TRANSCRIPTS) | up_kind.rlike("(RNA|_transcript)$") | up_kind.isin("pseudogene", "transposable_element")
    covered = features.filter("featuretype = 'CDS'").alias("c").join(
        features.filter("featuretype = 'exon'").select("parent", F.col("start_pos").alias("e0"), F.col("end_pos").alias("e1")), "parent").filter("e0 <= start_pos AND e1 >= end_pos").select("id", "parent").distinct()
    out = [
        _finding("orphan_parent", graph.orphans(pairs, features), "child"),
        _finding("gene_has_parent", own.filter(kind.isin(*GENES) & ~none)),
        _finding("transcript_no_parent", own.filter(is_tx & none & ~F.col("root"))),
        _finding("transcript_parent_type", both.filter(is_tx & ~up_kind.isin(*GENES) & ~F.col("up_root"))),
        *(_finding(f"{name}_no_parent", own.filter((kind == k) & none)) for k, name in parts),
        *(_finding(f"{name}_parent_type", both.filter((kind == k) & ~holds & ~F.col("up_root"))) for k, name in parts),
        _finding("transcript_has_exons", own.filter(is_tx & ~F.coalesce(F.col("has_exon") | F.col("has_cds"), F.lit(False)))),
        _finding("mrna_has_cds", own.filter((kind == "mRNA") & ~F.coalesce("has_cds", F.lit(False)))),
        _finding("cds_outside_exons", features.filter("featuretype = 'CDS' AND parent IS NOT NULL").join(covered, ["id", "parent"], "left_anti")),
    ]
    return reduce(DataFrame.unionByName, out)


def declared_earlier(features: DataFrame) -> DataFrame:
    """Findings on line order (column line): children before their parent's first line, and
    ids that are repeated, but for the parts of one CDS (same sequence, strand and parent)."""
    first = features.groupBy(F.col("id").alias("parent")).agg(F.min("line").alias("up_line"))
    late = features.join(first, "parent").filter("line < up_line")
    signature = F.struct("featuretype", "seqid", "strand", F.coalesce("parent", F.lit("")).alias("parent"))
    repeated = features.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(signature).alias("a"), F.max(signature).alias("b"))
    wrong = repeated.filter((F.col("n") > 1) & ~((F.col("a") == F.col("b")) & (F.col("a.featuretype") == "CDS")))
    return _finding("parent_declared_later", late).unionByName(_finding("duplicate_id", wrong))


def score_attributes(features: DataFrame, names: tuple[str, ...] = ("protein_identity", "dna_identity"), sources: tuple[str, ...] = (".",)) -> DataFrame:
    """Findings on ``attrs``: identities that are no number from 0 to 1, transcripts that
    lack one, and sources that are not listed."""
    out = [_finding("unexpected_source", features.filter(~F.col("source").isin(*sources)))]
    for name in names:
        value = F.get(F.col("attrs")[name], F.lit(0))
        number = F.expr(f"try_cast(get(attrs['{name}'], 0) AS DOUBLE)")
        out.append(_finding(f"{name}_invalid", features.filter(value.isNotNull() & ~F.coalesce(number.between(0, 1), F.lit(False)))))
        out.append(_finding(f"{name}_missing", features.filter(F.col("featuretype").isin(*TRANSCRIPTS) & value.isNull())))
    return reduce(DataFrame.unionByName, out)


#: Attribute names that the format defines.
OFFICIAL = ("ID", "Name", "Alias", "Parent", "Target", "Gap", "Derives_from", "Note", "Dbxref", "Ontology_term", "Is_circular")


def lines(rows: DataFrame, seqids: DataFrame | None = None) -> DataFrame:
    """(rule, line) findings on the text of a file (columns line, from 1, and value).

    Version line, byte order mark, number of columns, places, strand, phase, and the
    attributes: pairs, empty ids and parents, capitals, characters that should be
    encoded; with ``seqids`` (seqid), sequences that are not listed.
    """
    fields = ("seqid", "source", "kind", "a", "b", "score", "strand", "phase", "attributes")
    col = lambda c: F.get("p", F.lit(fields.index(c)))
    # parts as a generated row: what filters and rules ask of them does not split the line again
    part = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    feature = (F.trim("value") != "") & ~F.col("value").startswith("#")
    own = rows.select("line", "value", F.explode(F.array(part)).alias("p")).withColumn("feature", feature)
    whole = own.filter(F.col("feature") & (F.size("p") == 9))
    a, b = col("a").try_cast("bigint"), col("b").try_cast("bigint")
    pairs = whole.select("line", F.explode(F.split(col("attributes"), ";")).alias("t")).withColumn("t", F.trim("t")).filter("t <> '' AND t <> '.'")

    def found(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        """A finding for each rule that holds for a row: one pass over the rows."""
        hit = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in rules.items()))))
        return rows.select(hit.alias("rule"), "line")

    first, is_feature, is_whole = F.col("line") == 1, F.col("feature"), F.col("feature") & (F.size("p") == 9)
    named = F.contains("t", F.lit("="))
    k, v = F.trim(F.substring_index("t", "=", 1)), F.regexp_extract("t", "=(.*)$", 1)
    out = [
        found(own, {
            "utf8_bom": first & F.col("value").startswith("\ufeff"),
            "missing_gff_version": first & ~F.regexp_replace("value", "^\ufeff", "").startswith("##gff-version"),
            "bad_column_count": is_feature & (F.size("p") != 9),
            "empty_seqid": is_whole & (col("seqid") == ""),
            "bad_coordinate": is_whole & (a.isNull() | b.isNull()),
            "negative_start": is_whole & (a < 1),
            "negative_end": is_whole & (b < 1),
            "start_gt_end": is_whole & (a > b),
            "bad_strand": is_whole & ~col("strand").isin("+", "-", ".", "?"),
            "bad_phase": is_whole & ~col("phase").isin("0", "1", "2", "."),
            "cds_missing_phase": is_whole & (col("kind") == "CDS") & (col("phase") == "."),
        }),
        found(pairs, {
            "bad_attribute": ~named,
            "empty_id": named & (k == "ID") & (F.trim(v) == ""),
            "empty_parent": named & (k == "Parent") & F.exists(F.split(v, ","), lambda x: F.trim(x) == ""),
            "miscapitalised_attribute": named & ~k.isin(*OFFICIAL) & k.rlike("^[A-Z]") & F.lower(k).isin(*(n.lower() for n in OFFICIAL)),
            "unencoded_reserved_char": named & v.rlike("[=&]"),
        }),
    ]
    if seqids is not None:
        listed = whole.select("line", col("seqid").alias("seqid")).filter("seqid <> ''").join(seqids, "seqid", "left_anti")
        out.append(listed.select(F.lit("unknown_seqid").alias("rule"), "line"))
    return reduce(DataFrame.unionByName, out)
