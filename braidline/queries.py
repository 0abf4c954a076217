"""Queries over the annotation view, each with the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequence as sq
from .functions.align import align_identity
from .operators import evaluate as ev
from .operators import interval as iv
from .plans import graph
from .sources import gff
from .sources.model import ANNOTATION_SQL, exons, features, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Whole sequences are worked on in stretches of this many bits of bases.
STRETCH = 12
SPAN = ["id", "seqid", "start_pos", "end_pos", "strand"]


def query(sql: str | None = None, view: bool = True) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` follows the annotation view if ``view``."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (ANNOTATION_SQL if view else "") + sql
        return f

    return add


def _mrna(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).filter("featuretype = 'mRNA'")


def _closure(spark: SparkSession, d: str) -> DataFrame:
    """The view has three kinds of features, so two levels are all."""
    return graph.closure(graph.edges(features(spark, d)), max_depth=2)


@query("""
, pr AS (SELECT *, max(end_pos) OVER (PARTITION BY gene ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
fl AS (SELECT *, CASE WHEN start_pos <= reach + 1 THEN 0 ELSE 1 END AS nw FROM pr),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY gene ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM fl),
m AS (SELECT gene, k, min(start_pos) AS a, max(end_pos) AS b FROM isl GROUP BY gene, k)
SELECT gene AS id, CAST(sum(b - a + 1) AS BIGINT) AS bp, count(*) AS n_islands FROM m GROUP BY gene""")
def op_children_bp(spark: SparkSession, d: str) -> DataFrame:
    """Bases covered by the exons of each gene, over the closure."""
    f = features(spark, d)
    genes = f.filter("featuretype = 'gene'").select(F.col("id").alias("anchor"))
    below = graph.relatives(genes, _closure(spark, d), f, featuretype="exon")
    merged = iv.islands(below, ["anchor"])
    return merged.groupBy(F.col("anchor").alias("id")).agg(F.sum(iv.length()).alias("bp"), F.count(F.lit(1)).alias("n_islands"))


@query("SELECT id, seqid, start_pos, end_pos, strand FROM f WHERE featuretype = 'mRNA' AND strand = '+'")
def op_features_scan(spark: SparkSession, d: str) -> DataFrame:
    return _mrna(spark, d).filter("strand = '+'").select(*SPAN).orderBy("seqid", "start_pos", "id")


@query("SELECT featuretype, count(*) AS n FROM f GROUP BY featuretype")
def op_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("featuretype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT seqid FROM f")
def op_seqids(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("seqid").distinct().orderBy("seqid")


@query("SELECT id, base AS original_id, copy FROM ex WHERE copy > 1")
def op_dup_ids(spark: SparkSession, d: str) -> DataFrame:
    return exons(spark, d).filter("copy > 1").select("id", F.col("base").alias("original_id"), F.col("copy").cast("long").alias("copy"))


@query("SELECT parent, child FROM edges")
def op_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(features(spark, d))


@query("SELECT ancestor, descendant, depth FROM closure")
def op_closure(spark: SparkSession, d: str) -> DataFrame:
    return _closure(spark, d)


@query("SELECT c.ancestor AS anchor, f.id, f.featuretype, f.start_pos, f.end_pos, c.depth FROM closure c JOIN f ON c.descendant = f.id WHERE c.depth = 1 AND c.ancestor LIKE 'g%'")
def op_children_level(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    genes = f.filter("featuretype = 'gene'").select(F.col("id").alias("anchor"))
    return graph.relatives(genes, _closure(spark, d), f, level=1).select("anchor", "id", "featuretype", "start_pos", "end_pos", "depth")


@query("SELECT c.ancestor AS anchor, f.id, f.start_pos, f.end_pos, c.depth FROM closure c JOIN f ON c.descendant = f.id WHERE c.ancestor LIKE 'g%' AND f.featuretype = 'exon'")
def op_children_all(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    genes = f.filter("featuretype = 'gene'").select(F.col("id").alias("anchor"))
    return graph.relatives(genes, _closure(spark, d), f, featuretype="exon").select("anchor", "id", "start_pos", "end_pos", "depth")


@query("SELECT c.descendant AS anchor, f.id, f.featuretype, c.depth FROM closure c JOIN f ON c.ancestor = f.id WHERE c.descendant LIKE 'e%'")
def op_parents_all(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    leaves = f.filter("featuretype = 'exon'").select(F.col("id").alias("anchor"))
    return graph.relatives(leaves, _closure(spark, d), f, up=True).select("anchor", "id", "featuretype", "depth")


@query("SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", view=False)
def op_childless(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts without exons, by an anti join."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.concat(F.lit("o"), "o_orderkey").alias("child"), F.concat(F.lit("c"), "o_custkey").alias("parent"))


@query("SELECT parent, child FROM edges WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = edges.parent AND strand = '+')")
def op_orphan_parents(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose parent is missing from the features of the plus strand."""
    f = features(spark, d)
    return graph.orphans(graph.edges(f), f.filter("strand = '+'"))


@query("SELECT id, seqid, start_pos, end_pos, strand FROM f WHERE seqid = 'chr7' AND start_pos <= 9000 AND end_pos >= 3000")
def op_region_overlap(spark: SparkSession, d: str) -> DataFrame:
    return iv.region(features(spark, d), "chr7", 3000, 9000).select(*SPAN)


@query("SELECT id, seqid, start_pos, end_pos, strand FROM f WHERE seqid = 'chr7' AND start_pos >= 3000 AND end_pos <= 9000")
def op_region_within(spark: SparkSession, d: str) -> DataFrame:
    return iv.region(features(spark, d), "chr7", 3000, 9000, within=True).select(*SPAN)


REGIONS_SQL = ", q AS (SELECT event_id AS query_idx, 'chr' || (user_id % 25) AS q_seqid, (event_id * 7919) % 20000 + 1 AS q_start, (event_id * 7919) % 20000 + 50 AS q_end FROM events)"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    start = (F.col("event_id") * 7919) % 20000
    return table(spark, d, "events").select(F.col("event_id").alias("query_idx"), F.concat(F.lit("chr"), F.col("user_id") % 25).alias("q_seqid"), (start + 1).alias("q_start"), (start + 50).alias("q_end"))


@query(REGIONS_SQL + " SELECT query_idx, id, start_pos, end_pos FROM q JOIN ex ON q_seqid = seqid AND start_pos <= q_end AND end_pos >= q_start")
def op_region_batched(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d).filter("featuretype = 'exon'").select("id", "seqid", "start_pos", "end_pos")
    return iv.overlap_join(_regions(spark, d), f).select("query_idx", "id", "start_pos", "end_pos")


@query(REGIONS_SQL + " SELECT DISTINCT id FROM ex WHERE NOT EXISTS (SELECT 1 FROM q WHERE q_seqid = seqid AND start_pos <= q_end AND end_pos >= q_start AND (least(end_pos, q_end) - greatest(start_pos, q_start) + 1) * 1.0 / least(end_pos - start_pos + 1, 50) > 0.1)")
def op_overlap_ratio_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Exons that no region overlaps by over a tenth of the shorter one."""
    ex = features(spark, d).filter("featuretype = 'exon'").select("id", "seqid", "start_pos", "end_pos")
    hit = iv.overlap_join(_regions(spark, d), ex)
    shorter = F.least(iv.length(), iv.length("q_start", "q_end"))
    hit = hit.filter(iv.overlap("start_pos", "end_pos", "q_start", "q_end") / shorter > 0.1)
    return ex.join(hit.select("id").distinct(), "id", "left_anti").select("id").distinct()


@query("""
, pr AS (SELECT *, max(end_pos) OVER (PARTITION BY seqid, strand ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
fl AS (SELECT *, CASE WHEN start_pos <= reach + 1 THEN 0 ELSE 1 END AS nw FROM pr),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY seqid, strand ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM fl)
SELECT seqid, strand, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_parts FROM isl GROUP BY seqid, strand, k""")
def op_merge_default(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(features(spark, d).filter("featuretype = 'exon'"), ["seqid", "strand"], bits=STRETCH).drop("island")


@query("""
, pr AS (SELECT *, max(end_pos) OVER (PARTITION BY parent ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
fl AS (SELECT *, CASE WHEN start_pos <= reach THEN 0 ELSE 1 END AS nw FROM pr),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY parent ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM fl)
SELECT parent, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_parts FROM isl GROUP BY parent, k""")
def op_merge_children(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(features(spark, d).filter("featuretype = 'exon'"), ["parent"], adjacent=False).drop("island")


INTRONS_SQL = ", gp AS (SELECT parent, end_pos + 1 AS gap_start, lead(start_pos) OVER (PARTITION BY parent ORDER BY start_pos, end_pos) - 1 AS gap_end FROM ex), intr AS (SELECT * FROM gp WHERE gap_end >= gap_start)"


@query(INTRONS_SQL + " SELECT parent, gap_start, gap_end FROM intr")
def op_introns(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(features(spark, d).filter("featuretype = 'exon'"), ["parent"]).select("parent", "gap_start", "gap_end")


@query(INTRONS_SQL + " SELECT parent, gap_start AS site FROM intr UNION ALL SELECT parent, gap_end FROM intr")
def op_splice_sites(spark: SparkSession, d: str) -> DataFrame:
    return iv.splice_sites(op_introns(spark, d)).select("parent", "site")


@query("SELECT seqid, end_pos + 1 AS gap_start, nxt - 1 AS gap_end FROM (SELECT seqid, end_pos, lead(start_pos) OVER (PARTITION BY seqid ORDER BY start_pos, end_pos) AS nxt FROM f WHERE featuretype = 'gene') WHERE nxt - 1 >= end_pos + 1")
def op_interfeatures(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(features(spark, d).filter("featuretype = 'gene'"), ["seqid"], bits=STRETCH).select("seqid", "gap_start", "gap_end")


@query("""
, b AS (SELECT parent, count(*) AS n, string_agg(CAST(end_pos - start_pos + 1 AS VARCHAR), ',' ORDER BY start_pos, end_pos) || ',' AS sizes, list(start_pos ORDER BY start_pos, end_pos) AS st FROM ex GROUP BY parent)
SELECT m.id, m.seqid || chr(9) || (m.start_pos - 1) || chr(9) || m.end_pos || chr(9) || m.id || chr(9) || '0' || chr(9) || m.strand || chr(9) || (m.start_pos - 1) || chr(9) || (m.start_pos - 1) || chr(9) || '0,0,0' || chr(9) || b.n || chr(9) || b.sizes || chr(9) || array_to_string(list_transform(b.st, lambda x: x - m.start_pos), ',') || ',' AS bed
FROM mrna m JOIN b ON b.parent = m.id""")
def op_bed12(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    return iv.bed12(f.filter("featuretype = 'mRNA'").drop("parent"), f.filter("featuretype = 'exon'").select("parent", "start_pos", "end_pos"))


@query("""
SELECT id, CAST(CASE WHEN (start_pos-1)>>17 = (end_pos-1)>>17 THEN 585 + ((start_pos-1)>>17) WHEN (start_pos-1)>>20 = (end_pos-1)>>20 THEN 73 + ((start_pos-1)>>20)
WHEN (start_pos-1)>>23 = (end_pos-1)>>23 THEN 9 + ((start_pos-1)>>23) WHEN (start_pos-1)>>26 = (end_pos-1)>>26 THEN 1 + ((start_pos-1)>>26) ELSE 0 END AS BIGINT) AS bin FROM f""")
def op_ucsc_bin(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("id", iv.ucsc_bin().alias("bin"))


@query("SELECT id, seqid, start_pos, end_pos, strand FROM gene")
def op_gene_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).filter("featuretype = 'gene'").select(*SPAN)


@query("SELECT id, parent, seqid, start_pos, end_pos, strand FROM mrna")
def op_transcript_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return _mrna(spark, d).select("id", "parent", "seqid", "start_pos", "end_pos", "strand")


@query("SELECT l_partkey, l_suppkey AS major, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE r = 1", view=False)
def op_major_gene_id(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest."""
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("n"), "l_suppkey")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("l_partkey", F.col("l_suppkey").alias("major"), "n")


@query("""
SELECT id, CAST((3 - coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY parent ORDER BY CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END, CASE WHEN strand = '-' THEN -end_pos ELSE end_pos END, id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS BIGINT) AS phase FROM ex""")
def op_cds_phase(spark: SparkSession, d: str) -> DataFrame:
    return iv.phases(features(spark, d).filter("featuretype = 'exon'"), "parent").select("id", F.col("phase").cast("long").alias("phase"))


@query("SELECT e.child, e.parent FROM edges e JOIN f c ON c.id = e.child JOIN f p ON p.id = e.parent WHERE c.strand <> p.strand OR c.start_pos < p.start_pos OR c.end_pos > p.end_pos OR c.seqid <> p.seqid")
def op_containment(spark: SparkSession, d: str) -> DataFrame:
    """Children outside their parent, or on another strand or sequence."""
    f = features(spark, d)
    up = f.select(F.col("id").alias("parent"), F.col("strand").alias("ps"), F.col("start_pos").alias("pa"), F.col("end_pos").alias("pb"), F.col("seqid").alias("pq"))
    bad = (F.col("strand") != F.col("ps")) | (F.col("start_pos") < F.col("pa")) | (F.col("end_pos") > F.col("pb")) | (F.col("seqid") != F.col("pq"))
    return f.join(up, "parent").filter(bad).select(F.col("id").alias("child"), "parent")


@query("SELECT id, 'ID' AS name, id AS value, 0 AS idx FROM ex UNION ALL SELECT id, 'Parent', parent, 0 FROM ex UNION ALL SELECT id, 'Dbxref', 'flag:' || flag, 0 FROM ex UNION ALL SELECT id, 'Dbxref', 'seq ' || seqid, 1 FROM ex")
def op_attr_explode(spark: SparkSession, d: str) -> DataFrame:
    """A ninth column parsed to one row for each value."""
    ninth = F.concat(F.lit("ID="), "id", F.lit(";Parent="), "parent", F.lit(";Dbxref=flag:"), "flag", F.lit(",seq%20"), "seqid", F.lit(";"))
    return gff.attribute_rows(exons(spark, d).select("id", ninth.alias("attributes")), "id").select("id", "name", "value", F.col("idx").cast("int").alias("idx"))


@query("SELECT id, seqid || chr(9) || 'braidline' || chr(9) || featuretype || chr(9) || start_pos || chr(9) || end_pos || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'ID=' || id || coalesce(';Parent=' || parent, '') AS line FROM f")
def op_gff_line(spark: SparkSession, d: str) -> DataFrame:
    return gff.gff_line(features(spark, d))


LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SEQ_SQL = f"WITH s AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"
CODON_SQL = f"substr('{sq.CODE}', CAST(16 * (strpos('TCAG', substr(seq, 3*i+1, 1)) - 1) + 4 * (strpos('TCAG', substr(seq, 3*i+2, 1)) - 1) + strpos('TCAG', substr(seq, 3*i+3, 1)) AS BIGINT), 1)"
PROTEIN_SQL = SEQ_SQL + f", p AS (SELECT doc_id, seq, coalesce(array_to_string(list_transform(range(length(seq) // 3), lambda i: {CODON_SQL}), ''), '') AS protein FROM s)"


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """A sequence for each document."""
    return table(spark, d, "documents").select("doc_id", F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, BASES).alias("seq"))


@query(SEQ_SQL + " SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp FROM s", view=False)
def op_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("revcomp"))


@query(PROTEIN_SQL + " SELECT doc_id, length(protein) AS n_aa, md5(protein) AS protein FROM p", view=False)
def op_translate(spark: SparkSession, d: str) -> DataFrame:
    out = _sequences(spark, d).withColumn("protein", sq.translate(F.col("seq")))
    return out.select("doc_id", F.length("protein").cast("long").alias("n_aa"), F.md5("protein").alias("protein"))


@query(PROTEIN_SQL + " SELECT doc_id, protein LIKE 'M%' AND protein LIKE '%*' AND strpos(protein, '*') = length(protein) AS orf_valid FROM p", view=False)
def op_orf_validity(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", sq.orf_valid(sq.translate(F.col("seq"))).alias("orf_valid"))


@query(SEQ_SQL + " SELECT doc_id, round(CASE WHEN length(seq) = 0 THEN 0.0 ELSE len(list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i, 1) = substr(seq, length(seq) + 1 - i, 1))) * 1.0 / length(seq) END, 9) AS identity FROM s", view=False)
def op_dna_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each sequence and its reverse."""
    return _sequences(spark, d).select("doc_id", F.round(sq.dna_identity(F.col("seq"), F.reverse("seq")), 9).alias("identity"))


@query()
def op_global_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Global alignment of benchmark items with the item after them (dynamic programming in Arrow batches)."""
    seq = table(spark, d, "benchmark").select("item_id", F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, BASES).alias("seq"))
    after = seq.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("other"))
    return seq.join(after, "item_id").select("item_id", align_identity("seq", "other").alias("a")).select("item_id", "a.score", "a.identity")


@query("SELECT l_partkey, l_orderkey AS best_order, l_linenumber AS best_line, l_extendedprice AS best_price, copy_count FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS copy_count, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1", view=False)
def op_best_copy(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    order = [(-F.col("l_extendedprice")).alias("o0"), (-F.col("l_discount")).alias("o1"), F.col("l_orderkey").alias("o2"), F.col("l_linenumber").alias("o3")]
    best = ev.best_per_key(lines, "l_partkey", order)
    return best.select("l_partkey", F.col("l_orderkey").alias("best_order"), F.col("l_linenumber").alias("best_line"), F.col("l_extendedprice").alias("best_price"), "copy_count")


@query("""
SELECT p_brand AS kind, count(*) AS n_reference, count(n) AS n_lifted, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_target, count(*) - count(n) AS n_missed, CAST(sum(coalesce(n, 0)) - count(n) AS BIGINT) AS n_extra, round(100.0 * count(n) / count(*), 5) AS pct_recovered
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey GROUP BY p_brand""", view=False)
def op_completeness_by_type(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"))
    found = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return ev.completeness(reference, found, "kind")


SCORES_SQL = "WITH s AS (SELECT p_partkey, v FROM part LEFT JOIN (SELECT l_partkey, max(l_discount * 10) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Each reference row with its best score, null where it is lost."""
    best = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_discount") * 10).alias("v"))
    return table(spark, d, "part").select("p_partkey").join(best, "p_partkey", "left")


@query(SCORES_SQL + " SELECT round(coalesce(sum(v), 0) / count(*), 5) AS cov, " + ", ".join(f"round(sum(CASE WHEN v >= {c} THEN 1 ELSE 0 END) * 1.0 / count(*), 5) AS recall_{int(c * 100)}" for c in (0.5, 0.75, 0.9, 0.95)) + " FROM s", view=False)
def op_recall_at(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_at(_scores(spark, d), "v", [0.5, 0.75, 0.9, 0.95])


@query(SCORES_SQL + " SELECT p_partkey, v, CASE WHEN v IS NULL THEN 'lost' ELSE 'found' END AS status FROM s", view=False)
def op_lost(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("status", F.when(F.col("v").isNull(), "lost").otherwise("found"))


@query(SCORES_SQL + " SELECT CAST(least(9, floor(v * 10)) AS BIGINT) AS bin, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY 1", view=False)
def op_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter("v IS NOT NULL").groupBy(F.least(F.lit(9), F.floor(F.col("v") * 10)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag", view=False)
def op_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    p = F.percentile("l_extendedprice", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"))


@query("SELECT l_returnflag AS flag, CAST(sum(CASE WHEN l_discount - l_tax > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS improved, CAST(sum(CASE WHEN l_discount - l_tax < -1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS regressed, CAST(sum(CASE WHEN abs(l_discount - l_tax) <= 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS tied FROM lineitem GROUP BY l_returnflag", view=False)
def op_paired_delta(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("before"), F.col("l_discount").alias("after"))
    return ev.paired_delta(pairs, "flag")


MULTI_SQL = ", a AS (SELECT seqid, start_pos, end_pos, count(*) AS na FROM ex WHERE flag <> 'N' GROUP BY ALL), b AS (SELECT seqid, start_pos, end_pos, count(*) AS nb FROM ex WHERE flag <> 'A' GROUP BY ALL), tp AS (SELECT seqid, start_pos, end_pos, least(na, nb) AS n FROM a JOIN b USING (seqid, start_pos, end_pos))"


@query(MULTI_SQL + " SELECT seqid, start_pos, end_pos, n FROM tp")
def op_interval_multiset(spark: SparkSession, d: str) -> DataFrame:
    ex = exons(spark, d)
    return ev.shared_multiset(ex.filter("flag <> 'N'"), ex.filter("flag <> 'A'"), ["seqid", "start_pos", "end_pos"])


@query(MULTI_SQL + """, t AS (SELECT CAST((SELECT sum(n) FROM tp) AS DOUBLE) AS tp, CAST((SELECT sum(na) FROM a) AS DOUBLE) AS p, CAST((SELECT sum(nb) FROM b) AS DOUBLE) AS r)
SELECT round(tp / p, 5) AS precision, round(tp / r, 5) AS recall, round(2 * (tp / p) * (tp / r) / (tp / p + tp / r), 5) AS f1 FROM t""")
def op_prf(spark: SparkSession, d: str) -> DataFrame:
    keys = ["seqid", "start_pos", "end_pos"]
    ex = exons(spark, d)
    sides = [s.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for s, n in ((ex.filter("flag <> 'N'"), "na"), (ex.filter("flag <> 'A'"), "nb"))]
    total = sides[0].join(sides[1], keys, "full").agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("tp"), F.sum("na").alias("p"), F.sum("nb").alias("r"))
    return total.select(*ev.precision_recall(F.col("tp"), F.col("p"), F.col("r")))


@query("SELECT id, lag(id) OVER (PARTITION BY seqid ORDER BY start_pos, end_pos, id) AS upstream FROM gene")
def op_upstream_neighbor(spark: SparkSession, d: str) -> DataFrame:
    genes = features(spark, d).filter("featuretype = 'gene'").select("seqid", "start_pos", "end_pos", "id")
    return iv.neighbor(genes, ["seqid"], ["start_pos", "end_pos", "id"], "id", STRETCH).select("id", F.col("before").alias("upstream"))


PAIRS_SQL = "WITH p AS (SELECT l_partkey AS source, l_suppkey AS target, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY ALL)"


@query(PAIRS_SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS a, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS b FROM p) SELECT source, target FROM x WHERE a = 1 AND b = 1", view=False)
def op_reciprocal_best(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return ev.reciprocal_best(pairs)


@query("SELECT id, gene, row_number() OVER (PARTITION BY gene ORDER BY start_pos, end_pos, id) - 1 AS copy_num FROM ex")
def op_copy_numbers(spark: SparkSession, d: str) -> DataFrame:
    out = ev.copy_numbers(exons(spark, d), "gene", ["start_pos", "end_pos", "id"])
    return out.select("id", "gene", F.col("copy_num").cast("long").alias("copy_num"))


@query("SELECT ex.id FROM ex JOIN mrna ON ex.parent = mrna.id WHERE ex.start_pos = mrna.start_pos AND ex.flag = 'R'")
def op_attribute_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Exons with an attribute value that begin their transcript."""
    first = _mrna(spark, d).select(F.col("id").alias("parent"), "start_pos")
    return exons(spark, d).filter("flag = 'R'").join(first, ["parent", "start_pos"], "left_semi").select("id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL", view=False)
def op_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extra, beyond the reference: tumbling windows over the events."""
    from .streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"))


@query("""
SELECT 'strand_differs' AS rule, c.id FROM f c JOIN f p ON c.parent = p.id WHERE c.strand <> p.strand
UNION ALL SELECT 'outside_parent', c.id FROM f c JOIN f p ON c.parent = p.id WHERE c.start_pos < p.start_pos OR c.end_pos > p.end_pos
UNION ALL SELECT 'sequence_differs', c.id FROM f c JOIN f p ON c.parent = p.id WHERE c.seqid <> p.seqid
UNION ALL SELECT 'duplicate_id', id FROM f GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'parent_missing', child FROM edges WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = edges.parent)
UNION ALL SELECT 'bad_coordinates', id FROM f WHERE start_pos < 1 OR end_pos < start_pos
UNION ALL SELECT 'beyond_sequence', id FROM f WHERE end_pos > 18000""")
def op_validate_structure(spark: SparkSession, d: str) -> DataFrame:
    """All structural findings, with sequences of 18,000 bases."""
    from .operators.validate import structure

    f = features(spark, d)
    return structure(f, f.select("seqid").distinct().withColumn("length", F.lit(18000)))


@query("SELECT l_partkey AS part, max(l_discount) AS identity, max_by(l_suppkey, (l_discount, l_suppkey)) AS candidate FROM lineitem GROUP BY l_partkey", view=False)
def op_best_outcome(spark: SparkSession, d: str) -> DataFrame:
    from .operators.fusion import best_outcome

    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_discount").alias("identity"), F.col("l_suppkey").alias("priority"), F.col("l_suppkey").alias("candidate"))
    return best_outcome(c, "part")


@query()
def op_chain_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest chains of each transcript's exons as alignment blocks (dynamic programming per group)."""
    from .operators.fusion import chain_blocks

    own = exons(spark, d)
    blocks = own.select(F.col("parent").alias("gene"), "seqid", (F.col("start_pos") - 1).alias("query_start"), (F.col("end_pos") - 1).alias("query_end"), (F.col("start_pos") + 99).alias("target_start"), (F.col("end_pos") + 99).alias("target_end"), (F.col("start_pos") % 3).alias("mismatches"))
    return chain_blocks(blocks)


@query("SELECT id FROM ex WHERE strand = '+' AND NOT EXISTS (SELECT 1 FROM gene g WHERE g.strand = '-' AND g.seqid = ex.seqid AND g.start_pos <= ex.end_pos AND g.end_pos >= ex.start_pos AND (least(g.end_pos, ex.end_pos) - greatest(g.start_pos, ex.start_pos) + 1) * 1.0 / least(g.end_pos - g.start_pos + 1, ex.end_pos - ex.start_pos + 1) > 0.1)")
def op_copy_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """Exons of the plus strand that no gene of the minus strand covers by over a tenth."""
    from .operators.fusion import copy_suppressed

    f = features(spark, d)
    models = f.filter("featuretype = 'exon' AND strand = '+'").select("id", "seqid", "start_pos", "end_pos")
    return copy_suppressed(models, f.filter("featuretype = 'gene' AND strand = '-'")).select("id")


@query("SELECT DISTINCT id FROM f WHERE featuretype = 'gene' AND NOT EXISTS (SELECT 1 FROM edges WHERE child = f.id)")
def op_tops(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    return graph.tops(f, graph.edges(f)).select("id").distinct()


@query("SELECT f.id, f.featuretype, coalesce(max(c.depth), 0) AS levels FROM f LEFT JOIN closure c ON c.ancestor = f.id GROUP BY f.id, f.featuretype")
def op_hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    """How many levels each feature has below it."""
    f = features(spark, d)
    deep = _closure(spark, d).groupBy(F.col("ancestor").alias("id")).agg(F.max("depth").alias("levels"))
    return f.join(deep, "id", "left").select("id", "featuretype", F.coalesce("levels", F.lit(0).cast("long")).alias("levels"))


@query("SELECT m.id AS transcript, count(*) AS n_parts, CAST(max(e.end_pos) - min(e.start_pos) + 1 AS BIGINT) AS span, CAST(sum(e.end_pos - e.start_pos + 1) AS BIGINT) AS bases FROM mrna m JOIN ex e ON e.parent = m.id GROUP BY m.id")
def op_reference_length(spark: SparkSession, d: str) -> DataFrame:
    """Number of parts, span and bases of each transcript."""
    ex = features(spark, d).filter("featuretype = 'exon'")
    return ex.groupBy(F.col("parent").alias("transcript")).agg(F.count(F.lit(1)).alias("n_parts"), (F.max("end_pos") - F.min("start_pos") + 1).alias("span"), F.sum(iv.length()).alias("bases"))


@query("SELECT a.id FROM f a WHERE a.strand = '+' EXCEPT ALL SELECT b.id FROM f b WHERE b.featuretype = 'gene'")
def op_difference(spark: SparkSession, d: str) -> DataFrame:
    """Bag difference of two id lists."""
    f = features(spark, d)
    return f.filter("strand = '+'").select("id").exceptAll(f.filter("featuretype = 'gene'").select("id"))
