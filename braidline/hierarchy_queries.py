"""More queries over the annotation view: attributes, sinks, coding parts, lifted
features, rescue and validation, each with the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequence as sq
from .operators import coding, lifting, rescue, validate
from .plans import graph
from .queries import PROTEIN_SQL, SCORES_SQL, _closure, _mrna, _scores, _sequences, query
from .sources import attributes as at
from .sources import gff, writer
from .sources.model import exons, features, table
from .store import FeatureStore

BLOB = """concat('ID=', id, ';Parent=', parent, ';Note="a;b",c%2Cd; Dbxref=flag:', flag, ',seq:', seqid, ';Dbxref=more')"""
GTF = """concat('gene_id "', gene, '"; transcript_id "', parent, '"; tag "basic"; tag "', flag, '";')"""
UP = "CASE WHEN strand = '-' THEN -start_pos ELSE start_pos END, CASE WHEN strand = '-' THEN -end_pos ELSE end_pos END, id"


def _gtf_lines(spark: SparkSession, d: str) -> DataFrame:
    """The view's exons as the lines of a GTF file."""
    ex = exons(spark, d)
    value = F.concat_ws("\t", "seqid", F.lit("view"), F.lit("exon"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), F.expr(GTF))
    return ex.select(value.alias("value"), F.monotonically_increasing_id().alias("file_order"))


def _gtf_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = gff.parse_rows(_gtf_lines(spark, d)).filter("error_kind IS NULL")
    return rows.withColumn("attrs", at.mapped(F.col("attributes")))


@query("""SELECT id, 'ID' AS name, id AS value, 0 AS idx FROM ex UNION ALL SELECT id, 'Parent', parent, 0 FROM ex UNION ALL SELECT id, 'Note', '"a;b"', 0 FROM ex UNION ALL SELECT id, 'Note', 'c,d', 1 FROM ex
UNION ALL SELECT id, 'Dbxref', 'flag:' || flag, 0 FROM ex UNION ALL SELECT id, 'Dbxref', 'seq:' || seqid, 1 FROM ex UNION ALL SELECT id, 'Dbxref', 'more', 2 FROM ex""")
def op_attribute_table(spark: SparkSession, d: str) -> DataFrame:
    """Quoted semicolons, encoded commas and repeated names."""
    return at.attribute_table(exons(spark, d).select("id", F.expr(BLOB).alias("attributes")), "id")


@query("""SELECT id, 'gene_id' AS name, gene AS value, 0 AS idx FROM ex UNION ALL SELECT id, 'transcript_id', parent, 0 FROM ex UNION ALL SELECT id, 'tag', 'basic', 0 FROM ex UNION ALL SELECT id, 'tag', flag, 1 FROM ex""")
def op_gtf_attributes(spark: SparkSession, d: str) -> DataFrame:
    return at.attribute_table(exons(spark, d).select("id", F.expr(GTF).alias("attributes")), "id")


@query("SELECT 'gtf' AS fmt, false AS leading, true AS trailing, true AS quoted, true AS repeated, false AS semicolon, 'gene_id,transcript_id,tag' AS names, '; ' AS field_separator", view=False)
def op_dialect(spark: SparkSession, d: str) -> DataFrame:
    own = at.dialect(gff.parse_rows(_gtf_lines(spark, d)))
    return own.withColumn("names", F.array_join("order", ",")).drop("order")


@query("SELECT id, parent, seqid, 'transcript' AS featuretype, start_pos, end_pos, strand FROM mrna UNION ALL SELECT * FROM gene")
def op_gtf_models(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts and genes that a GTF file of exons implies."""
    return at.gtf_models(_gtf_rows(spark, d)).filter("featuretype <> 'exon'")


@query("SELECT parent, id AS child FROM mrna UNION ALL SELECT parent, 'exon' FROM ex")
def op_gtf_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that GTF ids imply; exons, which have no id there, all as ``exon``."""
    pairs = at.linked(at.gtf_models(_gtf_rows(spark, d)))
    return pairs.select("parent", F.when(F.col("child").startswith("exon_"), "exon").otherwise(F.col("child")).alias("child"))


@query("SELECT parent AS anchor, count(*) AS n FROM ex GROUP BY parent")
def op_create_store(spark: SparkSession, d: str) -> DataFrame:
    """A store made of GTF lines, asked for the parts of each transcript."""
    store = at.create_store(spark, _gtf_lines(spark, d))
    anchors = store.features.filter("featuretype = 'transcript'").select(F.col("id").alias("anchor"))
    return store.children(anchors, level=1, featuretype="exon").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM ex WHERE flag = 'R'")
def op_attribute_predicate(spark: SparkSession, d: str) -> DataFrame:
    own = exons(spark, d).select("id", F.expr(BLOB).alias("attributes"))
    return at.with_value(own, at.attribute_table(own, "id"), "Dbxref", "flag:R").select("id")


@query("SELECT id, seqid || chr(9) || 'braidline' || chr(9) || 'exon' || chr(9) || start_pos || chr(9) || end_pos || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'ID=' || id || ';Parent=' || parent || ';Dbxref=flag:' || flag || ',seq:' || seqid || ',more;Note=\"a%3Bb\",c%2Cd' AS line FROM ex")
def op_gff_line_full(spark: SparkSession, d: str) -> DataFrame:
    """A parsed ninth column written again: ID, Parent, then by name; reserved characters encoded."""
    own = exons(spark, d).withColumn("attrs", at.mapped(F.expr(BLOB)))
    return own.select("id", writer.full_line(own).alias("line"))


TOPS_SQL = ", tops AS (SELECT id, id AS gene, CAST(NULL AS VARCHAR) AS tx FROM gene UNION ALL SELECT id, parent, id FROM mrna UNION ALL SELECT id, gene, parent FROM ex)"


@query(TOPS_SQL + """, o AS (SELECT f.id, t.gene, t.tx, m.start_pos AS ts, CASE f.featuretype WHEN 'gene' THEN 0 WHEN 'mRNA' THEN 1 ELSE 2 END AS k, f.start_pos, f.end_pos FROM f JOIN tops t ON f.id = t.id LEFT JOIN mrna m ON m.id = t.tx)
SELECT id, gene, row_number() OVER (PARTITION BY gene ORDER BY ts NULLS FIRST, tx NULLS FIRST, k, start_pos, end_pos, id) AS ord FROM o""")
def op_hierarchy_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every feature in its gene's block of lines."""
    f, ex = features(spark, d), exons(spark, d)
    none = F.lit(None).cast("string")
    own = ["id", "seqid", "featuretype", "start_pos", "end_pos"]
    blocks = f.filter("featuretype = 'gene'").select(*own, F.col("id").alias("gene"), none.alias("transcript"))
    blocks = blocks.unionByName(_mrna(spark, d).select(*own, F.col("parent").alias("gene"), F.col("id").alias("transcript"))).unionByName(ex.select(*own, "gene", F.col("parent").alias("transcript")))
    ordered = writer.block_order(blocks.filter("id IS NOT NULL AND gene IS NOT NULL"))
    place = F.row_number().over(Window.partitionBy("gene").orderBy(*writer.hierarchy_sort(ordered)))
    return ordered.select("id", "gene", place.cast("long").alias("ord"))


@query("SELECT CASE WHEN c > 0 THEN id || '_copy' || c ELSE id END AS id, CASE WHEN c > 0 THEN parent || '_copy' || c ELSE parent END AS parent FROM (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY start_pos, end_pos, id) - 1 AS c FROM ex)")
def op_copy_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("parent").orderBy("start_pos", "end_pos", "id")) - 1
    return writer.copy_ids(exons(spark, d).select("id", "parent", n.alias("copy_num"))).select("id", "parent")


@query("SELECT doc_id, md5('>doc' || doc_id || chr(10) || regexp_replace(s, '(.{60})', '\\1' || chr(10), 'g')) AS record FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') || 'x' AS s FROM documents) WHERE length(s) % 60 <> 0", view=False)
def op_fasta_records(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"), F.concat(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit("x")).alias("seq")).filter("length(seq) % 60 <> 0")
    return own.select("doc_id", F.md5(writer.fasta_record("name", "seq", 60)).alias("record"))


@query("SELECT id FROM f WHERE featuretype IN ('mRNA', 'exon') AND NOT EXISTS (SELECT 1 FROM f p WHERE p.id = f.parent AND p.featuretype IN ('mRNA', 'exon'))")
def op_skip_nested(spark: SparkSession, d: str) -> DataFrame:
    """Features of the listed kinds, but not those below another of them."""
    listed = features(spark, d).filter(F.col("featuretype").isin("mRNA", "exon"))
    return listed.join(listed.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 'identity_below_minimum' WHEN l_quantity / 50 < 0.2 THEN 'query_coverage_below_minimum' WHEN l_tax * 10 < 0.2 THEN 'target_coverage_below_minimum'
WHEN l_extendedprice > 50000 THEN 'evalue_above_maximum' END AS reason FROM lineitem""", view=False)
def op_hit_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("identity"), (F.col("l_quantity") / 50).alias("query_coverage"), (F.col("l_tax") * 10).alias("target_coverage"), F.col("l_extendedprice").alias("evalue"))
    return hits.select("l_orderkey", "l_linenumber", rescue.hit_reason(0.02, 0.2, 50000).alias("reason"))


@query("SELECT id, featuretype FROM f WHERE id > (SELECT min(id) FROM mrna) ORDER BY id LIMIT 100")
def op_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The hundred features after the first transcript."""
    store = FeatureStore(features(spark, d))
    return store.page(100, _mrna(spark, d).agg(F.min("id")).first()[0]).select("id", "featuretype")


@query("SELECT a.id AS gene, b.id FROM gene a JOIN mrna b ON a.seqid = b.seqid AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND a.strand = '+' AND a.end_pos - a.start_pos < 3000")
def op_half_open_probe(spark: SparkSession, d: str) -> DataFrame:
    genes = features(spark, d).filter("featuretype = 'gene' AND strand = '+' AND end_pos - start_pos < 3000")
    q = genes.select(F.col("id").alias("gene"), F.col("seqid").alias("q_seqid"), F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    return lifting.half_open_probe(q, _mrna(spark, d).select("id", "seqid", "start_pos", "end_pos")).select("gene", "id")


@query("SELECT ex.id, ex.parent AS transcript, m.parent AS gene FROM ex LEFT JOIN mrna m ON m.id = ex.parent AND m.strand = '+'")
def op_target_mapping(spark: SparkSession, d: str) -> DataFrame:
    models = exons(spark, d).select("id", F.concat("parent", F.lit(" 1 "), F.col("end_pos").cast("string")).alias("target"))
    genes = _mrna(spark, d).filter("strand = '+'").select(F.col("id").alias("transcript"), F.col("parent").alias("gene"))
    return rescue.target_ids(models, genes)


@query("""SELECT a.id AS prediction, b.id AS truth FROM ex a JOIN ex b ON a.gene = b.gene AND a.seqid = b.seqid AND a.flag <> 'N' AND b.flag <> 'A' AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
WHERE (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1) * 1.0 / greatest(a.end_pos - a.start_pos + 1, b.end_pos - b.start_pos + 1) >= 0.5""")
def op_reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    ex = exons(spark, d)
    return lifting.reciprocal_pairs(ex.filter("flag <> 'N'"), ex.filter("flag <> 'A'"), "gene").drop("share")


@query("SELECT id, CASE WHEN parent IS NULL THEN 'parent' WHEN EXISTS (SELECT 1 FROM edges WHERE edges.parent = f.id) THEN 'intermediate' ELSE 'child' END AS role FROM f")
def op_parent_partition(spark: SparkSession, d: str) -> DataFrame:
    return graph.roles(features(spark, d))


@query("""SELECT class, count(*) AS n_reference, count(n) AS n_lifted, count(CASE WHEN n = 1 THEN 1 END) AS n_single, count(CASE WHEN n > 1 THEN 1 END) AS n_extra, CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS n_extra_sum
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'coding' WHEN p_size % 3 = 1 THEN 'non-coding' ELSE 'other' END AS class FROM part) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey GROUP BY class""", view=False)
def op_summary_tallies(spark: SparkSession, d: str) -> DataFrame:
    from .operators.evaluate import tallies

    kind = F.when(F.col("p_size") % 3 == 0, "coding").when(F.col("p_size") % 3 == 1, "non-coding").otherwise("other")
    reference = table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("class"))
    return tallies(reference, table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")), "class")


@query(SCORES_SQL + " SELECT count(v) AS n, round(avg(v), 5) AS mean, round(median(v), 5) AS median, round(100.0 * sum(CASE WHEN v >= 0.999999 THEN 1 ELSE 0 END) / count(v), 5) AS pct_identical FROM s", view=False)
def op_mean_median(spark: SparkSession, d: str) -> DataFrame:
    from .operators.evaluate import summary

    return summary(_scores(spark, d), "v")


@query("SELECT seqid, n, n = max(n) OVER () AND seqid = min(CASE WHEN n = top THEN seqid END) OVER () AS chosen FROM (SELECT seqid, count(*) AS n, max(count(*)) OVER () AS top FROM mrna GROUP BY seqid)")
def op_mrna_per_seqid(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of each sequence, and the sequence with most of them (ties: the least)."""
    n = _mrna(spark, d).groupBy("seqid").agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.min(F.struct(-F.col("n"), F.col("seqid"))).alias("b")).select("b.seqid")
    return n.withColumn("chosen", F.col("seqid") == best.scalar())


@query("SELECT featuretype, count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM f GROUP BY featuretype")
def op_feature_index(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("featuretype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT gene, max_by(end_pos, (start_pos, end_pos)) - min(start_pos) + 1 AS ref_length, count(*) AS n_cds FROM ex GROUP BY gene")
def op_reference_cds_length(spark: SparkSession, d: str) -> DataFrame:
    """Last end less first start in order of start, and the number of coding parts."""
    last = F.max_by("end_pos", F.struct("start_pos", "end_pos"))
    return exons(spark, d).groupBy("gene").agg((last - F.min("start_pos") + 1).alias("ref_length"), F.count(F.lit(1)).alias("n_cds"))


@query("SELECT round(recall, 6) AS recall, round(CASE WHEN recall <= 0.1 THEN 0.3 WHEN recall >= 0.5 THEN 0.6 ELSE 0.3 + 0.3 * (recall - 0.1) / 0.4 END, 6) AS floor FROM (SELECT count(l_partkey) * 1.0 / count(*) AS recall FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 2) ON p_partkey = l_partkey)", view=False)
def op_adaptive_floor(spark: SparkSession, d: str) -> DataFrame:
    emitted = table(spark, d, "lineitem").filter("l_quantity < 2").select(F.col("l_partkey").alias("id"))
    out = rescue.adaptive_floor(emitted, table(spark, d, "part").select(F.col("p_partkey").alias("id")), 0.6)
    return out.select(F.round("recall", 6).alias("recall"), F.round("floor", 6).alias("floor"))


@query("SELECT event_type, round(median(user_id), 4) AS median_user, count(*) AS n FROM events GROUP BY event_type", view=False)
def op_protocol_medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("user_id"), 4).alias("median_user"), F.count(F.lit(1)).alias("n"))


@query("SELECT statement, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(text, '''[^'']*''', '?', 'g'), '[0-9]+', '?', 'g'), '[ \t\n\r]+', ' ', 'g')) AS statement FROM conversations) GROUP BY statement", view=False)
def op_statement_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are equal but for their literals."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "'[^']*'", "?"), "[0-9]+", "?"), "[ \t\n\r]+", " ")
    return table(spark, d, "conversations").groupBy(F.trim(text).alias("statement")).agg(F.count(F.lit(1)).alias("n"))


THROUGH_SQL = f"sum(end_pos - start_pos + 1) OVER (PARTITION BY parent ORDER BY {UP} ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT id, round((t - (end_pos - start_pos + 1)) / 3.0, 6) AS aa_start, round(t / 3.0, 6) AS aa_end FROM (SELECT *, {THROUGH_SQL} AS t FROM ex)")
def op_protein_boundaries(spark: SparkSession, d: str) -> DataFrame:
    out = coding.protein_boundaries(exons(spark, d), "parent")
    return out.select("id", F.round("aa_start", 6).alias("aa_start"), F.round("aa_end", 6).alias("aa_end"))


JUNCTIONS_SQL = f", thr AS (SELECT *, {THROUGH_SQL} AS t FROM ex), jn AS (SELECT parent, list(t ORDER BY t)[:-2] AS j FROM thr GROUP BY parent)"


@query(JUNCTIONS_SQL + " SELECT parent, array_to_string(j, ',') AS junctions FROM jn")
def op_junctions(spark: SparkSession, d: str) -> DataFrame:
    return coding.junctions(exons(spark, d), "parent").select("parent", F.array_join(F.transform("junctions", lambda x: x.cast("string")), ",").alias("junctions"))


@query(JUNCTIONS_SQL + """, jr AS (SELECT parent, list(t ORDER BY t)[:-2] AS j FROM (SELECT *, """ + THROUGH_SQL + """ AS t FROM ex WHERE flag <> 'R') GROUP BY parent)
SELECT a.parent, round(CASE WHEN len(a.j) = 0 THEN 1.0 ELSE len(list_intersect(a.j, b.j)) / len(a.j) END, 6) AS sensitivity, round(CASE WHEN len(b.j) = 0 THEN 1.0 ELSE len(list_intersect(a.j, b.j)) / len(b.j) END, 6) AS precision, a.j = b.j AS exact FROM jn a JOIN jr b ON a.parent = b.parent""")
def op_junction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Junctions of each transcript against those without the parts of one flag."""
    ex = exons(spark, d)
    both = coding.junctions(ex, "parent").withColumnRenamed("junctions", "a").join(coding.junctions(ex.filter("flag <> 'R'"), "parent").withColumnRenamed("junctions", "b"), "parent")
    s, p, e = coding.junction_scores(F.col("a"), F.col("b"))
    return both.select("parent", F.round(s, 6).alias("sensitivity"), F.round(p, 6).alias("precision"), e)


@query(f"""SELECT CASE WHEN max(n > 1) OVER (PARTITION BY parent) THEN parent || '-exon-' || row_number() OVER (PARTITION BY parent ORDER BY {UP.replace('id', 'own')}) ELSE own END AS id, own FROM
(SELECT id AS own, parent, strand, start_pos, end_pos, count(*) OVER (PARTITION BY base) AS n FROM ex)""")
def op_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Exons of transcripts in which the ids without their copy marks collide."""
    ex = exons(spark, d)
    clash = F.count(F.lit(1)).over(Window.partitionBy("base")) > 1
    own = ex.withColumn("own", F.col("id")).withColumn("id", F.when(clash, F.col("base")).otherwise(F.col("id")))
    return coding.renumbered(own, "parent", order="own").select("id", "own")


@query("SELECT a.id, (SELECT b.id FROM gene b WHERE b.seqid = a.seqid AND b.end_pos < a.start_pos ORDER BY b.start_pos DESC, b.end_pos DESC, b.id DESC LIMIT 1) AS upstream FROM gene a")
def op_upstream_apart(spark: SparkSession, d: str) -> DataFrame:
    return lifting.upstream_apart(features(spark, d).filter("featuretype = 'gene'"))


COVER_SQL = ", cds AS (SELECT parent, start_pos - 5 AS c0, start_pos + 20 AS c1 FROM ex WHERE flag = 'R')"


@query(COVER_SQL + " SELECT ex.id, least(ex.start_pos, min(c0)) AS start_pos, greatest(ex.end_pos, max(c1)) AS end_pos FROM ex LEFT JOIN cds ON cds.parent = ex.parent AND c0 <= end_pos AND c1 >= start_pos GROUP BY ex.id, ex.start_pos, ex.end_pos")
def op_exons_cover(spark: SparkSession, d: str) -> DataFrame:
    ex = exons(spark, d)
    cds = ex.filter("flag = 'R'").select("parent", (F.col("start_pos") - 5).alias("start_pos"), (F.col("start_pos") + 20).alias("end_pos"))
    return coding.exons_cover(ex, cds).select("id", "start_pos", "end_pos")


@query("SELECT m.id, coalesce(min(e.start_pos), m.start_pos) AS start_pos, coalesce(max(e.end_pos), m.end_pos) AS end_pos FROM mrna m LEFT JOIN ex e ON e.parent = m.id AND e.flag = 'R' GROUP BY m.id, m.start_pos, m.end_pos")
def op_fit_parents(spark: SparkSession, d: str) -> DataFrame:
    return coding.fit_parents(_mrna(spark, d), exons(spark, d).filter("flag = 'R'")).select("id", "start_pos", "end_pos")


@query("SELECT a.id AS a, b.id AS b, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1 AS shared FROM ex a JOIN ex b ON a.parent = b.parent AND a.id < b.id")
def op_signed_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Bases shared by the exons of a transcript, less than one for those apart."""
    a, b = (exons(spark, d).select("parent", F.col("id").alias(n), F.col("start_pos").alias(f"{n}0"), F.col("end_pos").alias(f"{n}1")) for n in "ab")
    return a.join(b, "parent").filter("a < b").select("a", "b", lifting.signed_overlap("a0", "a1", "b0", "b1").alias("shared"))


ALN_SQL = """WITH al AS (SELECT DISTINCT l_orderkey AS gene, l_linenumber AS aln_id, l_suppkey % 3 AS target, l_partkey * 10 AS target_start, l_suppkey AS query_start, l_orderkey % 3 AS previous_target, l_orderkey AS start, l_orderkey - 50 AS previous_ref_start, l_partkey * 5 AS previous_start FROM lineitem),
b AS (SELECT gene, aln_id, min((target <> previous_target, abs((start - previous_ref_start) - (target_start - query_start - previous_start)))) AS best FROM al GROUP BY ALL)"""


@query(ALN_SQL + " SELECT gene, aln_id, row_number() OVER (PARTITION BY gene ORDER BY best, aln_id) - 1 AS aln_order FROM b", view=False)
def op_alignment_order(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").selectExpr("l_orderkey AS gene", "l_linenumber AS aln_id", "l_suppkey % 3 AS target", "l_partkey * 10 AS target_start", "l_suppkey AS query_start", "l_orderkey % 3 AS previous_target", "l_orderkey AS start", "l_orderkey - 50 AS previous_ref_start", "l_partkey * 5 AS previous_start")
    return lifting.alignment_order(own, "gene").select("gene", "aln_id", F.col("aln_order").cast("long").alias("aln_order")).distinct()


@query("SELECT gene, string_agg(id, ',' ORDER BY end_pos, start_pos, id) AS ids FROM ex GROUP BY gene")
def op_order_by_end(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each gene as a list kept in order of end."""
    own = exons(spark, d).groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("end_pos", "start_pos", "id"))).alias("p"))
    return own.select("gene", F.array_join(F.transform("p", lambda x: x["id"]), ",").alias("ids"))


@query("SELECT ex.id, CASE WHEN ex.strand = '-' THEN m.end_pos - ex.start_pos ELSE ex.start_pos - m.start_pos END AS place FROM ex JOIN mrna m ON m.id = ex.parent")
def op_relative_coordinate(spark: SparkSession, d: str) -> DataFrame:
    m = _mrna(spark, d).select(F.col("id").alias("parent"), F.col("start_pos").alias("m0"), F.col("end_pos").alias("m1"))
    return exons(spark, d).join(m, "parent").select("id", coding.relative_coordinate(F.col("start_pos"), F.col("m0"), F.col("m1"), F.col("strand") == "-").alias("place"))


@query(", r AS (SELECT * FROM ex WHERE flag = 'R'), t AS (SELECT r.parent AS id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, min(gene) AS gene FROM r GROUP BY r.parent) SELECT id, 'mRNA' AS featuretype, start_pos, end_pos FROM t UNION ALL SELECT gene, 'gene', min(start_pos), max(end_pos) FROM t GROUP BY gene")
def op_rebuild_parents(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts and genes from those exons that were lifted."""
    f = features(spark, d)
    return lifting.rebuild_parents(exons(spark, d).filter("flag = 'R'"), f.filter("featuretype <> 'exon'")).select("id", "featuretype", "start_pos", "end_pos")


LIFTED_SQL = """, li AS (SELECT id, seqid, strand, start_pos, start_pos + (end_pos - start_pos) % 700 AS end_pos, start_pos % 5 = 0 AS is_copy, 'r' || (end_pos % 9) AS ref_seqid, start_pos AS ref_start, end_pos AS ref_end, end_pos % 100 / 100.0 AS identity, start_pos % 17 AS displacement FROM gene),
cf AS (SELECT a.id AS a, b.id AS b FROM li a JOIN li b ON a.seqid = b.seqid AND a.strand = b.strand AND a.id < b.id AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos
WHERE (a.ref_seqid <> b.ref_seqid OR least(a.ref_end, b.ref_end) - greatest(a.ref_start, b.ref_start) + 1 <= 0) AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1) * 1.0 / least(a.end_pos - a.start_pos + 1, b.end_pos - b.start_pos + 1) > CASE WHEN a.is_copy OR b.is_copy THEN 0 ELSE 0.1 END)"""


def _lifted(spark: SparkSession, d: str) -> DataFrame:
    g = features(spark, d).filter("featuretype = 'gene'")
    return g.selectExpr("id", "seqid", "strand", "start_pos", "start_pos + (end_pos - start_pos) % 700 AS end_pos", "start_pos % 5 = 0 AS is_copy", "concat('r', end_pos % 9) AS ref_seqid", "start_pos AS ref_start", "end_pos AS ref_end", "end_pos % 100 / 100.0D AS identity", "start_pos % 17 AS displacement")


@query(LIFTED_SQL + " SELECT a, b FROM cf")
def op_lift_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return lifting.conflicts(_lifted(spark, d))


@query(LIFTED_SQL + """ SELECT a, b, CASE WHEN (NOT x.is_copy, x.identity, -x.displacement, x.end_pos - x.start_pos) < (NOT y.is_copy, y.identity, -y.displacement, y.end_pos - y.start_pos) THEN a ELSE b END AS loser FROM cf JOIN li x ON x.id = a JOIN li y ON y.id = b""")
def op_conflict_losers(spark: SparkSession, d: str) -> DataFrame:
    own = _lifted(spark, d)
    return lifting.conflict_losers(lifting.conflicts(own), own)


@query()
def op_settled_lift(spark: SparkSession, d: str) -> DataFrame:
    """What is left when the losers of conflicts go, round by round (an iteration: no SQL)."""
    own = _lifted(spark, d)
    return lifting.settle(own, lambda gone: gone.limit(0)).select("id")


@query(LIFTED_SQL + " SELECT id, 1 - identity AS score, identity >= 0.5 AND displacement / 17.0 >= 0.2 AS mapped FROM li")
def op_lift_outcome(spark: SparkSession, d: str) -> DataFrame:
    own = _lifted(spark, d).withColumn("coverage", F.col("displacement") / 17).withColumnRenamed("identity", "sequence_id")
    return lifting.lift_outcome(own, coverage=0.2).select("id", "score", "mapped")


PLACED_SQL = ", cs AS (SELECT 'chr' || doc_id AS seqid, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents WHERE doc_id < 25), pl AS (SELECT id, parent, seqid, strand, start_pos % 400 + 1 AS start_pos, start_pos % 400 + 1 + end_pos - start_pos AS end_pos FROM ex)"


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The exons near the beginning of 25 sequences, and those."""
    docs = table(spark, d, "documents").filter("doc_id < 25")
    seq = F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    parts = exons(spark, d).selectExpr("id", "parent", "seqid", "strand", "start_pos % 400 + 1 AS start_pos", "start_pos % 400 + 1 + end_pos - start_pos AS end_pos")
    return parts, docs.select(F.concat(F.lit("chr"), "doc_id").alias("seqid"), seq.alias("seq"))


TURN = "CASE WHEN strand = '-' THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END"


@query(PLACED_SQL + f" SELECT id, {TURN} AS seq FROM (SELECT id, strand, substr(seq, start_pos, end_pos - start_pos + 1) AS s FROM pl JOIN cs ON pl.seqid = cs.seqid)")
def op_feature_sequence(spark: SparkSession, d: str) -> DataFrame:
    parts, seqs = _placed(spark, d)
    return parts.join(seqs, "seqid").select("id", coding.feature_sequence(F.col("seq"), F.col("start_pos"), F.col("end_pos"), F.col("strand")).alias("seq"))


@query(PLACED_SQL + f""", pr AS (SELECT *, max(end_pos) OVER (PARTITION BY parent ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pl),
fl AS (SELECT *, CASE WHEN start_pos <= reach THEN 0 ELSE 1 END AS nw FROM pr), isl AS (SELECT *, sum(nw) OVER (PARTITION BY parent ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS k FROM fl),
m AS (SELECT parent, min(seqid) AS seqid, min(strand) AS strand, min(start_pos) AS a, max(end_pos) AS b FROM isl GROUP BY parent, k),
j AS (SELECT m.parent, min(strand) AS strand, string_agg(substr(seq, a, b - a + 1), '' ORDER BY a) AS s FROM m JOIN cs ON m.seqid = cs.seqid GROUP BY m.parent)
SELECT parent, md5(q || repeat('N', CAST((3 - length(q) % 3) % 3 AS BIGINT))) AS seq FROM (SELECT parent, {TURN} AS q FROM j)""")
def op_spliced_sequence(spark: SparkSession, d: str) -> DataFrame:
    return coding.spliced(*_placed(spark, d)).select("parent", F.md5("seq").alias("seq"))


@query("SELECT id, seqid, start_pos, end_pos FROM f")
def op_location_parse(spark: SparkSession, d: str) -> DataFrame:
    own = features(spark, d).select("id", F.concat("seqid", F.lit(":"), F.col("start_pos").cast("string"), F.lit("-"), F.col("end_pos").cast("string")).alias("place"))
    return own.select("id", sq.location(F.col("place")).alias("p")).select("id", "p.*")


@query(" SELECT id || '_' || n AS id, CASE WHEN strand = '+' THEN id ELSE id || '_' || n END AS base FROM (SELECT id, strand, start_pos % 4 AS n FROM mrna)")
def op_base_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids without their copy suffix, where what is left is known."""
    own = _mrna(spark, d)
    ids = own.select(F.concat("id", F.lit("_"), (F.col("start_pos") % 4).cast("string")).alias("id"))
    return rescue.base_id(F.col("id"), own.filter("strand = '+'").select("id"), ids)


HEX_SQL = " || ".join(f"sha256(encode('s' || c_custkey) || unhex('00{k:016x}'))" for k in range(2))


@query(f"SELECT c_custkey, substr(array_to_string(list_transform(string_split({HEX_SQL}, ''), lambda h: substr('AAACAGATCACCCGCTGAGCGGGTTATCTGTT', 2 * CAST('0x' || h AS INT) + 1, 2)), ''), 1, 200) AS seq FROM customer", view=False)
def op_made_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sq.made_sequence(F.concat(F.lit("s"), F.col("c_custkey").cast("string")), 200).alias("seq"))


MODELS_SQL = ", md AS (SELECT ex.id, ex.gene, ex.seqid, ex.start_pos, ex.end_pos, ex.start_pos % 100 / 100.0 AS identity, 1 + ex.start_pos % 2 AS n_cds, CAST(ex.start_pos % 150 AS BIGINT) AS ref_length, CAST(ex.end_pos % 3 AS BIGINT) AS ref_n_cds FROM ex)"


def _models(spark: SparkSession, d: str) -> DataFrame:
    return exons(spark, d).selectExpr("id", "gene", "seqid", "start_pos", "end_pos", "start_pos % 100 / 100.0D AS identity", "1 + start_pos % 2 AS n_cds", "start_pos % 150 AS ref_length", "end_pos % 3 AS ref_n_cds")


BAND_SQL = "ref_length > 0 AND (end_pos - start_pos + 1) * 1.0 / ref_length > {} AND (end_pos - start_pos + 1) * 1.0 / ref_length < {} AND NOT (n_cds = 1 AND ref_n_cds > 1)"


@query(MODELS_SQL + " SELECT id FROM md WHERE " + BAND_SQL.format(0.9, 1.5))
def op_protein_only(spark: SparkSession, d: str) -> DataFrame:
    return rescue.protein_only(_models(spark, d)).select("id")


@query(MODELS_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY seqid, start_pos, end_pos, id) AS r FROM md WHERE identity >= 0.4 AND " + BAND_SQL.format(0.5, 2.0) + ") SELECT gene, seqid, start_pos, end_pos, id FROM o WHERE r = 1")
def op_rescue_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rescue.rescue_candidates(_models(spark, d), F.lit(0.4))


@query(MODELS_SQL + """, em AS (SELECT gene, seqid, start_pos, start_pos + 40 AS end_pos, (end_pos % 70) / 100.0 AS identity FROM ex WHERE flag = 'R'), bs AS (SELECT gene, max(identity) AS best FROM em GROUP BY gene),
o AS (SELECT md.gene, md.id, md.identity, row_number() OVER (PARTITION BY md.gene ORDER BY md.identity DESC, md.seqid, md.start_pos, md.end_pos, md.id) AS r FROM md JOIN bs ON bs.gene = md.gene WHERE best < 0.5 AND md.identity > best + 0.3 AND NOT (n_cds = 1 AND ref_n_cds > 1)
AND NOT EXISTS (SELECT 1 FROM em WHERE em.gene = md.gene AND em.seqid = md.seqid AND em.start_pos <= md.end_pos AND em.end_pos >= md.start_pos)) SELECT gene, id, identity FROM o WHERE r = 1""")
def op_cross_locus(spark: SparkSession, d: str) -> DataFrame:
    emitted = exons(spark, d).filter("flag = 'R'").selectExpr("gene", "seqid", "start_pos", "start_pos + 40 AS end_pos", "(end_pos % 70) / 100.0D AS identity")
    return rescue.replacements(_models(spark, d), emitted)


@query(""", mo AS (SELECT id, parent AS reference, seqid, start_pos, end_pos, start_pos % 100 / 100.0 AS identity FROM ex WHERE flag <> 'A'), gn AS (SELECT id, seqid, start_pos, end_pos FROM gene),
mg AS (SELECT mo.id AS m, gn.id AS g FROM mo JOIN gn ON mo.seqid = gn.seqid AND mo.start_pos <= gn.end_pos AND gn.start_pos <= mo.end_pos), tg AS (SELECT mrna.id AS t, gn.id AS g FROM mrna JOIN gn ON mrna.seqid = gn.seqid AND mrna.start_pos <= gn.end_pos AND gn.start_pos <= mrna.end_pos),
bad AS (SELECT DISTINCT mo.id FROM mo JOIN mg ON mg.m = mo.id LEFT JOIN tg ON tg.t = mo.reference AND tg.g = mg.g WHERE tg.g IS NULL),
o AS (SELECT mrna.id AS transcript, mo.id AS model, row_number() OVER (PARTITION BY mrna.id ORDER BY mo.identity DESC, mo.id) AS r FROM mrna JOIN mo ON mo.reference = mrna.id AND mo.seqid = mrna.seqid AND mo.start_pos <= mrna.end_pos AND mrna.start_pos <= mo.end_pos WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.id = mo.id))
SELECT transcript, model FROM o WHERE r = 1""")
def op_locus_pairing(spark: SparkSession, d: str) -> DataFrame:
    models = exons(spark, d).filter("flag <> 'A'").selectExpr("id", "parent AS reference", "seqid", "start_pos", "end_pos", "start_pos % 100 / 100.0D AS identity")
    genes = features(spark, d).filter("featuretype = 'gene'").select("id", "seqid", "start_pos", "end_pos")
    return rescue.locus_pairing(models, _mrna(spark, d).withColumn("reference", F.col("id")), genes)


@query("SELECT DISTINCT featuretype FROM f WHERE parent IS NULL AND EXISTS (SELECT 1 FROM edges WHERE edges.parent = f.id)")
def op_gene_like_types(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    return rescue.gene_like_types(f, graph.edges(f))


@query(""", b AS (SELECT id, CASE start_pos % 4 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'lncRNA' WHEN 2 THEN 'misc' END AS biotype, EXISTS (SELECT 1 FROM ex WHERE ex.gene = gene.id AND flag = 'R') AS has FROM gene)
SELECT id, biotype, CASE WHEN biotype = 'protein_coding' AND has THEN 'coding' WHEN biotype = 'lncRNA' THEN 'non-coding' ELSE 'other' END AS class FROM b""")
def op_gene_class(spark: SparkSession, d: str) -> DataFrame:
    genes = features(spark, d).filter("featuretype = 'gene'")
    kind = F.when(F.col("start_pos") % 4 == 0, "protein_coding").when(F.col("start_pos") % 4 == 1, "lncRNA").when(F.col("start_pos") % 4 == 2, "misc")
    genes = genes.withColumn("attrs", F.when(kind.isNotNull(), F.create_map(F.lit("gene_type"), F.array(kind))).otherwise(F.create_map(F.lit("Name"), F.array("id"))))
    return rescue.gene_class(genes, exons(spark, d).filter("flag = 'R'").select(F.col("gene").alias("id")), "gencode")


@query("""SELECT g.id, g.featuretype, EXISTS (SELECT 1 FROM ex WHERE ex.gene = g.id AND flag = 'R') AS coding, g.strand = '-' AS novel FROM gene g""")
def op_coding_partitions(spark: SparkSession, d: str) -> DataFrame:
    ex = exons(spark, d).select("id", "flag")
    f = features(spark, d)
    marked = f.join(ex, "id", "left").withColumn("featuretype", F.when(F.col("flag") == "R", "CDS").otherwise(F.col("featuretype"))).drop("flag")
    return rescue.partitions(marked, graph.edges(f), _closure(spark, d), f.filter("strand = '+'").select("id"))


@query(", n AS (SELECT id AS owner, gene AS base, row_number() OVER (PARTITION BY gene ORDER BY id) - 1 AS n FROM ex) SELECT owner, base, 'cds-' || base || CASE WHEN n + 1 + (n > 1)::INT > 0 THEN '-' || (n + 1 + CASE WHEN n > 1 THEN 1 ELSE 0 END) ELSE '' END AS id FROM n")
def op_allocated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of coding parts by gene, where ``cds-gene`` and ``cds-gene-3`` are taken."""
    wanted = exons(spark, d).select(F.col("id").alias("owner"), F.col("gene").alias("base"))
    genes = features(spark, d).filter("featuretype = 'gene'").select(F.concat(F.lit("cds-"), "id").alias("id"))
    return rescue.allocated_ids(wanted, genes.unionByName(genes.select(F.concat("id", F.lit("-3")).alias("id"))))


@query(", ids AS (SELECT base AS id FROM ex UNION ALL SELECT base || '_2' FROM ex WHERE flag = 'R') SELECT id FROM ids GROUP BY id HAVING count(*) > 1 AND EXISTS (SELECT 1 FROM ex WHERE flag = 'R' AND (ids.id = base OR (regexp_replace(base, '_[0-9]+$', '') = ids.id)))")
def op_contaminated_ids(spark: SparkSession, d: str) -> DataFrame:
    ex = exons(spark, d)
    ids = ex.select(F.col("base").alias("id")).unionByName(ex.filter("flag = 'R'").select(F.concat("base", F.lit("_2")).alias("id")))
    return rescue.contaminated_ids(ids)


@query(""", ph AS (SELECT id, parent, start_pos % 4 AS actual, row_number() OVER w AS number, CAST((3 - coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY parent ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS INT) AS expected FROM ex WINDOW w AS (PARTITION BY parent ORDER BY CASE WHEN strand = '-' THEN -end_pos ELSE start_pos END, id))
SELECT id, parent, expected, CAST(actual AS INT) AS actual FROM ph WHERE number > 1 AND actual < 3 AND actual <> expected""")
def op_phase_findings(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("start_pos") % 4 == 3, ".").otherwise((F.col("start_pos") % 4).cast("string"))
    return coding.phase_findings(exons(spark, d).withColumn("phase", phase))


@query(""", v AS (SELECT id, start_pos % 5 AS k, start_pos / 9000.0 AS x, end_pos % 6 AS s FROM mrna)
SELECT 'unexpected_source' AS rule, id FROM v WHERE s = 0 UNION ALL SELECT 'dna_identity_invalid', id FROM v WHERE k = 1 OR (k > 1 AND x > 1) UNION ALL SELECT 'dna_identity_missing', id FROM v WHERE k = 0 UNION ALL SELECT 'protein_identity_missing', id FROM v""")
def op_score_attributes(spark: SparkSession, d: str) -> DataFrame:
    own = _mrna(spark, d).withColumn("k", F.col("start_pos") % 5)
    value = F.when(F.col("k") == 1, "high").otherwise((F.col("start_pos") / 9000).cast("string"))
    own = own.withColumn("attrs", F.when(F.col("k") == 0, F.create_map(F.lit("Name"), F.array("id"))).otherwise(F.create_map(F.lit("dna_identity"), F.array(value))))
    own = own.withColumn("source", F.when(F.col("end_pos") % 6 == 0, "else").otherwise("."))
    return validate.score_attributes(own)


@query(""", ln AS (SELECT id, parent, featuretype, seqid, strand, start_pos AS line FROM f UNION ALL SELECT parent, CAST(NULL AS VARCHAR), 'CDS', seqid, strand, 0 FROM ex WHERE flag = 'R'), fst AS (SELECT id, min(line) AS l FROM ln GROUP BY id)
SELECT 'parent_declared_later' AS rule, ln.id FROM ln JOIN fst ON fst.id = ln.parent WHERE line < l UNION ALL
SELECT 'duplicate_id', id FROM ln GROUP BY id HAVING count(*) > 1 AND NOT (count(DISTINCT (featuretype, seqid, strand, coalesce(parent, ''))) = 1 AND min(featuretype) = 'CDS')""")
def op_declared_earlier(spark: SparkSession, d: str) -> DataFrame:
    """Line order, where the start stands for the line and some transcripts' ids are used again."""
    f = features(spark, d).select("id", "parent", "featuretype", "seqid", "strand", F.col("start_pos").alias("line"))
    again = exons(spark, d).filter("flag = 'R'").selectExpr("parent AS id", "CAST(NULL AS STRING) AS parent", "'CDS' AS featuretype", "seqid", "strand", "0L AS line")
    return validate.declared_earlier(f.unionByName(again))


@query(""", hv AS (SELECT id, CASE WHEN featuretype = 'exon' AND start_pos % 7 = 0 THEN NULL ELSE parent END AS parent, CASE WHEN featuretype = 'exon' AND start_pos % 3 = 0 THEN 'CDS' WHEN featuretype = 'gene' AND start_pos % 5 = 0 THEN 'region' WHEN featuretype = 'mRNA' AND start_pos % 11 = 0 THEN 'match' ELSE featuretype END AS featuretype, start_pos, end_pos FROM f),
kd AS (SELECT parent AS id, bool_or(featuretype = 'exon') AS e, bool_or(featuretype = 'CDS') AS c FROM hv WHERE parent IS NOT NULL GROUP BY ALL), hw AS (SELECT hv.*, e, c, parent IS NULL AND e IS NOT NULL AND featuretype NOT IN ('exon', 'CDS') AS root FROM hv LEFT JOIN kd ON kd.id = hv.id),
bt AS (SELECT hw.*, p.featuretype AS pk, p.root AS pr FROM hw JOIN hw p ON p.id = hw.parent)
SELECT 'exon_no_parent' AS rule, id FROM hw WHERE featuretype = 'exon' AND parent IS NULL UNION ALL SELECT 'cds_no_parent', id FROM hw WHERE featuretype = 'CDS' AND parent IS NULL
UNION ALL SELECT 'exon_parent_type', id FROM bt WHERE featuretype = 'exon' AND pk <> 'mRNA' AND NOT pr UNION ALL SELECT 'cds_parent_type', id FROM bt WHERE featuretype = 'CDS' AND pk <> 'mRNA' AND NOT pr
UNION ALL SELECT 'transcript_parent_type', id FROM bt WHERE featuretype = 'mRNA' AND pk <> 'gene' AND NOT pr UNION ALL SELECT 'transcript_has_exons', id FROM hw WHERE featuretype = 'mRNA' AND NOT coalesce(e OR c, false)
UNION ALL SELECT 'mrna_has_cds', id FROM hw WHERE featuretype = 'mRNA' AND NOT coalesce(c, false)
UNION ALL SELECT 'cds_outside_exons', id FROM hw a WHERE featuretype = 'CDS' AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hw x WHERE x.featuretype = 'exon' AND x.parent = a.parent AND x.start_pos <= a.start_pos AND x.end_pos >= a.end_pos)""")
def op_hierarchy_rules(spark: SparkSession, d: str) -> DataFrame:
    """Who may stand below whom, in a view with wrong kinds and lost parents."""
    kind = F.expr("CASE WHEN featuretype = 'exon' AND start_pos % 3 = 0 THEN 'CDS' WHEN featuretype = 'gene' AND start_pos % 5 = 0 THEN 'region' WHEN featuretype = 'mRNA' AND start_pos % 11 = 0 THEN 'match' ELSE featuretype END")
    up = F.expr("CASE WHEN featuretype = 'exon' AND start_pos % 7 = 0 THEN NULL ELSE parent END")
    return validate.hierarchy(features(spark, d).withColumn("parent", up).withColumn("featuretype", kind))


@query(PROTEIN_SQL + " SELECT doc_id, length(substr(protein, 1, greatest(length(protein) - 1, 0))) - length(replace(substr(protein, 1, greatest(length(protein) - 1, 0)), '*', '')) AS n_inner FROM p", view=False)
def op_truncated_proteins(spark: SparkSession, d: str) -> DataFrame:
    """Stops before the last letter of each protein."""
    return _sequences(spark, d).select("doc_id", sq.truncated(sq.translate(F.col("seq"))).cast("long").alias("n_inner"))


SAM_SQL = "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def _sam_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as alignments; those of every fifth order are unmapped."""
    q = F.col("l_quantity").cast("long").cast("string")
    cigar = F.concat(F.lit("5S"), q, F.lit("M3I"), q, F.lit("=2X4D"), F.lit("7M"))
    off = F.col("l_orderkey") % 5 == 0
    fields = [F.concat(F.lit("q"), "l_orderkey", F.lit("_"), "l_linenumber"), F.when(off, "4").when(F.col("l_orderkey") % 2 == 0, "16").otherwise("0"), F.when(off, "*").otherwise(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string"))),
              F.col("l_partkey").cast("string"), F.lit("60"), F.when(off, "*").otherwise(cigar), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")]
    head = table(spark, d, "supplier").select(F.concat(F.lit("@SQ\tSN:chr"), F.col("s_suppkey").cast("string"), F.lit("\tLN:100000")).alias("value"))
    return head.unionByName(table(spark, d, "lineitem").select(F.concat_ws("\t", *fields).alias("value")))


@query(SAM_SQL + " SELECT 'q' || l_orderkey || '_' || l_linenumber AS query, CASE WHEN l_orderkey % 5 <> 0 THEN 'chr' || l_suppkey END AS target, CASE WHEN l_orderkey % 5 <> 0 THEN l_partkey END AS target_start, CASE WHEN l_orderkey % 5 <> 0 AND l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM s", view=False)
def op_sam_scan(spark: SparkSession, d: str) -> DataFrame:
    from .sources import sam

    return sam.alignments(_sam_lines(spark, d)).select("query", "target", F.col("target_start"), "strand")


@query(SAM_SQL + """, m AS (SELECT DISTINCT 'q' || l_orderkey || '_' || l_linenumber AS query, 'chr' || l_suppkey AS target, l_partkey - 1 AS t, q FROM s WHERE l_orderkey % 5 <> 0)
SELECT query, target, 5 AS query_start, 4 + q AS query_end, t AS target_start, t + q - 1 AS target_end FROM m UNION ALL SELECT query, target, 8 + q, 9 + 2 * q, t + q, t + 2 * q + 1 FROM m UNION ALL SELECT query, target, 10 + 2 * q, 16 + 2 * q, t + 2 * q + 6, t + 2 * q + 12 FROM m""", view=False)
def op_sam_blocks(spark: SparkSession, d: str) -> DataFrame:
    from .sources import sam

    return sam.blocks(sam.alignments(_sam_lines(spark, d))).drop("strand").distinct()


@query(""", bl AS (SELECT id, gene, start_pos AS a, start_pos + (end_pos - start_pos) // 2 AS b, start_pos * 2 + 7 AS t FROM ex WHERE flag <> 'A'), met AS (SELECT e.gene, e.id, e.start_pos, e.end_pos, t + greatest(e.start_pos, a) - a AS x, t + least(e.end_pos, b) - a AS y FROM ex e JOIN bl ON bl.gene = e.gene AND a <= e.end_pos AND b >= e.start_pos)
SELECT gene, id, min(x) AS lifted_start, max(y) AS lifted_end, CAST(sum(y - x + 1) AS BIGINT) AS covered, round(sum(y - x + 1) / (end_pos - start_pos + 1), 6) AS coverage FROM met GROUP BY gene, id, start_pos, end_pos""")
def op_convert_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Exons through the blocks of their gene's chain."""
    ex = exons(spark, d)
    blocks = ex.filter("flag <> 'A'").selectExpr("gene", "start_pos AS query_start", "start_pos + (end_pos - start_pos) DIV 2 AS query_end", "start_pos * 2 + 7 AS target_start", "start_pos * 2 + 7 + (end_pos - start_pos) DIV 2 AS target_end")
    out = lifting.converted(ex.select("gene", "id", "start_pos", "end_pos"), blocks, "gene")
    return out.select("gene", "id", "lifted_start", "lifted_end", "covered", F.round("coverage", 6).alias("coverage"))


@query(""", cd AS (SELECT parent, start_pos - 9 AS c0, start_pos + 30 AS c1, row_number() OVER (PARTITION BY parent ORDER BY start_pos - 9, start_pos + 30) AS i, count(*) OVER (PARTITION BY parent) AS n FROM ex WHERE flag = 'R'),
en AS (SELECT parent, min(c0) AS a, max(c1) AS b FROM cd GROUP BY ALL),
sp AS (SELECT cd.parent, i, min(start_pos) AS s0, max(end_pos) AS s1, min((start_pos, end_pos)) AS f FROM cd JOIN ex ON ex.parent = cd.parent AND start_pos <= c1 AND end_pos >= c0 GROUP BY cd.parent, i)
SELECT cd.parent, CASE WHEN n = 1 THEN coalesce(s0, c0) WHEN cd.i = 1 THEN least(c0, f[1]) ELSE c0 END AS start_pos, CASE WHEN n = 1 THEN coalesce(s1, c1) WHEN cd.i = n THEN greatest(c1, f[2]) ELSE c1 END AS end_pos, c0 AS cds_start, c1 AS cds_end
FROM cd LEFT JOIN sp ON sp.parent = cd.parent AND sp.i = cd.i UNION ALL SELECT ex.parent, start_pos, end_pos, NULL, NULL FROM ex LEFT JOIN en ON en.parent = ex.parent WHERE a IS NULL OR end_pos < a OR start_pos > b""")
def op_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Exons rebuilt around new coding parts."""
    ex = exons(spark, d)
    return coding.reconciled(ex, ex.filter("flag = 'R'").selectExpr("parent", "start_pos - 9 AS start_pos", "start_pos + 30 AS end_pos"))


@query(PLACED_SQL + """, fl AS (SELECT pl.id, greatest(1, start_pos - (end_pos - start_pos + 1) // 10) AS start_pos, least(length(seq), end_pos + (end_pos - start_pos + 1) // 10) AS end_pos, seq FROM pl JOIN cs ON pl.seqid = cs.seqid)
SELECT id, start_pos, end_pos, substr(seq, start_pos, greatest(0, end_pos - start_pos + 1)) AS seq FROM fl""")
def op_gene_flank(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with a tenth of their length more on both sides."""
    return coding.with_flank(*_placed(spark, d), flank=0.1)


@query(""", dup AS (SELECT base AS id, featuretype, parent FROM ex), al AS (SELECT id, featuretype, seqid, parent FROM f UNION ALL SELECT base, 'CDS', seqid, parent || 'x' FROM ex)
SELECT 'featuretype' AS fact, featuretype AS name, count(*) AS n FROM al GROUP BY featuretype UNION ALL SELECT 'seqid', seqid, count(*) FROM al GROUP BY seqid
UNION ALL SELECT CASE WHEN bool_and(featuretype = 'CDS') THEN 'discontinuous_cds' ELSE 'duplicate_id' END, id, count(*) FROM al GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'orphan_parent', parent || 'x', count(*) FROM ex GROUP BY parent""")
def op_annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Facts about the view, to which parts with the exons' ids and lost parents were added."""
    again = exons(spark, d).selectExpr("base AS id", "concat(parent, 'x') AS parent", "seqid", "'CDS' AS featuretype", "start_pos", "end_pos", "strand")
    own = features(spark, d).unionByName(again)
    return at.annotation_scan(own, graph.edges(own))


@query()
def op_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the mean difference by flag (seeded resampling: no SQL)."""
    from .operators.evaluate import paired_bootstrap

    pairs = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return paired_bootstrap(pairs, "l_returnflag", "key", "delta", 200)


@query()
def op_greedy_admission(spark: SparkSession, d: str) -> DataFrame:
    """Exons of one flag as candidates, taken in order of place (a fold: no SQL)."""
    from .operators.fusion import admit

    return admit(exons(spark, d).filter("flag = 'R' AND start_pos % 3 = 0"))


@query()
def op_chained_models(spark: SparkSession, d: str) -> DataFrame:
    """Two models of each transcript's exons, chained chunk by chunk (a walk of both: no SQL)."""
    from .operators.chaining import MODEL, chained

    parts = exons(spark, d).groupBy("parent").agg(F.sort_array(F.collect_list(F.struct(F.col("start_pos").alias("a"), F.col("end_pos").alias("b")))).alias("p"))
    edges = "transform(sequence(0, size(p)), i -> CAST(3 * i AS DOUBLE))"

    def model(letter: str, every: int) -> DataFrame:
        target = f"array_join(transform(p, x -> CASE WHEN x.a % {every} = 0 THEN 'MKA' ELSE 'M{letter}{letter}' END), '')"
        return parts.selectExpr("parent", f"CAST(named_struct('parts', p, 'reference', repeat('MKA', size(p)), 'target', {target}, 'edges', {edges}) AS {MODEL}) AS model")

    return chained(model("X", 2), model("Y", 3).filter("parent LIKE '%1'"), "parent")


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_partkey % 7 AS k, l_quantity AS q, l_suppkey FROM lineitem)
SELECT 'bad_column_count' AS rule, line FROM t WHERE k = 0 UNION ALL SELECT 'start_gt_end', line FROM t WHERE k = 1 UNION ALL SELECT 'negative_start', line FROM t WHERE k = 2 UNION ALL SELECT 'bad_strand', line FROM t WHERE k = 3
UNION ALL SELECT 'cds_missing_phase', line FROM t WHERE k = 4 UNION ALL SELECT 'bad_attribute', line FROM t WHERE k = 5 UNION ALL SELECT 'miscapitalised_attribute', line FROM t WHERE k = 6 UNION ALL SELECT 'unencoded_reserved_char', line FROM t WHERE k = 6
UNION ALL SELECT 'unknown_seqid', line FROM t WHERE k <> 0 AND l_suppkey % 3 = 0""", view=False)
def op_line_findings(spark: SparkSession, d: str) -> DataFrame:
    """Line items as lines of a file below its version line, each with something wrong; lines are counted from there."""
    k = F.col("l_partkey") % 7
    pick = lambda n, bad, good: F.when(k == n, bad).otherwise(good)
    fields = [F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.lit("x"), pick(4, "CDS", "exon"), F.when(k == 2, "0").when(k == 1, "90").otherwise("5"), F.lit("50"), F.lit("."), pick(3, "*", "+"), F.lit("."),
              F.when(k == 5, "ID=a;oops").when(k == 6, "ID=a;PARENT=b&c").otherwise("ID=a")]
    value = F.when(k == 0, F.concat_ws("\t", *fields[:8])).otherwise(F.concat_ws("\t", *fields))
    known = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("seqid"))
    head = spark.createDataFrame([(1, "##gff-version 3")], "line long, value string")
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("line"), value.alias("value"))
    return validate.lines(head.unionByName(items), known).withColumn("line", F.col("line") - 1)


@query()
def op_assessed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as transcripts against the items after them (alignments: no SQL)."""
    from .operators.assess import assessed

    own = table(spark, d, "benchmark").select("item_id", F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("dna"))
    after = own.select((F.col("item_id") - 1).alias("item_id"), F.col("dna").alias("ref_dna"), sq.translate(F.col("dna")).alias("ref_protein"))
    return assessed(own.join(after, "item_id"), "item_id").drop("classes", "frame_start", "frame_end", "frame_identity")
