"""Models beside the lifted ones: filters, bands, pairing, replacement, classes of genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import spread
from . import interval as iv


def hit_reason(identity: float, coverage: float, evalue: float) -> Column:
    """Why a protein hit is left out; null for those that stay."""
    return (
        F.when(F.col("identity") < identity, "identity_below_minimum").when(F.col("query_coverage") < coverage, "query_coverage_below_minimum")
        .when(F.col("target_coverage") < coverage, "target_coverage_below_minimum").when(F.col("evalue") > evalue, "evalue_above_maximum")
    )


def target_ids(models: DataFrame, genes: DataFrame) -> DataFrame:
    """Reference transcript and gene of each protein model: the first word of its Target,
    and the gene that (transcript, gene) has for it."""
    own = models.withColumn("transcript", F.nullif(F.substring_index(F.trim("target"), " ", 1), F.lit("")))
    return own.join(genes, "transcript", "left").select("id", "transcript", "gene")


def base_id(id_: Column, known: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, base): the id without its copy suffix where what is left is a known id."""
    stripped = F.regexp_replace(id_, r"_\d+$", "")
    own = ids.select(id_.alias("id"), stripped.alias("stripped"))
    marked = own.join(known.select(F.col("id").alias("stripped"), F.lit(True).alias("is_known")).distinct(), "stripped", "left")
    return marked.select("id", F.when(F.col("is_known"), F.col("stripped")).otherwise(F.col("id")).alias("base"))


def protein_only(models: DataFrame, low: float = 0.9, high: float = 1.5) -> DataFrame:
    """Models (id, start_pos, end_pos, n_cds, ref_length, ref_n_cds) that may stand alone:
    of a length in the band, and not with one coding part where the reference has more."""
    ratio = iv.length() / F.nullif(F.col("ref_length"), F.lit(0))
    one = (F.col("n_cds") == 1) & (F.coalesce("ref_n_cds", F.lit(0)) > 1)
    return models.withColumn("ratio", ratio).filter((F.col("ratio") > low) & (F.col("ratio") < high) & ~one)


def rescue_candidates(models: DataFrame, floor: Column, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Models in the wider band with an identity of at least ``floor``: of each gene the
    first by place, as it would be met in order."""
    ok = protein_only(models, low, high).filter(F.col("identity") >= floor)
    first = ok.groupBy("gene").agg(F.min(F.struct("seqid", "start_pos", "end_pos", "id")).alias("m"))
    return first.select("gene", "m.*")


def adaptive_floor(emitted: DataFrame, universe: DataFrame, base: float) -> DataFrame:
    """One row (recall, floor): how many ids of the universe were emitted, and the least
    identity that this asks of a rescue: a clamp between two recalls.

    Fixed values: floor 0.30 at a recall of 0.10, ``base`` at 0.50.
    """
    n = universe.join(emitted.select("id", F.lit(1).alias("hit")).distinct(), "id", "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    least = min(0.30, base)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("recall") - 0.10) / (0.50 - 0.10)))
    return n.withColumn("floor", F.lit(least) + (base - least) * share)


def replacements(hits: DataFrame, emitted: DataFrame, weak: float = 0.5, gain: float = 0.3) -> DataFrame:
    """(gene, id, identity): for genes whose best emitted identity is below ``weak``, the
    best hit elsewhere that is better by more than ``gain``; ties to the first by place.

    ``hits``: id, gene, seqid, start_pos, end_pos, identity, n_cds, ref_n_cds; ``emitted``:
    gene, seqid, start_pos, end_pos, identity, a row for each emitted model.
    """
    best = emitted.groupBy("gene").agg(F.max("identity").alias("best"))
    q = hits.select(F.col("id").alias("hit"), F.concat_ws("\t", "gene", "seqid").alias("q_seqid"), F.col("start_pos").alias("q_start"), F.col("end_pos").alias("q_end"))
    f = emitted.select(F.concat_ws("\t", "gene", "seqid").alias("seqid"), "start_pos", "end_pos")
    touching = iv.overlap_join(q, f).select(F.col("hit").alias("id")).distinct()
    one = (F.col("n_cds") == 1) & (F.coalesce("ref_n_cds", F.lit(0)) > 1)
    ok = hits.join(best, "gene").filter((F.col("best") < weak) & (F.col("identity") > F.col("best") + gain) & ~one).join(touching, "id", "left_anti")
    top = ok.groupBy("gene").agg(F.min(F.struct((-F.col("identity")).alias("i"), "seqid", "start_pos", "end_pos", "id")).alias("m"))
    return top.select("gene", F.col("m.id").alias("id"), (-F.col("m.i")).alias("identity"))


def locus_pairing(models: DataFrame, transcripts: DataFrame, genes: DataFrame) -> DataFrame:
    """(transcript, model): of the protein models of a transcript's reference that overlap
    it and touch no gene that it does not touch, the one of highest identity.

    ``models``: id, reference, identity and place; ``transcripts``: id, reference and place;
    ``genes``: id and place, none of which ends before it starts.  Ties go to the least id.

    Of a model and a transcript that overlap, a gene touches the model alone if it ends in
    what the model has before the transcript, or starts in what it has behind it: so it is
    enough to look for one end or start there, and no pairs with genes are made.
    """
    m = models.select(F.col("id").alias("model"), "reference", "identity", F.col("seqid").alias("m_seqid"), F.col("start_pos").alias("m0"), F.col("end_pos").alias("m1"))
    t = transcripts.select(F.col("id").alias("transcript"), "reference", "seqid", "start_pos", "end_pos")
    met = t.join(m, "reference").filter("seqid = m_seqid AND m0 <= end_pos AND m1 >= start_pos")
    outside = F.array(F.struct(F.lit(0).alias("side"), F.col("m0").alias("a"), (F.col("start_pos") - 1).alias("b")), F.struct(F.lit(1).alias("side"), (F.col("end_pos") + 1).alias("a"), F.col("m1").alias("b")))
    pieces = met.select("transcript", "model", "seqid", F.explode(outside).alias("p")).filter("p.a <= p.b")
    points = genes.select("seqid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("end_pos").alias("at")), F.struct(F.lit(1).alias("side"), F.col("start_pos").alias("at")))).alias("p"))
    held = iv.holds_a_point(pieces.select("transcript", "model", "seqid", "p.*"), points.select("seqid", "p.*"), ["seqid", "side"])
    within = met.join(held.select("transcript", "model").distinct(), ["transcript", "model"], "left_anti")
    best = within.groupBy("transcript").agg(F.min(F.struct((-F.col("identity")).alias("i"), "model")).alias("b"))
    return best.select("transcript", F.col("b.model").alias("model"))


def gene_like_types(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(featuretype) of which some feature has children and no parent."""
    tops = features.filter("parent IS NULL").join(pairs.select(F.col("parent").alias("id")), "id", "left_semi")
    return tops.select("featuretype").distinct()


#: Where each kind of database keeps a gene's biotype, in order of preference.
BIOTYPE_KEYS = {"refseq": ("gene_biotype", "biotype"), "gencode": ("gene_type", "biotype"), "ensembl": ("gene_type", "biotype"), "chess": ("gene_type", "biotype")}


def gene_class(genes: DataFrame, coding: DataFrame, database: str = "") -> DataFrame:
    """(id, biotype, class) of genes with ``attrs``: coding if protein_coding with a coding
    part (``coding`` lists their ids), non-coding for lncRNA and ncRNA, else other."""
    keys = BIOTYPE_KEYS.get(database.lower(), ("gene_biotype", "gene_type", "biotype"))
    biotype = F.coalesce(*(F.get(F.col("attrs")[k], F.lit(0)) for k in keys))
    own = genes.select("id", biotype.alias("biotype")).join(coding.select("id", F.lit(True).alias("has")).distinct(), "id", "left")
    kind = F.when((F.col("biotype") == "protein_coding") & F.col("has"), "coding").when(F.col("biotype").isin("lncRNA", "ncRNA"), "non-coding").otherwise("other")
    return own.select("id", "biotype", kind.alias("class"))


def partitions(features: DataFrame, pairs: DataFrame, closure: DataFrame, reference: DataFrame, part: str = "CDS") -> DataFrame:
    """(id, coding, novel) of features without parents: whether a coding part lies below, and
    whether the reference (id) lacks them."""
    tops = features.join(pairs.select(F.col("child").alias("id")), "id", "left_anti").select("id", "featuretype")
    below = closure.join(features.filter(F.col("featuretype") == part).select(F.col("id").alias("descendant")), "descendant").select(F.col("ancestor").alias("id"), F.lit(True).alias("c")).distinct()
    out = tops.join(below, "id", "left").join(reference.select("id", F.lit(True).alias("r")).distinct(), "id", "left")
    return out.select("id", "featuretype", F.coalesce("c", F.lit(False)).alias("coding"), F.col("r").isNull().alias("novel"))


def allocated_ids(wanted: DataFrame, reserved: DataFrame) -> DataFrame:
    """(owner, base, id): the first owner of a base gets ``cds-base``, others ``cds-base-N``;
    ids that are reserved are passed over.

    Numbers that are taken are left out of the sequence by rank, not by trial: the n-th
    owner gets the n-th free number.
    """
    taken = reserved.select(F.regexp_extract("id", r"^cds-(.*?)(?:-(\d+))?$", 1).alias("base"), F.coalesce(F.expr(r"try_cast(regexp_extract(id, '^cds-(.*?)(?:-(\\d+))?$', 2) AS INT)"), F.lit(0)).alias("k")).distinct()
    # the n-th free number is n plus how many taken ones lie before it: taken k shifts all n >= k - its rank.
    # Owners and taken numbers of a base meet in one place, dealt out once, and are counted there
    owners = wanted.select("owner", "base", F.lit(1).alias("side"), F.lit(None).cast("int").alias("k"))
    both = owners.unionByName(taken.select(F.lit(None).cast(wanted.schema["owner"].dataType).alias("owner"), "base", F.lit(0).alias("side"), "k"))
    place = F.row_number().over(Window.partitionBy("base", "side").orderBy("k", "owner")) - 1
    own = spread(both, "base").withColumn("n", F.when(F.col("side") == 1, place).otherwise(F.col("k") - place))
    before = Window.partitionBy("base").orderBy("n", "side").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("s", F.sum(1 - F.col("side")).over(before)).filter("side = 1")
    number = F.col("n") + F.col("s")
    return own.select("owner", "base", F.concat(F.lit("cds-"), "base", F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(F.lit(""))).alias("id"))


def contaminated_ids(ids: DataFrame) -> DataFrame:
    """(id): found twice or more, while some ``id_N`` is there as well."""
    twice = ids.groupBy("id").count().filter("count > 1").select("id")
    suffixed = ids.filter(F.col("id").rlike(r"_\d+$")).select(F.regexp_replace("id", r"_\d+$", "").alias("id")).distinct()
    return twice.join(suffixed, "id", "left_semi")
