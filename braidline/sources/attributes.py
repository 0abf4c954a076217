"""The ninth column: parsing, dialects, the attribute table, and models from GTF ids."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import percent_decode
from ..operators.interval import numbered
from ..store import FeatureStore
from . import gff
from .stage import stage

PAIRS = "array<struct<name:string,value:string>>"


def segments(column: Column) -> Column:
    """Parts between semicolons that are not inside quotes, without blanks at the ends."""
    parts = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r'((?:[^;"]++|"[^"]*+(?:"|$))++)'), F.lit(1))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def name_values(segment: Column) -> Column:
    """(name, value) for each value of a segment: ``name=a,b`` is decoded and split at
    commas outside quotes, ``name "a"`` has one value; quotes around go."""
    eq = F.instr(segment, "=")
    name = F.when(eq > 0, F.trim(F.substring(segment, F.lit(1), eq - 1))).otherwise(F.regexp_extract(segment, r"^([^ \t]+)", 1))
    raw = F.when(eq > 0, F.substring(segment, eq + 1, F.length(segment))).otherwise(F.regexp_extract(segment, r"^[^ \t]+[ \t]+(.*)$", 1))
    raw = F.trim(raw)
    clean = F.regexp_replace(raw, r'^"(.*)"$', "$1")
    many = F.transform(F.split(clean, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), percent_decode)
    gtf = (eq == 0) & segment.rlike(r"[ \t]")
    values = F.when(gtf, F.array(clean)).otherwise(many)
    pairs = F.transform(values, lambda v: F.struct(name.alias("name"), v.alias("value")))
    return F.when(name == "", F.array().cast(PAIRS)).otherwise(pairs)


#: What ``.`` does not match and ``$`` may stand before, to Spark.
_ENDS = "\n\r\u0085\u2028\u2029"
_SEGMENT = re.compile(r'(?:[^;"]++|"[^"]*+(?:"|$))++')
_SPACED = re.compile(rf"[^ \t]+[ \t]+([^{_ENDS}]*)(?=(?:\r\n|[{_ENDS}])?\Z)")
_QUOTED = re.compile(rf'"([^{_ENDS}]*)"(?=(?:\r\n|[{_ENDS}])?\Z)')
_COMMA = re.compile(r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
_CODES = re.compile("(?:%[0-9A-Fa-f]{2})+")


def _rows(*texts: str, **others: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in texts] + [T.StructField(n, t) for n, t in others.items()]))


def _decoded(value: str) -> str:
    if "%" not in value or "%" in _CODES.sub("", value):
        return value
    return _CODES.sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), value)


def _segment(s: str, memo: dict[str, tuple[str, list[str]]]) -> tuple[str, list[str]]:
    """``name_values`` of one segment: its name and values."""
    name, eq, raw = s.partition("=")
    if eq and '"' not in raw and "%" not in raw and "," not in raw:
        return name.strip(" "), [raw.strip(" ")]
    if (got := memo.get(s)) is not None:
        return got
    if eq:
        name, raw = name.strip(" "), raw.strip(" ")
    else:
        name = re.match(r"[^ \t]*", s)[0]
        raw = m[1].strip(" ") if (m := _SPACED.match(s)) else ""
    if m := _QUOTED.match(raw):
        raw = m[1] + raw[m.end():]
    if not eq and (" " in s or "\t" in s):
        values = [raw]
    else:
        values = [_decoded(v) for v in (_COMMA.split(raw) if '"' in raw else raw.split(","))]
    if len(memo) < 100_000:
        memo[s] = name, values
    return name, values


def read_pairs(text: str | None, memo: dict[str, tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """(name, values) of each segment of a ninth column; ``memo`` keeps segments that come again."""
    if not text:
        return []
    parts = _SEGMENT.findall(text) if '"' in text else text.split(";")
    found = (_segment(s, memo) for x in parts if (s := x.strip(" ")))
    return [f for f in found if f[0]]


@F.arrow_udf(_rows("name", "value", idx=T.IntegerType()))
def indexed(column: pa.Array) -> pa.Array:
    """All (name, value, idx) of a ninth column in file order; idx counts a name's values."""
    memo: dict = {}
    ends, names, values, places = [0], [], [], []
    for text in column.to_pylist():
        seen: dict[str, int] = {}
        for name, some in read_pairs(text, memo):
            n = seen.get(name, 0)
            for v in some:
                names.append(name)
                values.append(v)
                places.append(n)
                n += 1
            seen[name] = n
        ends.append(len(names))
    rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(places, pa.int32())], ["name", "value", "idx"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(_rows("name", "value"))
def parsed(column: pa.Array) -> pa.Array:
    """All (name, value) pairs of a ninth column, in file order: ``name_values`` of its
    ``segments``, which as functions of arrays take several times as long."""
    memo: dict = {}
    ends, names, values = [0], [], []
    for text in column.to_pylist():
        for name, some in read_pairs(text, memo):
            names.extend([name] * len(some))
            values.extend(some)
        ends.append(len(names))
    rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def mapped(column: pa.Array) -> pa.Array:
    """Names and their values (an array each) of a ninth column."""
    memo: dict = {}
    ends, names, cuts, values = [0], [], [0], []
    for text in column.to_pylist():
        row: dict[str, list[str]] = {}
        for name, some in read_pairs(text, memo):
            row[name] = row[name] + some if name in row else some
        for name, some in row.items():
            names.append(name)
            values.extend(some)
            cuts.append(len(values))
        ends.append(len(names))
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.string()))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), lists)


def attribute_map(pairs: str) -> Column:
    """Names and their values (an array each) from a column of pairs."""
    names = F.array_distinct(F.transform(F.col(pairs), lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(F.col(pairs), lambda p: p["name"] == n), lambda p: p["value"])))


def attribute_table(rows: DataFrame, key: str, attributes: str = "attributes") -> DataFrame:
    """(key, name, value, idx): a row for each value; idx counts a name's values, also
    of names that are repeated."""
    return rows.select(key, F.explode(indexed(F.col(attributes))).alias("a")).select(key, "a.*")


def with_value(features: DataFrame, table: DataFrame, name: str, value: str) -> DataFrame:
    """The features (id) that have a value of an attribute."""
    hit = table.filter((F.col("name") == name) & (F.col("value") == value)).select("id")
    return features.join(hit, "id", "left_semi")


def dialect(rows: DataFrame, sample: int = 10) -> DataFrame:
    """One row that describes the ninth columns of the first ``sample`` rows.

    The format and the separator of most rows (ties: gff3, the least separator),
    whether any row has the other marks, and names by first appearance.
    """
    a = F.coalesce("attributes", F.lit(""))
    some = rows.orderBy("file_order").limit(sample).select("file_order", a.alias("a"), segments(a).alias("s"))
    first = F.get("s", F.lit(0))
    gtf = first.isNotNull() & (F.instr(first, "=") == 0) & first.rlike(r"[ \t]")
    sep = F.when(F.contains("a", F.lit("; ")), "; ").when(F.contains("a", F.lit(" ; ")), " ; ").otherwise(";")
    names = F.transform("s", lambda x: F.get(F.transform(name_values(x), lambda p: p["name"]), F.lit(0)))
    bare = F.regexp_replace("a", r'"[^"]*(?:"|$)', "")
    marks = some.select(
        "file_order", gtf.alias("gtf"), sep.alias("sep"), F.trim("a").startswith(";").alias("leading"), F.trim("a").endswith(";").alias("trailing"),
        F.col("a").rlike(r'[= \t]"[^"]*"').alias("quoted"), (F.regexp_count("a", F.lit(";")) > F.regexp_count(bare, F.lit(";"))).alias("semicolon"), names.alias("names"),
    )
    marks = marks.withColumn("repeated", F.size("names") > F.size(F.array_distinct("names")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    order = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("file_order", "names"))), lambda x: x["names"])))
    is_gtf = F.coalesce(F.sum(F.col("gtf").cast("int")) * 2 > F.count(F.lit(1)), F.lit(False))
    votes = marks.groupBy("sep").count().agg(F.min(F.struct(-F.col("count"), F.col("sep"))).alias("v")).select(F.coalesce("v.sep", F.lit(";")).alias("field_separator"))
    out = marks.agg(F.when(is_gtf, "gtf").otherwise("gff3").alias("fmt"), any_("leading"), any_("trailing"), any_("quoted"), any_("repeated"), any_("semicolon"), order.alias("order"))
    return out.crossJoin(votes)  # one row each


def first_value(name: str) -> Column:
    return F.get(F.col("attrs")[name], F.lit(0))


def envelopes(parts: DataFrame, key: str, kind: str, up: Column) -> DataFrame:
    """A feature of that kind for each value of ``key``, from the least start to the greatest end."""
    out = parts.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.min("seqid").alias("seqid"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("strand").alias("strand"), F.min(up).alias("parent"))
    return out.select("id", "parent", "seqid", F.lit(kind).alias("featuretype"), "start_pos", "end_pos", "strand")


def major_gene(parts: DataFrame) -> DataFrame:
    """(transcript_id, gene_id): the gene that most parts of a transcript name, ties to the least."""
    n = parts.filter("transcript_id IS NOT NULL AND gene_id IS NOT NULL").groupBy("transcript_id", "gene_id").count()
    return n.groupBy("transcript_id").agg(F.min(F.struct(-F.col("count"), F.col("gene_id"))).alias("b")).select("transcript_id", F.col("b.gene_id").alias("gene_id"))


def gtf_models(rows: DataFrame, subfeature: str = "exon", transcripts: bool = True, genes: bool = True) -> DataFrame:
    """Features (id, parent, seqid, featuretype, start_pos, end_pos, strand) of GTF rows.

    ``rows`` has the columns of ``gff.parse_rows`` and ``attrs``.  Rows of transcripts
    and genes keep their own ids; others are numbered by kind.  Transcripts and genes
    that have parts but no row are made from the extent of their parts.  The rows' places
    and two ids are staged, as the file would be parsed for each use of them.
    """
    own = rows.select("seqid", "featuretype", "start_pos", "end_pos", "strand", "file_order", first_value("transcript_id").alias("transcript_id"), first_value("gene_id").alias("gene_id"))
    own = stage(own, "gtf-rows")  # five times read, once parsed
    is_tx, is_gene = F.col("featuretype") == "transcript", F.col("featuretype") == "gene"
    named = F.when(is_tx, F.col("transcript_id")).when(is_gene, F.col("gene_id"))
    by_kind = F.concat("featuretype", F.lit("_"), F.col("number").cast("string"))
    up = F.when(is_gene, F.lit(None)).when(is_tx, F.col("gene_id")).otherwise(F.coalesce("transcript_id", "gene_id"))
    base = numbered(own, ["featuretype"], "file_order").select(F.coalesce(named, by_kind).alias("id"), up.alias("parent"), "seqid", "featuretype", "start_pos", "end_pos", "strand")
    parts = own.filter(F.col("featuretype") == subfeature)
    out = base
    if transcripts:
        made = envelopes(parts.drop("gene_id").join(major_gene(parts), "transcript_id", "left"), "transcript_id", "transcript", F.col("gene_id"))
        out = out.unionByName(made.join(base.select("id"), "id", "left_anti"))
    if genes:
        made = envelopes(parts, "gene_id", "gene", F.lit(None).cast("string"))
        out = out.unionByName(made.join(base.select("id"), "id", "left_anti"))
    return out


def linked(features: DataFrame) -> DataFrame:
    """(parent, child) where the parent is a feature."""
    pairs = features.filter("parent IS NOT NULL").select("parent", F.col("id").alias("child"))
    return pairs.join(features.select(F.col("id").alias("parent")), "parent", "left_semi")


def gff3_models(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features with ``attrs``, and (parent, child) for every value of Parent.

    Repeated ids become ``id__2`` and so on in file order, and rows without an id are
    numbered by kind; edges name the first of repeated ids.
    """
    own = numbered(rows.withColumn("_bare", first_value("ID").isNull()), ["featuretype", "_bare"], "file_order")
    named = F.coalesce(first_value("ID"), F.concat("featuretype", F.lit("_"), F.col("number").cast("string")))
    own = own.withColumn("base", named)
    n = F.row_number().over(Window.partitionBy("base").orderBy("file_order"))
    own = own.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat("base", F.lit("__"), F.col("n").cast("string"))).otherwise(F.col("base")))
    pairs = own.select(F.explode(F.col("attrs")["Parent"]).alias("parent"), F.col("id").alias("child"))
    own = own.withColumn("parent", first_value("Parent"))
    return own.select("id", "parent", "seqid", "source", "featuretype", "start_pos", "end_pos", "score", "strand", "frame", "attrs", "file_order"), pairs


def create_store(spark: SparkSession, path: str | DataFrame, infer_transcripts: bool = True, infer_genes: bool = True, subfeature: str = "exon", max_depth: int = 8) -> FeatureStore:
    """A store from a file, or from a DataFrame of lines (file_order, value); bad rows are left out.

    The dialect of the first rows says whether it is GFF3 or GTF.  Features and edges
    are stage tables: the file is parsed once.
    """
    lines = gff.read_lines(spark, path) if isinstance(path, str) else path
    rows = gff.parse_rows(lines).filter("error_kind IS NULL")
    fmt = dialect(rows).first()["fmt"]
    rows = rows.withColumn("attrs", mapped(F.col("attributes")))
    if fmt == "gtf":
        features = stage(gtf_models(rows, subfeature, infer_transcripts, infer_genes), "features")
        return FeatureStore(features, max_depth, stage(linked(features), "edges"))
    features, pairs = gff3_models(rows)
    return FeatureStore(stage(features, "features"), max_depth, stage(pairs, "edges"))


def annotation_scan(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fact, name, n): features of each kind and sequence, ids found twice or more, parts
    of one CDS among them, and parents that are missing."""
    def fact(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "name", "n")

    ids = features.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("featuretype") == "CDS").alias("cds")).filter("n > 1")
    twice = ids.select(F.when(F.col("cds"), "discontinuous_cds").otherwise("duplicate_id").alias("fact"), F.col("id").alias("name"), "n")
    lost = pairs.join(features.select(F.col("id").alias("parent")), "parent", "left_anti")
    return fact("featuretype", features, "featuretype").unionByName(fact("seqid", features, "seqid")).unionByName(twice).unionByName(fact("orphan_parent", lost, "parent"))


def read_list(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The columns c0, c1 of a list file (sequence pairs, kinds of features, unplaced
    sequences): lines that are empty or begin with # are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' AND value NOT LIKE '#%'")
    p = F.split("value", sep)
    return lines.select(F.trim(F.get(p, F.lit(0))).alias("c0"), F.trim(F.get(p, F.lit(1))).alias("c1"))


def from_string(spark: SparkSession, text: str | bytes) -> DataFrame:
    """Lines (file_order, value) of an annotation in memory, up to ``##FASTA``."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    lines = text.splitlines()
    stop = next((i for i, x in enumerate(lines) if x.startswith("##FASTA")), len(lines))
    return spark.createDataFrame(list(enumerate(lines[:stop])), "file_order long, value string")
