"""Assessment of transcripts: identities, classes, frames; strict scans."""

import pytest

from braidline.operators.assess import assessed
from braidline.sources import attributes as at
from braidline.sources import gff

GENE = "ATGGCTGCTAAAGATTGTGAATTTGGTTAA"
PROTEIN = "MAAKDCEFG*"


def test_classes_of_changed_transcripts(spark):
    cases = {
        "same": (GENE, ["identical"]), "silent": (GENE.replace("GCTGCT", "GCCGCT"), ["synonymous"]), "changed": (GENE.replace("GATTGT", "GGTTGT"), ["nonsynonymous"]),
        "gone": (None, ["full_transcript_loss"]), "shifted": (GENE[:9] + GENE[10:], None), "shorter": (GENE[:9] + GENE[12:], ["inframe_deletion"]), "tail": (GENE[:-3] + "GGG", ["stop_missing"]),
    }
    rows = [(k, GENE, dna, PROTEIN) for k, (dna, _) in cases.items()] + [("rna", GENE, GENE, None)]
    out = {r.k: r for r in assessed(spark.createDataFrame(rows, "k string, ref_dna string, dna string, ref_protein string"), "k").collect()}
    for k, (_, classes) in cases.items():
        if classes is not None:
            assert out[k].classes == classes, k
    assert out["rna"].classes == ["non_coding"] and "frameshift" in out["shifted"].classes
    assert out["same"].dna_identity == out["same"].protein_identity == out["silent"].protein_identity == 1.0
    assert out["changed"].protein_identity == pytest.approx(0.9) and out["gone"].dna_identity == 0.0


def test_a_frame_further_on_is_found(spark):
    late = "CAAGCCC" + GENE + "GG"
    r = assessed(spark.createDataFrame([("k", GENE, late, PROTEIN)], "k string, ref_dna string, dna string, ref_protein string"), "k").first()
    assert late[r.frame_start:r.frame_end] == GENE and r.frame_identity == 1.0 and r.protein_identity < 0.9


def test_strict_scan(spark):
    text = "c\ts\texon\t1\t9\t\t+\t.\tID=a\nc\ts\texon\t9\t1\t.\t+\t.\tID=b\nc\ts\texon\t1\t9\t.\t+\t.\tnothing\n"
    rows = gff.parse_rows(at.from_string(spark, text))
    good, bad = gff.scan(rows, strict=False)
    assert good.count() == 1 and {r.error_kind for r in bad.collect()} == {"InvalidCoordinate", "InvalidAttribute"}
    with pytest.raises(gff.BadRows, match="InvalidCoordinate at 1"):
        gff.scan(rows)


def test_line_item_numbered_one_is_not_the_version_line(spark, tmp_path):
    import duckdb

    from braidline import hierarchy_queries as own, queries

    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT CAST(x // 7 AS BIGINT) AS l_orderkey, CAST(x % 7 + 1 AS INT) AS l_linenumber, CAST(x AS BIGINT) AS l_partkey, CAST(x % 5 AS BIGINT) AS l_suppkey, CAST(1 AS DOUBLE) AS l_quantity FROM range(40) t(x)")
    con.execute("CREATE TABLE supplier AS SELECT x AS s_suppkey FROM range(5) t(x)")
    for t in ("lineitem", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    out = own.op_line_findings(spark, str(tmp_path))
    want = con.execute("SELECT rule, line FROM (" + queries.ORACLE_SQL["op_line_findings"] + ")").fetchall()
    assert ("bad_column_count", 1) in want
    assert sorted(tuple(r) for r in out.select("rule", "line").collect()) == sorted(want)
