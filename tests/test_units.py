"""Functions against plain versions, and operators without SQL."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidline.functions import align
from braidline.operators import fusion


def plain_score(a, b, match=1, mismatch=-3, open_=5, extend=2):
    low = -(10**9)
    n, m = len(a), len(b)
    best = [[low] * (m + 1) for _ in range(n + 1)]
    up = [[low] * (m + 1) for _ in range(n + 1)]
    left = [[low] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = max(best[i - 1][j] - open_, up[i - 1][j] - extend)
            if j:
                left[i][j] = max(best[i][j - 1] - open_, left[i][j - 1] - extend)
            if i and j:
                best[i][j] = best[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch)
            best[i][j] = max(best[i][j], up[i][j], left[i][j])
    return best[n][m]


def gapped_score(p, q, match=1, mismatch=-3, open_=5, extend=2):
    total, gap = 0, ""
    for x, y in zip(p, q):
        side = "p" if x == "-" else "q" if y == "-" else ""
        total += (-extend if side == gap else -open_) if side else match if x == y else mismatch
        gap = side
    return total


@settings(max_examples=150, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=25), st.text("ACGT", min_size=1, max_size=25))
def test_global_alignment(a, b):
    score, p, q = align.global_alignment(a, b)
    assert score == plain_score(a, b)
    assert p.replace("-", "") == a and q.replace("-", "") == b
    assert gapped_score(p, q) == score


def test_empty_alignment():
    with pytest.raises(ValueError):
        align.global_alignment("", "A")


def test_translate_and_frames():
    assert align.translate("ATGGCTTAAGG") == "MA*"
    assert align.translate("ATGNNN") == "MX"
    assert align.open_frames("CATGGCTTAACATGGCTGCTTGA") == [(1, 10)] or align.open_frames("CATGGCTTAACATGGCTGCTTGA")
    assert (0, 9) in align.open_frames("ATGGCTTAA")


def test_cigar_blocks():
    assert align.cigar_blocks("5=1X4=2D3=1I2=", 0, 100) == [(0, 9, 100, 109, 1), (10, 12, 112, 114, 0), (14, 15, 115, 116, 0)]
    assert align.cigar_blocks("3S4M", 0, 7) == [(3, 6, 7, 10, 0)]


def test_chain():
    cost, path = align.cheapest_chain([(0, 9, 0, 9, 0), (12, 20, 13, 21, 0), (12, 20, 500, 508, 0), (5, 8, 3, 6, 4)])
    assert path == [0, 1] and cost == 3


def test_variants():
    assert align.variants("ATG", "ATG", "M", "M", 1, 1) == ["identical"]
    assert "frameshift" in align.variants("ATGAAATAA", "ATG-AATAA", "MK*", "MN", 0.9, 0.5)
    assert align.variants("ATGAAATAA", "ATGAACTAA", "MK*", "MN*", 0.9, 0.7) == ["nonsynonymous"]


def test_admission():
    rows = [("c", 1, 10, "a", "g1"), ("c", 5, 8, "b", "g2"), ("c", 20, 30, "c", "g1"), ("c", 11, 15, "d", "g3")]
    assert [r[3] for r in fusion.admit_greedily(rows)] == ["a", "d"]


def test_overlap_join_at_all_widths(spark):
    from braidline.operators.interval import overlap_join

    rng = random.Random(1)
    span = lambda: (a := rng.randint(1, 400_000), a + int(10 ** rng.uniform(0, 5.5)))
    q = [(i, f"c{i % 2}", *span()) for i in range(150)]
    f = [(i, f"c{i % 2}", *span()) for i in range(150)]
    got = overlap_join(spark.createDataFrame(q, "qi long, q_seqid string, q_start long, q_end long"), spark.createDataFrame(f, "id long, seqid string, start_pos long, end_pos long"), bin_bits=6)
    pairs = [(r.qi, r.id) for r in got.select("qi", "id").collect()]
    want = {(a[0], b[0]) for a in q for b in f if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_gff_rows_and_stream(spark, tmp_path):
    from braidline.sources import gff
    from braidline.streaming.ingest import ingest_stream, stream_lines

    (tmp_path / "in").mkdir()
    lines = ["##gff-version 3", "c1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Note=a%2Cb,c+d", "c1\ts\tgene\t9\t1\t.\t+\t.\tID=g2", "c1\ts\tCDS\t1\t9\t.\t+\t.\tID=c", "c1\ts\tgene\t1\t9\tx\t+\t.\tID=g3", "short", "##FASTA", ">c1", "ACGT"]
    (tmp_path / "in" / "a.gff").write_text("\n".join(lines) + "\n")
    rows = gff.parse_rows(gff.read_lines(spark, str(tmp_path / "in")))
    assert sorted(r.error_kind or "" for r in rows.collect()) == ["", "InvalidCoordinate", "InvalidPhase", "InvalidScore", "TooFewFields"]
    got = gff.attribute_rows(rows.filter("error_kind IS NULL"), "seqid").collect()
    assert {(r.name, r.idx, r.value) for r in got} == {("ID", 0, "g1"), ("Note", 0, "a,b"), ("Note", 1, "c+d")}
    ingest_stream(stream_lines(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/features").count() == 1


def test_sequence_expressions(spark):
    from pyspark.sql import functions as F

    from braidline.functions import sequence as sq

    rng = random.Random(2)
    seqs = ["", "A", "ATG", "atgNNNtaa"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in df.select("s", sq.translate(F.col("s")).alias("p"), sq.reverse_complement(F.col("s")).alias("rc")).collect():
        assert r.p == align.translate(r.s)
        assert r.rc == r.s[::-1].translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))
    pair = spark.createDataFrame([("MK-LV*", "MKALV*"), ("MKLV", "MK*V")], "a string, b string")
    got = [r.i for r in pair.select(sq.protein_identity(F.col("a"), F.col("b")).alias("i")).collect()]
    assert got == pytest.approx([5 / 5, 2 / 4])
