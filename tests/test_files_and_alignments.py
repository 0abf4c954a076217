"""Files in and out, the store's other methods, long alignments, frames, merge criteria."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from braidline.functions import align
from braidline.operators import fold, lifting
from braidline.operators.evaluate import paired_bootstrap
from braidline.sources import attributes as at
from braidline.sources import sam, writer
from braidline.store import FeatureStore

GFF = """##gff-version 3
##sequence-region chr1 1 900
#!genome-build X
chr1\tsrc\tgene\t1\t90\t.\t+\t.\tID=g1;Name=a%3Bb;Alias=x,y
chr1\tsrc\tmRNA\t1\t90\t.\t+\t.\tID=t1;Parent=g1
chr1\tsrc\texon\t1\t30\t.\t+\t.\tParent=t1
chr1\tsrc\texon\t50\t90\t.\t+\t.\tParent=t1
chr1\tsrc\tCDS\t5\t30\t0.5\t+\t0\tID=c1;Parent=t1
chr1\tsrc\tCDS\t50\t60\t.\t+\t1\tID=c1;Parent=t1
chr1\tsrc\tgene\t0\t90\t.\t+\t.\tID=bad
##FASTA
>chr1
ACGT
"""


@pytest.fixture(scope="module")
def store(spark):
    return at.create_store(spark, at.from_string(spark, GFF))


def test_store_from_text(spark, store):
    rows = {r.id: r for r in store.features.collect()}
    assert set(rows) == {"g1", "t1", "exon_1", "exon_2", "c1", "c1__2"}
    assert rows["g1"].attrs == {"ID": ["g1"], "Name": ["a;b"], "Alias": ["x", "y"]} and rows["c1"].score == "0.5"
    assert sorted(tuple(r) for r in store.edges.collect()) == [("g1", "t1"), ("t1", "c1"), ("t1", "c1__2"), ("t1", "exon_1"), ("t1", "exon_2")]
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(store.region("chr1:31-49")) == ids(store.region(("chr1", 31, 49))) == ["g1", "t1"]
    assert ids(store.region(store.get("exon_1"))) == ["c1", "exon_1", "g1", "t1"]
    (up, kids), = store.by_parent("mRNA", "exon")
    assert up.id == "t1" and [k.id for k in kids] == ["exon_1", "exon_2"]
    gone = store.transform(lambda f: f.filter("featuretype <> 'CDS'"))
    assert gone.count() == 4 and gone.edges.count() == 3
    more = store.add_relation("g1", "exon_1", child_func=lambda f: f.withColumn("strand", F.lit("-")))
    assert more.get("exon_1")["strand"] == "-" and more.edges.count() == 6 and more.count() == store.count()
    assert [r.id for r in store.page(2).collect()] == ["g1", "t1"] and [r.id for r in store.page(2, "t1").collect()] == ["exon_1", "exon_2"]


def test_hierarchy_file_and_directives(spark, store, tmp_path):
    tops = spark.createDataFrame([("g1", "g1", None), *((i, "g1", "t1") for i in ("t1", "exon_1", "exon_2", "c1", "c1__2"))], "id string, gene string, transcript string")
    writer.write_hierarchy(store.features, tops, f"{tmp_path}/gff")
    lines = [r.value.split("\t") for r in spark.read.text(f"{tmp_path}/gff").collect()]
    assert [(x[2], x[3]) for x in lines] == [("gene", "1"), ("mRNA", "1"), ("exon", "1"), ("exon", "50"), ("CDS", "5"), ("CDS", "50")]
    assert lines[0][8] == "ID=g1;Alias=x,y;Name=a%3Bb" and lines[4][5] == "0.5" and lines[5][7] == "1"
    from braidline.sources import gff

    kept = writer.kept_directives(gff.directives(at.from_string(spark, GFF)))
    assert [r.directive for r in kept.collect()] == ["##gff-version 3"]
    with pytest.raises(Exception, match="no place to write"):
        bad = store.features.withColumn("start_pos", F.lit(0).cast("long"))
        bad.select(writer.full_line(bad)).collect()


def test_publish_and_export(spark, store, tmp_path):
    df = spark.range(5)
    writer.publish(df, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 5
    with pytest.raises(FileExistsError):
        writer.publish(df, f"{tmp_path}/a")
    with pytest.raises(ValueError):
        writer.publish(df, f"{tmp_path}/b", check=lambda t: t.count() > 5)
    assert not (tmp_path / "b").exists() and (tmp_path / "b.partial").exists()
    writer.export_sqlite(store, f"{tmp_path}/x.db", batch=2)
    con = sqlite3.connect(f"{tmp_path}/x.db")
    assert con.execute("SELECT count(*) FROM features").fetchone() == (6,) and con.execute("SELECT count(*) FROM relations WHERE level = 2").fetchone() == (4,)
    one, two = (writer.run_manifest({"f": d}).first() for d in (df.repartition(3), df))
    assert one == two and one.n_rows == 5
    writer.write_table(spark.createDataFrame([("a", 1), ("b", None)], "x string, y int"), f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["a\t1", "b\t"]
    (tmp_path / "list").write_text("# pairs\nchr1, 1\n\nchr2,2\n")
    assert [tuple(r) for r in at.read_list(spark, f"{tmp_path}/list").collect()] == [("chr1", "1"), ("chr2", "2")]


def test_sam_header(spark):
    lines = spark.createDataFrame([("@SQ\tSN:chr1\tLN:77",), ("q\t0\tchr1\t5\t9\t4M\t*\t0\t0\t*\t*",)], "value string")
    assert [tuple(r) for r in sam.sequences(lines).collect()] == [("chr1", 77)]
    assert sam.blocks(sam.alignments(lines)).first().asDict() == {"query": "q", "target": "chr1", "strand": "+", "query_start": 0, "query_end": 3, "target_start": 4, "target_end": 7}
    with pytest.raises(sam.NoSequences):
        sam.alignments(lines.filter("value NOT LIKE '@%'"))


def test_long_alignments_are_as_good_as_whole_ones():
    rng = random.Random(2)
    for _ in range(6):
        a = "".join(rng.choice("ACGT") for _ in range(700))
        b = list(a)
        for _ in range(25):
            i = rng.randrange(len(b))
            b[i:i + rng.randint(0, 2)] = rng.choice(["", "A", "CG", "T"])
        b = "".join(b)
        p, q = align.anchored_alignment(a, b, limit=100)
        assert p.replace("-", "") == a and q.replace("-", "") == b and len(p) == len(q)
        same = lambda x, y: sum(c == d for c, d in zip(x, y))
        assert same(p, q) >= 0.97 * same(*align.global_alignment(a, b)[1:])
    assert align.anchored_alignment("", "AC") == ("--", "AC")
    far = ("A" * 300, "C" * 250)
    p, q = align.anchored_alignment(*far, limit=100)
    assert p.replace("-", "") == far[0] and q.replace("-", "") == far[1]


def test_scores_of_a_matrix():
    table = align.score_table("# a note\n   A  R  N\nA  4 -1 -2\nR -1  5  0\nN -2  0  6\n")
    score, p, q = align.global_alignment("ARNA", "ARA", open_=11, extend=1, table=table)
    assert (score, p, q) == (4 + 5 + 4 - 11, "ARNA", "AR-A")
    assert align.clean_dna("acgtRYn") == "ACGTNNN"


def test_frames_and_their_parts():
    frame = "ATGGCTGCTAAATAA"
    seq = "CC" + frame + "GATGTAGC"
    start, end, identity = align.chosen_frame(seq, "MAAK*", 0.5)
    assert seq[start:end] == frame and identity == 1.0
    assert align.chosen_frame(seq, "MAAK*", 0.995) is None
    parts = [(101, 110), (201, 230)]
    assert align.frame_parts(parts, "+", 2, 17) == [(103, 110), (201, 207)]
    assert align.frame_parts(parts, "-", 2, 35) == [(106, 110), (201, 228)]
    assert align.variants("A", "A", "M", "M", 0.5, 0.5, coding=False) == ["non_coding"]


def test_merge_criteria():
    row = lambda a, b: {"start_pos": a, "end_pos": b}
    acc = row(100, 200)
    cases = [(fold.reaches_back(), [(50, 99), (50, 100), (150, 200)], [(50, 98), (150, 201)]), (fold.touches(), [(201, 300), (50, 99)], [(202, 300), (20, 98)]),
             (fold.near_end(5), [(195, 400), (205, 400)], [(206, 400), (194, 400)]), (fold.near_start(5), [(1, 95), (1, 105)], [(1, 94), (1, 106)]), (fold.near(5), [(205, 400), (1, 95)], [(206, 400)])]
    for criterion, yes, no in cases:
        assert all(criterion(acc, row(*x), []) for x in yes) and not any(criterion(acc, row(*x), []) for x in no)


def test_conflicts_are_settled(spark):
    kind = "id string, seqid string, strand string, start_pos long, end_pos long, is_copy boolean, ref_seqid string, ref_start long, ref_end long, identity double, displacement long"
    rows = [("a", "c", "+", 1, 100, False, "r", 1, 100, 0.9, 0), ("b", "c", "+", 50, 150, False, "r", 500, 600, 0.8, 0), ("c", "c", "+", 140, 200, False, "r", 900, 960, 0.7, 0),
            ("d", "c", "-", 1, 100, True, "r", 1, 100, 0.2, 0), ("e", "c", "+", 60, 90, True, "r", 70, 99, 1.0, 0), ("f", "c", "+", 100, 130, True, "r", 2000, 2030, 1.0, 0)]
    lifted = spark.createDataFrame(rows, kind)
    # all losers of a round go together; those that get a place again stay if it is free then
    for again, want in ((lambda gone: gone.limit(0), ["a", "d"]), (lambda gone: gone.filter("id = 'c'"), ["a", "c", "d"])):
        assert sorted(r.id for r in lifting.settle(lifted, again).collect()) == want


def test_bootstrap_is_that_of_its_pairs(spark):
    rows = [("g", f"k{i}", i % 7 - 3.0) for i in range(200)] + [("h", "only", 0.25)]
    df = spark.createDataFrame(rows, "grp string, key string, delta double")
    one = {r.grp: r for r in paired_bootstrap(df.repartition(5), "grp", "key", "delta", 300).collect()}
    two = {r.grp: r for r in paired_bootstrap(df, "grp", "key", "delta", 300).collect()}
    assert one == two and one["h"].asDict() == {"grp": "h", "low": 0.25, "high": 0.25, "replicates": 1}
    assert one["g"].low < 0 < one["g"].high and one["g"].replicates == 300


def test_pages_walk_the_store(spark):
    own = spark.createDataFrame([(f"f{i}",) for i in range(7)], "id string")
    store = FeatureStore(own, pairs=spark.createDataFrame([], "parent string, child string"))
    assert [r.id for r in store.page(3, "f1").collect()] == ["f2", "f3", "f4"]
