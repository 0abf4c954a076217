"""Pairing, chains, line checks and admission make no pairs, tasks or passes that grow beyond their rows."""

import random

from pyspark.sql import functions as F

from braidline import hierarchy_queries, queries
from braidline.operators import fusion, interval, rescue, validate


def test_pairing_looks_outside_the_transcript_only(spark, monkeypatch):
    rng = random.Random(8)
    span = lambda w: (a := rng.randint(1, 20_000), a + rng.randint(0, w))
    genes = [(f"g{i}", f"c{i % 2}", *span(300)) for i in range(60)]
    tx = [(f"t{i}", f"r{i % 25}", f"c{i % 2}", *span(3000)) for i in range(50)]
    models = [(f"m{i}", f"r{i % 25}", f"c{i % 2}", *span(5000), rng.randint(0, 9) / 10) for i in range(400)]
    touched = lambda q, a, b: {g[0] for g in genes if g[1] == q and g[2] <= b and g[3] >= a}
    want = {}
    for t in tx:
        ok = [(-m[5], m[0]) for m in models if m[1:3] == t[1:3] and m[3] <= t[4] and m[4] >= t[3] and not touched(m[2], m[3], m[4]) - touched(t[2], t[3], t[4])]
        if ok:
            want[t[0]] = min(ok)[1]
    place = "seqid string, start_pos long, end_pos long"
    monkeypatch.setattr(interval, "overlap_join", None)  # no pairs with genes
    got = rescue.locus_pairing(spark.createDataFrame(models, f"id string, reference string, {place}, identity double"), spark.createDataFrame(tx, f"id string, reference string, {place}"), spark.createDataFrame(genes, f"id string, {place}"))
    assert want and {r.transcript: r.model for r in got.collect()} == want


def test_whole_genes_are_paired_with():
    assert "200" not in queries.ORACLE_SQL["op_locus_pairing"]


def test_chains_are_made_in_batches(spark):
    blocks = spark.createDataFrame([("g", "c", 0, 9, 100, 109, 1), ("g", "c", 10, 19, 110, 119, 0), ("h", None, 5, 6, 7, 8, 0)], "gene string, seqid string, query_start long, query_end long, target_start long, target_end long, mismatches long")
    out = fusion.chain_blocks(blocks)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.gene, r.query_start, r.cost, r.place) for r in out.collect()) == [("g", 0, 2.0, 0), ("g", 10, 2.0, 1), ("h", 5, 0.0, 0)]


def test_lines_are_read_three_times_at_most(spark):
    rows = spark.range(9).select(F.col("id").alias("line"), F.lit("c\tx").alias("value"))
    assert validate.lines(rows, spark.createDataFrame([("c",)], "seqid string"))._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 9") <= 3


def test_admission_searches_no_list():
    rows = [("c", 10 * i, 10 * i + 5, f"m{i:06}", f"g{i}") for i in range(100_000)] + [("c", 7, 6, "x", "gx")]
    assert len(list(fusion.admit_greedily(iter(rows)))) == 100_001  # quadratic, this would take minutes


def test_ids_and_blocks_take_one_shuffle(spark):
    wanted = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("d", "h")], "owner string, base string")
    out = rescue.allocated_ids(wanted, spark.createDataFrame([("cds-g",), ("cds-g-2",), ("cds-h-1",)], "id string"))
    assert {r.owner: r.id for r in out.collect()} == {"a": "cds-g-1", "b": "cds-g-3", "c": "cds-g-4", "d": "cds-h"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    order = hierarchy_queries.op_hierarchy_order(spark, "/root/testdata/sf0.001")
    assert "Join" not in order._jdf.queryExecution().optimizedPlan().toString()
