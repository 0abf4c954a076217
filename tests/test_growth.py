"""What a query shuffles, holds and repeats does not grow faster than its input."""

import os

from braidline.sources import model, stage

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def unbroadcast(spark, make):
    """``make()`` as it is planned for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return planned(make())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_items_are_dealt_out_once(spark):
    plan = unbroadcast(spark, lambda: model.derived_exons(spark, SF))
    # line items; orders and customers for their join; orders once more, by order
    assert plan.count("Exchange ") == 4 and plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_a_kind_of_feature_is_read_alone(spark):
    f = model.features(spark, SF)
    assert leaves(f) == 3 and leaves(f.filter("featuretype = 'gene'")) == 1


def test_tasks_follow_the_bytes_that_are_read(spark, monkeypatch):
    lines = model.table(spark, SF, "lineitem")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stage.tasks(lines) == least and stage.spread(lines, "l_orderkey") is lines
    monkeypatch.setattr(stage, "TASK_BYTES", 1 << 12)
    assert stage.tasks(lines, lines) > stage.tasks(lines) > least
    assert stage.spread(lines, "l_orderkey").rdd.getNumPartitions() == stage.tasks(lines)


def test_structure_joins_children_with_parents_once(spark):
    from braidline.operators.validate import structure

    rows = [("g", None, "c", "gene", 1, 90, "+"), ("t", "g", "c", "mRNA", 1, 99, "-"), ("x", "t", "d", "exon", 2, 3, "-"), ("h", None, "c", "gene", 1, 9, "+"), ("y", "h", "c", "exon", 1, 2, "+"), ("y", None, "c", "mRNA", 1, 2, "+")]
    found = structure(spark.createDataFrame(rows, "id string, parent string, seqid string, featuretype string, start_pos long, end_pos long, strand string"))
    # the second y is an mRNA, so h has one below it, as its id says
    assert sorted(tuple(r) for r in found.collect()) == [("duplicate_id", "y"), ("outside_parent", "t"), ("sequence_differs", "x"), ("strand_differs", "t"), ("transcript_without_exon", "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("up_strand") < 8
