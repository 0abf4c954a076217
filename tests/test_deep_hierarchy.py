"""Relations beyond the depth of the stored closure."""

from braidline.store import FeatureStore

KIND = "id string, parent string, seqid string, featuretype string, start_pos long, end_pos long, strand string"


def chain(spark, n, max_depth=8):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, "c", "exon" if i == n else "part", 10 * i + 1, 10 * i + 10, "+") for i in range(n + 1)]
    return FeatureStore(spark.createDataFrame(rows + [("alone", None, "c", "part", 1, 2, "+")], KIND), max_depth)


def test_relations_below_and_above_the_closure(spark):
    store = chain(spark, 12)
    top, low = (spark.createDataFrame([(x,), ("alone",)], "anchor string") for x in ("n0", "n12"))
    assert {(r.anchor, r.id, r.depth) for r in store.children(top).collect()} == {("n0", f"n{i}", i) for i in range(1, 13)}
    assert {(r.anchor, r.id, r.depth) for r in store.parents(low).collect()} == {("n12", f"n{i}", 12 - i) for i in range(12)}
    assert [(r.id, r.depth) for r in store.children(top, level=11).collect()] == [("n11", 11)]
    assert [(r.id, r.depth) for r in store.parents(low, level=9).collect()] == [("n3", 9)]
    assert store.children(top, level=13).count() == 0 and store.children(top).count() == 12
    assert [(r.anchor, r.bp) for r in store.children_bp(top).collect()] == [("n0", 10)]


def test_a_cycle_ends_at_the_bound(spark):
    store = chain(spark, 1, 2).add_relation("n1", "n0")
    depths = [r.depth for r in store.children(spark.createDataFrame([("n0",)], "anchor string")).collect()]
    assert sorted(depths) == list(range(1, 65))
