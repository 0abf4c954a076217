"""The store's methods over a small hierarchy with a shared exon."""

import pytest

from braidline.operators import fold
from braidline.store import FeatureNotFound, FeatureStore

ROWS = [
    ("g1", None, "c1", "gene", 100, 400, "+"), ("t1", "g1", "c1", "mRNA", 100, 400, "+"), ("t2", "g1", "c1", "mRNA", 100, 300, "+"),
    ("e1", "t1", "c1", "exon", 100, 150, "+"), ("e1", "t2", "c1", "exon", 100, 150, "+"), ("e2", "t1", "c1", "exon", 200, 400, "+"), ("g2", None, "c2", "gene", 5, 9, "-"),
]


@pytest.fixture(scope="module")
def store(spark):
    return FeatureStore(spark.createDataFrame(ROWS, "id string, parent string, seqid string, featuretype string, start_pos long, end_pos long, strand string"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_lookups(spark, store):
    assert store["g2"].seqid == "c2" and "e2" in store and "x" not in store
    with pytest.raises(FeatureNotFound):
        store.get("x")
    order = spark.createDataFrame([("g2", 0), ("x", 1), ("g1", 2)], "id string, ord int")
    assert [r.id for r in store.batched(order).collect()] == ["g2", "g1"]
    assert [r.id for r in store.scan("gene", order_by="length").collect()] == ["g2", "g1"]
    assert [r.id for r in store.scan(limit=("c1", 160, 180)).collect()] == ["g1", "t1", "t2"]
    with pytest.raises(ValueError):
        store.scan(order_by="1; drop")


def test_hierarchy(spark, store):
    g = spark.createDataFrame([("g1",)], "anchor string")
    assert ids(store.children(g, level=1)) == ["t1", "t2"]
    assert ids(store.children(g, featuretype="exon", distinct=True).select("id", "start_pos").distinct()) == ["e1", "e2"]
    assert [r.bp for r in store.children_bp(g).collect()] == [252]
    e = spark.createDataFrame([("e2",)], "anchor string")
    assert ids(store.parents(e)) == ["g1", "t1"]


def test_changes(spark, store):
    less = store.delete(spark.createDataFrame([("t1",)], "id string"))
    g = spark.createDataFrame([("g1",)], "anchor string")
    assert ids(less.children(g).select("id").distinct()) == ["e1", "t2"] and "e2" in less
    more = store.add_relation("g2", "t2").children(spark.createDataFrame([("g2",)], "anchor string"), level=1)
    assert ids(more) == ["t2"]
    assert store.execute("SELECT count(*) AS n FROM {edges}").first().n == 5
    assert store.count("exon") == 3


def test_save(store, tmp_path):
    store.save(str(tmp_path / "s"))
    assert FeatureStore.open(store.features.sparkSession, str(tmp_path / "s")).count() == len(ROWS)


def test_fold(spark, store):
    rows = [(f"f{i}", "c", "exon", a, b, s) for i, (a, b, s) in enumerate([(1, 5, "+"), (4, 9, "-"), (6, 8, "+"), (20, 30, "+"), (31, 40, "+")])]
    df = spark.createDataFrame(rows, "id string, seqid string, featuretype string, start_pos long, end_pos long, strand string")
    want = fold.fold_rows([r.asDict() for r in df.orderBy("start_pos", "end_pos", "id").collect()])
    got = fold.merge_with(df).orderBy("start_pos", "id").collect()
    assert [(r.start_pos, r.end_pos, r.n_parts) for r in got] == [(w["start_pos"], w["end_pos"], w["n_parts"]) for w in want] == [(1, 5, 1), (4, 9, 1), (6, 8, 1), (20, 40, 2)]


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "k long, v double")
    r = fold.bootstrap_mean(df, "k", "v", 300).first()
    assert r.low < r.mean == 4.5 < r.high and 0.3 < r.high - r.low < 0.9
