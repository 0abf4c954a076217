"""Near-duplicate joins send no table through the driver, however small its files are."""

from braidline.llm import components, simhash
from braidline.llm.common import stage_table


def test_no_join_broadcasts(spark, monkeypatch):
    plans = []

    def ran(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    def staged(df, name):
        ran(df)
        return stage_table(df, name)

    for module in (components, simhash):
        monkeypatch.setattr(module, "stage_table", staged)
    chain = [((1 << i) - 1, 100 - i) for i in range(40)]
    got = ran(simhash.grouped(spark.createDataFrame([*chain, (0x5555555555555555, 7)], "fp long, id long")))
    assert {r.fp: r.component_id for r in got} == {fp: 61 for fp, _ in chain} | {0x5555555555555555: 7}
    texts = [(i, f"text {i % 3} of nine, three of them copies of each other") for i in range(9)]
    got = ran(simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert sorted(r.doc_id for r in got) == [*range(9)]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
