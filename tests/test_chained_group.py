"""A chained ortholog group, wider than fifty hops, is one component."""

import random

from braidline.operators.matching import connected, largest_matching


def test_a_chained_group_is_matched_as_one(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = [(f"s{order[i]:02}", f"t{i:02}") for i in range(60)] + [(f"s{order[i + 1]:02}", f"t{i:02}") for i in range(59)]
    pairs = spark.createDataFrame(edges + [("z", "z")], "source string, target string").repartition(3)
    assert {r.component for r in connected(pairs).collect()} == {"ss00", "sz"}
    got = [(r.source, r.target) for r in largest_matching(pairs).collect()]
    assert len(got) == 61 == len({s for s, _ in got}) == len({t for _, t in got}) and set(got) <= {*edges, ("z", "z")}
