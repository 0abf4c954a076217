"""Largest matchings against exhaustive search."""

import itertools
import random

from braidline.operators.matching import augmenting, largest_matching


def best(edges):
    sources = sorted({s for s, _ in edges})
    near = {s: [t for a, t in edges if a == s] + [None] for s in sources}
    return max(len([t for t in pick if t]) for pick in itertools.product(*(near[s] for s in sources)) if len(set(t for t in pick if t)) == len([t for t in pick if t]))


def test_augmenting():
    rng = random.Random(3)
    for _ in range(60):
        edges = [(f"s{a}", f"t{b}") for a in range(5) for b in range(5) if rng.random() < 0.35]
        if not edges:
            continue
        got = augmenting(edges)
        assert len(got) == best(edges) == len(set(got.values())) and set(got.items()) <= set(edges)


def test_largest_matching(spark):
    edges = [("a", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("d", "z")]
    got = largest_matching(spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(got) == 3 and {(r.source, r.target) for r in got} <= set(edges)
