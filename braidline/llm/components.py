"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, unsent


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    In each round every node points at the least of itself and its neighbours,
    pointers are followed once more, and edges are drawn between what their ends
    point at; equal edges and loops go.  The graph shrinks by a factor in every
    round, so there are about log(longest path) rounds, each of a few joins over
    tables in the shared folder; nothing is collected or broadcast.
    """
    links = edges.select("a", "b")
    held: DataFrame | None = None
    turn = 0
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = stage_table(least, f"least{turn}")
        step = least.join(unsent(least.select(F.col("node").alias("to"), F.col("to").alias("next"))), "to").select("node", F.col("next").alias("root"))
        step = stage_table(step, f"step{turn}")
        if held is None:
            held = step
        else:
            held = held.join(unsent(step.select(F.col("node").alias("root"), F.col("root").alias("next"))), "root", "left")
            held = stage_table(held.select("node", F.coalesce("next", "root").alias("root")), f"held{turn}")
        of_a, of_b = (unsent(step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))) for c in "ab")
        moved = links.join(of_a, "a").join(of_b, "b").filter("ra <> rb")
        links = stage_table(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{turn}")
        turn += 1
        if links.isEmpty():
            return held
