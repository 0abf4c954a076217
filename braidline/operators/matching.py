"""Largest matchings of ortholog pairs, component by component."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components


def connected(pairs: DataFrame) -> DataFrame:
    """(source, target, component): the least node name reachable."""
    named = pairs.select(F.concat(F.lit("s"), "source").alias("a"), F.concat(F.lit("t"), "target").alias("b"))
    label = components(named).filter("node LIKE 's%'").select(F.expr("substring(node, 2)").alias("source"), "component")
    return pairs.join(label, "source")


def augmenting(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Source to target of a largest matching; nodes are tried in order of name."""
    near: dict[str, list[str]] = {}
    for s, t in sorted(edges):
        near.setdefault(s, []).append(t)
    owner: dict[str, str] = {}
    for root in near:
        # breadth first over alternating paths, so depth is no matter of recursion
        back: dict[str, str] = {}
        queue, free = [root], None
        for s in queue:
            for t in near[s]:
                if t in back:
                    continue
                back[t] = s
                if t not in owner:
                    free = t
                    break
                queue.append(owner[t])
            if free is not None:
                break
        while free is not None:
            s = back[free]
            before = next((t for t, o in owner.items() if o == s), None)
            owner[free] = s
            free = before
            if free is not None:
                del owner[free]
    return {s: t for t, s in owner.items()}


def largest_matching(pairs: DataFrame) -> DataFrame:
    """(source, target) of a largest one-to-one matching of string pairs.

    Components are ortholog groups, which are small; each is matched in a task.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = augmenting(list(frame[["source", "target"]].itertuples(index=False, name=None)))
        return pd.DataFrame(sorted(found.items()), columns=["source", "target"], dtype=object)

    return connected(pairs.distinct()).groupBy("component").applyInPandas(run, "source string, target string")
