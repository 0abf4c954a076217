"""Parent-child edges, their bounded closure, and relation lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stage


def edges(features: DataFrame) -> DataFrame:
    """(parent, child); a bag, as the input has them."""
    return features.filter(F.col("parent").isNotNull()).select("parent", F.col("id").alias("child"))


def closure(pairs: DataFrame, max_depth: int = 8) -> DataFrame:
    """(ancestor, descendant, depth) up to ``max_depth``; several ways give several rows.

    Each level joins the one before with the edges once; it ends early when a level
    is empty, and a cycle ends by the depth.
    """
    level = pairs.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).cast("long").alias("depth"))
    out = level
    for depth in range(2, max_depth + 1):
        step = pairs.select(F.col("parent").alias("descendant"), F.col("child").alias("next"))
        level = level.join(step, "descendant").select("ancestor", F.col("next").alias("descendant"), F.lit(depth).cast("long").alias("depth"))
        if depth < max_depth and level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed once: a stage table in the shared folder."""
    return stage(df, "settled")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the least node reachable.

    In each round every node points at the least of itself and its neighbours, pointers
    are followed once more, and links are drawn between what their ends point at, until
    none is left: about log(longest path) rounds.
    """
    links, label = links.select("a", "b"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        step = settled(least.join(least.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("component")))
        if label is None:
            label = step
        else:
            label = settled(label.join(step.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        ends = [step.select(F.col("node").alias(c), F.col("component").alias(f"l{c}")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").filter("la <> lb")
        links = settled(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if links.isEmpty():
            return label


def walk(anchors: DataFrame, pairs: DataFrame, reached: DataFrame, depth: int, bound: int, up: bool = False) -> DataFrame:
    """(ancestor, descendant, depth) of the anchors from below ``depth`` on to ``bound``.

    It goes on from the rows of the closure ``reached`` that have this depth, and
    ends early when a level is empty; a cycle ends by the bound.
    """
    near, far = ("descendant", "ancestor") if up else ("ancestor", "descendant")
    own = anchors.select(F.col("anchor").alias(near)).distinct()
    level = reached.filter(F.col("depth") == depth).join(own, near, "left_semi").select("ancestor", "descendant", "depth")
    step = pairs.select(F.col("child" if up else "parent").alias(far), F.col("parent" if up else "child").alias("next"))
    out = level.limit(0)
    for below in range(depth + 1, bound + 1):
        level = settled(level.join(step, far).select(near, F.col("next").alias(far), F.lit(below).cast("long").alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def relatives(anchors: DataFrame, pairs: DataFrame, features: DataFrame, up: bool = False, featuretype: str | None = None, level: int | None = None, distinct: bool = False) -> DataFrame:
    """Features below (or above) the anchors (column ``anchor``), with their depth."""
    near, far = ("descendant", "ancestor") if up else ("ancestor", "descendant")
    found = pairs if level is None else pairs.filter(F.col("depth") == level)
    found = anchors.join(found.withColumnRenamed(near, "anchor"), "anchor")
    own = features if featuretype is None else features.filter(F.col("featuretype") == featuretype)
    out = found.join(own.withColumnRenamed("id", far), far).withColumnRenamed(far, "id")
    return out.distinct() if distinct else out


def without(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Delete: the features whose id is not listed; descendants stay."""
    return features.join(ids.select("id").distinct(), "id", "left_anti")


def orphans(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Edges whose parent is no feature."""
    return pairs.join(features.select(F.col("id").alias("parent")), "parent", "left_anti")


def tops(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Features that are nobody's child."""
    return features.join(pairs.select(F.col("child").alias("id")).distinct(), "id", "left_anti")


def copy_suffix(name: Column) -> Column:
    """The id without a trailing ``_N``."""
    return F.regexp_replace(name, r"_\d+$", "")


def roles(features: DataFrame) -> DataFrame:
    """(id, role): ``parent`` without a parent of its own, ``intermediate`` with one and
    with children, else ``child``."""
    has = edges(features).select(F.col("parent").alias("id"), F.lit(True).alias("has")).distinct()
    role = F.when(F.col("parent").isNull(), "parent").when(F.col("has"), "intermediate").otherwise("child")
    return features.join(has, "id", "left").select("id", role.alias("role"))
