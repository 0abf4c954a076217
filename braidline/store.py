"""The annotation store: features, edges and closure behind one object.

All methods are lazy and give DataFrames, but for ``get``, ``__contains__`` and
``count``.  Features have id, parent, seqid, featuretype, start_pos, end_pos, strand
and, if the source has an order, file_order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import interval as iv
from .plans import graph

ORDERS = {"seqid", "source", "featuretype", "start_pos", "end_pos", "score", "strand", "frame", "file_order", "length"}


class FeatureNotFound(KeyError):
    """No feature has the id that was asked for."""


class FeatureStore:
    def __init__(self, features: DataFrame, max_depth: int = 8, pairs: DataFrame | None = None) -> None:
        self.features, self.max_depth = features, max_depth
        self.edges = graph.edges(features) if pairs is None else pairs

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FeatureStore:
        """A store that ``save`` wrote."""
        return cls(spark.read.parquet(f"{path}/features"), pairs=spark.read.parquet(f"{path}/edges"))

    def save(self, path: str) -> None:
        """Features in order of place, so that a region reads few row groups; and edges."""
        self.features.repartitionByRange("seqid", "start_pos").sortWithinPartitions("seqid", "start_pos").write.parquet(f"{path}/features")
        self.edges.write.parquet(f"{path}/edges")

    @cached_property
    def closure(self) -> DataFrame:
        return graph.closure(self.edges, self.max_depth)

    # lookups and scans

    def get(self, id: str) -> Row:
        """The feature with an id; raises FeatureNotFound."""
        found = self.features.filter(F.col("id") == id).take(1)
        if not found:
            raise FeatureNotFound(id)
        return found[0]

    __getitem__ = get

    def __contains__(self, id: str) -> bool:
        return bool(self.features.filter(F.col("id") == id).take(1))

    def batched(self, ids: DataFrame) -> DataFrame:
        """The features with ids (id, ord) in the order ``ord``; what is missing is left out."""
        return self.features.join(ids, "id").orderBy("ord")

    def scan(self, featuretype: str | Iterable[str] | None = None, strand: str | None = None, limit: tuple[str, int, int] | None = None, within: bool = False, order_by: str | Iterable[str] | None = None, reverse: bool = False) -> DataFrame:
        """All features that meet the conditions; ties go by file order (if any) and id."""
        out = self.features if limit is None else iv.region(self.features, *limit, within=within)
        if featuretype is not None:
            kinds = [featuretype] if isinstance(featuretype, str) else list(featuretype)
            out = out.filter(F.col("featuretype").isin(kinds))
        if strand is not None:
            out = out.filter(F.col("strand") == strand)
        return out.orderBy(*self._order(order_by, reverse))

    def _order(self, order_by: str | Iterable[str] | None, reverse: bool) -> list[Column]:
        names = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
        if unknown := set(names) - ORDERS:
            raise ValueError(f"cannot order by {sorted(unknown)}")
        keys = [iv.length() if n == "length" else F.col(n) for n in names]
        keys = [k.desc() if reverse else k.asc() for k in keys]
        return keys + [F.col(c).asc() for c in ("file_order", "id") if c in self.features.columns]

    def page(self, n: int, after: str | None = None) -> DataFrame:
        """The next ``n`` features by file order (those without one last) and id, after the feature ``after``."""
        order = [F.coalesce(F.col("file_order"), F.lit(2**63 - 1))] if "file_order" in self.features.columns else []
        key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate([*order, F.col("id")])))
        out = self.features.withColumn("_key", key)
        if after is not None:
            seen = out.filter(F.col("id") == after).agg(F.min("_key").alias("seen"))
            out = out.filter(F.col("_key") > seen.scalar())
        return out.orderBy("_key").limit(n).drop("_key")

    def region(self, seqid: str | tuple | Row, start: int | None = None, end: int | None = None, within: bool = False) -> DataFrame:
        """Features of a place: a sequence with bounds, ``seqid:start-end``, a tuple or a feature."""
        if isinstance(seqid, Row):
            seqid, start, end = seqid["seqid"], seqid["start_pos"], seqid["end_pos"]
        elif isinstance(seqid, tuple):
            seqid, start, end = (*seqid, None, None)[:3]
        elif start is None and end is None and (place := re.fullmatch(r"(.+):(\d+)-(\d+)", seqid)):
            seqid, start, end = place[1], int(place[2]), int(place[3])
        return iv.region(self.features, seqid, start, end, within)

    def region_batched(self, regions: DataFrame, within: bool = False, featuretype: str | None = None) -> DataFrame:
        """Features for each region (query_idx, q_seqid, q_start, q_end)."""
        own = self.features if featuretype is None else self.features.filter(F.col("featuretype") == featuretype)
        out = iv.overlap_join(regions, own)
        return out.filter("start_pos >= q_start AND end_pos <= q_end") if within else out

    # hierarchy

    def children(self, anchors: DataFrame, level: int | None = None, featuretype: str | None = None, distinct: bool = False) -> DataFrame:
        """Features below each anchor (column ``anchor``), with their depth.

        Without a level the walk ends at the greater of 64 and four times ``max_depth``.
        """
        return graph.relatives(anchors, self._reach(anchors, level, False), self.features, False, featuretype, level, distinct)

    def parents(self, anchors: DataFrame, level: int | None = None, featuretype: str | None = None, distinct: bool = False) -> DataFrame:
        """Features above each anchor, as ``children`` has those below."""
        return graph.relatives(anchors, self._reach(anchors, level, True), self.features, True, featuretype, level, distinct)

    def _reach(self, anchors: DataFrame, level: int | None, up: bool) -> DataFrame:
        """The closure, and what lies beyond it for the anchors that reach its depth."""
        if level is not None and level <= self.max_depth:
            return self.closure
        bound = max(64, 4 * self.max_depth) if level is None else level
        return self.closure.unionByName(graph.walk(anchors, self.edges, self.closure, self.max_depth, bound, up))

    def children_bp(self, anchors: DataFrame, featuretype: str = "exon", merge: bool = True) -> DataFrame:
        """Bases below each anchor, each counted once with ``merge``."""
        below = self.children(anchors, featuretype=featuretype)
        parts = iv.islands(below, ["anchor"]) if merge else below
        return parts.groupBy("anchor").agg(F.sum(iv.length()).alias("bp"))

    # counts

    def count(self, featuretype: str | None = None) -> int:
        return (self.features if featuretype is None else self.features.filter(F.col("featuretype") == featuretype)).count()

    def featuretypes(self) -> DataFrame:
        return self.features.select("featuretype").distinct().orderBy("featuretype")

    def seqids(self) -> DataFrame:
        return self.features.select("seqid").distinct().orderBy("seqid")

    # interval algebra

    def merge(self, featuretype: str) -> DataFrame:
        return iv.islands(self.features.filter(F.col("featuretype") == featuretype), ["seqid", "strand", "featuretype"], bits=20)

    def introns(self, child: str = "exon") -> DataFrame:
        return iv.gaps(self.features.filter(F.col("featuretype") == child), ["parent"])

    def splice_sites(self, child: str = "exon") -> DataFrame:
        return iv.splice_sites(self.introns(child))

    def bed12(self, parent: str = "mRNA", child: str = "exon") -> DataFrame:
        f = self.features
        return iv.bed12(f.filter(F.col("featuretype") == parent).drop("parent"), f.filter(F.col("featuretype") == child).select("parent", "start_pos", "end_pos"))

    # changes give a new store

    def delete(self, ids: DataFrame) -> FeatureStore:
        """Without these features and the edges at them; descendants stay."""
        gone = ids.select("id").distinct()
        pairs = self.edges.join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("id", "child"), "child", "left_anti")
        return FeatureStore(graph.without(self.features, gone), self.max_depth, pairs.select("parent", "child"))

    def update(self, more: DataFrame) -> FeatureStore:
        """With more features; their parents become edges too."""
        return FeatureStore(self.features.unionByName(more), self.max_depth, self.edges.unionByName(graph.edges(more)))

    def add_relation(self, parent: str, child: str, parent_func: Callable[[DataFrame], DataFrame] | None = None, child_func: Callable[[DataFrame], DataFrame] | None = None) -> FeatureStore:
        """With one more edge; the functions may change the row of either feature."""
        own = self.features
        for id_, change in ((parent, parent_func), (child, child_func)):
            if change is not None:
                own = own.filter(F.col("id") != id_).unionByName(change(own.filter(F.col("id") == id_)))
        pair = self.edges.sparkSession.createDataFrame([(parent, child)], "parent string, child string")
        return FeatureStore(own, self.max_depth, self.edges.unionByName(pair))

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> FeatureStore:
        """With the features as ``change`` gives them; edges of those that are gone go too."""
        own = change(self.features)
        return FeatureStore(own, self.max_depth, self.edges.join(own.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child"))

    def by_parent(self, parent_type: str, child_type: str | None = None) -> Iterator[tuple[Row, list[Row]]]:
        """Every feature of a kind with its children, parent by parent, in order of start."""
        up = self.features.filter(F.col("featuretype") == parent_type)
        kids = self.children(up.select(F.col("id").alias("anchor")), level=1, featuretype=child_type)
        lists = kids.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct(*self.features.columns)).alias("_kids"))
        for r in up.join(lists, "id", "left").orderBy("seqid", "start_pos", "id").toLocalIterator():
            yield r, sorted(r["_kids"] or (), key=lambda k: (k["start_pos"], k["end_pos"], k["id"]))

    def execute(self, sql: str) -> DataFrame:
        """SQL over features, edges and closure; they are views of this call only."""
        spark = self.features.sparkSession
        return spark.sql(sql, features=self.features, edges=self.edges, closure=self.closure)
