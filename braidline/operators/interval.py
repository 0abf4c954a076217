"""Interval joins, islands, gaps and blocks.  Coordinates are 1-based, inclusive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import spread, tasks


def length(lo: str = "start_pos", hi: str = "end_pos") -> Column:
    return F.col(hi) - F.col(lo) + 1


def overlap(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Bases that two intervals share, at least 0."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)


def region(features: DataFrame, seqid: str, start: int | None = None, end: int | None = None, within: bool = False) -> DataFrame:
    """Features of a region.  With one bound only, the bound is on that side alone."""
    out = features.filter(F.col("seqid") == seqid)
    if start is not None and end is not None and not within:
        return out.filter((F.col("start_pos") <= end) & (F.col("end_pos") >= start))
    if start is not None:
        out = out.filter(F.col("start_pos") >= start)
    return out.filter(F.col("end_pos") <= end) if end is not None else out


LEVELS = tuple(range(8))


def overlap_join(left: DataFrame, right: DataFrame, bin_bits: int = 9) -> DataFrame:
    """Pairs of rows of one seqid that overlap; left has q_seqid, q_start, q_end.

    An interval's level is the first whose bins (each level's 8 times as wide as the
    one before) it touches about 32 of at most: so bins are never much wider than what
    lies in them, and few meet there that do not overlap.  The last level takes all that
    are wider, and its outer bins have no end.  A pair meets at the coarser level of its two: either the
    query at its own level meets features of that or a finer one, or the feature at
    its own level meets finer queries.  So both joins are on the level and bin as keys,
    short meets short at the finest level only, and rows are sent to the levels alone
    that the other side has (which a job of its own finds).  A pair is made in the first
    bin that both touch.
    """
    def wide(lo: str, hi: str) -> Column:
        return F.col(hi).cast("double") - F.col(lo).cast("double") + 1

    def level(lo: str, hi: str) -> Column:
        coarse = F.least(F.ceil(F.log2(wide(lo, hi) / (32 << bin_bits)) / 3).cast("int"), F.lit(LEVELS[-1]))
        return F.when(wide(lo, hi) <= (32 << bin_bits), F.lit(0)).otherwise(coarse)

    def bin_of(c: str, k: int) -> Column:
        out = F.shiftright(F.col(c).cast("long"), bin_bits + 3 * k)
        return F.greatest(F.lit(-1).cast("long"), F.least(out, F.lit(64).cast("long"))) if k == LEVELS[-1] else out

    def at(df: DataFrame, lo: str, hi: str, tag: str, takes: Callable[[Column, int], Column], of: set[int]) -> DataFrame:
        """A row for each bin of each level that ``takes`` holds for, of those in ``of``."""
        bins = F.array(*(F.when(takes(F.col("_own"), k), F.struct(F.lit(k).alias("k"), bin_of(lo, k).alias("a"), bin_of(hi, k).alias("b"))) for k in sorted(of)))
        out = df.withColumn("_own", level(lo, hi)).withColumn("_p", F.explode(bins)).filter("_p IS NOT NULL").drop("_own")
        out = out.withColumn(f"{tag}_bin", F.explode(F.sequence("_p.a", "_p.b")))
        return out.withColumn(f"{tag}_k", F.col("_p.k")).withColumn(f"{tag}_first", F.col("_p.a")).drop("_p")

    query, feature = ("q_start", "q_end"), ("start_pos", "end_pos")
    of_queries, of_features = (set(df.select(level(*ends).alias("k")).agg(F.collect_set("k")).first()[0]) for df, ends in ((left, query), (right, feature)))
    n = tasks(left, right)
    same = (F.col("q_seqid") == F.col("seqid")) & (F.col("q_bin") == F.col("f_bin")) & (F.col("q_k") == F.col("f_k"))
    once = F.col("q_bin") == F.greatest("q_first", "f_first")
    hit = (F.col("start_pos") <= F.col("q_end")) & (F.col("end_pos") >= F.col("q_start"))
    extra = [f"{t}_{c}" for t in "qf" for c in ("bin", "k", "first")]
    met = []
    if fine := {k for k in of_queries if k >= min(of_features, default=k + 1)}:
        met.append((at(left, *query, "q", lambda own, k: own == k, fine), at(right, *feature, "f", lambda own, k: own <= k, fine)))
    if fine := {k for k in of_features if k > min(of_queries, default=k)}:
        met.append((at(left, *query, "q", lambda own, k: own < k, fine), at(right, *feature, "f", lambda own, k: own == k, fine)))
    met = [(spread(a, "q_seqid", "q_bin", "q_k", n=n), spread(b, "seqid", "f_bin", "f_k", n=n)) for a, b in met]
    met = [a.join(b, same & once & hit).drop(*extra) for a, b in met]
    return reduce(DataFrame.unionByName, met) if met else left.limit(0).crossJoin(right.limit(0))


def _attached(df: DataFrame, heads: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the column ``name`` of a table with a row for each stretch; null keys are equal."""
    by = [*keys, "_at"]
    named = heads.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), name)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    return df.join(named, same).drop(*(f"_k{i}" for i in range(len(by))))


def _before(df: DataFrame, keys: list[str], head: Column, name: str) -> DataFrame:
    """Add ``name``: the greatest ``head`` of all earlier stretches of the row's keys.  The
    window is over a row for each stretch, not over the rows."""
    heads = df.groupBy(*keys, "_at").agg(head.alias("_head"))
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return _attached(df, heads.select(*keys, "_at", F.max("_head").over(w).alias(name)), keys, name)


def numbered(df: DataFrame, keys: list[str], order: str, bits: int = 18) -> DataFrame:
    """Add ``number``: the row's place, from 1, among those of its keys in order of a column of
    distinct whole numbers, in stretches of 2^bits of these, so that no task meets all rows of a key."""
    own = df.withColumn("_at", F.shiftright(F.col(order).cast("long"), bits))
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    heads = own.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    own = _attached(own, heads.select(*keys, "_at", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_earlier")), keys, "_earlier")
    place = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(order))
    return own.withColumn("number", place + F.col("_earlier")).drop("_at", "_earlier")


def islands(df: DataFrame, keys: list[str], adjacent: bool = True, bits: int | None = None) -> DataFrame:
    """Union of overlapping intervals for each combination of keys.

    With ``adjacent`` intervals that touch end to start join too; without, only
    those that share a base.  With ``bits``, keys of very many rows (whole sequences) are
    worked on in stretches of 2^bits bases; how far earlier stretches reach, and where
    their last island begins, is carried to the later ones.  An island is told by its
    start (column ``island``).
    """
    touch = 1 if adjacent else 0
    own = (spread(df, *keys) if bits is None else df).withColumn("_at", F.lit(0) if bits is None else F.shiftright(F.col("start_pos").cast("long"), bits))
    by = [*keys, "_at"]
    w = Window.partitionBy(*by).orderBy("start_pos", "end_pos")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end_pos").over(before)
    if bits is not None:
        own = _before(own, keys, F.max("end_pos"), "_far")
        reach = F.greatest(reach, F.col("_far"))
    own = own.withColumn("_reach", reach)
    own = own.withColumn("_new", F.when(F.coalesce(F.col("start_pos") <= F.col("_reach") + touch, F.lit(False)), None).otherwise(F.col("start_pos")))
    start = F.max("_new").over(so_far)
    if bits is not None:
        own = _before(own, keys, F.max("_new"), "_open")
        start = F.coalesce(start, F.col("_open"))
    own = own.withColumn("island", start)
    return own.groupBy(*keys, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("n_parts"))


def gaps(df: DataFrame, keys: list[str], bits: int | None = None) -> DataFrame:
    """Gaps of one base or more between neighbours in start order (introns of exons).

    With ``bits``, in stretches of 2^bits bases, the last of which looks at the first
    start of the next.
    """
    own = (spread(df, *keys) if bits is None else df).withColumn("_at", F.lit(0) if bits is None else F.shiftright(F.col("start_pos").cast("long"), bits))
    w = Window.partitionBy(*keys, "_at").orderBy("start_pos", "end_pos")
    following = F.lead("start_pos").over(w)
    if bits is not None:
        heads = own.groupBy(*keys, "_at").agg(F.min("start_pos").alias("_head"))
        later = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_at"))
        own = _attached(own, heads.select(*keys, "_at", later.alias("_next")), keys, "_next")
        following = F.coalesce(following, F.col("_next"))
    out = own.withColumn("gap_start", F.col("end_pos") + 1).withColumn("gap_end", following - 1)
    return out.filter(F.col("gap_end") >= F.col("gap_start")).drop("_at", "_next")


def neighbor(df: DataFrame, keys: list[str], order: list[str], value: str, bits: int) -> DataFrame:
    """Add ``before``: the value of the row before in order (which begins with start_pos), in
    stretches of 2^bits bases."""
    own = df.withColumn("_at", F.shiftright(F.col("start_pos").cast("long"), bits))
    last = own.groupBy(*keys, "_at").agg(F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_at"))
    own = _attached(own, last.select(*keys, "_at", earlier.alias("_earlier")), keys, "_earlier")
    w = Window.partitionBy(*keys, "_at").orderBy(*order)
    place = F.row_number().over(w)
    return own.withColumn("before", F.when(place == 1, F.col("_earlier._value")).otherwise(F.lag(value).over(w))).drop("_at", "_earlier")


def holds_a_point(pieces: DataFrame, points: DataFrame, keys: list[str], bits: int = 12) -> DataFrame:
    """The pieces (keys, a, b) that hold one of the points (keys, at): those whose last point
    up to b lies at a or behind it.  In stretches of 2^bits bases, without pairs."""
    rest = [c for c in pieces.columns if c not in keys]
    asked = pieces.select(*keys, F.col("b").cast("long").alias("_b"), F.lit(None).cast("long").alias("_p"), F.struct(*rest).alias("_row"))
    known = points.select(*keys, F.col("at").cast("long").alias("_b")).distinct()
    own = known.select(*keys, "_b", F.col("_b").alias("_p"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")).unionByName(asked)
    own = _before(own.withColumn("_at", F.shiftright("_b", bits)), keys, F.max("_p"), "_far")
    w = Window.partitionBy(*keys, "_at").orderBy("_b").rangeBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_last", F.coalesce(F.max("_p").over(w), F.col("_far")))
    return own.filter("_row IS NOT NULL AND _last >= _row.a").select(*keys, "_row.*")


def splice_sites(introns: DataFrame) -> DataFrame:
    """Two one-base rows for each intron: its first and its last base."""
    return introns.withColumn("site", F.explode(F.array("gap_start", "gap_end")))


def ucsc_bin(lo: str = "start_pos", hi: str = "end_pos") -> Column:
    """The bin of the standard binning scheme: the smallest that holds the interval."""
    a, b = F.col(lo) - 1, F.col(hi) - 1
    out = F.lit(0)
    for offset, shift in ((1, 26), (9, 23), (73, 20), (585, 17)):
        out = F.when(F.shiftright(a, shift) == F.shiftright(b, shift), offset + F.shiftright(a, shift)).otherwise(out)
    return out.cast("long")


def phases(df: DataFrame, key: str) -> DataFrame:
    """Add the phase that each coding part has in 5' to 3' order."""
    order = F.when(F.col("strand") == "-", -F.col("start_pos")).otherwise(F.col("start_pos"))
    tie = F.when(F.col("strand") == "-", -F.col("end_pos")).otherwise(F.col("end_pos"))
    w = Window.partitionBy(key).orderBy(order, tie, "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length()).over(w), F.lit(0))
    return spread(df, key).withColumn("phase", (3 - before % 3) % 3)


def bed12(parents: DataFrame, blocks: DataFrame) -> DataFrame:
    """A line of twelve fields for each parent, its blocks in start order."""
    parts = blocks.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("b")).withColumnRenamed("parent", "id")
    sizes = F.array_join(F.transform("b", lambda x: (x["end_pos"] - x["start_pos"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("b", lambda x: (x["start_pos"] - F.col("start_pos")).cast("string")), ",")
    thin = (F.col("start_pos") - 1).cast("string")
    line = F.concat_ws("\t", "seqid", thin, F.col("end_pos").cast("string"), "id", F.lit("0"), "strand", thin, thin, F.lit("0,0,0"), F.size("b").cast("string"), F.concat(sizes, F.lit(",")), F.concat(starts, F.lit(",")))
    return parents.join(parts, "id").select("id", line.alias("bed"))
