"""Operator 7: SimHash near-duplicates by segment-popcount embedding.

A fingerprint's sixteen segments of four bits are mapped to their bit counts, a
point of a grid.  A bit that differs moves the point by one step at most, so the
Manhattan distance of two points is a lower bound of the bits that differ.  Every
fingerprint goes to its own point and to those one step away: two fingerprints
meet at some point if and only if their points are at most two steps apart (a
range join as an equality).  Pairs that meet are verified exactly, by the bits that
differ, inside the join.  No side of a join goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keyed, stage_table, unsent
from .components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        ones += np.unpackbits(h[a:a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, fp) of every row."""

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in batch.column("t").to_pylist()], np.uint64).view(np.int64))]

    return keyed(docs, key, text, of, "fp long")


SEGMENTS = 16


def point(fp: Column) -> Column:
    """The bit counts of the segments, four bits for each."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(0x55555555) + F.shiftright(x, 1).bitwiseAND(0x55555555)
        return pairs.bitwiseAND(0x33333333) + F.shiftright(pairs, 2).bitwiseAND(0x33333333)

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(0xFFFFFFFF)))


def near_points(at: Column) -> Column:
    """The point itself and those one step away, within 0 and 4 in each direction."""
    out = [at]
    for i in range(SEGMENTS):
        count = F.shiftright(at, 4 * i).bitwiseAND(15)
        out += [F.when(count < 4, at + F.lit(1 << 4 * i)), F.when(count > 0, at - F.lit(1 << 4 * i))]
    return F.array_compact(F.array(*out))


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in 1 to ``max_bits`` (at most 2) bits."""
    cells = nodes.select("fp", F.explode(near_points(point(F.col("fp")))).alias("cell"))
    a, b = (cells.select(F.col("fp").alias(name), F.col("cell").alias(f"c{name}")) for name in "ab")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = a.join(unsent(b), (F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")) & (apart <= max_bits))
    return met.select("a", "b").distinct()


def grouped(nodes: DataFrame) -> DataFrame:
    """(fp, component_id): the least ``id`` of the fingerprints that are linked, for nodes (fp, id)."""
    nodes = stage_table(nodes, "nodes")
    root = components(stage_table(links(nodes), "links"))
    rooted = nodes.join(unsent(root.select(F.col("node").alias("fp"), "root")), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(unsent(linked), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint and the smallest key reachable.

    Null, empty and wordless texts have fingerprint 0 and are linked like any
    other.  Equal fingerprints collapse to one node before the join, so a group of
    copies costs no pairs; a text of any length is read whole, its hashes as one
    array.  Null keys stay null and are never a component's id, unless the component
    has no other.  Other columns are left out; an empty table gives no rows.
    """
    own = stage_table(fingerprints(docs, key, text), "fingerprints")
    out = own.join(unsent(grouped(own.groupBy("fp").agg(F.min("k").alias("id")))), "fp")
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near duplicates, that of the smallest key.

    Rows are told apart by 128 bits of hashes of all their columns, so null and
    repeated keys are no trouble: a null key comes after all others, and of equal keys
    the least hash is taken; of rows that are equal in every column one stays.  All
    columns stay, whatever their names; an empty table gives no rows.
    """
    x, y, order = (free_name(docs, c) for c in ("x", "y", "order"))
    marked = docs.withColumns({x: F.xxhash64(*docs.columns), y: F.xxhash64(F.lit(1), *docs.columns)})
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"))
    own = stage_table(fingerprints(marked.select(place.alias(order), text), order, text), "fingerprints")
    first = grouped(own.groupBy("fp").agg(F.min("k").alias("id"))).select(F.col("component_id.x").alias(x), F.col("component_id.y").alias(y)).distinct()
    return marked.join(stage_table(first, "kept"), [x, y], "left_semi").dropDuplicates([x, y]).drop(x, y)
