"""Operator 6: benchmark decontamination by q-gram lemma filtering.

A passage of m characters with at most e edits shares at least m - q + 1 - q*e of
its q-grams with the text, all within e diagonals of each other.  Shared q-grams
are counted in overlapping bands of 2e + 1 diagonals or more; regions that meet
the bound are verified by a banded alignment, and only those within the budget of
edits count as matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import keyed, stage_table

#: Odd multipliers of the q-gram hash.
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
TABLE_BITS = 22


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_codes(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit codes of the q-grams at each place."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, wide, f = points.astype(np.uint64), 1, FACTOR
    while 2 * wide <= q:
        h = h[:len(h) - wide] * f + h[wide:]
        h ^= h >> np.uint64(29)
        wide, f = 2 * wide, np.uint64(int(f) * int(SPREAD) % (1 << 64) | 1)
    for i in range(wide, q):
        h = h[:n] * f + points[i:i + n]
    return (h[:n] * SPREAD) ^ (h[:n] >> np.uint64(32))


def edit_budget(length: int, q: int, rate: float) -> int:
    """Edits allowed: ``rate`` of the length, but no more than leave one shared q-gram."""
    return max(0, min(int(rate * length), (length - q) // q))


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Least edits of the whole item against a part of the region, and where that
    part ends, if within the budget; among equals the first end.

    The part begins at one of the diagonals ``low`` to ``high`` (place in the region
    less place in the item), and only these and ``budget`` more to both sides are
    computed, a row of the band for each character of the item.
    """
    low, high = low - budget, high + budget
    wide = high - low + 1
    far = 1 << 20  # as good as any more
    padded = np.full(len(item) + wide, 0xFFFFFFFF, np.uint32)  # place p of the region at p - low
    a, b = max(0, low), min(len(region), low + len(padded))
    if a < b:
        padded[a - low:b - low] = region[a:b]
    differ = np.lib.stride_tricks.sliding_window_view(padded, wide)[:len(item)] != item[:, None]
    # the row less its diagonal's number: a step along the region, which costs one, changes nothing then
    steps = np.arange(wide, dtype=np.int32)
    row = np.where((steps + low >= 0) & (steps + low <= len(region)), 0, far).astype(np.int32) - steps
    for i, unlike in enumerate(differ):
        new = row + unlike  # the next characters of both
        np.minimum(new[:-1], row[1:] + 2, out=new[:-1])  # the item's only
        row = np.minimum.accumulate(new, out=new)  # the region's only
        if i + 1 + low < 0:  # before the region
            row[:-(i + 1 + low)] = far
        if i + 1 + high > len(region):  # behind it
            row[max(0, len(region) - i - low):] = far
        if i % 8 == 7 and (row + steps).min() > budget:
            return None
    row = row + steps
    end = int(row.argmin())
    return (int(row[end]), end + low + len(item)) if row[end] <= budget else None


class Index:
    """q-grams of a block of benchmark items, for looking up those of texts."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q = q
        norm = [(i, normal(t)) for i, t in items]
        self.ids = [i for i, t in norm if t]
        self.texts = [t for _, t in norm if t]
        self.points = [code_points(t) for t in self.texts]
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.array([edit_budget(n, q, rate) for n in self.length], np.int64)
        self.need = np.maximum(1, self.length - q + 1 - q * self.budget)
        long = [k for k in range(len(self.ids)) if self.length[k] >= q]
        self.short = [k for k in range(len(self.ids)) if self.length[k] < q]
        codes = [gram_codes(self.points[k], q) for k in long]
        self.code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.item = np.repeat(np.array(long, np.int64), [len(c) for c in codes])
        self.place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(self.code, kind="stable")
        self.code, self.item, self.place = self.code[order], self.item[order], self.place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) of the best region of each item that matches."""
        found = {}
        padded = f" {text} "
        for k in self.short:  # too short for a q-gram: as whole words
            at = padded.find(f" {self.texts[k]} ")
            if at >= 0:
                found[k] = (at, at + len(self.texts[k]), 0)
        points = code_points(text)
        code = gram_codes(points, self.q)
        at = np.flatnonzero(self.table[(code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]) if len(code) else code
        if len(at):
            lo = np.searchsorted(self.code, code[at], "left")
            n = np.searchsorted(self.code, code[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            stop = np.cumsum(n)
            hit = np.repeat(lo - stop + n, n) + np.arange(int(n.sum()))
            where = np.repeat(at, n)
            enough = np.bincount(self.item[hit], minlength=len(self.ids)) >= self.need
            keep = enough[self.item[hit]]
            hit, where = hit[keep], where[keep]
            if len(hit):
                self._regions(points, self.item[hit], where - self.place[hit], where, found)
        return [(k, *v) for k, v in found.items()]

    def _regions(self, points: np.ndarray, item: np.ndarray, diagonal: np.ndarray, where: np.ndarray, found: dict) -> None:
        """Count hits in overlapping bands of diagonals and verify those that meet the bound."""
        offset = int(diagonal.min())
        wide = 2 * self.budget[item] + 1
        for shift in (0, 1):  # bands of twice that width, every band shared with the next by half
            band = (diagonal - offset + shift * wide) // (2 * wide)
            key = item * (2 * (int(diagonal.max()) - offset + 2 * int(wide.max()) + 2)) + band
            order = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.diff(key[order], prepend=-1))
            stop = np.append(edge[1:], len(order))
            full = stop - edge >= self.need[item[order[edge]]]
            for a, b in zip(edge[full].tolist(), stop[full].tolist()):
                k = int(item[order[a]])
                at = where[order[a:b]]
                # what edits leave are q-grams at as many places of the text and of the item
                if min(len(np.unique(at)), len(np.unique(at - diagonal[order[a:b]]))) < self.need[k]:
                    continue
                best = found.get(k)
                if best is not None and best[2] == 0:
                    continue
                near, m, e = diagonal[order[a:b]], int(self.length[k]), int(self.budget[k])
                low, high = int(near.min()), int(near.max())
                got = banded_distance(self.points[k], points, low, high, e)
                if got is not None and (best is None or got[0] < best[2]):
                    # backwards from where it ends: as many edits, and the start nearest to the end
                    back = banded_distance(self.points[k][::-1], points[:got[1]][::-1], 0, 0, e)
                    found[k] = (got[1] - (back[1] if back is not None else m), *reversed(got))


def benchmark_blocks(benchmark: DataFrame, key: str, text: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``chars`` characters: what is broadcast has that size."""
    block, size = [], 0
    for r in benchmark.select(key, text).filter(F.col(text).isNotNull()).distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """(key, item, start, end, edits) for every row and item that its text holds.

    Texts are compared in lower case with white space folded; places count in that
    form.  An item matches with at most ``rate`` of its length in edits, but no more
    than leave one q-gram shared (see ``edit_budget``); items shorter than ``q`` only as
    whole words.  Null and empty texts and items match
    nothing; repeated rows give rows each; equal items match each; of regions with
    equally few edits the first counts; texts of any length are read whole; null keys
    stay null; other columns are left out; empty tables give no rows.  The benchmark is
    a query set against all rows: it goes out in blocks of ``block_chars`` characters,
    one at a time, each with a pass over the rows.
    """
    spark = docs.sparkSession
    item_kind = benchmark.schema[item_key].dataType.simpleString()
    found = f"m array<struct<item:{item_kind},start:int,end:int,edits:int>>"
    parts: list[DataFrame] = []
    held = None
    for block in benchmark_blocks(benchmark, item_key, item_text, block_chars):
        if held is not None:  # one block at a time: its part is written before the next is made
            parts[-1] = stage_table(parts[-1], "matches")
            held.unpersist()
        held = spark.sparkContext.broadcast(Index(block, q, rate))
        parts.append(keyed(docs, key, text, _matches(held, to_arrow_type(benchmark.schema[item_key].dataType)), found).filter("size(m) > 0"))
    if not parts:
        parts.append(docs.select(F.col(key).alias("k")).limit(0).withColumn("m", F.lit(None).cast(found[2:])))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("k"), F.explode("m").alias("m")).select("k", "m.*").withColumnsRenamed({"k": key, "item": item_key})


def _matches(index, item_type: pa.DataType):
    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [[(index.value.ids[i], a, b, e) for i, a, b, e in index.value.matches(normal(t))] for t in batch.column("t").to_pylist()]
        flat = list(zip(*(r for x in rows for r in x))) or [(), (), (), ()]
        columns = [pa.array(c, t) for c, t in zip(flat, (item_type, pa.int32(), pa.int32(), pa.int32()))]
        at = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        return [pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, ["item", "start", "end", "edits"]))]

    return of


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns, whatever
    their names; nothing is shuffled.  Null and empty texts hold none and stay, as do
    all rows where the benchmark is empty; repeated rows are judged each."""
    held = None
    for block in benchmark_blocks(benchmark, item_key, item_text, block_chars):
        if held is not None:  # one block at a time
            docs = stage_table(docs, "clean")
            held.unpersist()
        held = docs.sparkSession.sparkContext.broadcast(Index(block, q, rate))
        docs = docs.mapInArrow(_clean(held, text), docs.schema)
    return docs


def _clean(index, text: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            clean = [not index.value.matches(normal(t)) for t in part.column(text).to_pylist()]
            yield part.filter(pa.array(clean, pa.bool_()))

    return run
