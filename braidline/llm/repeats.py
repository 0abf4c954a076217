"""Operator 10: repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``depth`` bytes of a suffix count, so the groups of more than one in
the finished sort are exactly the repeated windows of ``depth`` bytes.

1.  Buckets.  A window's anchor is the least-hashed ``GRAM`` bytes in it (leftmost of
    equals): equal windows have it at the same place.  Neighbouring windows share
    one, so a run of windows is one row.  Runs whose anchor's hash is found once have
    no repeated window and end here; hashes choose and sieve only, and decide nothing
    else.
2.  Runs whose whole stretches of bytes are equal (grouped by the bytes themselves)
    are repeated as a whole, whatever their number; one of each stretch goes on.
3.  In each bucket the stretches are sorted by most-significant-digit passes over
    their bytes to the right of the anchor, and to the left of it, a digit being
    eight bytes; groups of one end at each pass.  The sorts give, for every reach, the
    classes of stretches that agree that far.  Windows with the same place of the
    anchor and the same class to both sides are equal, byte by byte.
4.  A bucket of more than ``limit`` stretches is not held in a task: its next digits
    are the bytes that a quarter of the places have in common, then the rest of each
    window, and each of these two passes is an aggregation with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_id, drop_stage, portions, stage_table, utf8

GRAM, PARTS = 32, 4
U64 = np.uint64
#: Odd multipliers of the hashes.
SPREAD, MIX = 0x9E3779B97F4A7C15, U64(0xD6E8FEB86659FD93)

Arrays = tuple[np.ndarray, ...]
RUN = "i0 long, i1 long, first int, n int, off int, h long, x long"


def block_hashes(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the blocks of each width, rising powers of two, that begin at each byte."""
    out, h, wide, f = [], (data.astype(U64) + U64(1)) * MIX, 1, SPREAD
    for w in widths:
        while wide < w:
            h = h[:-wide] * U64(f) + h[wide:]
            h ^= h >> U64(29)
            wide, f = 2 * wide, f * SPREAD % (1 << 64)
        out.append(h)
    return out


def least_place(values: np.ndarray, wide: int) -> np.ndarray:
    """Place of the least of ``wide`` neighbours (leftmost of equals) from each place on."""
    low = (values & ~U64(0xFFFFFF)) | np.arange(len(values), dtype=U64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
    return (low & U64(0xFFFFFF)).astype(np.int64)


def runs(data: np.ndarray, stops: np.ndarray, depth: int, gram: int = GRAM) -> Arrays:
    """Runs of windows with one anchor in the texts that end at ``stops``.

    Gives text number, first window's start in the text, number of windows, the
    anchor's place after the first, and hashes of anchor and stretch.
    """
    if len(data) < depth:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    block = 1 << (depth.bit_length() - 1)
    grams, blocks = block_hashes(data, (gram, block))
    grams = grams * MIX
    anchor = least_place(grams, depth - gram + 1)
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.repeat(np.arange(len(stops)), stops - starts)[:len(anchor)]
    fits = np.arange(len(anchor)) + depth <= stops[doc]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~fits[:-1]
    first = np.flatnonzero(change & fits)
    edge = np.append(np.flatnonzero(change | ~fits), len(anchor))
    n = edge[np.searchsorted(edge, first, "right")] - first
    last = first + n - 1 + depth - block
    x = np.zeros(len(first), U64)
    for j in range(-(-2 * depth // block)):
        x = (x ^ blocks[np.minimum(first + j * block, last)]) * U64(SPREAD)
        x ^= x >> U64(32)
    a = anchor[first]
    return doc[first], first - starts[doc[first]], n, a - first, grams[a].view(np.int64), x.view(np.int64)


def _runs_of(depth: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("t"))
            ids = [batch.column(c).to_numpy() for c in ("i0", "i1")]
            for a, b in portions(at, piece):
                # one giant text is read in parts, of which each window lies in one
                for lo in range(at[a], max(at[a] + 1, at[b] - depth + 1), piece) if b == a + 1 else (at[a],):
                    hi = min(at[b], lo + piece + depth - 1) if b == a + 1 else at[b]
                    doc, first, n, off, h, x = runs(data[lo:hi], np.minimum(at[a + 1:b + 1], hi) - lo, depth)
                    out = [*(i[doc + a] for i in ids), *(v.astype(np.int32) for v in (first + lo - at[a] if b == a + 1 else first, n, off)), h, x]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["i0", "i1", "first", "n", "off", "h", "x"])

    return run


STRETCH = "h long, off int, n int, x long, i0 long, i1 long, first int, b binary"


def _stretches_of(depth: int, most: int = 16_384):
    """The bytes of the runs, a row each."""
    names = [c.split()[0] for c in STRETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("t"))
            lists = batch.column("runs")
            of = lists.flatten()
            own = {c: of.field(c).to_numpy() for c in ("first", "n", "off", "h", "x")}
            doc = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            own |= {c: batch.column(c).to_numpy()[doc] for c in ("i0", "i1")}
            start = at[doc] + own["first"]
            stop = start + own["n"] - 1 + depth
            for a in range(0, len(doc), most):
                b = pa.array([data[p:q].tobytes() for p, q in zip(start[a:a + most].tolist(), stop[a:a + most].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(own[c][a:a + most]) for c in names[:-1]), b], names)

    return run


def context(data: np.ndarray, anchor: np.ndarray, reach: np.ndarray, wide: int) -> np.ndarray:
    """Digits (eight bytes each, as numbers) of the ``wide`` bytes from each anchor on; zero beyond ``reach``."""
    wide = -(-wide // 8) * 8
    padded = np.concatenate([data, np.zeros(wide, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[anchor].copy()
    rows[np.arange(wide) >= reach[:, None]] = 0
    return rows.view(">u8").astype(U64)


BYTE = np.arange(56, -1, -8, dtype=U64)


def radix_order(digits: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by bucket and digits, by passes from the most significant digit on.

    ``bucket`` rises.  Also gives how many bytes each row in that order shares with
    the one before it: -1 at the beginning of a bucket.
    """
    rows, passes = digits.shape
    order = np.arange(rows)
    shared = np.full(rows, 8 * passes)
    edge = np.ones(rows + 1, bool)
    edge[1:-1] = bucket[1:] != bucket[:-1]
    shared[edge[:-1]] = -1
    for d in range(passes):
        open_ = np.flatnonzero(~(edge[:-1] & edge[1:]))  # those in groups of more than one
        if not len(open_):
            break
        group = np.cumsum(edge[:-1])[open_]
        digit = digits[order[open_], d]
        by = np.lexsort((digit, group))
        order[open_], digit = order[open_][by], digit[by]
        apart = np.flatnonzero((digit[1:] != digit[:-1]) & (group[1:] == group[:-1])) + 1
        differ = digit[apart] ^ digit[apart - 1]
        edge[open_[apart]] = True
        shared[open_[apart]] = 8 * d + ((differ[:, None] >> BYTE) == 0).sum(1)
    return order, shared


def classes(order: np.ndarray, shared: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Number of the class of each row (down) that agrees in the first ``reach`` bytes (across)."""
    place = np.arange(len(order), dtype=np.int64)[:, None]
    by_place = np.maximum.accumulate(np.where(shared[:, None] < reach, place, 0), axis=0)
    out = np.empty_like(by_place)
    out[order] = by_place
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, off: np.ndarray, n: np.ndarray, depth: int, gram: int = GRAM, cells: int = 1 << 20) -> Arrays:
    """Row, first and last window of what is repeated in the stretches of whole buckets.

    Stretches (bytes from ``at`` to the next) differ within their bucket, and ``bucket`` rises.
    """
    anchor, rows, wide = at[:-1] + off, len(off), depth - gram + 1
    right = radix_order(context(data, anchor, at[1:] - anchor, depth), bucket)
    left = radix_order(context(data[::-1], len(data) - anchor, off, wide - 1), bucket)
    found = []
    step = max(1, cells // max(1, rows))
    for lo in range(0, wide, step):  # some of the anchor's places at a time
        o = np.arange(lo, min(wide, lo + step))
        own = (o <= off[:, None]) & (o > (off - n)[:, None])
        key = (o * rows + classes(*left, o)) * rows + classes(*right, depth - o)
        _, which, count = np.unique(key[own], return_inverse=True, return_counts=True)
        twice = np.zeros((rows, len(o) + 2), np.int8)
        twice[:, 1:-1][own] = count[which] > 1
        turn = np.diff(twice, axis=1)
        row, begin = np.nonzero(turn == 1)
        end = np.nonzero(turn == -1)[1]
        found.append((row, off[row] - (lo + end - 1), off[row] - (lo + begin)))
    return tuple(np.concatenate(c) for c in zip(*found))


SPAN = "i0 long, i1 long, start int, stop int"


def _sorted_buckets(depth: int, chunk: int = 8192):
    """Spans of the repeated windows; rows come by bucket (h), and no bucket is cut."""

    def spans(part: pa.Table) -> pa.RecordBatch | None:
        h, cnt = part["h"].to_numpy(), part["cnt"].to_numpy()
        part = part.combine_chunks()
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.repeat(np.diff(np.append(edge, len(h))) > 1, np.diff(np.append(edge, len(h))))
        if not many.any():
            return None
        part = part.filter(pa.array(many)).combine_chunks()
        h, cnt, off, n, first, i0, i1 = (part[c].to_numpy() for c in ("h", "cnt", "off", "n", "first", "i0", "i1"))
        data, at = utf8(part["b"].chunk(0))
        bucket = np.cumsum(np.append(False, h[1:] != h[:-1]))
        row, a, z = repeated_windows(data, at, bucket, off.astype(np.int64), n.astype(np.int64), depth)
        one = cnt[row] == 1  # stretches found twice are repeated as a whole
        row, a, z = row[one], a[one], z[one]
        out = [i0[row], i1[row], (first[row] + a).astype(np.int32), (first[row] + z + depth).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["i0", "i1", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < chunk:
                continue
            part = pa.Table.from_batches(held)
            h = part["h"].to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last bucket may go on
            if cut and (out := spans(part.slice(0, cut))) is not None:
                yield out
            held = part.slice(cut).to_batches()
            rows = len(part) - cut
        if rows and (out := spans(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def parts(depth: int, gram: int = GRAM) -> list[tuple[int, int]]:
    """Least and greatest place of the anchor in the windows of each part."""
    edge = [j * (depth - gram + 1) // PARTS for j in range(PARTS + 1)]
    return [(edge[j], edge[j + 1] - 1) for j in range(PARTS) if edge[j] < edge[j + 1]]


def hot_spans(stretches: DataFrame, depth: int) -> DataFrame:
    """Spans of the repeated windows of buckets of any size: two passes as aggregations."""
    side = [F.struct(F.lit(near).alias("near"), F.lit(far).alias("far"), F.greatest(F.lit(near), F.col("off") - F.col("n") + 1).alias("a"), F.least(F.lit(far), F.col("off")).alias("z")) for near, far in parts(depth)]
    sides = stretches.withColumn("s", F.explode(F.filter(F.array(*side), lambda s: s["a"] <= s["z"]))).select("*", "s.*").drop("s")
    sides = stage_table(sides.withColumn("core", F.expr(f"substring(b, off - near + 1, {depth} - (far - near))")), "sides")
    cores = sides.groupBy("h", "near", "core").count().filter("count > 1").select("h", "near", "core", F.monotonically_increasing_id().alias("c"))
    windows = sides.join(stage_table(cores, "cores"), ["h", "near", "core"]).drop("core")
    windows = windows.withColumn("o", F.explode(F.sequence("a", "z")))
    windows = windows.withColumn("rest", F.expr(f"concat(substring(b, off - o + 1, o - near), substring(b, off - far + {depth} + 1, far - o))"))
    windows = stage_table(windows.select("c", "o", "rest", "cnt", "i0", "i1", (F.col("first") + F.col("off") - F.col("o")).alias("start")), "windows")
    twice = windows.groupBy("c", "o", "rest").count().filter("count > 1").drop("count")
    return windows.filter("cnt = 1").join(twice, ["c", "o", "rest"]).select("i0", "i1", "start", (F.col("start") + depth).alias("stop"))


def repeated_spans(docs: DataFrame, depth: int, limit: int = 2048, piece: int = 1 << 20) -> DataFrame:
    """(i0, i1, spans): ranges whose union is what is repeated in the texts of that
    content; docs has i0, i1, the name of the content, and t, the text."""
    rows = stage_table(docs.mapInArrow(_runs_of(depth, piece), RUN), "runs")
    # a table, so that the join reads two plain exchanges and a bucket of many runs can be split
    anchors = stage_table(rows.groupBy("h").count().filter("count > 1").select("h"), "anchors")
    shared = rows.join(anchors, "h").dropDuplicates(["i0", "i1", "first"])  # rows of equal content are one here
    shared = stage_table(shared.select("i0", "i1", "first", "n", "off", "h", "x"), "shared")
    drop_stage(rows)
    drop_stage(anchors)
    of = shared.groupBy("i0", "i1").agg(F.sort_array(F.collect_list(F.struct("first", "n", "off", "h", "x"))).alias("runs"))
    opened = docs.join(of, ["i0", "i1"]).select("i0", "i1", "t", "runs").mapInArrow(_stretches_of(depth), STRETCH)
    # where cnt is 1, the least of each of these is that of the one run
    least = [F.min(c).alias(c) for c in ("i0", "i1", "first")]
    stretches = stage_table(opened.groupBy("h", "off", "n", "x", "b").agg(F.count(F.lit(1)).alias("cnt"), *least), "stretches")
    keys = ["h", "off", "n", "x"]
    many = stage_table(stretches.filter("cnt > 1").select(*keys).distinct(), "many")
    whole = shared.join(many, keys).select("i0", "i1", "first", "n")
    clash = stretches.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    clash = stage_table(stretches.filter("cnt = 1").join(clash, keys).select("i0", "i1", "first"), "clashes")
    if not clash.isEmpty():  # other bytes of the same hash: their windows are judged below
        whole = whole.join(clash, ["i0", "i1", "first"], "left_anti")
    found = stage_table(whole.select("i0", "i1", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + depth).alias("stop")), "whole")
    hot = stage_table(stretches.groupBy("h").count().filter(F.col("count") > limit).select("h"), "hot")
    cool = stretches
    if not hot.isEmpty():
        found = found.unionByName(stage_table(hot_spans(stretches.join(hot, "h"), depth), "hot-spans"))
        cool = stretches.join(hot, "h", "left_anti")
    cool = cool.select("h", "off", "n", "cnt", "i0", "i1", "first", "b").repartition("h").sortWithinPartitions("h")
    found = found.unionByName(stage_table(cool.mapInArrow(_sorted_buckets(depth), SPAN), "sorted"))
    spans = stage_table(found.groupBy("i0", "i1").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")
    for done in (shared, stretches):
        drop_stage(done)
    return spans


def joined_spans(start: np.ndarray, stop: np.ndarray) -> Arrays:
    """Union of half-open ranges that rise by start; touching ones join."""
    far = np.maximum.accumulate(stop) if len(stop) else stop
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > far[:-1]
    first = np.flatnonzero(new)
    return start[first], far[np.append(first[1:], len(start)) - 1] if len(start) else far


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("t"))
        lists = batch.column("spans")
        of = lists.flatten()
        doc = np.repeat(np.arange(len(batch)), lists.value_lengths().fill_null(0).to_numpy())
        # a place between any two texts keeps their spans apart
        base = at[:-1] + np.arange(len(batch))
        start, stop = joined_spans(base[doc] + of.field("start").to_numpy(), base[doc] + of.field("stop").to_numpy())
        owner = np.searchsorted(base, start, "right") - 1
        n = np.bincount(owner, minlength=len(batch))
        gone = np.bincount(owner, weights=stop - start, minlength=len(batch)).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n)]).tolist()
        start, stop = (start - owner).tolist(), (stop - owner).tolist()
        kept = []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            whole = zip([a, *stop[edge[i]:edge[i + 1]]], [*start[edge[i]:edge[i + 1]], b])
            kept.append(b"".join(data[p:q].tobytes() for p, q in whole))
        columns = [batch.column("k"), pa.array(np.diff(at)), pa.array(gone), pa.array(n.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 200, limit: int = 2048, piece: int = 1 << 20) -> DataFrame:
    """Every row with the bytes that lie in no ``depth``-byte string found twice.

    ``depth`` is at least 33.  Matches lie within documents, may overlap, and are
    judged on the input.  Null texts are empty; texts shorter than ``depth`` bytes lose
    nothing; rows with the same text are documents of their own, whatever their keys,
    and so lose all that they share.  Null keys stay null; a text of any length is read
    in parts of ``piece`` bytes; other columns are left out, so their names cannot clash; an
    empty table gives no rows.
    """
    i0, i1 = content_id(text)
    own = docs.select(F.col(key).alias("k"), i0.alias("i0"), i1.alias("i1"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spans = repeated_spans(own.drop("k"), depth, limit, piece)
    kind = docs.schema[key].dataType.simpleString()
    out = own.join(spans, ["i0", "i1"], "left").select("k", "t", "spans")
    out = out.mapInArrow(_cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("k", key)
