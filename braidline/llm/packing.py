"""Operator 1: best-fit packing by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .tokens import WordEncoder, batches

PIECES = "piece int, start long, length long, ids_crc32 long"


def pack(lengths: list[int], capacity: int, partners: int = 24, patience: int = 12) -> list[list[int]]:
    """Bins (lists of item numbers) for items of the given lengths.

    The start is best fit in falling order of length.  Then local search: the
    emptiest bin gives away its items by a move, by exchanging one of its items
    for a smaller one, or two of its items for one and one for two, each of which
    must raise the sum of squared fills; it goes on until bins empty or nothing
    improves.  A giver looks at the ``partners`` bins with most room, and the
    search ends after ``patience`` givers that found no step.  No bin is searched
    when there are no more bins than the sum of lengths needs, or than items that
    fit no bin in pairs.  Ties go to the first item, so the result is deterministic.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in order:
        k = bisect_left(room, (lengths[i], -1))
        if k == len(room):
            bins.append([i])
            free, b = capacity - lengths[i], len(bins) - 1
        else:
            free, b = room.pop(k)
            bins[b].append(i)
            free -= lengths[i]
        if free:
            insort(room, (free, b))
    least = max(-(-sum(lengths) // capacity), sum(1 for x in lengths if 2 * x > capacity))
    fill = [sum(lengths[i] for i in b) for b in bins]
    tried: set[int] = set()
    count = sum(1 for b in bins if b)
    while count > least:
        open_bins = [b for b in range(len(bins)) if bins[b] and fill[b] < capacity]
        giver = min((b for b in open_bins if b not in tried), key=lambda b: (fill[b], b), default=None)
        if giver is None or len(open_bins) < 2 or len(tried) >= patience:
            break
        takers = nsmallest(partners, (b for b in open_bins if b != giver), key=lambda b: (fill[b], b))
        if not _improve(giver, takers, bins, fill, lengths, capacity):
            tried.add(giver)
        if not bins[giver]:
            count -= 1
    return [b for b in bins if b]


def _improve(giver: int, takers: list[int], bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int) -> bool:
    """One step that takes length from the giver's bin; every such step raises the
    sum of squares, for the takers are at least as full as the giver."""
    own = bins[giver]
    best: tuple[int, int, tuple[int, ...], tuple[int, ...]] | None = None
    for t in takers:
        free = capacity - fill[t]
        if best and best[0] >= free:
            continue
        for a in own:  # move
            if lengths[a] <= free and (not best or lengths[a] > best[0]):
                best = (lengths[a], t, (a,), ())
        mine = sorted((lengths[a], a) for a in own)
        for c in bins[t]:  # one for one
            k = bisect_left(mine, (lengths[c] + free + 1, -1)) - 1
            if k >= 0 and (gain := mine[k][0] - lengths[c]) > 0 and (not best or gain > best[0]):
                best = (gain, t, (mine[k][1],), (c,))
        theirs = sorted((lengths[c], c) for c in bins[t])
        for p, (x, a) in enumerate(mine):  # two for one
            for y, b in mine[p + 1:]:
                k = bisect_left(theirs, (x + y - free, -1))
                if k < len(theirs) and (gain := x + y - theirs[k][0]) > 0 and (not best or gain > best[0]):
                    best = (gain, t, (a, b), (theirs[k][1],))
        for p, (x, c) in enumerate(theirs):  # one for two
            for y, d in theirs[p + 1:]:
                k = bisect_left(mine, (x + y + free + 1, -1)) - 1
                if k >= 0 and (gain := mine[k][0] - x - y) > 0 and (not best or gain > best[0]):
                    best = (gain, t, (mine[k][1],), (c, d))
    if not best:
        return False
    gain, t, give, get = best
    bins[giver] = [i for i in own if i not in give] + list(get)
    bins[t] = [i for i in bins[t] if i not in get] + list(give)
    fill[giver] -= gain
    fill[t] += gain
    return True


def token_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every row; null text is empty, and
    every document ends with ``end_id``, so no document is without a piece."""

    names = ["row_key", *(x.split()[0] for x in PIECES.split(", "))]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches_:
            texts = ["" if t is None else t for t in batch.column("t").to_pylist()]
            of, rows = [], []
            for a, b in batches(texts):
                for i, ids in enumerate(encoder.ids(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s:s + capacity]
                        of.append(i)
                        rows.append((p, s, len(part), zlib.crc32(part.tobytes())))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(of)), *columns], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"row_key {kind}, {PIECES}")


def _placer(turn: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one group of one round; sequence numbers hold round, group and bin."""

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("tie")
        lengths = group["length"].to_pylist()
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        base = (turn << 56) | (group["g"][0].as_py() << 20)
        for b, items in enumerate(pack(lengths, capacity)):
            size = np.array([lengths[i] for i in items])
            sequence[items] = base + b
            offset[items] = np.cumsum(size) - size
            fill[items] = size.sum()
        group = group.drop_columns(["g", *(c for c in ADDED if c in group.column_names)])
        for name, values in zip(ADDED, (sequence, offset, fill)):
            group = group.append_column(name, pa.array(values))
        return group

    return place


ADDED = ["sequence_id", "offset", "fill"]


def pack_pieces(pieces: DataFrame, capacity: int, group_size: int = 2048, close_at: float = 0.995, rounds: int = 5) -> DataFrame:
    """Give every piece a sequence and its place in it.

    Pieces are dealt by a hash to groups of about ``group_size``, whatever their
    keys; each group is packed alone.  Bins filled to ``close_at`` or more stay;
    the pieces of the others are dealt anew to fewer groups and packed again, so
    what the groups leave meets in the end in one small group.  Full pieces are
    sequences of their own and need no search.
    """
    todo = stage_table(pieces.withColumn("tie", F.monotonically_increasing_id()), "pieces")
    n = todo.count()
    done: list[DataFrame] = []
    names = todo.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema) + "".join(f", {c} long" for c in ADDED)
    for turn in range(rounds):
        groups = max(1, -(-n // group_size))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("tie", F.lit(turn)), F.lit(groups)))
        packed = stage_table(dealt.groupBy("g").applyInArrow(_placer(turn, capacity), schema), f"packed{turn}")
        if groups == 1 or turn == rounds - 1:
            done.append(packed)
            break
        closed = F.col("fill") >= int(close_at * capacity)
        done.append(packed.filter(closed))
        todo = packed.filter(~closed).select(*names)
        n = todo.count()
        if not n:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("tie")


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Null and empty texts give one piece holding ``end_id`` only; repeated rows are
    packed each; a null key stays null; an empty table gives no rows; other
    columns are left out.
    """
    return pack_pieces(token_pieces(docs, key, text, vocabulary, capacity, end_id), capacity).withColumnRenamed("row_key", key)
