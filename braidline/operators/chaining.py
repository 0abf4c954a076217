"""Chaining the coding parts of two models of one transcript."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "struct<parts:array<struct<a:bigint,b:bigint>>,reference:string,target:string,edges:array<double>>"


@dataclass
class Model:
    """Coding parts in 5' to 3' order as (start, end), and the aligned proteins.

    ``edges`` are the parts' boundaries in alignment columns, one more than parts.
    """

    parts: list[tuple[int, int]]
    reference: str
    target: str
    edges: list[float]

    def residues(self, upto: float) -> int:
        """Reference residues in the columns before a boundary."""
        return sum(c != "-" for c in self.reference[:math.ceil(upto)])

    def identity(self, a: float, b: float) -> float:
        """Share of equal columns among reference residues and insertions of a stretch,
        which ends with the target's first stop."""
        lo, hi = math.floor(a), math.ceil(b)
        ref, own = self.reference[lo:hi], self.target[lo:hi]
        stop = own.find("*")
        if stop >= 0:
            ref, own = ref[:stop + 1], own[:stop + 1]
        length = (hi - lo) - ref.count("-")
        return sum(x == y for x, y in zip(ref, own)) / (length or 1)


def synchronous(lift: Model, protein: Model) -> list[tuple[int, int]]:
    """Pairs of part numbers after which both models have used up the same reference
    residues and end at the same place; the last pair is both ends."""
    ends = {(lift.residues(lift.edges[i]), lift.parts[i - 1][1]): i for i in range(1, len(lift.parts))}
    out = []
    for j in range(1, len(protein.parts)):
        i = ends.get((protein.residues(protein.edges[j]), protein.parts[j - 1][1]))
        if i is not None and (not out or i > out[-1][0]):
            out.append((i, j))
    return [*out, (len(lift.parts), len(protein.parts))]


def chain(lift: Model | None, protein: Model | None) -> tuple[list[tuple[int, int]], list[str]]:
    """Coding parts of the better model for each chunk, and which it was.

    The protein model wins a chunk only if it is strictly better; a chunk in which
    both have no identity gives no part. If a model has one part, all is one chunk.
    """
    if lift is None or not lift.parts:
        return (protein.parts, ["protein"]) if protein is not None else ([], [])
    if protein is None or not protein.parts:
        return lift.parts, ["lift"]
    cuts = synchronous(lift, protein) if min(len(lift.parts), len(protein.parts)) > 1 else [(len(lift.parts), len(protein.parts))]
    parts, chosen = [], []
    i = j = 0
    for a, b in cuts:
        x = lift.identity(lift.edges[i], lift.edges[a])
        y = protein.identity(protein.edges[j], protein.edges[b])
        if x == y == 0:
            chosen.append("empty")
        elif y > x:
            parts += protein.parts[j:b]
            chosen.append("protein")
        else:
            parts += lift.parts[i:a]
            chosen.append("lift")
        i, j = a, b
    return parts, chosen


def _model(row: dict | None) -> Model | None:
    if row is None:
        return None
    return Model([(p["a"], p["b"]) for p in row["parts"]], row["reference"], row["target"], row["edges"])


def chained(lifts: DataFrame, proteins: DataFrame, key: str) -> DataFrame:
    """(key, parts, chosen) for transcripts with a lifted model, a protein model or both
    (columns key and ``model``, of the type ``MODEL``)."""
    kind = lifts.schema[key].dataType.simpleString()
    chosen = pa.list_(pa.string())
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [chain(_model(x), _model(y)) for x, y in zip(batch.column("lift").to_pylist(), batch.column("protein").to_pylist())]
            parts = pa.array([[{"a": a, "b": b} for a, b in g[0]] for g in got], pairs)
            yield pa.RecordBatch.from_arrays([batch.column("k"), parts, pa.array([g[1] for g in got], chosen)], ["k", "parts", "chosen"])

    both = lifts.select(F.col(key).alias("k"), F.col("model").cast(MODEL).alias("lift")).join(proteins.select(F.col(key).alias("k"), F.col("model").cast(MODEL).alias("protein")), "k", "full")
    out = both.select("k", "lift", "protein").mapInArrow(run, f"k {kind}, parts array<struct<a:bigint,b:bigint>>, chosen array<string>")
    return out.withColumnRenamed("k", key)
