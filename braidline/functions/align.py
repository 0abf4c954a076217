"""Alignment, reading frames and variants, for use in Arrow-batched functions."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import CODE

STOPS = {"TAA", "TAG", "TGA"}


def score_table(text: str, other: int = -4) -> np.ndarray:
    """Scores of letter pairs from a matrix in its usual text form: a line of letters,
    then for each letter a line of its scores; lines with # are notes.  Letters that the
    matrix lacks score ``other``."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    table = np.full((256, 256), other, np.int64)
    for row in lines[1:]:
        for letter, score in zip(lines[0], row[1:]):
            table[ord(row[0]), ord(letter)] = int(score)
    return table


def clean_dna(seq: str) -> str:
    """Upper case; every letter but A, C, G, T is N."""
    return re.sub("[^ACGT]", "N", seq.upper())


def global_alignment(a: str, b: str, match: int = 1, mismatch: int = -3, open_: int = 5, extend: int = 2, table: np.ndarray | None = None) -> tuple[int, str, str]:
    """Score and gapped strings of a global alignment with affine gaps.

    The first base of a gap costs ``open_``, each further one ``extend``; pairs score by
    ``table`` (see ``score_table``) if there is one.  Rows are arrays; within a row the
    horizontal gap is a running maximum.
    """
    if not a or not b:
        raise ValueError("an empty sequence cannot be aligned")
    x, y = (np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8) for s in (a, b))
    n, m = len(x), len(y)
    low = -(10**8)
    steps = np.arange(m + 1) * extend
    best = np.concatenate([[0], -open_ - extend * np.arange(m)])
    down = np.full(m + 1, low)
    trace = np.zeros((n + 1, m + 1), np.uint8)  # 1: diagonal, 2: down, 4: across; 8, 16: down, across goes on
    trace[0, 1:] = 4 | 16
    trace[0, 1:2] = 4
    for i in range(1, n + 1):
        goes_on = down - extend > best - open_
        down = np.maximum(best - open_, down - extend)
        diagonal = np.concatenate([[low], best[:-1] + (np.where(y == x[i - 1], match, mismatch) if table is None else table[x[i - 1], y])])
        here = np.maximum(diagonal, down)
        across = np.full(m + 1, low)
        across[1:] = np.maximum.accumulate(here + steps)[:-1] - open_ - steps[1:] + extend
        best = np.maximum(here, across)
        trace[i] = np.where(best == diagonal, 1, np.where(best == down, 2, 4)) | np.where(goes_on, 8, 0)
        trace[i, 1:] |= np.where(across[:-1] - extend > best[:-1] - open_, 16, 0).astype(np.uint8)
    i, j, p, q = n, m, [], []
    while i or j:
        t = trace[i, j]
        if i and j and t & 1:
            i, j = i - 1, j - 1
            p.append(a[i]), q.append(b[j])
        elif i and (t & 2 or not j):
            while True:
                more = bool(trace[i, j] & 8)
                i -= 1
                p.append(a[i]), q.append("-")
                if not more or not i:
                    break
        else:
            while True:
                more = bool(trace[i, j] & 16)
                j -= 1
                p.append("-"), q.append(b[j])
                if not more or not j:
                    break
    return int(best[m]), "".join(p[::-1]), "".join(q[::-1])


def shared_anchors(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of words of ``k`` letters that each has once, in the longest
    chain that rises in both."""
    def once(s: str) -> dict[str, int]:
        at: dict[str, int] = {}
        for i in range(len(s) - k + 1):
            at[s[i:i + k]] = -1 if s[i:i + k] in at else i
        return {w: i for w, i in at.items() if i >= 0}

    left, right = once(a), once(b)
    pairs = sorted((i, right[w]) for w, i in left.items() if w in right)
    tails: list[int] = []  # least end of a chain of each length
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(last[at - 1] if at else -1)
        tails[at:at + 1], last[at:at + 1] = [j], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def anchored_alignment(a: str, b: str, k: int = 15, least: int = 8, limit: int = 8000, **scores: object) -> tuple[str, str]:
    """Gapped strings of two sequences of any length.

    Up to ``limit`` letters they are aligned as a whole.  Longer ones are cut at words
    of ``k`` letters that both have once, and what lies between is aligned the same way,
    with shorter words down to ``least``; where no word is shared, both are cut in half.
    """
    if not a or not b:
        return a + "-" * len(b), "-" * len(a) + b
    if max(len(a), len(b)) <= limit:
        return global_alignment(a, b, **scores)[1:]
    while not (chain := shared_anchors(a, b, k)) and k > least:
        k = max(least, k // 2)
    if not chain:
        x, y = len(a) // 2, len(b) // 2
        halves = [anchored_alignment(a[:x], b[:y], k, least, limit, **scores), anchored_alignment(a[x:], b[y:], k, least, limit, **scores)]
        return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]
    out: list[tuple[str, str]] = []
    i = j = 0
    for p, q in chain:
        if p < i or q < j:  # overlaps the word before
            continue
        out.append(anchored_alignment(a[i:p], b[j:q], max(least, k // 2), least, limit, **scores))
        out.append((a[p:p + k], b[q:q + k]))
        i, j = p + k, q + k
    out.append(anchored_alignment(a[i:], b[j:], max(least, k // 2), least, limit, **scores))
    return "".join(x for x, _ in out), "".join(y for _, y in out)


def aligned_identity(ref: str, target: str) -> float:
    """Identity of aligned proteins: equal columns up to the target's first stop, over the
    longer length less the reference's gaps there."""
    n = target.find("*") + 1 or len(ref)
    base = max(len(ref), len(target)) - ref[:n].count("-")
    return sum(x == y for x, y in zip(ref[:n].upper(), target[:n].upper())) / max(base, 1)


def chosen_frame(seq: str, reference: str, current: float, gain: float = 0.01, **scores: object) -> tuple[int, int, float] | None:
    """The reading frame (start, end, identity) whose protein is most like the reference's,
    if it is better than ``current`` by more than ``gain``; the first of equals."""
    best: tuple[int, int, float] | None = None
    for start, end in open_frames(seq):
        ref, own = anchored_alignment(reference, translate(seq[start:end]), 8, 4, 2500, **scores)
        identity = aligned_identity(ref, own)
        if best is None or identity > best[2]:
            best = (start, end, identity)
    return best if best is not None and best[2] > current + gain else None


def frame_parts(parts: list[tuple[int, int]], strand: str, start: int, end: int) -> list[tuple[int, int]]:
    """The bases ``start`` to ``end`` (0-based, half-open) of a spliced transcript as genomic
    intervals, for its parts (1-based, inclusive) in rising order."""
    out, at = [], 0
    for a, b in parts if strand != "-" else parts[::-1]:
        n = b - a + 1
        x, y = max(start - at, 0), min(end - at, n)
        if x < y:
            out.append((a + x, a + y - 1) if strand != "-" else (b - y + 1, b - x))
        at += n
    return sorted(out)


def translate(seq: str) -> str:
    order = "TCAG"
    seq = seq.upper()
    out = []
    for i in range(0, len(seq) - 2, 3):
        k = [order.find(c) for c in seq[i:i + 3]]
        out.append("X" if min(k) < 0 else CODE[16 * k[0] + 4 * k[1] + k[2]])
    return "".join(out)


def open_frames(seq: str) -> list[tuple[int, int]]:
    """Of each frame the longest stretch from ATG to a stop (start, end); the first of equals."""
    out = []
    for frame in range(3):
        start, best = None, None
        for i in range(frame, len(seq) - 2, 3):
            codon = seq[i:i + 3].upper()
            if codon == "ATG" and start is None:
                start = i
            elif codon in STOPS and start is not None:
                if best is None or i + 3 - start > best[1] - best[0]:
                    best = (start, i + 3)
                start = None
        if best:
            out.append(best)
    return out


def variants(ref_dna: str, dna: str, ref_protein: str, protein: str, dna_identity: float, protein_identity: float, coding: bool = True) -> list[str]:
    """Classes of a lifted transcript from aligned sequences; ``coding`` is that of the reference."""
    if not coding:
        return ["non_coding"]
    if not dna:
        return ["full_transcript_loss"]
    if not protein:
        return ["no_protein"]
    if dna_identity == 1:
        return ["identical"]
    if protein_identity == 1:
        return ["synonymous"]
    out = []
    shifted = any(len(r) % 3 for s in (ref_dna, dna) for r in re.findall("-+", s))
    if shifted:
        out.append("frameshift")
    if ref_dna[:3].upper() != dna[:3].upper() != "ATG" and ref_protein[:1] != protein[:1] != "M":
        out.append("start_lost")
    if not shifted:
        out += ["inframe_insertion"] * ("-" in ref_dna) + ["inframe_deletion"] * ("-" in dna)
    parts = protein.replace("-", "").split("*")
    if len(parts) == 2 and not parts[1]:
        return out or ["nonsynonymous"]
    return out + ["stop_missing" if len(parts) == 1 else "stop_codon_gain"]


def cigar_blocks(cigar: str, query: int, target: int) -> list[tuple[int, int, int, int, int]]:
    """Ungapped blocks (query start, end, target start, end, mismatches), 0-based inclusive."""
    out = []
    open_block: list[int] | None = None
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "M=X":
            if open_block is None:
                open_block = [query, query - 1, target, target - 1, 0]
            open_block[1] += n
            open_block[3] += n
            open_block[4] += n if op == "X" else 0
            query, target = query + n, target + n
            continue
        if op in "IDN" and open_block is not None:
            out.append(tuple(open_block))
            open_block = None
        query += n if op in "IS" else 0
        target += n if op in "DN" else 0
    return out + ([tuple(open_block)] if open_block is not None else [])


def cheapest_chain(blocks: list[tuple[int, int, int, int, int]], mismatch: int = 2, gap_open: int = 2, gap_extend: int = 1, stretch: float = 2.0) -> tuple[float, list[int]]:
    """Cheapest path through blocks that advance in query and target.

    A block costs its mismatches, a step the query bases between its ends; a step
    must not be longer in the target than ``stretch`` times what the query has.
    All query bases outside the path cost as gaps do.
    """
    order = sorted(range(len(blocks)), key=lambda i: (blocks[i][1], blocks[i][0], i))
    if not order:
        return 0.0, []
    first, last = min(b[0] for b in blocks), max(b[1] for b in blocks)
    gap = lambda n: (n * gap_extend + gap_open - gap_extend) if n > 0 else 0
    cost: dict[int, float] = {}
    back: dict[int, int | None] = {}
    for k, i in enumerate(order):
        q0, q1, t0, t1, bad = blocks[i]
        cost[i], back[i] = gap(q0 - first), None
        for j in order[:k]:
            p0, p1, s0, s1, _ = blocks[j]
            if q0 > p1 and t0 > s1 and t1 - s0 <= stretch * (q1 - p0 + 1):
                c = cost[j] + gap(q0 - p1 - 1)
                if c < cost[i]:
                    cost[i], back[i] = c, j
        cost[i] += bad * mismatch
    end = min(order, key=lambda i: (cost[i] + gap(last - blocks[i][1]), i))
    total, path = cost[end] + gap(last - blocks[end][1]), []
    at: int | None = end
    while at is not None:
        path.append(at)
        at = back[at]
    return float(total), path[::-1]


@F.pandas_udf(T.StructType([T.StructField("score", T.LongType()), T.StructField("identity", T.DoubleType())]))
def align_identity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Score and identity of the global alignment; null for an empty side."""
    rows = []
    for x, y in zip(a, b):
        if not x or not y:
            rows.append((None, None))
            continue
        score, p, q = global_alignment(x, y)
        rows.append((score, sum(c == d for c, d in zip(p.upper(), q.upper())) / len(p)))
    return pd.DataFrame(rows, columns=["score", "identity"])
