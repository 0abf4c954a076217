"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the standard genetic code, codons in the order of TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def translate(seq: Column) -> Column:
    """Amino acids of a sequence; a rest of fewer than three bases is left out, and
    codons with other letters are X."""
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.regexp_extract_all(F.upper(seq), F.lit("(...)"), F.lit(1))
    table = F.create_map(*(F.lit(x) for i, a in enumerate(CODE) for x in ("TCAG"[i // 16] + "TCAG"[i // 4 % 4] + "TCAG"[i % 4], a)))
    return F.when(n > 0, F.array_join(F.transform(codons, lambda c: F.coalesce(table[c], F.lit("X"))), "")).otherwise("")


def equal_columns(a: Column, b: Column) -> Column:
    """Places at which two strings of one length agree, case apart."""
    pairs = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def dna_identity(a: Column, b: Column) -> Column:
    """Equal columns over columns; gaps count."""
    return F.when(F.length(a) == 0, F.lit(0.0)).otherwise(equal_columns(a, b) / F.length(a))


def protein_identity(ref: Column, target: Column) -> Column:
    """Equal columns up to and with the target's first stop, over the longer length
    less the reference's gaps in that part."""
    stop = F.instr(target, "*")
    n = F.when(stop > 0, stop).otherwise(F.length(ref))
    part = F.substring(ref, F.lit(1), n)
    gaps = F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit("")))
    base = F.greatest(F.length(ref), F.length(target)) - gaps
    return equal_columns(part, F.substring(target, F.lit(1), n)) / F.when(base > 0, base).otherwise(1)


def orf_valid(protein: Column) -> Column:
    """Starts with M, ends with its only stop."""
    return protein.startswith("M") & protein.endswith("*") & (F.instr(protein, "*") == F.length(protein))


def frameshift(aligned: Column) -> Column:
    """Whether any run of gaps is no multiple of three."""
    return F.exists(F.regexp_extract_all(aligned, F.lit("(-+)"), F.lit(1)), lambda r: F.length(r) % 3 != 0)


def percent_encode(value: Column) -> Column:
    """Reserved characters of the ninth column as %XX."""
    for c in "%;=&,\t\n\r":
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def percent_decode(value: Column) -> Column:
    """%XX to text; ``+`` stays, and what cannot be decoded stays as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    return F.when(F.contains(value, F.lit("%")), decoded).otherwise(value)


def made_sequence(seed: Column, length: int) -> Column:
    """Bases that follow from a seed: two for each hexadecimal digit of the SHA-256 of the
    seed, a zero byte and a counter of eight bytes, digest after digest."""
    pairs = F.array(*(F.lit("ACGT"[i // 4] + "ACGT"[i % 4]) for i in range(16)))
    digests = [F.sha2(F.concat(F.encode(seed, "UTF-8"), F.unhex(F.lit(f"00{k:016x}"))), 256) for k in range(-(-length // 128))]
    digits = F.filter(F.split(F.concat(*digests) if digests else F.lit(""), ""), lambda d: d != "")
    bases = F.transform(digits, lambda d: F.element_at(pairs, F.conv(d, 16, 10).cast("int") + 1))
    return F.substring(F.array_join(bases, ""), 1, length)


def location(text: Column) -> Column:
    """``seqid:start-end`` as a struct; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", i)
    return F.when(text.rlike(r"^.+:\d+-\d+$"), F.struct(part(1).alias("seqid"), part(2).cast("long").alias("start_pos"), part(3).cast("long").alias("end_pos")))


def truncated(protein: Column) -> Column:
    """How many stops a protein has before its last letter."""
    inner = F.substring(protein, F.lit(1), F.greatest(F.length(protein) - 1, F.lit(0)))
    return F.length(inner) - F.length(F.replace(inner, F.lit("*"), F.lit("")))
