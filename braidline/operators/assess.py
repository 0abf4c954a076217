"""Assessment of lifted transcripts: identities, variant classes and reading frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align

#: Classes after which a transcript's reading frame is searched anew.
BROKEN = {"stop_missing", "stop_codon_gain", "frameshift", "start_lost"}
RESULT = "dna_identity double, protein_identity double, classes array<string>, frame_start int, frame_end int, frame_identity double"


def assessed_one(ref_dna: str | None, dna: str | None, ref_protein: str | None, table: np.ndarray | None, limit: tuple[int, int] = (8000, 2500)) -> tuple:
    """One transcript against its reference: (identities, classes, frame).

    The protein is that of the whole sequence.  The frame is only looked for where
    something is broken, and given if its protein is better by more than a hundredth.
    """
    protein = align.translate(dna or "")
    protein = protein[:protein.find("*") + 1] or protein  # up to its first stop
    if not ref_protein:
        return None, None, ["non_coding"], None
    if not dna or not ref_dna:
        return 0.0, 0.0, ["full_transcript_loss"], None
    a, b = align.anchored_alignment(align.clean_dna(ref_dna), align.clean_dna(dna), 15, 8, limit[0])
    same = sum(x == y for x, y in zip(a, b)) / len(a)
    if not protein:
        return same, 0.0, ["no_protein"], None
    scores = {"table": table, "open_": 11, "extend": 1} if table is not None else {}
    p, q = align.anchored_alignment(ref_protein, protein, 8, 4, limit[1], **scores)
    identity = align.aligned_identity(p, q)
    classes = align.variants(a, b, p, q, same, identity)
    frame = align.chosen_frame(dna, ref_protein, identity, **scores) if BROKEN & set(classes) else None
    return same, identity, classes, frame


def assessed(transcripts: DataFrame, key: str, matrix: str | None = None) -> DataFrame:
    """Identities, classes and, where it is better, another reading frame of transcripts
    (key, ref_dna, dna, ref_protein; null: none), a row each.

    ``matrix`` is the text of a table of amino acid scores (``align.score_table``); without
    one, proteins are aligned by equality.
    """
    table = None if matrix is None else align.score_table(matrix)
    kind = transcripts.schema[key].dataType.simpleString()
    names = ["k", *(c.split()[0] for c in RESULT.split(", "))]
    types = [pa.float64(), pa.float64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y, z in zip(*(batch.column(c).to_pylist() for c in ("ref_dna", "dna", "ref_protein"))):
                *head, frame = assessed_one(x, y, z, table)
                rows.append((*head, *(frame or (None, None, None))))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *columns], names)

    own = transcripts.select(F.col(key).alias("k"), "ref_dna", "dna", "ref_protein")
    return own.mapInArrow(run, f"k {kind}, {RESULT}").withColumnRenamed("k", key)
