"""Operator 5: token counts of whole texts with overlap resynchronisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .tokens import WordEncoder, batches, library_offsets, spliced_ids


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048, huge: int = 32_768, overlap: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text, for a .json or .model vocabulary.

    Texts over ``huge`` characters are encoded in chunks of ``huge`` characters
    that overlap by ``overlap``, and spliced (see ``spliced_ids``), so a task never
    holds the encoding of more than a few chunks beside the ids; others are
    encoded whole.  Null texts count as empty: no bytes, no tokens.  Repeated rows
    give a row each, a null key stays null, other columns are left out, an empty table
    gives no rows.
    """

    held: list = []  # the worker's vocabulary

    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.extend((library_offsets(vocabulary), WordEncoder(vocabulary) if vocabulary.endswith(".json") else None))
        encode, words = held
        texts = ["" if t is None else t for t in batch.column("t").to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        tokens = np.zeros(len(texts), np.int64)
        short = np.flatnonzero(size <= huge)
        for a, b in batches([texts[i] for i in short]):
            part = [texts[i] for i in short[a:b]]
            tokens[short[a:b]] = words.counts(part) if words else [len(encode(t)[0]) for t in part]
        for i in np.flatnonzero(size > huge):
            tokens[i] = len(spliced_ids(texts[i], encode, huge, overlap))
        return [pa.array(np.array([len(t.encode()) for t in texts], np.int64)), pa.array(tokens), pa.array(tokens > limit)]

    return keyed(docs, key, text, of, "n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)
