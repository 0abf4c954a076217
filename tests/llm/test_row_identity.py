"""Rows of one key, or of none, whose texts have equal 32-bit hashes."""

import collections
import hashlib

from pyspark.sql import functions as F

from braidline.llm import repeats

PASSAGE = "a passage that two of the rows hold and that is cut from both of them, no more. "
#: (long row, short row) by number: equal Murmur3 hashes.
CLASHES = [(12815, 87002), (33768, 34835), (33826, 137864), (36506, 27933)]


def brute(rows, depth):
    raw = [(k, (t or "").encode()) for k, t in rows]
    n = collections.Counter(r[s:s + depth] for _, r in raw for s in range(len(r) - depth + 1))
    out = collections.Counter()
    for k, r in raw:
        gone = {x for s in range(len(r) - depth + 1) if n[r[s:s + depth]] > 1 for x in range(s, s + depth)}
        kept = bytes(b for j, b in enumerate(r) if j not in gone)
        out[k, len(r), len(gone), sum(1 for j in gone if j - 1 not in gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_of_rows_with_null_and_equal_keys(spark):
    rows = []
    for i, (a, b) in enumerate(CLASHES):
        key = (None, 7)[i % 2]
        rows += [(key, f"{PASSAGE}long row {a}"), (key, f"short row of its own bytes, in which nothing is said twice: {b}")]
    rows += [(key, f"row {i} of many of one key. {hashlib.sha256(str(i).encode()).hexdigest()}") for i in range(40) for key in (None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = [r.h for r in spark.createDataFrame(rows[:8], "doc_id long, text string").select(F.hash("text").alias("h")).collect()]
    assert hashes[::2] == hashes[1::2]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, depth=60).collect())
    assert got == brute(rows, 60)
