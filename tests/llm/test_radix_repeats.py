"""Repeats against brute force: periodic and Thue-Morse texts, null, equal and wide
keys, buckets that are split, texts that are read in parts."""

import collections
import random

import numpy as np
import pytest

from braidline.llm import repeats

from test_row_identity import brute


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    out = [(None, None), (1, ""), (2, "x" * 2000), (3, "x" * 150), (4, "abc" * 300 + prose(30)), (5, thue_morse(1024)), (6, thue_morse(2048)[1024:]), (2**60 + 1, "é漢字" * 120), (None, "é漢字" * 90)]
    for i in range(60):
        t = prose(rng.randint(5, 80))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 50)
            t = t + p[a:a + rng.randint(40, 400)] + prose(rng.randint(0, 20))
        out.append((rng.choice([None, 7, 2**60 + 1, i]), t))
        if i % 7 == 0:
            out += [(i, t), (None, t)]
        if i % 5 == 0:
            out.append((i, t[:len(t) // 2] + "Z" + t[len(t) // 2:]))
    return out


@pytest.mark.parametrize(("depth", "limit", "piece"), [(200, 2048, 1 << 20), (200, 2, 1 << 20), (200, 2048, 500), (40, 2, 300)])
def test_repeats_equal_brute_force(spark, rows, depth, limit, piece):
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, h string, spans int").repartition(3)
    out = repeats.remove_repeats(docs, depth=depth, limit=limit, piece=piece).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows, depth)


def test_radix_order_gives_sorted_rows_and_shared_bytes():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, (200, 16)).astype(np.uint8)
    raw[50:60] = raw[40:50]
    bucket = np.sort(rng.integers(0, 5, 200))
    order, shared = repeats.radix_order(raw.view(">u8").astype(np.uint64), bucket)
    keys = [(bucket[i], raw[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 200):
        (b0, x), (b1, y) = keys[k - 1:k + 1]
        same = next((j for j in range(16) if x[j] != y[j]), 16)
        assert shared[k] == (same if b0 == b1 else -1)
