"""Interval joins of whole chromosomes, above 2^27 bases, and of open ends."""

import random

from braidline.operators.fusion import copy_suppressed
from braidline.operators.interval import overlap_join

CHR1 = 248_956_422


def test_overlap_join_above_the_last_level(spark):
    rng = random.Random(11)
    span = lambda: (a := rng.randint(1, CHR1), a + int(10 ** rng.uniform(0, 8.5)))
    fixed = [("c0", 1, CHR1), ("c1", 1, 2**31 - 1), ("c0", 0, 2**63 - 1), ("c1", -(2**62), 2**62), ("c0", 2**35, 2**35 + 9)]
    q = [(i, *x) for i, x in enumerate(fixed + [(f"c{i % 2}", *span()) for i in range(60)])]
    f = [(i, *x) for i, x in enumerate([(f"c{i % 2}", *span()) for i in range(60)] + fixed)]
    got = overlap_join(spark.createDataFrame(q, "qi long, q_seqid string, q_start long, q_end long"), spark.createDataFrame(f, "id long, seqid string, start_pos long, end_pos long"))
    pairs = [(r.qi, r.id) for r in got.select("qi", "id").collect()]
    want = {(a[0], b[0]) for a in q for b in f if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_copies_on_a_whole_chromosome_are_suppressed(spark):
    kind = "id string, seqid string, start_pos int, end_pos int"
    models = spark.createDataFrame([("m", "c1", 5000, 5999), ("w", "c1", 1, 2**31 - 1), ("x", "c2", 1, 9)], kind)
    emitted = spark.createDataFrame([("g", "c1", 1, CHR1)], kind)
    assert [r.id for r in copy_suppressed(models, emitted).collect()] == ["x"]
