"""Greedy admission over linked candidates, and chains of many transcripts, against the plain folds."""

import random

from braidline.operators.chaining import MODEL, Model, chain, chained
from braidline.operators.fusion import admit, admit_greedily


def test_admission_is_that_of_one_fold(spark):
    rng = random.Random(9)
    for wide, genes in ((30, 150), (200, 60), (5, 20)):
        rows = [(f"m{i:03}", f"g{rng.randint(0, genes)}", f"c{rng.randint(0, 2)}", a := rng.randint(1, 5000), a + rng.randint(0, wide)) for i in range(200)]
        want = {r[3] for r in admit_greedily((s, a, b, i, g) for i, g, s, a, b in rows)}
        got = [r.id for r in admit(spark.createDataFrame(rows, "id string, gene string, seqid string, start_pos long, end_pos long")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_chains_of_a_table(spark):
    lift = Model([(1, 9), (20, 28)], "MKAMKA", "MXXMKA", [0, 3, 6])
    protein = Model([(1, 9), (21, 28)], "MKAMKA", "MKAMXX", [0, 3, 6])
    row = lambda k, m: (k, (m.parts, m.reference, m.target, [float(e) for e in m.edges]))
    schema = f"t string, model {MODEL}"
    out = {r.t: r for r in chained(spark.createDataFrame([row("a", lift), row("b", lift)], schema), spark.createDataFrame([row("a", protein), row("c", protein)], schema), "t").collect()}
    for t, x, y in (("a", lift, protein), ("b", lift, None), ("c", None, protein)):
        parts, chosen = chain(x, y)
        assert [(p.a, p.b) for p in out[t].parts] == parts and out[t].chosen == chosen
