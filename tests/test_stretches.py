"""Islands, gaps and neighbours of whole sequences, worked on in stretches."""

import random

import pytest

from braidline.operators import interval as iv


def merged(rows, touch):
    out = []
    for c in {r[1] for r in rows}:
        last = None
        for _, _, a, b in sorted((r for r in rows if r[1] == c), key=lambda r: r[2:]):
            if last and a <= last[2] + touch:
                last[2], last[3] = max(last[2], b), last[3] + 1
            else:
                last = [c, a, b, 1]
                out.append(last)
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("width", [1, 2.6])
def test_stretches_change_nothing(spark, width):
    rng = random.Random(4)
    rows = [(i, rng.choice(["c0", None]), a := rng.randint(1, 3000), a + int(10 ** rng.uniform(0, width))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, seqid string, start_pos long, end_pos long")
    for touch in (True, False):
        for bits in (None, 5):
            got = [(r.seqid, r.start_pos, r.end_pos, r.n_parts) for r in iv.islands(df, ["seqid"], touch, bits).collect()]
            assert sorted(got, key=repr) == merged(rows, int(touch))
    gaps = [sorted(((r.seqid, r.gap_start, r.gap_end) for r in iv.gaps(df, ["seqid"], b).collect()), key=repr) for b in (None, 5)]
    assert gaps[0] == gaps[1]
    before = {r.id: r.before for r in iv.neighbor(df, ["seqid"], ["start_pos", "end_pos", "id"], "id", 5).collect()}
    for c in ("c0", None):
        order = [r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[0]))]
        assert [before[x] for x in order] == [None, *order[:-1]]
