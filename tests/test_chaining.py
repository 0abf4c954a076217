"""Chaining: better chunks, ties, single parts, empty sides."""

from braidline.operators.chaining import Model, chain


def test_better_chunk_wins():
    lift = Model([(1, 9), (20, 28)], "MKAMKA", "MXXMKA", [0, 3, 6])
    protein = Model([(1, 9), (21, 28)], "MKAMKA", "MKAMXX", [0, 3, 6])
    assert chain(lift, protein) == ([(1, 9), (20, 28)], ["protein", "lift"])


def test_tie_goes_to_the_lift_and_nothing_to_nobody():
    lift = Model([(1, 9), (20, 28)], "MKAMKA", "MKAXXX", [0, 3, 6])
    protein = Model([(4, 9), (21, 28)], "MKAMKA", "MKAXXX", [0, 3, 6])
    assert chain(lift, protein) == ([(1, 9)], ["lift", "empty"])


def test_single_part_is_one_chunk():
    lift = Model([(1, 18)], "MKAMKA", "MKAMXX", [0, 6])
    protein = Model([(1, 9), (20, 28)], "MKAMKA", "MKAMKX", [0, 3, 6])
    assert chain(lift, protein) == ([(1, 9), (20, 28)], ["protein"])
    assert chain(None, protein)[0] == protein.parts and chain(lift, None)[0] == lift.parts and chain(None, None) == ([], [])
