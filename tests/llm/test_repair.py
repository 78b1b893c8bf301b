"""Re-Pair round trips, random access and the file format."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import repair_grammar as rg


def held(docs):
    starts = np.cumsum([0, *map(len, docs)])[:-1]
    g = rg.unpack(rg.pack(rg.compress(np.array([x for d in docs for x in d], np.uint32), starts, 60, least=2, least_gain=0.0)))
    assert rg.expand(g, g.symbols).tolist() == [x for d in docs for x in d]
    for k, d in enumerate(docs):
        assert rg.document(g, k).tolist() == d
        for at in {0, len(d) // 2, len(d) - 1}:
            assert rg.token(g, k, at) == d[at]
    return g


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=40), min_size=1, max_size=6))
def test_round_trip(docs):
    held(docs)


def test_repeats_shrink_and_lengths_add_up():
    g = held([[1, 2, 3, 4] * 300, [1, 2, 3, 4] * 200 + [0]])
    assert len(g.symbols) < 2001 / 4 and len(g.rounds) > 1
    assert [len(rg.expand(g, np.array([g.first_rule + k]))) for k in range(len(g.rules))] == g.lengths.tolist()


def test_damage_is_noticed():
    b = bytearray(rg.pack(rg.compress(np.arange(50, dtype=np.uint32), np.array([0]), 60)))
    b[20] ^= 1
    with pytest.raises(ValueError):
        rg.unpack(bytes(b))
