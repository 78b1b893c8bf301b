"""Ids of a column of texts: equal to the library's, each different run of characters encoded once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import chunk_encoder
from marlstone.llm.chunk_encoder import IdEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
IDS = IdEncoder(PATH, limit=50)
PIECES = ["a", "Foo", "it's", "été,", "x!!", "12", "3.14", "a1b2", "--", " ", " ", " ", "  ", "\n", "\t", "\x00", "\xa0", "<|endoftext|>", "日本", "Ġ", "Ċ", "_"]


def held(texts):
    found = [x for some in IDS.columns(pa.array(texts, pa.string())) for x in some]
    assert [x.tolist() for x in found] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("column_bytes", "call_runs"), [(1 << 24, 50_000), (20, 3)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=8))
def test_columns(column_bytes, call_runs, texts):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chunk_encoder, "COLUMN_BYTES", column_bytes)
        patch.setattr(chunk_encoder, "CALL_RUNS", call_runs)
        held(texts)


def test_slices_of_columns():
    texts = ["one two", "", "three, two\nfour", "\ttab", "two two.", "last 1.5"]
    found = [x.tolist() for some in IDS.columns(pa.array(texts).slice(2, 3)) for x in some]
    assert found == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts[2:5]]


class Counted:
    def __init__(self, runs):
        self.runs, self.seen = runs, []

    def encode_batch_fast(self, texts, **options):
        self.seen += [run for text in texts for run in text.split()]
        return self.runs.encode_batch_fast(texts, **options)


def test_different_runs_are_encoded_once(monkeypatch):
    ids = IdEncoder(PATH)
    ids.runs, whole, asked = Counted(ids.runs), ids.whole, []
    monkeypatch.setattr(ids, "whole", lambda chunk: asked.append(chunk) or whole(chunk))
    rng = np.random.default_rng(3)
    texts = ["worda. " + " ".join(f"word{'abcdefgh'[k % 8]}{'.,;!'[k % 4]}" for k in rng.integers(0, 8, 200)) for _ in range(50)]
    assert sum(len(x) for some in ids.columns(pa.array(texts)) for x in some) > 10_000
    assert sorted(run for run in ids.runs.seen if run[0] == "Ġ") == ["Ġword" + c for c in "abcdefgh"]
    assert len(ids.runs.seen) == 8 + 2 * 4  # and each mark once, behind a newline
    assert set(asked) <= {"worda.", " "}
