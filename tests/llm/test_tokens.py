"""Encoders against whole-text encoding by the library."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm.chunk_encoder import CountEncoder, IdEncoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WHOLE = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
IDS, COUNTS = IdEncoder(BYTE, limit=50), CountEncoder(WORD, limit=50)

PIECES = ["a", "Foo", "it's", "'ll", "été,", "x!!", "12", "3.14", " ", "  ", "\n", "\n\n", "\t", " \n", "\x1c", "\x85", "\xa0", " ", "　", "​", "́", "é"]
PIECES += ["<|endoftext|>", "<|startoftext|>", "<|", "İ", "ΟΔΟΣ", "ß", "ﬁ", "日本", "\U0001f642", "!", "$$$", "_", "\x00", "ǅ", "K"]


def check(text):
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == WHOLE[BYTE].encode(text, add_special_tokens=False).ids
    assert COUNTS.count(text) == len(WHOLE[WORD].encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_pieces(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check(text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize("text", ["", " ", "\n", "word " * 5000, "x" * 20000, "a  b   c\n\n\nd ", " lead", "\nlead", "tail\n\n"])
def test_edges(text):
    check(text)


def test_digests_stored_twice(spark, tmp_path):
    import public_tokenizers
    import pytest
    from pyspark.sql import functions as F

    from marlstone.llm.token_counts import token_counts

    cache, tokenizer = str(tmp_path / "cache"), public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id bigint, text string")
    first = sorted(map(tuple, token_counts(docs, tokenizer, cache).collect()))
    spark.read.parquet(cache).write.mode("append").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(cache)
    assert sorted(map(tuple, token_counts(docs, tokenizer, cache).collect())) == first and len(first) == 2
    spark.read.parquet(str(tmp_path / "again")).withColumn("n_tokens", F.col("n_tokens") + 1).write.mode("append").parquet(cache)
    with pytest.raises(Exception, match="different counts"):
        token_counts(docs, tokenizer, cache).collect()
