"""run() against its stages in SQL and Python."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from conftest import SF
from test_similar_sets import kept
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm.decontamination import OP4_SQL
from marlstone.llm.mixing import OP8_SQL
from marlstone.llm.quality_rules import OP9_SQL


def test_run(spark):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    c.execute(f"CREATE TABLE benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")

    def keep(ids):
        c.execute("CREATE OR REPLACE TABLE ids AS SELECT unnest($1) AS doc_id", [sorted(ids)])
        c.execute("CREATE OR REPLACE TABLE documents AS SELECT * FROM documents SEMI JOIN ids USING (doc_id)")

    keep([i for (i,) in c.execute(f"SELECT doc_id FROM ({OP9_SQL}) WHERE kept").fetchall()])
    keep(kept(sorted(c.execute("SELECT doc_id, text FROM documents").fetchall()))[0])
    bad = {i for (i,) in c.execute(f"SELECT doc_id FROM ({OP4_SQL})").fetchall()}
    keep([i for (i,) in c.execute("SELECT doc_id FROM documents").fetchall() if i not in bad])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in c.execute(f"SELECT m.doc_id, text FROM ({OP8_SQL}) m JOIN documents d USING (doc_id)").fetchall():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        wanted.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert sorted((r[0], *r[2:]) for r in got) == sorted(wanted) and wanted
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == sorted(r[0] for r in got)
    assert [r[1] for r in by_start] == np.cumsum([0, *(r[2] for r in by_start)])[:-1].tolist()
