"""Stages over nulls, repeated rows, clashing names and nothing at all; registered queries over empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import token_counts, token_files
from marlstone.llm.common import scratch
from marlstone.llm.queries import QUERIES

GOOD = "The river is wide and the old bridge in this town was built by people that are long gone, for all of us to see it."
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf_dirs: rows that are awkward, and no rows."""
    base = tmp_path_factory.mktemp("edges")
    item = " ".join(f"tok{k}" for k in range(30))
    rows = [
        (1, GOOD, "en", "src1", 1), (1, GOOD, "en", "src1", 1), (1, GOOD.replace("river", "street") + " Other words follow here, and they are of another kind.", "en", "src1", 1), (2, None, None, None, None), (3, "", "en", None, 0),
        (None, f"{GOOD} A row without an id, which is the one of its kind in this table.", None, None, 3), (4, f"{item} and so it is in the end of all that was said of it by the many.", "en", "src2", 1), (5, (GOOD + " ") * 40, "en", "src3", 1),
    ]
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    for name, own in (("rows", rows), ("none", [])):
        spark.createDataFrame(own, SCHEMA).withColumns({c: F.lit(9) for c in ("row", "id", "epoch", "domain", "bad", "plan")}).write.parquet(f"{base}/{name}/documents.parquet")
        bench.write.parquet(f"{base}/{name}/benchmark.parquet")
        pages.write.parquet(f"{base}/{name}/pages.parquet")
        labels.write.parquet(f"{base}/{name}/labels.parquet")
        vectors.write.parquet(f"{base}/{name}/embeddings.parquet")
    return {name: f"{base}/{name}" for name in ("rows", "none")}


def test_stages_keep_columns_and_decide(spark, tables):
    docs = spark.read.parquet(f"{tables['rows']}/documents.parquet")
    ids = lambda df: sorted((str(r.doc_id) for r in df.select("doc_id").collect()))
    steps = {name: f for name, f in corpus_pipeline.STAGES}
    kept = steps["quality rules"](spark, docs, tables["rows"])
    assert ids(kept) == ["1", "1", "1", "4", "None"] and kept.columns == docs.columns
    kept = steps["simhash near-dedup"](spark, kept, tables["rows"])
    assert ids(kept) == ["1", "1", "4", "None"] and kept.columns == docs.columns
    kept = steps["benchmark decontamination"](spark, kept, tables["rows"])
    assert ids(kept) == ["1", "1", "None"] and kept.columns == docs.columns
    kept = steps["mixing sources to target weights"](spark, kept, tables["rows"])
    assert set(ids(kept)) <= {"1", "None"} and kept.columns == docs.columns  # test_mixing_brute.py says which
    assert corpus_pipeline.run(spark, tables["rows"]).count() == kept.count()


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_nothing(spark, tables, name):
    query = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert query(spark, tables["none"]).count() == 0


def test_token_operators_over_nothing(spark):
    import public_tokenizers

    none = spark.createDataFrame([], "doc_id bigint, text string")
    cache, files = scratch(spark, "cache"), scratch(spark, "files")
    assert token_counts.token_counts(none, public_tokenizers.path("word_bpe_49k.json"), cache).count() == 0
    token_files.write_token_files(none, public_tokenizers.path("byte_bpe_50k.json"), files)
    assert token_files.read_token_files(spark, files).count() == 0


def test_tokenizers_for_which_white_space_counts(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_counts.token_counts(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "cache"))
