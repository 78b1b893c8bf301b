"""Toxicity of disguised text: restore what was meant, then score it.

Texts are restored by the noisy channel of deobfuscation, whose character model
counts all of the corpus. The score is a logistic regression over the letter
sequences (three to six letters, word boundaries included) and words that set toxic
documents apart, fitted with MLlib on labelled rows. An automaton of those sequences
reads each restored text once, so scoring is one pass over the documents in place.

Bounds: the fit takes at most MOST_LABELLED labelled documents, those with the least
hash of their ids, and MOST_FEATURES sequences; the character model has a fixed size.
All else covers all rows: every whole text is counted by the model and scored.

Defined results: a null text counts as empty; empty texts get the score of a text
without any known sequence; a null id is neither held out nor labelled; repeated rows
each keep their row. Of several labels of a document the largest holds, null labels
are none. If no labels are there, or only one kind, all scores are the share of toxic
ones among them (0 without labels). An empty table gives no rows. Other columns are
not read, so they may have any name.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import load, written
from marlstone.llm.deobfuscation import Reader, gram_counts, model_of

MOST_LABELLED, MOST_FEATURES = 12_000, 4_096
SHORTEST, LONGEST = 3, 6
#: Toxic documents that a sequence must be in at least to be looked at.
LEAST_DOCUMENTS = 3
THRESHOLD = 0.3
#: Of squared weights. Little, as one telling word has to do.
PENALTY = 3e-4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sequences(word: str) -> set[str]:
    """Letter sequences of a word with its boundaries, and the whole word."""
    own = f" {word} "
    return {own[k : k + n] for n in range(SHORTEST, LONGEST + 1) for k in range(len(own) - n + 1)} | {own}


@dataclass(frozen=True)
class Scorer:
    """Weights of sequences and of no sequence at all; the model that texts are restored by."""

    model: array
    weights: dict[str, float]
    bias: float

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score of each row."""
        model, weights, bias = self.model, self.weights, self.bias

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, held = Reader(model), _automaton(weights)

            def of(text: str | None) -> float:
                found = {g for _, g in held.iter(f" {reader.text(text)} ")} if weights else ()
                return 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + math.fsum(weights[g] for g in found)))))

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id bigint, score double")


def _automaton(found):
    import ahocorasick

    a = ahocorasick.Automaton()
    for g in found:
        a.add_word(g, g)
    a.make_automaton()
    return a


def training_rows(docs: DataFrame, labels: DataFrame, model: array) -> DataFrame:
    """toxic (0 or 1) and the restored text of at most MOST_LABELLED labelled documents that are not held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(written(marks.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED), "toxic-labels"))  # at most MOST_LABELLED rows
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text")).join(sample, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.text(t) for t in batch.column(1).to_pylist()], pa.string())], ["toxic", "text"])

    return written(rows.select((F.col("toxic") == 1).cast("int").alias("toxic"), "text").mapInArrow(read, "toxic int, text string"), "toxic-training")


def telling(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The sequences that are likelier in toxic documents, by the likelihood ratio of their counts of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[Counter, Counter] = (Counter(), Counter())
        of: dict[str, set[str]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[str] = set()
                for w in set(text.split()):
                    if w not in of:
                        if len(of) > 50_000:
                            of.clear()
                        of[w] = sequences(w)
                    found |= of[w]
                own[toxic].update(found)
        names = list(own[0].keys() | own[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([own[1][g] for g in names], pa.int64()), pa.array([own[0][g] for g in names], pa.int64())], ["gram", "toxic", "clean"])

    found = rows.mapInArrow(count, "gram string, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= LEAST_DOCUMENTS)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share, both = n_toxic / (n_toxic + n_clean), n_toxic + n_clean

    def part(x: Column, wanted: Column) -> Column:
        return F.when(x > 0, x * F.log(x / wanted)).otherwise(F.lit(0.0))

    rest = F.lit(float(both)) - a - b
    gain = part(a, (a + b) * share) + part(b, (a + b) * (1 - share)) + part(n_toxic - a, rest * share) + part(n_clean - b, rest * (1 - share))
    best = found.where(a * n_clean > b * n_toxic).orderBy(F.desc(gain), "gram").limit(MOST_FEATURES)
    return [r.gram for r in best.select("gram").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    model = model_of(gram_counts(docs))
    rows = training_rows(docs, labels, model)
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return Scorer(model, {}, 500.0 if n_toxic else -500.0)
    chosen = telling(rows, n_toxic, n - n_toxic)
    if not chosen:
        return Scorer(model, {}, math.log(n_toxic / (n - n_toxic)))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _automaton(chosen)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted({g for _, g in held.iter(f" {t} ")}) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["toxic", "grams"])

    held = written(rows.mapInArrow(hold, "toxic int, grams array<string>"), "toxic-features")
    vectors = CountVectorizerModel.from_vocabulary(chosen, inputCol="grams", outputCol="features", minTF=1.0).setBinary(True).transform(held)
    fitted = LogisticRegression(labelCol="toxic", featuresCol="features", regParam=PENALTY, standardization=False, maxIter=60).fit(vectors)
    return Scorer(model, dict(zip(chosen, map(float, fitted.coefficients.toArray()))), float(fitted.intercept))


def op12_noisy_channel(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = fit(docs, load(spark, sf_dir, "labels")).scores(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
