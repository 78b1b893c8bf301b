"""Readings against all paths of the lattice; scores of disguised words; awkward rows; held-out accuracy."""

import math
import random
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import deobfuscation as d
from marlstone.llm.toxicity import fit, op12_noisy_channel

SF = "/root/testdata/sf0.1"
FILLER = "the weather in town was fine and people went to market with their friends for bread trash idiot stupid loser clown moron".split()


def counts_of(words):
    return np.bincount(d._grams("   " + " ".join(words) + " "), minlength=d.GRAMS)


@pytest.fixture(scope="module")
def reader():
    return d.Reader(d.model_of(counts_of(FILLER * 50)))


def cost_of(model, seen, arcs):
    """Cost of one path and what it writes."""
    h, cost, out = 0, 0.0, ""
    for a, code, extra in arcs:
        cost += extra
        if a and code:
            cost, h = cost + model[h * d.BASE + code], (h * d.BASE + code) % d.BASE**3
        elif a:
            cost, h = cost + (model[h * d.BASE] if h else 0.0), 0
        out += a
    return cost + (model[h * d.BASE] if h else 0.0), out


@settings(max_examples=150, deadline=None)
@given(seen=st.text("it1!0o$s-. éß¤е", min_size=1, max_size=7), spaced=st.booleans())
def test_cheapest_path(reader, seen, spaced):
    paths = [cost_of(reader.model, seen, p) for p in product(*[d.arcs_of(seen, i, spaced) for i in range(len(seen))])]
    got = reader.read(seen, spaced)
    assert min(c for c, out in paths if out == got) == pytest.approx(min(paths)[0])


@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.text("abzéß9-", min_size=1, max_size=6), max_size=8))
def test_counts(words):
    wanted = {}
    text = " ".join(words)
    codes = [0, 0, 0, *[d._CODES.get(c, 0) for c in text], 0]
    for i in range(3, len(codes)):
        one, two, three = codes[i - 1], codes[i - 2], codes[i - 3]
        two = two if one else 0
        three = three if two else 0
        if one or codes[i]:
            key = ((three * 27 + two) * 27 + one) * 27 + codes[i]
            wanted[key] = wanted.get(key, 0) + 1
    got = counts_of(words)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == wanted


def test_model_is_a_distribution(reader):
    p = np.exp(-np.array(reader.model)).reshape(-1, d.BASE)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


@pytest.mark.parametrize(
    ("seen", "meant"),
    [
        ("1d10t", "idiot"), ("!diot", "idiot"), ("$tup1d!", "stupid"), ("l0ser", "loser"), ("looooser", "loser"), ("tr@@@sh", "trash"), ("i d i o t", "idiot"), ("M.O.R.O.N", "moron"), ("c-l-0-w-n", "clown"),
        ("st*pid", "stupid"), ("trаsh", "trash"), ("ＩＤＩＯＴ", "idiot"), ("id​iot", "idiot"), ("market???", "market"), ("people###", "people"), ("the weather in town", "the weather in town"), ("2024", "2024"), ("", ""), (None, ""),
        ("\ud800x", "\ud800x".encode("utf-8", "ignore").decode()),
    ],
)
def test_readings(reader, seen, meant):
    if seen and "\ud800" in seen:  # a lone surrogate cannot come from a table; it still must not stop a task
        assert isinstance(reader.text(seen), str)
    else:
        assert reader.text(seen) == meant


def test_long_token_is_read_in_stretches(reader):
    own = "1d10t-" * 20_000
    assert reader.read(own).count("idiot") > 19_000


def disguised(rng, word):
    how = rng.randrange(4)
    if how == 0:
        return word.translate(str.maketrans("oieas", "01345"))
    if how == 1:
        return rng.choice(" .-").join(word)
    if how == 2:
        k = rng.randrange(1, len(word) - 1)
        return word[:k] + word[k] * 4 + word[k + 1 :]
    return word.replace("s", "$").replace("i", "!").replace("a", "@").replace("o", "0")


@pytest.fixture(scope="module")
def scorer(spark):
    rng = random.Random(3)
    calm = FILLER[:15]
    docs, labels = [], []
    for i in range(400):
        own = [rng.choice(calm) for _ in range(30)]
        if i % 4 == 0:
            for w in rng.sample(FILLER[15:], rng.randrange(1, 3)):
                own.insert(rng.randrange(len(own)), w)
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 4 == 0), "x"))
    at = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    return fit(*at)


def test_disguised_words_score_like_plain_ones(spark, scorer):
    rng = random.Random(4)
    calm = [" ".join(rng.choice(FILLER[:15]) for _ in range(25)) for _ in range(200)]
    rows = [(k, f"{t} {disguised(rng, rng.choice(FILLER[15:]))} {t}" if k % 2 else t) for k, t in enumerate(calm)]
    found = {r.doc_id: r.score for r in scorer.scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[k] >= 0.3 for k in found if k % 2) >= 95 and not [k for k in found if k % 2 == 0 and found[k] >= 0.3]


def test_awkward_rows(spark, scorer):
    schema = "doc_id bigint, text string, score double, toxic int, gram string"
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "idiot"), (3, "idiot"), (4, "the weather " * 100_000 + "1d10t stupid"), (5, "漢字 данные ١٢٣")]
    found = [(r.doc_id, r.score) for r in scorer.scores(spark.createDataFrame([(*r, 0.5, 1, "g") for r in rows], schema)).collect()]
    score = dict(found)
    assert len(found) == len(rows) and score[1] == score[2] == score[5] and score[3] == score[None] > score[1] and score[4] > 0.3
    assert not scorer.scores(spark.createDataFrame([], schema)).collect()


@pytest.mark.parametrize(("marks", "wanted"), [([], 0.0), ([(1, 0), (2, None)], 0.0), ([(1, 1), (5, 1)], 1.0)], ids=["none", "clean only", "toxic only"])
def test_labels_of_one_kind(spark, marks, wanted):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1, 9)], "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    assert {round(r.score, 6) for r in fit(docs, labels).scores(docs).collect()} == {wanted}


def test_registered(spark):
    df = op12_noisy_channel(spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = {r.doc_id: r for r in df.collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 and not math.isnan(r.score) for i, r in found.items())
    held = [(found[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if found[r.doc_id].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((x > y) + (x == y) / 2 for x in toxic for y in clean) / len(toxic) / len(clean)
    assert auc > 0.97 and np.mean([s >= 0.3 for s in toxic]) > 0.8 and np.mean([s >= 0.3 for s in clean]) < 0.02
