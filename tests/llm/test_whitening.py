"""Whitening against exact integers and numpy's eigenvectors."""

import math

import numpy as np
import pytest
from conftest import SF

from marlstone.llm.embedding_whitening import integers, op13_whitening_svd, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, id string, d int"


def usable(rows):
    return [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def wanted(rows, k=8):
    own = usable(rows)
    x = np.array([v for _, v in own], object)
    n, sums = len(own), x.sum(0)
    deviations = ((n * x - sums) ** 2).sum(1)
    centred = np.array((n * x - sums), float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    kept = [c for c in range(min(k, len(e))) if e[c] > 1e-12 * e[0]]
    return own, deviations, [e[c] / (int(deviations.sum()) / n**3) for c in kept], centred @ u[:, kept] / np.sqrt(e[kept])


def check(rows, found, space, error):
    own, deviations, shares, w = wanted(rows)
    got = sorted(((r.id is None, r.id or 0, int(r.deviation), list(r.w)) for r in found.collect()), key=lambda r: r[:3])
    order = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, int(deviations[k])))
    assert [r[2] for r in got] == [int(deviations[k]) for k in order] and space.n == len(own)
    assert np.allclose(space.explained, shares, rtol=1e-9) and error < 1e-9
    mine, theirs = np.array([r[3] for r in got]).reshape(len(own), -1), w[order]
    signs = np.sign((mine * theirs).sum(0))
    assert mine.shape == theirs.shape and np.allclose(mine, theirs * signs, atol=1e-7)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "id", 3) for i, v in rows], SCHEMA)


def test_registered(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = op13_whitening_svd(spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = {(r.vec_id, r.component): r for r in df.collect()}
    own, deviations, shares, w = wanted(rows)
    assert len(got) == 8 * len(own)
    for c in range(8):
        signs = {np.sign(got[i, c + 1].whitened * w[k, c]) for k, (i, _) in enumerate(own) if abs(w[k, c]) > 1e-6}
        assert len(signs) == 1
        assert max(abs(abs(got[i, c + 1].whitened) - abs(w[k, c])) for k, (i, _) in enumerate(own)) < 1e-8
    assert all(r.n == len(own) and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got.values())
    assert all(got[i, 1].deviation == int(deviations[k]) for k, (i, _) in enumerate(own))


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 17, rng.normal(size=10).astype(np.float32).tolist()) for k in range(60)] + [(None, [0.5] * 10)] * 3
    bad = [(100, None), (101, []), (102, [None] * 10), (103, [float("nan")] + [0.0] * 9), (104, [float("inf")] + [0.0] * 9), (105, [float("-inf")] + [0.0] * 9)]
    check(rows, *whiten(table(spark, rows + bad)))
    found, space, _ = whiten(table(spark, rows + bad + [(200, [1.0, 2.0])]))  # another length has no place
    assert space.n == len(rows) and found.count() == len(rows)


def test_few_directions(spark):
    line = [(k, [float(k % 5), 2.0 * (k % 5), 1.0]) for k in range(40)]
    check(line, *whiten(table(spark, line)))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]], ids=["none", "one", "equal", "null"])
def test_no_variance(spark, rows):
    found, space, error = whiten(table(spark, rows))
    assert space.components == () and error == 0 and found.count() == len(usable(rows))
    assert all(r.deviation == 0 and r.w == [] for r in found.collect())


def test_whole_numbers(spark):
    got = integers(table(spark, [(1, [0.1, -0.1, 1e-9, -1e-9])])).first().x
    assert got == [100_102, 99_897, 100_000, 99_999]
