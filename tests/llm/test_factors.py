"""Relative Lempel-Ziv parsing against brute force on small alphabets, where everything repeats."""

import random

from marlstone.llm import substring_dedup


def brute(rows, width):
    first = {}
    for i, w in rows:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_everything_repeats(spark):
    rng = random.Random(1)
    rows = [(-(1 << 63), ["a", "b"] * 9), ((1 << 63) - 1, ["b", "a"] * 9)]
    rows += [(k // 2, [rng.choice("ab") for _ in range(rng.randint(0, 60))]) for k in range(120)] + [(200, ["c"] * 400), (201, ["c"] * 500)]
    docs = spark.createDataFrame([(i, "  ".join(w) + "\n") for i, w in rows], "doc_id bigint, text string")
    for width, blocks in ((3, 5), (8, 3)):
        got = substring_dedup.substring_dedup(docs, width=width, blocks=blocks).collect()
        assert sorted(tuple(r[:4]) for r in got) == brute(rows, width)


def test_factors_end_where_the_place_does():
    import numpy as np

    held = np.array([True] * 6 + [False] * 2 + [True] * 2)
    source = np.array([4, 4, 4, 3, 3, 9, 0, 0, 4, 4])
    place = np.array([0, 1, 2, 7, 8, 0, 0, 0, 0, 1])
    spans, straddling = substring_dedup.factors(held, source, place, 3)
    assert spans == [(0, 5, 4, 0), (5, 8, 9, 0), (8, 12, 4, 0)]
    assert straddling == [(3, 7)]
