"""The audit against a walk through every order, row by row."""

import re
from itertools import permutations

import pytest
from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from compare import same
from marlstone.llm.filter_audit import OP11_SQL, audit, flagged, op11_filter_audit, survivors

DOCS = "doc_id bigint, text string, source string, n bigint, digest string, part string, A boolean"
LABELS = "doc_id bigint, quality int, toxic int, text string"
LONG = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, None, "a"), (5, "", None), (6, "A B C", "b"), (7, "x " * 80, ""), (8, LONG + " #", "b"),
    (None, LONG, "a"), (9, LONG.upper(), "c"), (10, "y " * 200_000 + "%", "c"), (9, LONG.upper(), "c"), (11, LONG + " z", "hot"), (12, LONG + " z", "hot"), (13, " " * 60, "hot"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (6, 1, 1), (None, 1, 1), (10, 0, 1), (11, 1, None), (12, 1, 1), (99, 1, 1)]


def flags_of(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, p in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        yield i, p or "", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t or "")) > 5 * len(t or ""), bool(re.search(r"[#$%&*|]", t or "")),
            i is not None and first[t or ""] < i,
        )


def walked(rows, marks):
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None}
    found, removed_by = {}, {}
    at = list(flags_of(rows))
    for part in {p for _, p, _ in at}:
        own = [(i, f) for i, p, f in at if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                k = ord(letter) - 65
                gone, left = [x for x in left if x[1][k]], [x for x in left if not x[1][k]]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                fails = sum(f[k] for _, f in own)
                found[part, "".join(order), step] = (len(left), len(gone), fails - len(gone), sum(f[k] and sum(f) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return sorted((*key, *v, removed_by[key[0], key[1][key[2] - 1]]) for key, v in found.items())


def tables(spark, rows, marks):
    return spark.createDataFrame([(i, t, p, 7, "d", "p", True) for i, t, p in rows], DOCS), spark.createDataFrame([(*m, "x") for m in marks], LABELS)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_every_order(spark):
    got = audit(flagged(*tables(spark, ROWS, MARKS)))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == walked(ROWS, MARKS)


def test_empty_tables(spark):
    assert not audit(flagged(*tables(spark, [], []))).collect()
    got = audit(flagged(*tables(spark, ROWS[:3], [])))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == walked(ROWS[:3], [])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flags=st.lists(st.tuples(st.sampled_from(["", "p", "q"]), *[st.booleans()] * 7), max_size=30))
def test_subset_survivors(spark, flags):
    at = spark.createDataFrame(flags, "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    wanted = []
    for part in {f[0] for f in flags}:
        for mask in range(32):
            left = [f for f in flags if f[0] == part and not any(f[1 + k] for k in range(5) if mask >> k & 1)]
            wanted.append((part, mask, len(left), sum(f[6] for f in left), sum(f[7] for f in left)))
    assert sorted(map(tuple, survivors(at).collect())) == sorted(wanted)


@pytest.mark.parametrize("sf", [SF])
def test_sql(spark, duck, sf):
    same(op11_filter_audit(spark, sf), duck.execute(OP11_SQL))
