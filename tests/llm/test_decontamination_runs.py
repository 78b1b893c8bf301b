"""Whole diagonals are judged: long items, runs behind islands, short items."""

import pytest

from marlstone.llm import decontamination


def found(spark, docs, items):
    at = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.contaminated(at, bench)
    return {(r.doc_id, r.item_id): (r.matched_words, r.overlap_words) for r in got.collect()}, at, bench


@pytest.mark.parametrize("equal, replaced, verbatim", [(10, 13, 37), (10, 9, 21), (10, 40, 70)])
def test_run_behind_an_island(spark, equal, replaced, verbatim):
    item = [f"tok{k}" for k in range(equal + replaced + verbatim)]
    gone = [f"new{k}" for k in range(replaced)]
    docs = ["nothing here", " ".join([*item[:equal], *gone, *item[equal + replaced :]]), " ".join(["none"] * equal + gone + item[equal + replaced :]), " ".join([*item[:equal], *gone])]
    got, at, bench = found(spark, docs, [" ".join(item)])
    assert got == {(1, 0): (verbatim, verbatim), (2, 0): (verbatim, verbatim)}
    assert sorted(r.doc_id for r in decontamination.decontaminate(at, bench).collect()) == [0, 3]


def test_long_item(spark):
    item = [f"t{k}" for k in range(400)]
    island = [*item[:10], *(f"o{k}" for k in range(100)), *item[110:170], *(f"p{k}" for k in range(230))]
    tail = [*(f"q{k}" for k in range(312)), *item[312:]]
    thinned = [f"r{k}" if k % 6 == 5 else t for k, t in enumerate(item)]
    got, *_ = found(spark, [" ".join(x) for x in (item, island, tail, thinned, item[::-1], [*item[:11], *item[300:311]])], [" ".join(item)])
    assert got == {(0, 0): (400, 400), (1, 0): (60, 60), (2, 0): (88, 88), (3, 0): (334, 400)}


def test_short_items(spark):
    docs, items, whole = [], [None, ""], {}
    for n in range(3, 14):
        item = [f"s{n}x{k}" for k in range(n)]
        at, own = len(docs), len(items)
        docs += [" ".join(["a", *item, "b"]), " ".join(["a", *item[:-1], "c", "b"]), " ".join(item[1:]), " ".join(item)]
        items.append(" ".join(item))
        if n >= decontamination.LEAST_ITEM:
            whole |= {(at, own): (n, n), (at + 3, own): (n, n)}
        if n == 13:  # twelve of its tokens convict
            whole |= {(at + 1, own): (12, 12), (at + 2, own): (12, 12)}
    got, *_ = found(spark, docs, items)
    assert got == whole


def test_repeated_tokens_and_rows(spark):
    item = " ".join(["again"] * 20)
    got, *_ = found(spark, [" ".join(["again"] * 50), " ".join(["again"] * 4)], [item, item])
    assert got == {(0, 0): (20, 20), (0, 1): (20, 20)}


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 60)
    items = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(8)]
    got, *_ = found(spark, [f"x {t} y" for t in items], items)
    assert got == {(k, k): (20, 20) for k in range(8)}
