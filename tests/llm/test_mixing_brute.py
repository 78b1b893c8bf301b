"""Mixing against brute force over awkward rows: nulls, ties, repeated rows, hot leaves."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from marlstone.llm import mixing

WORDS = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()


def weight(path):
    return Fraction(mixing.WEIGHTS.get(path, 1.0))


def shares(total, nodes):
    """nodes: (weight, most) by name. Fill those that are full first, then share by weight."""
    given, left = {}, dict(nodes)
    while left:
        level = total / sum(w for w, _ in left.values())
        full = [k for k, (w, most) in left.items() if most <= w * level]
        if not full:
            return given | {k: w * level for k, (w, _) in left.items()}
        for k in full:
            given[k] = left.pop(k)[1]
            total -= given[k]
    return given


def brute(rows):
    leaf = defaultdict(list)
    for i, text, lang, source in rows:
        n = len((text or "").split())
        number = "".join(c for c in (source or "") if c.isdigit())
        leaf[mixing.DOMAINS[(int(number) if number else 0) % 4], lang or "", source or ""].append((i, n, (i, text, lang, source)))
    tokens = {k: sum(n for _, n, _ in v) for k, v in leaf.items()}
    most = lambda path: Fraction(sum(2 * n for k, n in tokens.items() if k[: len(path)] == path))
    budget = {(): Fraction(sum(tokens.values()))}
    for depth in (1, 2, 3):
        for up in [p for p in budget if len(p) == depth - 1]:
            names = {k[:depth] for k in leaf if k[: depth - 1] == up}
            budget |= shares(budget[up], {p: (weight(p), most(p)) for p in sorted(names)})
    out = []
    for k, docs in leaf.items():
        given, n = int(budget[k]), tokens[k]
        epochs, rest = (1, 0) if n == 0 else divmod(given, n)
        out += [(row, e) for e in range(epochs) for *_, row in docs]
        place = lambda i, e=epochs: hashlib.md5(f"{mixing.SEED}:{e}:{'' if i is None else i}".encode()).hexdigest()
        upto = 0
        for p in sorted({place(i) for i, *_ in docs}):
            tied = [(m, row) for i, m, row in docs if place(i) == p]
            upto += sum(m for m, _ in tied)
            if rest and upto <= rest:
                out += [(row, epochs) for _, row in tied]
    return sorted(map(str, out))


def test_rows(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.choice((0, 1, 5, 40))))
    rows = [(k, text(), rng.choice(("en", "de", "fr")), f"src{rng.randint(0, 9)}") for k in range(300)]
    rows += [(1000 + k, text(), "en", "src1") for k in range(400)]  # a hot leaf
    rows += rows[:20] + [(5, "other words", "en", "src1"), (None, "no id", None, None), (None, None, None, None), (2000, "", "xx", "src77"), (2001, None, "xx", "src77"), (2002, "w " * 900, "es", "books")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs.withColumns({c: F.lit(1) for c in ("epoch", "row", "plan", "domain", "n_tokens", "id", "cut", "wanted")}), carry=["doc_id", "text", "lang", "source"])
    assert sorted(str((tuple(r.row), r.epoch)) for r in got.collect()) == brute(rows)
