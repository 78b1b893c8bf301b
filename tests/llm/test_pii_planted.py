"""Planted personal data in shapes and contexts that the training sample does not write, and look-alikes."""

import random

from marlstone.llm import pii_boosting

LEADS = {
    "email": "Please drop me a line at any time, my courriel is", "phone": "You can call our fax or mobile under", "ssn": "His social security no.", "iban": "Transfer it to my konto", "card": "The credit was charged to",
    "ip": "traffic came from host",
}


def planted(rng, kind):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("{at}", "{dot}")))
        return f"m{d(2)}.smith{at}mail-{d(2)}{dot}{rng.choice(('com', 'org', 'de'))}"
    if kind == "phone":
        return rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}"))
    if kind == "ssn":
        return f"{d(3)}-{d(2)}-{d(4)}"
    if kind == "iban":
        return f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"
    if kind == "ip":
        return ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
    while True:
        v = "4" + d(15)
        if sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(v)))) % 10 == 0:
            return rng.choice("./_").join(v[k : k + 4] for k in range(0, 16, 4))


def test_recall_and_look_alikes(spark):
    rng, rows = random.Random(5), []
    for kind, lead in LEADS.items():
        for _ in range(60):
            rows.append((len(rows), f"{lead} {planted(rng, kind)} and thanks", kind))
    n = len(rows)
    for _ in range(60):
        d = "".join(rng.choice("0123456789") for _ in range(19))
        while sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d[:16])))) % 10 == 0:
            d = "".join(rng.choice("0123456789") for _ in range(19))
        rows += [(len(rows) + k, t, None) for k, t in enumerate((f"order no {d[:16]} of it", f"they met at home. It was version {d[:3]}-{d[3:5]}-{d[5:9]} then", f"words {d[:16]} more words", f"serial {d[:4]}-{d[4:7]}-{d[7:10]} of the part"))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii_boosting.pii_spans(docs).collect()}
    found = sum(kind in got[i] for i, _, kind in rows[:n])
    false = sum(bool(got[i]) for i, _, kind in rows[n:])
    assert found >= 0.9 * n, (found, n)
    assert false <= 0.05 * (len(rows) - n), (false, len(rows) - n)


def test_lengths_have_no_bound(spark):
    long = "a" * 300
    texts = [f"mail {long}[at]{long}[dot]com", "mail x [at] " + ".".join(["sub"] * 3000) + ".org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii_boosting.pii_spans(docs).collect()} == {k: [(5, len(t))] for k, t in enumerate(texts)}
