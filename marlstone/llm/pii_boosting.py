"""Personal data: generators propose spans, boosted trees score them, thresholds select.

Base patterns (email, ip, card, phone) are exact and always stay. High-recall
generators propose further, overlapping spans: obfuscated addresses, national and
00 phone numbers, cards with other separators or failing digits, long IP
addresses, identity and bank account numbers. Gradient-boosted trees over the
span's format and its context score each; a threshold for each kind, calibrated on
a held-out part of the training sample, selects; what overlaps a base span or an
earlier span goes. All of it is native columns over one row; nothing is shuffled.

The trees are fitted at the first use, on the driver, over SAMPLE labelled
candidates that labelled_sample() writes from templates with a fixed seed.

Defined results: null and empty texts have no spans; texts of any length are read
whole; rows are judged one by one, so repeated rows each keep a row; an empty
table gives no rows; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import boosted_trees as bt
from marlstone.llm.common import let, load
from marlstone.llm.spans import SPAN, apart, leftmost, matches, said

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Possessive and anchored forms of the base patterns: same matches, linear scans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, pattern, a cheap test that any match needs)
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\.|\x20dot\x20)[A-Za-z]{2,}+)++(?![A-Za-z0-9])", r"(?:\[at\]|\(at\)|\{at\}|\x20at\x20)"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("card", r"(?<![0-9A-Za-z.])[0-9](?:[./_\x20-]?[0-9]){11,18}+(?![0-9A-Za-z.])", r"[0-9](?:[./_\x20-]?[0-9]){11}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|00[1-9][0-9]{0,2}[\x20./-]?[0-9]{2,4}[\x20./-]|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])", r"[0-9][\x20.-][0-9]{3,4}(?![0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"),
)
#: Words before a span that tell what it is.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel)[^\n]{0,16}\z",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|from)[^\n]{0,16}\z",
    "card": r"(?i)(?:card|visa|master|credit|payment|tarjeta|carte|karte)[^\n]{0,16}\z",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|number|llam|rufen)[^\n]{0,16}\z",
    "ssn": r"(?i)(?:ssn|social|security|identity)[^\n]{0,16}\z",
    "iban": r"(?i)(?:iban|account|bank|konto|cuenta|compte)[^\n]{0,16}\z",
}
#: Words that stand before look-alikes.
OTHERWISE = r"(?i)(?:version|isbn|section|order|serial|part|lot|page|id|doi|art\.|\$)[^\n]{0,8}\z"
NEAR = 28
FEATURES = ("kind", "context", "otherwise", "digits", "letters", "marks", "varied", "luhn", "bracketed", "at_word", "tld")
SAMPLE = 2400
SEED = 7


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn test."""
    n = F.length(digits)

    def each(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda acc, i: acc + F.coalesce(each(i), F.lit(0))) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Sorted spans of the base patterns that pass their tests."""
    small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
    kept = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: small(p) & (F.coalesce(F.right(p, F.lit(9)).cast("bigint"), F.lit(0)) <= 255)),
        "card": lambda v: let(_digits(v), lambda d: F.length(d).between(12, 19) & luhn(d)),
        "phone": lambda v: F.length(_digits(v)).between(9, 15),
    }
    test = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": F.contains(text, F.lit("+"))}
    found = lambda k: F.filter(matches(text, BASE[k], k, KINDS.index(k), test[k]), lambda s: kept[k](s["value"]))
    return F.array_sort(F.concat(*map(found, BASE)))


def features(text: Column, span: Column) -> Column:
    """Format and context of a span."""
    v = span["value"]
    before = F.substring(text, F.greatest(span["start"].cast("int") + 1 - NEAR, F.lit(1)), F.least(span["start"].cast("int"), F.lit(NEAR)))
    told = F.lit(False)
    for k, pattern in CONTEXT.items():
        told = told | ((span["kind"] == k) & before.rlike(pattern))
    return let(
        _digits(v),
        lambda d: F.struct(
            span["rank"].cast("double").alias("kind"),
            told.cast("double").alias("context"),
            before.rlike(OTHERWISE).cast("double").alias("otherwise"),
            F.length(d).cast("double").alias("digits"),
            F.regexp_count(v, F.lit("[A-Za-z]")).cast("double").alias("letters"),
            F.regexp_count(v, F.lit("[^A-Za-z0-9]")).cast("double").alias("marks"),
            F.size(F.array_distinct(F.split(d, ""))).cast("double").alias("varied"),
            luhn(d).cast("double").alias("luhn"),
            v.rlike(r"[\[({]").cast("double").alias("bracketed"),
            v.rlike(r"\x20at\x20").cast("double").alias("at_word"),
            v.rlike(r"(?i)(?:com|org|net|edu|io|de|fr|es)\z").cast("double").alias("tld"),
        ),
    )


def features_of(text: str, start: int, end: int, kind: str) -> list[float]:
    """features() for the training sample."""
    v, before = text[start:end], text[max(0, start - NEAR) : start]
    d = re.sub("[^0-9]", "", v)
    folds = sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d))))
    has = lambda p, s: float(bool(re.search(p.replace(r"\z", r"\Z"), s)))
    return [
        float(KINDS.index(kind)), has(CONTEXT[kind], before), has(OTHERWISE, before), float(len(d)), float(len(re.findall("[A-Za-z]", v))), float(len(re.findall("[^A-Za-z0-9]", v))),
        float(len(set(d)) or 1), float(bool(d) and folds % 10 == 0), has(r"[\[({]", v), has(r"\x20at\x20", v), has(r"(?i)(?:com|org|net|edu|io|de|fr|es)\z", v),
    ]


def labelled_sample(n: int = SAMPLE, seed: int = SEED) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, 1 if personal) of n template-made candidates."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(3, 9)))

    def card(sep: str, good: bool) -> str:
        d = r.choice("345") + digits(14)
        total = sum((2 * x - 9 * (x > 4)) if i % 2 == 0 else x for i, x in enumerate(map(int, reversed(d))))
        d += str((-total) % 10 if good else (-total + r.randint(1, 9)) % 10)
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    filler = lambda: " ".join(name() for _ in range(4))
    told = {"email": ("mail me: ", "contact ", "write to "), "ip": ("server ", "ip ", "host "), "card": ("card ", "visa: ", "payment "), "phone": ("phone ", "tel. ", "call me on "), "ssn": ("ssn ", "social security "), "iban": ("iban ", "bank account ")}
    false = ("version ", "order ", "serial ", "section ", "isbn ", "part ", "page ", "id ")
    out = []
    for _ in range(n):
        kind = r.choice(KINDS)
        good = r.random() < 0.5
        lead = r.choice(told[kind]) if good and (kind in ("ssn", "phone") or r.random() < 0.6) else "" if r.random() < 0.5 else r.choice(false)
        if kind == "email":
            at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), ("{at}", "."), (" [at] ", "."), (" at ", " dot "))) if good else (" at ", r.choice((".", " dot ")))
            v = f"{name()}{at}{name()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr')) if good else name()}"
        elif kind == "ip":
            v = ":".join(f"{r.randint(0, 65535):x}" for _ in range(8)) if good else ":".join(digits(2) for _ in range(8))
        elif kind == "card":
            v = card(r.choice(("./_" if good else ("", "", " ", ".", "/"))), good)
        elif kind == "phone":
            v = r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0049 {digits(3)} {digits(4)} {digits(4)}"))
        elif kind == "ssn":
            v = f"{digits(3)}-{digits(2)}-{digits(4)}"
        else:
            v = r.choice(("DE", "FR", "ES", "GB") if good else ("ZZ", "AB", "XQ")) + digits(2) + "".join(digits(4) if good else r.choice((digits(4), "".join(r.choice("ABCDEFGH") for _ in range(4)))) for _ in range(r.choice((4, 5))))
        before = f"{filler()} {lead}"
        out.append((before + v + " " + filler(), len(before), len(before) + len(v), kind, int(good)))
    return out


@functools.cache
def model(n: int = SAMPLE, seed: int = SEED, precision: float = 0.98) -> tuple[bt.Model, dict[str, float]]:
    """Trees from two thirds of the sample; a threshold for each kind from the rest."""
    rows = labelled_sample(n, seed)
    x = np.array([features_of(t, a, b, k) for t, a, b, k, _ in rows])
    y = np.array([g for *_, g in rows], float)
    cut = 2 * n // 3
    trees = bt.fit(FEATURES, x[:cut], y[:cut])
    held = bt.score(trees, x[cut:])
    own = np.array([KINDS.index(k) for *_, k, _ in rows[cut:]])
    return trees, {k: bt.calibrated(held[own == i], y[cut:][own == i], precision) for i, k in enumerate(KINDS)}


def added_spans(text: Column, base: Column) -> Column:
    """Spans of the generators that the trees select, apart from base."""
    trees, least = model()
    found = F.concat(*[matches(text, pattern, k, KINDS.index(k), text.rlike(test)) for k, pattern, test in GENERATORS])

    def selected(s: Column) -> Column:
        bar = F.lit(float("inf"))
        for k, t in least.items():
            bar = F.when(s["kind"] == k, F.lit(t)).otherwise(bar)
        return let(features(text, s), lambda f: bt.compiled(trees, f)) >= bar

    return let(F.array_sort(apart(found, base)), lambda c: F.when(F.size(c) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(leftmost(F.filter(c, selected))))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays, sorted) of each row of docs."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    both = let(base_spans(whole), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, added_spans(whole, b))).alias("spans")))
    return docs.select(F.col(id_col).alias("doc_id"), both.alias("p")).select("doc_id", "p.base", "p.spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each selected span of text_col replaced by its kind in brackets; of overlapping spans the first counts."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    spans = let(base_spans(whole), lambda b: leftmost(F.array_sort(F.concat(b, added_spans(whole, b)))))

    def cut(s: Column) -> Column:
        pieces = F.transform(s, lambda x, k: F.concat(F.substring(whole, F.when(k == 0, F.lit(1)).otherwise(s[F.greatest(k - 1, F.lit(0))]["end"].cast("int") + 1), x["start"].cast("int") - F.when(k == 0, F.lit(0)).otherwise(s[F.greatest(k - 1, F.lit(0))]["end"].cast("int"))), F.lit("["), x["kind"], F.lit("]")))
        tail = F.substring(whole, F.coalesce(F.get(s, F.size(s) - 1)["end"].cast("int"), F.lit(0)) + 1, F.length(whole))
        return F.concat(F.array_join(pieces, ""), tail)

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(spans, cut)))


def op3_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    n_spans = F.size("spans").cast("bigint")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), n_spans.alias("n_spans"), (n_spans - F.size("base")).alias("n_added")
    )
