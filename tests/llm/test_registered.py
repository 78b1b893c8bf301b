"""Registered queries over the driver's smallest tables against brute force, digest columns and all."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

from marlstone.llm.queries import QUERIES
from marlstone.llm.simhash_neardup import fingerprint


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, columns, sf=SF):
    return sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect())


def test_token_counts(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in docs]
    assert rows(spark, "op2_token_counts", ("doc_id", "n_bytes", "n_tokens", "over_limit")) == sorted(wanted)
    assert any(w[3] for w in wanted)


def test_stored_counts_answer(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first, again = (sorted(map(tuple, QUERIES["op2_token_counts"](spark, SF, cache_path=cache).collect())) for _ in range(2))
    kept = spark.read.parquet(cache)
    assert first == again and kept.count() == kept.select("digest").distinct().count()


def test_token_files(spark, docs):
    t, start, wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, x in sorted(docs):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, "op10_repair_token_files", ("doc_id", "start", "n_tokens", "ids_crc32")) == wanted


def test_fingerprints_and_components(spark, docs):
    prints = np.array([fingerprint(x) for _, x in docs], np.uint64)
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 2).tolist():
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    assert rows(spark, "op7_simhash_pigeonring", ("doc_id", "fingerprint", "component_id")) == sorted((i, f"{int(prints[k]):016x}", least[find(k)]) for k, (i, _) in enumerate(docs))


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}
SECRETS = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


@pytest.mark.parametrize(("name", "patterns"), [("op3_pii_boosted", PII), ("op6_secret_ownership", SECRETS)])
def test_base_spans(spark, name, patterns):
    sf = SF.replace("sf0.001", "sf0.01")  # the smallest table has no secrets
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    wanted, spans = [], {}
    for i, x in docs:
        found = sorted((m.start(), k, m.end(), kind) for k, (kind, (p, good)) in enumerate(patterns.items()) for m in re.finditer(p, x, re.A) if good(m))
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        wanted.append((i, *[sum(f[3] == kind for f in found) for kind in patterns], hashlib.sha256(said.encode()).hexdigest()))
        spans[i] = said
    columns = ("doc_id", *[f"n_{k}" for k in patterns], "base_sha256")
    assert rows(spark, name, columns, sf) == sorted(wanted) and any(spans.values())
    for i, said in rows(spark, name, ("doc_id", "spans"), sf):  # base spans stay among all
        assert set(filter(None, spans[i].split(","))) <= set(said.split(","))
        starts = [int(x.split(":")[1]) for x in said.split(",") if x]
        assert starts == sorted(starts)
