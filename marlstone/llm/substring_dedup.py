"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. It is indexed in
blocks by its windows of `width` words: each window's first occurrence, the least
(id, place). A document is factored greedily from left to right against all
blocks: where the reference holds the window at a word, a factor starts there, at
that place of that document, and runs on word by word as long as the index leads
on to the next place of the same document; otherwise the word is a literal. A
factor is thus a copy of width words or more of one place of the reference, and
the next one starts where it ends. Windows that straddle the end of a factor,
which no factor has looked at, are looked up themselves. Words of factors and of
straddling windows that the reference holds are duplicates and go.

Flow. Documents are dealt to batches by a hash of id and text. A batch finds the
first occurrence of each of its windows and sends each block one packed row of
them. A block finds the first occurrence of all, and answers each batch with those
that stand in a smaller document elsewhere. The batch's texts, whose exchange is
used again, are then parsed. A window that very many documents share reaches its
block once a batch, not once a document. Batches and blocks are as many as the
counted bytes of text need, so that a group stays at batch_bytes however large the
input is. Each batch writes to each block, so larger executors should take larger
batches: at 256 MB a block's row still holds a hundred windows for 100 TB of text.

Windows are compared by 64 bits within blocks that a second hash of the same
window chooses.

Defined results: null and white-space-only texts have no words; texts of any
length are taken whole. Rows with the same id are not smaller than each other, so
repeated rows keep their words and each have a row. A row with a null id keeps all
words and is nobody's reference. An empty table gives no rows. Only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import load

WIDTH = 13
#: Bytes of text of a batch, and of the windows' texts of a block.
BATCH_BYTES = 8 << 20
_MESSAGE = "block int, batch int, ids binary, counts binary, gaps binary, hashes binary"
_ANSWER = "batch int, block int, held binary, sources binary, places binary"


@dataclass
class Hasher:
    """Hash of any run of bytes from prefix sums: sum of table[byte] * odd ** place, modulo 2 ** 64."""

    seed: int
    powers: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))
    inverse: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.table = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.odd = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 3

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, factor in (("powers", self.odd), ("inverse", pow(self.odd, -1, 1 << 64))):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15)


_hashers: list[Hasher] = []


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def windows(text: str | None, width: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's windows and their blocks."""
    if not _hashers:
        _hashers.extend((Hasher(5), Hasher(7)))
    own = _words(text)
    if len(own) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    data = np.frombuffer(b" ".join(own), np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(own) - width + 1]
    ends = np.append(gaps, len(data))[width - 1 :]
    first, second = (h.runs(data, starts, ends) for h in _hashers)
    return first, ((second >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from zero on in a byte or two each, those that need more once again at the end."""
    kind = np.dtype("u1" if not len(values) or np.mean(values >= 0xFF) < 0.2 else "u2")
    most = np.iinfo(kind).max
    wide = (values >= most) | (values < 0)  # differences of far ids may wrap around
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + np.where(wide, most, values).astype(kind).tobytes() + values[wide].astype(np.int64).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    kind, n = np.dtype(f"u{data[0]}"), int.from_bytes(data[1:9], "little")
    out = np.frombuffer(data, kind, n, 9).astype(np.int64)
    out[out == np.iinfo(kind).max] = np.frombuffer(data, np.int64, -1, 9 + n * kind.itemsize) if len(data) > 9 + n * kind.itemsize else 0
    return out


def _places(counts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Places from gaps that start anew after each count."""
    if not len(gaps):
        return gaps
    total = np.cumsum(gaps)
    start = np.cumsum(counts) - counts
    return total - np.repeat(total[start] - gaps[start], counts)


@dataclass
class Batch:
    """Windows of a batch's documents, which stand by id; each (id, text) stands once."""

    docs: list[tuple[int, int, str]]
    width: int
    blocks: int

    def __post_init__(self) -> None:
        found = [windows(t, self.width, self.blocks) for *_, t in self.docs]
        self.ids = np.array([i for i, *_ in self.docs], np.int64)
        self.ends = np.cumsum([len(x[0]) for x in found], dtype=np.int64)
        counts = np.diff(self.ends, prepend=0)
        doc = np.repeat(np.arange(len(found)), counts)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in found)])
        where = np.concatenate([np.zeros(0, np.int32), *(x[1] for x in found)])
        _, first, self.distinct = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.arange(len(hashes)) - (self.ends - counts)[doc]
        # of each distinct window, its first occurrence in the batch
        self.source, self.place = self.ids[doc[first]], place[first]
        at = np.sort(first)
        at = at[np.argsort(where[at], kind="stable")]
        self.cuts = np.searchsorted(where[at], np.arange(self.blocks + 1))
        self.entries = at
        self._of = lambda e: (doc[e], place[e], hashes[e])

    def messages(self) -> Iterator[tuple]:
        """(block, ids, counts, gaps, hashes): first occurrences by id and place; ids but for the first one as differences."""
        for b in range(self.blocks):
            e = self.entries[self.cuts[b] : self.cuts[b + 1]]
            if len(e):
                doc, place, hashes = self._of(e)
                docs, start, counts = np.unique(doc, return_index=True, return_counts=True)
                gaps = np.diff(place, prepend=0)
                gaps[start] = place[start]
                ids = self.ids[docs]
                yield b, ids[:1].tobytes() + _packed(np.diff(ids)), _packed(counts), _packed(gaps), hashes.tobytes()

    def learn(self, block: int, held: bytes, sources: bytes, places: bytes) -> None:
        """A block's answer: windows whose first occurrence is in a smaller document of another batch."""
        e = self.entries[self.cuts[block] : self.cuts[block + 1]]
        at = self.distinct[e[np.unpackbits(np.frombuffer(held, np.uint8), count=len(e)).astype(bool)]]
        self.source[at], self.place[at] = np.frombuffer(sources, np.int64), np.frombuffer(places, np.uint32)

    def parsed(self, k: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray | None]:
        """Factors of document k, and the mask of its words that go, if any does."""
        start = self.ends[k - 1] if k else 0
        own = self.distinct[start : self.ends[k]]
        source, place = self.source[own], self.place[own]
        spans, straddling = factors(source < self.ids[k], source, place, self.width)
        if not spans:
            return spans, None
        change = np.zeros(len(own) + self.width, np.int64)
        for first, end, *_ in (*spans, *straddling):
            change[first] += 1
            change[end] -= 1
        return spans, np.cumsum(change)[:-1] > 0


def factors(held: np.ndarray, source: np.ndarray, place: np.ndarray, width: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Greedy factors (start, end, source, source_start) in words, end exclusive, and spans of windows that straddle their ends.

    held: windows that the reference holds; source and place: where.
    """
    at = np.flatnonzero(held)
    if not len(at):
        return [], []
    new = np.concatenate([[True], (np.diff(at) > 1) | (source[at[1:]] != source[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)])
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    spans, straddling, upto = [], [], 0
    for a, b in zip(at[new].tolist(), last.tolist(), strict=True):  # windows a to b lead through one place of the reference
        if a < upto:
            straddling.append((a, min(b, upto - 1) + width))
        if b >= upto:
            start = max(a, upto)
            spans.append((start, b + width, int(source[start]), int(place[start])))
            upto = b + width
    return spans, straddling


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of ints and packed arrays."""
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, pa.binary() if k == "binary" else pa.int32()) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _rows(table: pa.Table) -> list[tuple[int | None, int, str]]:
    return list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True))


def _batch(rows: list[tuple], width: int, blocks: int) -> Batch:
    return Batch(sorted({r for r in rows if r[0] is not None}), width, blocks)


def _messages(width: int, blocks: int):
    def of(table: pa.Table) -> pa.Table:
        number = table.column("batch")[0].as_py()
        return _table([(b, number, *rest) for b, *rest in _batch(_rows(table), width, blocks).messages()], _MESSAGE)

    return of


def _answers(table: pa.Table) -> pa.Table:
    """A block: for each batch, the windows whose first occurrence is in a smaller document."""
    got = sorted(table.to_pylist(), key=lambda r: r["batch"])
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in got]
    owner, place = [], []
    for r in got:
        counts = _unpacked(r["counts"])
        ids = np.frombuffer(r["ids"], np.int64, 1) + np.concatenate([[0], np.cumsum(_unpacked(r["ids"][8:]))])
        owner.append(np.repeat(ids, counts))
        place.append(_places(counts, _unpacked(r["gaps"])).astype(np.uint32))
    h, own, at = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    by_id = np.argsort(own, kind="stable")  # a batch's entries stand by id and place already
    by_hash = by_id[np.argsort(h[by_id], kind="stable")]
    s = h[by_hash]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.empty(len(h), np.int64)
    first[by_hash] = by_hash[new][np.cumsum(new) - 1]
    held = own[first] < own
    rows, start = [], 0
    for r, own_hashes in zip(got, hashes, strict=True):
        mine = slice(start, start + len(own_hashes))
        start = mine.stop
        if held[mine].any():
            source = first[mine][held[mine]]
            rows.append((r["batch"], r["block"], np.packbits(held[mine]).tobytes(), own[source].tobytes(), at[source].tobytes()))
    return _table(rows, _ANSWER)


_FACTOR = [("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]
_PARSED = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, blocks: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and factors of each row of docs."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not blocks:
        n_bytes = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // batch_bytes))
    marked = texts.withColumn("mark", F.xxhash64("text"))
    dealt = marked.withColumn("batch", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(blocks)).cast("int")).repartition(blocks, "batch").groupBy("batch")
    answers = dealt.applyInArrow(_messages(width, blocks), _MESSAGE).repartition(blocks, "block").groupBy("block").applyInArrow(_answers, _ANSWER)

    def parse(own: pa.Table, answered: pa.Table) -> pa.Table:
        rows = _rows(own)
        batch = _batch(rows, width, blocks)
        for r in answered.to_pylist():
            batch.learn(r["block"], r["held"], r["sources"], r["places"])
        number = {doc: k for k, doc in enumerate(batch.docs)}
        out = []
        for row in rows:
            k, words = number.get(row), _words(row[2])
            spans, gone = ([], None) if k is None else batch.parsed(k)
            kept = words if gone is None else itertools.compress(words, (~gone).tolist())
            out.append((row[0], len(words), 0 if gone is None else int(gone.sum()), b" ".join(kept), [dict(zip(("start", "end", "source", "source_start"), x, strict=True)) for x in spans]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct(_FACTOR))]
        table = pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])
        return table.set_column(3, "kept_text", table.column("kept_text").cast(pa.string()))

    return dealt.cogroup(answers.repartition(blocks, "batch").groupBy("batch")).applyInArrow(parse, _PARSED)


def op5_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS gram
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d WHERE len(w) >= {WIDTH})),
first AS (SELECT gram, min(doc_id) AS least FROM win GROUP BY gram),
held AS (SELECT rid, i FROM win JOIN first USING (gram) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS p FROM held, (SELECT unnest(range(0, {WIDTH})) AS k)),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS said FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
