"""Noisy-channel reading of disguised words.

A writer means letters; a channel replaces some by look-alikes, repeats them, or
puts separators between them. What was seen becomes a lattice: at each character
the letters that it may stand for, the character itself, or, for a repeated letter
or a separator, nothing. Viterbi's algorithm takes the path that is cheapest under
the channel and a language model of characters together.

The model has the counts of all four-letter sequences of all words of a corpus,
summed by Spark. Letters are folded to a to z, so there are 27 ** 4 sequences at
most, with the word boundary: the table that tasks get is of 2 MB whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and the word boundary, which is 0.
BASE = 27
GRAMS = BASE**4
#: Characters and the letters that they are written for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i",
    "*": "aeiou", "#": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ι": "i", "ρ": "p", "υ": "u", "τ": "t", "κ": "k", "ν": "v",
}
SEPARATORS = " ._-*~/\\'"
#: Costs of the channel, in nats.
LOOK, WILD, LITERAL = 1.0, 1.5, 4.0
DROPPED, DROPPED_SPACED, KEPT, KEPT_SPACED = 3.0, 0.2, 0.5, 1.5
LONG_RUN, PAIR = 0.2, 3.0
#: A lattice is read in stretches: beyond so many characters the best path so far is settled, which bounds memory for any token.
STRETCH = 256
#: Tokens that a task remembers.
MEMORY = 200_000
#: Characters that are counted at once.
STEP = 1 << 20

_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
#: Single letters, digits or look-alikes with separators between them, and a quick sign that a text may have some.
SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ ._*~/\\-]{1,3}[^\W_]){2,}(?![^\W_])")
_SPACED_SIGN = re.compile(r" [^\W_][ ._*~/\\-]{1,3}[^\W_](?![^\W_])")
_RUN = re.compile(r"(.)\1\1")
_ODD = re.compile(r"(.)\1\1|[" + "".join(c for c in LOOKS if c.isalpha()) + "]")
_FOREIGN = re.compile("[" + "".join(c for c in LOOKS if c.isalpha()) + "]")
_BREAKS = re.compile(r"[\W_]+")
#: Three or more of one symbol at an end are ornament.
_ORNAMENT = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")
_LEFT, _RIGHT = ".,;:\"'([{<-", ".,;:!?\"')]}>-"


def _folded() -> np.ndarray:
    """The code of each character below U+0250; 0 for those that are no Latin letter."""
    table = np.zeros(0x250, np.uint8)
    for k in range(0x250):
        base = "s" if chr(k) == "ß" else unicodedata.normalize("NFKD", chr(k).lower())[:1]
        if "a" <= base <= "z" and chr(k).isalpha():
            table[k] = ord(base) - 96
    return table


FOLD = _folded()
_CODES = {chr(k): int(c) for k, c in enumerate(FOLD) if c}


def plain(text: str | None) -> str:
    """Lower case, compatibility forms unified, invisible characters gone."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).lower()


def core(token: str) -> str:
    """A token without the punctuation and ornament around it."""
    own = token.rstrip(_RIGHT).lstrip(_LEFT)
    return own if own.isalnum() else _ORNAMENT.sub("", own).rstrip(_RIGHT)


def _grams(text: str) -> np.ndarray:
    """Codes of the four-letter sequences that end at each character but the first three; context does not reach over a boundary."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < len(FOLD), FOLD[np.minimum(points, len(FOLD) - 1)], 0).astype(np.int32)
    one, two, three, last = codes[2:-1], codes[1:-2], codes[:-3], codes[3:]
    two = np.where(one > 0, two, 0)
    three = np.where(two > 0, three, 0)
    found = ((three * BASE + two) * BASE + one) * BASE + last
    return found[(one > 0) | (last > 0)]


def gram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all four-letter sequences of all whole texts, by code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)

        def add(texts: list[str]) -> None:
            total[:] += np.bincount(_grams("   " + " ".join(texts) + " "), minlength=GRAMS)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = plain(text)
                for k in range(0, len(text), STEP):  # a very long text is counted in pieces
                    held.append(text[k : k + STEP])
                    size += len(held[-1])
                    if size >= STEP:
                        add(held)
                        held, size = [], 0
        add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GRAMS, np.int64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def model_of(counts: np.ndarray) -> array:
    """Cost of each letter after three others, in nats: Witten-Bell's interpolation of all orders."""
    n = counts.astype(float).reshape((BASE,) * 4)
    p = np.full(BASE, 1 / BASE)
    for order in range(4):
        m = n.sum(axis=tuple(range(3 - order))) if order < 3 else n
        kinds = (m > 0).sum(axis=-1, keepdims=True)
        all_n = m.sum(axis=-1, keepdims=True)
        p = np.where(all_n + kinds > 0, (m + kinds * p) / np.maximum(all_n + kinds, 1), p)
    return array("f", (-np.log(np.maximum(p, 1e-12))).ravel().tolist())


def _has_run(text: str) -> bool:
    """True if a character stands three times in a row."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    same = points[1:] == points[:-1]
    return bool((same[1:] & same[:-1]).any())


def arcs_of(seen: str, i: int, spaced: bool) -> list[tuple[str, int, float]]:
    """What character i may mean: (written, code of the letter or 0 for a break, cost); nothing is written for a dropped one."""
    c = seen[i]
    separator = c in SEPARATORS
    if c in _CODES:
        arcs = [(c, _CODES[c], 0.0)]
    else:
        arcs = [(a, ord(a) - 96, LOOK + (WILD if len(LOOKS[c]) > 2 else 0.0)) for a in LOOKS.get(c, "")]
        itself = (KEPT_SPACED if spaced else KEPT) if separator else 0.0 if c.isalpha() and c not in LOOKS else LITERAL
        arcs.append((c, 0, itself))
    if separator:
        arcs.append(("", 0, DROPPED_SPACED if spaced else DROPPED))
    elif i and seen[i - 1] == c and (c in _CODES or c in LOOKS):
        arcs.append(("", 0, LONG_RUN if c * 3 in seen[max(0, i - 2) : i + 2] else PAIR))
    return arcs


class Reader:
    """Reads texts under a model; it remembers tokens that it has read."""

    def __init__(self, model: array):
        self.model, self.seen = model, {}

    def read(self, seen: str, spaced: bool = False) -> str:
        """The likeliest reading of a lower-case token, or of a run of single letters with separators."""
        model, wrap = self.model, BASE**3
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last three letters
        settled: list[str] = []
        for i in range(len(seen)):
            after: dict[int, tuple[float, tuple | None]] = {}
            arcs = arcs_of(seen, i, spaced)
            for h, (cost, node) in paths.items():
                for a, code, extra in arcs:
                    if not a:
                        to, total, path = h, cost + extra, node
                    elif code:
                        to, total, path = (h * BASE + code) % wrap, cost + extra + model[h * BASE + code], (node, a)
                    else:
                        to, total, path = 0, cost + extra + (model[h * BASE] if h else 0.0), (node, a)
                    if to not in after or total < after[to][0]:
                        after[to] = (total, path)
            paths = after
            if (i + 1) % STRETCH == 0:
                h, (cost, node) = min(paths.items(), key=lambda x: (x[1][0], x[0]))
                settled.append(self._written(node))
                paths = {h: (cost, None)}
        best = min(paths.items(), key=lambda x: (x[1][0] + (model[x[0] * BASE] if x[0] else 0.0), x[0]))
        return "".join(settled) + self._written(best[1][1])

    @staticmethod
    def _written(node: tuple | None) -> str:
        out = []
        while node is not None:
            out.append(node[1])
            node = node[0]
        return "".join(reversed(out))

    def _read_token(self, token: str) -> str:
        own = token.rstrip(_RIGHT).lstrip(_LEFT)
        if own.isalpha() and not _ODD.search(own):  # nearly all
            return own
        own = core(token)
        noisy = any(c in _CODES for c in own) and (bool(_RUN.search(own)) or any(c in LOOKS or c in SEPARATORS for c in own))
        return _BREAKS.sub(" ", self.read(own, bool(SPACED.fullmatch(own))) if noisy else own).strip()

    def _spelled(self, m: re.Match) -> str:
        own = m[0]
        return self.read(own, spaced=True) if sum(c in _CODES for c in own) > 1 else own

    def text(self, text: str | None) -> str:
        """The words of a whole text, restored, with one space between them."""
        own = plain(text)
        if _SPACED_SIGN.search(" " + own):
            own = SPACED.sub(self._spelled, own)
        tokens = own.split()
        every = _has_run(own) or not own.isascii() and bool(_FOREIGN.search(own))
        kinds = set(tokens)
        if not every:  # letters alone stand for themselves
            kinds = {t for t in kinds if not t.isalpha()}
        if len(self.seen) >= MEMORY:
            self.seen.clear()
        seen = self.seen
        for t in kinds.difference(seen):
            seen[t] = self._read_token(t)
        words = [seen[t] for t in tokens] if every else [t if t.isalpha() else seen[t] for t in tokens]
        return " ".join(filter(None, words))


def restored(docs: DataFrame, model: array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the restored text of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.text(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read, "doc_id bigint, text string")
