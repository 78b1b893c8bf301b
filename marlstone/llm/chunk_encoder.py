"""Token ids and token counts of whole texts, as the tokenizers library gives them.

The library spends most of its time on bookkeeping around words that it has
seen before. Both vocabularies cut texts at white space before anything else, so
a text is the sequence of its chunks, cut before single spaces and newlines.

Ids are found for a column of texts at once: Arrow cuts it and numbers its
different chunks, each of those is encoded once, and ids are gathered by number.
Plain chunks are cut into runs of letters, digits or punctuation, as the
vocabulary's pattern would, and their different runs go to the library's BPE model
many at a time; other chunks go through the whole library, with a bounded memo. Counts look chunks up in a bounded memo; misses go to the library,
the plain ones (letters, then ASCII punctuation) straight to its BPE model. A memo
is only a cache: when it is full it is emptied, and results never change.
tests/llm/test_tokens.py holds both against whole-text encoding.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, which both vocabularies' patterns call \s.
_WHITE = " \t\n\r\x0b\x0c\x85\xa0  -     　"
#: If a text holds one of these, cutting before each space or newline may cut a run of white space.
_IRREGULAR = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))
#: White space at the end whole; a longer run but for its last character; a word with the character before it.
_PIECES = re.compile(rf"[{_WHITE}]+\Z|[{_WHITE}]+(?=[{_WHITE}])|[{_WHITE}]?[^{_WHITE}]+")
#: Letters whose case, composition and class need no tables, then punctuation that starts no contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
#: What the byte-level pattern cuts only where letters, digits and punctuation meet; apostrophes start contractions.
_RUNS = r"([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n)"
_CUT = r"^\n?[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+$"
LIMIT = 300_000
#: Bytes of text whose chunks are numbered together (a longer text stands alone), and runs that one call encodes.
COLUMN_BYTES, CALL_RUNS = 1 << 24, 50_000


def _byte_level() -> dict[int, str]:
    """Byte-level alphabets print visible Latin-1 bytes as themselves and number the others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Encoder:
    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.alphabet = _byte_level()
        self.limit = limit

    def _bpe(self, pretoken: str) -> list[int]:
        return [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.alphabet))]

    def whole(self, chunk: str) -> list[int]:
        return self.library.encode_batch_fast([chunk], add_special_tokens=False)[0].ids


def _laid(table: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a table that number names, one after the other, and where each ends."""
    each = length[number]
    ends = np.cumsum(each)
    at = np.repeat(start[number] - (ends - each), each)
    at += np.arange(len(at))
    return table[at], ends


class IdEncoder(_Encoder):
    """For vocabularies without a normalizer, whose words take the space before them."""

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, limit)
        self.exact: dict[str, bytes] = {}  # by chunk as it stands
        self.runs = Tokenizer(self.model)  # takes runs in the byte-level alphabet, between spaces
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.codes = np.array([ord(self.alphabet[b]) for b in range(256)], "<u2")
        space, newline = self.alphabet[32], self.alphabet[10]
        self.codes[0], self.codes[32] = ord(space), 32  # no run holds a zero: it stands for the space before a chunk
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that hold a space or newline, which only chunks start with
        self.opens[[k for t, k in vocabulary.items() if t[0] in (space, newline)]] = True
        self.irregular = "|".join(re.escape(x) for x in (*_IRREGULAR, *self.special)) + r"|[ \n]\z"

    def _pack(self, ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _exactly(self, chunk: str) -> bytes:
        out = self.exact.get(chunk)
        if out is None:
            if len(self.exact) > self.limit:
                self.exact.clear()
            out = self.exact[chunk] = self._pack(self.whole(chunk))
        return out

    def _alone(self, text: str) -> np.ndarray:
        """A text with special strings or with white space that single spaces and newlines do not cut."""
        if any(x in text for x in self.special):  # the library cuts there before all else
            return np.array(self.whole(text), "<u4")
        return np.frombuffer(b"".join([self._exactly(c) for c in _PIECES.findall(text)]), "<u4")

    def _encoded(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs, one after the other, and where each begins. Runs that do not start a chunk have a newline before them."""
        ids, starts, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        for low in range(0, len(runs), CALL_RUNS):
            some = runs.slice(low, CALL_RUNS)
            some = pc.binary_join_element_wise(pc.if_else(pc.match_substring_regex(some, r"^[\x00\n]"), "", "\n "), some, "")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_buffer()
            text = self.codes[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
            own = np.array(self.runs.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.opens[own])
            if len(first) != len(some):
                raise ValueError("this vocabulary does not keep the space before a word")
            ids.append(own)
            starts.append(first + n)
            n += len(own)
        return np.concatenate(ids), np.concatenate(starts)

    def _plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has."""
        cut = pc.ascii_rtrim(pc.replace_substring_regex(chunks, _RUNS, r"\1 "), " ")
        cut = pc.binary_join_element_wise(pc.if_else(pc.starts_with(chunks, "\n"), "", "\x00"), cut, "")
        lists = pc.split_pattern(cut, " ")
        numbered = lists.values.dictionary_encode()
        ids, start = self._encoded(numbered.dictionary)
        length = np.diff(np.append(start, len(ids)))
        inner = pc.match_substring_regex(numbered.dictionary, r"^[^\x00\n]").to_numpy(zero_copy_only=False)
        laid, ends = _laid(ids, start + inner, length - inner, numbered.indices.to_numpy())
        return laid, np.diff(np.append(0, ends)[lists.offsets.to_numpy()])

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        cuts, flat = lists.offsets.to_numpy(), lists.values
        cuts, flat = cuts - cuts[0], flat.slice(cuts[0], cuts[-1] - cuts[0])
        numbered = flat.dictionary_encode()
        number, different = numbered.indices.to_numpy().copy(), numbered.dictionary
        begin = flat.take(pa.array(cuts[:-1])).dictionary_encode()  # what stands before a text's first space
        number[cuts[:-1]] = begin.indices.to_numpy() + len(different)

        plain = pc.match_substring_regex(different, _CUT)
        ids, counts = self._plain(different.filter(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        others = [self._exactly(c if c[:1] == "\n" else " " + c) for c in different.filter(pa.array(~plain)).to_pylist()]
        begins = [self._exactly(c) if c else b"" for c in begin.dictionary.to_pylist()]
        table = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4"), np.frombuffer(b"".join(begins), "<u4")])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), len(different) + np.arange(len(begins))])
        length, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        length[order] = n = np.concatenate([counts, [len(x) // 4 for x in (*others, *begins)]]).astype(np.int64)
        start[order] = np.cumsum(n) - n

        laid, ends = _laid(table, start, length, number)
        return np.split(laid, ends[cuts[1:-1] - 1])

    def columns(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Ids of each text, for slices of a column without nulls, in order."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COLUMN_BYTES, "right")))
            some = texts.slice(low, high - low)
            odd = pc.match_substring_regex(some, self.irregular)
            out = self._regular(pc.if_else(odd, "", some))
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                out[k] = self._alone(some[k].as_py())
            yield out
            low = high

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return next(self.columns(pa.array([text], pa.string())))[0].tobytes()


class CountEncoder(_Encoder):
    """For vocabularies that drop white space and lower letters."""

    def __init__(self, path: str, limit: int = LIMIT):
        super().__init__(path, limit)
        self.memo: dict[str, int] = {"": 0}
        self.marks: dict[str, int] = {"": 0}

    def _miss(self, key: str) -> int:
        if plain := _PLAIN.match(key):
            stem, marks = plain.groups()
            lower = stem.lower()
            n = self.memo.get(lower)
            if n is None:
                n = self.memo[lower] = len(self._bpe(lower))
            if marks not in self.marks:
                if len(self.marks) > self.limit:
                    self.marks.clear()
                self.marks[marks] = len(self._bpe(marks)) if marks else 0
            n += self.marks[marks]
        else:
            n = len(self.whole(key))
        self.memo[key] = n
        return n

    def count(self, text: str) -> int:
        if len(self.memo) > self.limit:
            self.memo.clear()
            self.memo[""] = 0
        memo, miss = self.memo, self._miss
        return sum([memo[w] if w in memo else miss(w) for w in text.replace("\n", " ").split(" ")])


_kept: dict[tuple, _Encoder] = {}


def encoder(kind: type, path: str) -> _Encoder:
    """One encoder for each worker process, as tasks follow each other."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]
