"""Re-Pair grammar compression of token ids, in NumPy, for one block of documents.

Rounds replace pairs that occur often by nonterminals. A round counts all pairs
at once, one pair for each slot of a hash table, and replaces those that no
neighbouring pair outnumbers, so that replacements never overlap; a pair that
lost its slot or its neighbours has its turn in a later round. Pairs never cross
the end of a document. Rounds end when they shorten the sequence too little.

The symbols of a document expand on their own: rules only name older symbols,
and each rule's expansion length is stored, so that a reader can find any token
of any document without decoding what stands before it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPG1"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """symbols below first_rule are token ids; symbol first_rule + k expands to rules[k]."""

    first_rule: int
    rules: np.ndarray  # (n, 2) uint32
    rounds: np.ndarray  # number of rules after each round
    lengths: np.ndarray  # tokens that each rule expands to
    symbols: np.ndarray  # uint32
    starts: np.ndarray  # first symbol of each document, and the number of symbols


def compress(ids: np.ndarray, starts: np.ndarray, first_rule: int, slots: int = 1 << 17, least: int = 16, least_gain: float = 0.04, most_rounds: int = 6) -> Grammar:
    """starts: offsets of the documents' first ids in ids. least: uses that a rule must have."""
    s = ids.astype(np.uint32)
    head = np.zeros(len(s) + 1, bool)
    head[starts] = True
    rules, rounds, lengths = [np.zeros((0, 2), np.uint32)], [], [np.zeros(0, np.int64)]
    known, all_lengths = 0, np.ones(0, np.int64)
    shift = np.uint64(64 - slots.bit_length() + 1)
    for _ in range(most_rounds):
        n = len(s)
        if n < 2 * least:
            break
        key = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
        slot = ((key * _MIX) >> shift).astype(np.int32)
        holder = np.zeros(slots, np.uint64)
        holder[slot[::-1]] = key[::-1]  # an early pair of the slot, whatever it is
        mine = holder[slot] == key
        mine &= ~head[1:n]
        count = np.bincount(slot[mine], minlength=slots).astype(np.int32)
        count[count < least] = 0
        c = np.zeros(n + 1, np.int32)
        c[1:n] = count[slot]
        c[1:n][~mine] = 0
        at = np.flatnonzero((c[1:n] > c[: n - 1]) & (c[1:n] >= c[2 : n + 1]))
        used = np.bincount(slot[at], minlength=slots)
        at = at[used[slot[at]] >= least]
        if len(at) < least_gain * n:
            break
        named = np.flatnonzero(used >= least)
        number = np.zeros(slots, np.uint32)
        number[named] = first_rule + known + np.arange(len(named), dtype=np.uint32)
        pairs = np.stack([holder[named] >> np.uint64(32), holder[named] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        each = np.where(pairs < first_rule, 1, all_lengths[np.maximum(pairs.astype(np.int64) - first_rule, 0)] if known else 1).sum(1)
        all_lengths = np.concatenate([all_lengths, each])
        rules.append(pairs)
        known += len(named)
        rounds.append(known)
        s[at] = number[slot[at]]
        stay = np.ones(n, bool)
        stay[at + 1] = False
        s = s[stay]
        head = np.append(head[:n][stay], False)
    at = np.flatnonzero(head[: len(s)])
    return Grammar(first_rule, np.concatenate(rules), np.array(rounds, np.int64), all_lengths, s, np.append(at, len(s)))


def expand(g: Grammar, symbols: np.ndarray) -> np.ndarray:
    """Token ids of a run of symbols: a document, or a whole block."""
    s = symbols.astype(np.uint32)
    for low in [0, *g.rounds.tolist()][-2::-1] if len(g.rounds) else []:
        big = s >= g.first_rule + low  # this round's rules, as later ones are gone
        if not big.any():
            continue
        rule = g.rules[s[big].astype(np.int64) - g.first_rule]
        end = np.cumsum(1 + big)
        out = np.empty(end[-1], np.uint32)
        out[end - 1] = s
        out[end[big] - 2], out[end[big] - 1] = rule[:, 0], rule[:, 1]
        s = out
    return s


def document(g: Grammar, k: int) -> np.ndarray:
    return expand(g, g.symbols[g.starts[k] : g.starts[k + 1]])


def token(g: Grammar, k: int, at: int) -> int:
    """Token at of document k: skip symbols by their lengths, then descend through rules."""
    own = g.symbols[g.starts[k] : g.starts[k + 1]].astype(np.int64)
    ends = np.cumsum(np.where(own < g.first_rule, 1, g.lengths[np.maximum(own - g.first_rule, 0)] if len(g.lengths) else 1))
    j = int(np.searchsorted(ends, at, "right"))
    at -= int(ends[j - 1]) if j else 0
    x = int(own[j])
    while x >= g.first_rule:
        left, right = (int(v) for v in g.rules[x - g.first_rule])
        width = 1 if left < g.first_rule else int(g.lengths[left - g.first_rule])
        x, at = (left, at) if at < width else (right, at - width)
    return x


def _narrow(a: np.ndarray) -> bytes:
    """Three bytes for each number if they suffice."""
    wide = a.astype("<u4")
    if len(wide) and int(wide.max()) >= 1 << 24:
        return b"\x04" + wide.tobytes()
    return b"\x03" + wide.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _widen(b: bytes) -> np.ndarray:
    if b[:1] == b"\x04":
        return np.frombuffer(b, "<u4", offset=1)
    out = np.zeros((len(b) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, 3)
    return out.view("<u4").ravel()


def pack(g: Grammar) -> bytes:
    """magic, first rule, number of parts, then parts with their sizes, and a checksum of all that."""
    parts = [_narrow(g.rules.ravel()), g.rounds.astype("<u4").tobytes(), _narrow(g.lengths), _narrow(g.symbols), g.starts.astype("<u8").tobytes()]
    out = MAGIC + struct.pack("<II", g.first_rule, len(parts)) + b"".join(struct.pack("<Q", len(p)) + p for p in parts)
    return out + struct.pack("<I", zlib.crc32(out))


def unpack(b: bytes) -> Grammar:
    if b[:4] != MAGIC or zlib.crc32(b[:-4]) != struct.unpack("<I", b[-4:])[0]:
        raise ValueError("not a whole block of grammar-compressed tokens")
    first, n = struct.unpack_from("<II", b, 4)
    at, parts = 12, []
    for _ in range(n):
        (size,) = struct.unpack_from("<Q", b, at)
        parts.append(b[at + 8 : at + 8 + size])
        at += 8 + size
    return Grammar(first, _widen(parts[0]).reshape(-1, 2), np.frombuffer(parts[1], "<u4").astype(np.int64), _widen(parts[2]).astype(np.int64), _widen(parts[3]), np.frombuffer(parts[4], "<u8").astype(np.int64))
