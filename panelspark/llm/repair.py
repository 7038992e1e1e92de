"""Re-Pair grammar of a block of token ids, and its binary form.

Each round counts the neighbouring pairs of the block and gives frequent ones a new symbol each, by falling count, as far as
they can't overlap one another: within a round a symbol is on the left of pairs or on the right, not both, unless it is its
own pair. Rounds follow until no pair occurs `LEAST_COUNT` times, so a passage of n ids that repeats so often shrinks to a
few symbols by O(log n) rounds. A pair that has become rare can't become frequent again, so later rounds look at few places.
A symbol never reaches beyond the end id of a document. Layout, little-endian: magic, then counts (documents, ids, different
ids, rules, symbols) and the width, then the arrays doc_id (int64), has_id (uint8), n_tokens (uint32), the different ids
(uint32), left, right, expansion length of each rule (uint32), symbols. Symbols number the different ids and then the rules,
so left, right and symbols mostly fit into uint16 (else uint32).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"RPGRAM02"
HEAD = "<8sQQIIQB"
#: A rule takes 12 bytes and saves a symbol of 2 or 4 bytes at each place.
LEAST_COUNT = 6
#: Pairs looked at in a round, by falling count; the others wait for the next round.
PAIRS = 20_000
SIEVE_BITS = 22
SPREAD = {np.dtype(np.uint32): np.uint32(0x9E3779B1), np.dtype(np.uint64): np.uint64(0x9E3779B97F4A7C15)}


def _keys(seq: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Number of the pair that begins at each of these places."""
    if size <= 0x10000:
        return (seq[at] << np.uint32(16)) | seq[at + 1]
    return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]


def _frequent(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur `LEAST_COUNT` times or more, ascending, and how often."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(at, append=len(keys))
    often = np.flatnonzero(count >= LEAST_COUNT)
    return keys[at[often]], count[often]


def _hashed(keys: np.ndarray) -> np.ndarray:
    return (keys * SPREAD[keys.dtype]) >> keys.dtype.type(keys.dtype.itemsize * 8 - SIEVE_BITS)


def _chosen(pairs: list[tuple[int, int]], closed: bytearray, size: int) -> list[tuple[int, int]]:
    """Of these pairs, by falling count, those of which no two can overlap."""
    role = bytearray(size)  # 1: left of pairs, 2: right of pairs, 3: its own pair
    out = []
    for a, b in pairs:
        if closed[a]:
            continue
        if a == b:
            if not role[a]:
                role[a] = 3
                out.append((a, b))
        elif role[a] < 2 and role[b] in (0, 2):
            role[a], role[b] = 1, 2
            out.append((a, b))
    return out


def _grammar(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right, names): symbols are numbered densely, names[k] for the block's ids and then the rules."""
    number = np.bincount(ids, minlength=end + 1) > 0
    number[end] = True
    names = np.flatnonzero(number).astype(np.uint32)
    n_ids = len(names)
    seq = (np.cumsum(number) - 1).astype(np.uint32)[ids]
    left: list[int] = []
    right: list[int] = []
    closed = bytearray(n_ids)  # symbols that end with the end id
    closed[int(np.searchsorted(names, end))] = 1
    alive = np.arange(len(seq) - 1)  # places whose pair may be frequent
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    while len(alive):
        size = n_ids + len(left)
        keys = _keys(seq, alive, size)
        often, count = _frequent(keys)
        top = np.argsort(-count, kind="stable")[:PAIRS]
        wide = often.dtype.type
        shift = wide(16 if size <= 0x10000 else 32)
        lefts, rights = (often[top] >> shift).tolist(), (often[top] & ((wide(1) << shift) - wide(1))).tolist()
        chosen = _chosen(list(zip(lefts, rights)), closed, size)
        if not chosen:
            break
        marks = _hashed(often)
        sieve[marks] = True
        kept = np.flatnonzero(sieve[_hashed(keys)])
        sieve[marks] = False
        alive, keys = alive[kept], keys[kept]
        a, b = (np.array(x, np.uint32) for x in zip(*chosen))
        first, second = np.zeros(size, bool), np.zeros(size, bool)
        first[a], second[b] = True, True
        maybe = np.flatnonzero(first[seq[alive]] & second[seq[alive + 1]])
        made = (a.astype(wide) << shift) | b.astype(wide)
        order = np.argsort(made)
        found = np.minimum(np.searchsorted(made[order], keys[maybe]), len(made) - 1)
        exact = made[order][found] == keys[maybe]
        hit, rule = alive[maybe[exact]], order[found[exact]]
        for x, y in chosen:
            left.append(x)
            right.append(y)
            closed.append(closed[y])
        run = np.flatnonzero((a == b)[rule])
        if len(run):  # in a run of one symbol every second one begins a pair
            place = hit[run]
            fresh = np.concatenate([[True], place[1:] != place[:-1] + 1])
            origin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            keep = np.ones(len(hit), bool)
            keep[run[(np.arange(len(run)) - origin) % 2 == 1]] = False
            hit, rule = hit[keep], rule[keep]
        seq[hit] = size + rule
        stays = np.ones(len(seq), bool)
        stays[hit + 1] = False
        looked = np.zeros(len(seq), bool)
        looked[alive] = True
        looked[hit] = True
        before = np.maximum(hit, 1) - 1
        looked[before - ~stays[before]] = True  # the symbol before a new one
        seq, looked = seq[stays], looked[stays]
        alive = np.flatnonzero(looked[:-1])
    return seq, np.array(left, np.uint32), np.array(right, np.uint32), names


def compress(ids: np.ndarray, first_rule: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): rule k, written as symbol first_rule + k, stands for left[k] right[k]."""
    seq, left, right, names = _grammar(ids, end)
    table = np.concatenate([names, first_rule + np.arange(len(left), dtype=np.uint32)])
    return table[seq], table[left], table[right]


def _expansions(left: np.ndarray, right: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each rule, one after the other, and where each rule's begin."""
    rows: list[np.ndarray] = []
    for a, b in zip(left.tolist(), right.tolist()):
        part = [rows[x - first_rule] if x >= first_rule else np.array([x], np.uint32) for x in (a, b)]
        rows.append(np.concatenate(part))
    return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    flat, at = _expansions(left, right, first_rule)
    rule = symbols >= first_rule
    own = np.where(rule, symbols.astype(np.int64) - first_rule, 0)
    count = np.where(rule, np.append(np.diff(at), 0)[own] if len(left) else 1, 1)
    total = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(total[-1], np.uint32)
    out[total[:-1][~rule]] = symbols[~rule]
    if rule.any():
        place = np.repeat(rule, count)
        out[place] = flat[np.repeat(at[own[rule]] - total[:-1][rule], count[rule]) + np.flatnonzero(place)]
    return out


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, first_rule: int, end: int) -> bytes:
    """One block of ids below `first_rule`."""
    if len(ids) and int(ids.max()) >= first_rule:
        raise ValueError("an id is no token of the vocabulary")
    symbols, left, right, names = _grammar(ids, end)
    _, at = _expansions(left, right, len(names))
    narrow = len(names) + len(left) <= 0x10000
    kind = "<u2" if narrow else "<u4"
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), len(names), len(left), len(symbols), narrow)
    arrays = [
        np.array([0 if x is None else x for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], np.uint8), counts.astype("<u4"),
        names.astype("<u4"), left.astype(kind), right.astype(kind), np.diff(at).astype("<u4"), symbols.astype(kind),
    ]
    body = b"".join(x.tobytes() for x in arrays)
    return head + struct.pack("<Q", len(body)) + body


class Block:
    """A block read back. `ids()` gives all ids; `between(a, b)` expands only the symbols that reach into that range."""

    def __init__(self, data: memoryview):
        at = struct.calcsize(HEAD) + 8
        magic, docs, self.n_tokens, names, rules, symbols, narrow = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        (body,) = struct.unpack_from("<Q", data, at - 8)
        self.bytes = at + body
        kind = "<u2" if narrow else "<u4"

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, has = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.counts, self.names = take("<u4", docs), take("<u4", names)
        self.left, self.right, self.length, self.symbols = take(kind, rules), take(kind, rules), take("<u4", rules), take(kind, symbols)
        self._ends: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        return self.names[expand(self.symbols, self.left, self.right, len(self.names))]

    def between(self, a: int, b: int) -> np.ndarray:
        if self._ends is None:
            size = np.concatenate([np.ones(len(self.names), np.uint32), self.length])
            self._ends = np.concatenate([[0], np.cumsum(size[self.symbols], dtype=np.int64)])
        total = self._ends
        i, j = np.searchsorted(total, a, "right") - 1, np.searchsorted(total, b, "left")
        if a >= b:
            return self.names[:0]
        out = np.concatenate([self._expanded(int(s)) for s in self.symbols[i:j]])
        return self.names[out[a - total[i] : b - total[i]]]

    def _expanded(self, symbol: int) -> np.ndarray:
        """Ids of one symbol, without expanding any other rule."""
        out, todo = [], [symbol]
        while todo:
            s = todo.pop()
            if s < len(self.names):
                out.append(s)
            else:
                todo += [int(self.right[s - len(self.names)]), int(self.left[s - len(self.names)])]
        return np.array(out, np.uint32)


def blocks_of(data: bytes) -> Iterator[Block]:
    view, at = memoryview(data), 0
    while at < len(view):
        block = Block(view[at:])
        at += block.bytes
        yield block
