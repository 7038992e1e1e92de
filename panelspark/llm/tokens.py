"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

The vocabulary drops white space and never joins what white space parts, so a text's ids are its words' ids put together.
A letter and the sentence marks that end a word are also encoded apart, which its rules do in any case. Words are found
and counted with numpy and Arrow; the library sees only words that the worker has not met. Texts that hold "<|", which
may begin a special token, go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import LOWER, SPACE, blocks, utf8, words

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Words whose ids a worker keeps.
CACHE_WORDS = 400_000
#: Bytes of text whose words are looked up together, and of which ids are built together.
LOOKUP_BYTES = 6 << 20
BUILD_BYTES = 2 << 20
MARK = np.zeros(256, bool)
MARK[list(b",.!?;:|*#$%&")] = True
#: Lower-case letters that stay one piece when texts are cut into words.
LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
_PART = "<|endoftext|>"
_JOINED = 256

_caches: dict[str, "_Cache"] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Cache:
    """Words and their ids, ragged; slot 0 is the end id."""

    def __init__(self, path: str, end: int):
        self.tool, self.end = tokenizer(path), end
        self.part = self.tool.token_to_id(_PART)
        self.closes = np.zeros(self.tool.get_vocab_size(), bool)
        self.closes[[i for word, i in self.tool.get_vocab().items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([b""], pa.large_binary())
        self.ids, self.at = np.array([self.end], np.uint32), np.array([0, 1], np.int64)

    def encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words and how many each has."""
        joined = [_PART.join(new[i : i + _JOINED]) + _PART for i in range(0, len(new), _JOINED)]
        flat = self.flat(joined)
        cut = flat == self.part
        ends = np.flatnonzero(cut) - np.arange(len(new))
        return flat[~cut], np.diff(ends, prepend=0)

    def encode_letters(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: each ends with the one id of it that closes a word."""
        flat = self.flat([" ".join(new[i : i + _JOINED]) for i in range(0, len(new), _JOINED)])
        return flat, np.diff(np.flatnonzero(self.closes[flat]) + 1, prepend=0)

    def flat(self, joined: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in self.tool.encode_batch_fast(joined, add_special_tokens=False))])

    def slots(self, found: pa.Array) -> np.ndarray:
        """Where in the cache each word is; all of them are there afterwards."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        slot = pc.index_in(found, value_set=self.words)
        missing = pc.is_null(slot)
        new = found.filter(missing)
        if len(new):
            base = len(self.words)
            text = new.cast(pa.large_string())
            plain = pc.match_substring_regex(text, LETTERS)
            ids, count = self.encode_letters(text.filter(plain).to_pylist())
            more, counts = self.encode(text.filter(pc.invert(plain)).to_pylist())
            ids, count = np.concatenate([ids, more]), np.concatenate([count, counts])
            self.words = pa.concat_arrays([self.words, new.filter(plain), new.filter(pc.invert(plain))])
            place = np.empty(len(new), np.int64)
            place[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = base + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count)])
            out = slot.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out[missing.to_numpy(zero_copy_only=False)] = place
            return out
        return slot.to_numpy(zero_copy_only=False).astype(np.int64)


def _split_marks(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut before the sentence marks that end them, where a letter is before these."""
    if not len(start):
        return start, end
    last = np.maximum.accumulate(np.where(MARK[raw], np.int32(-1), np.arange(len(raw), dtype=np.int32)))[end - 1]
    own = (last >= start) & (last < end - 1)
    byte, lead = raw[np.maximum(last, 0)], raw[np.maximum(last - 1, 0)]
    letter = (byte >= 97) & (byte <= 122) | (lead == 0xC3) & (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)
    cut = last[own & letter] + 1
    return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))


def encoded(column: pa.Array | pa.ChunkedArray, path: str, end: int = END) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of texts in order: (first row, all their ids as uint32, where each text's ids begin, one more at the end).

    Every text's ids are followed by `end`; a null or empty text has that alone.
    """
    key = f"{path} {end}"
    cache = _caches[key] = _caches.get(key) or _Cache(path, end)
    whole, ends = utf8(column)
    for first, last in blocks(ends, LOOKUP_BYTES):
        offsets = ends[first : last + 1]
        original = whole[offsets[0] : offsets[-1]]
        raw, offsets = LOWER[original], offsets - offsets[0]
        opening = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)) if len(raw) else np.zeros(0, int)
        special = np.unique(np.searchsorted(offsets, opening, "right") - 1)
        if len(special):
            direct = {int(i): np.array(cache.tool.encode(original[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for i in special}
            raw = raw.copy()
            for i in special:
                raw[offsets[i] : offsets[i + 1]] = 0x20
        start, stop, _ = words(raw, offsets)
        start, stop = _split_marks(raw, start, stop)
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(stop - start, out=at[1:])
        letters = raw[~SPACE[raw]]
        each = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        slot = cache.slots(each.dictionary)[each.indices.to_numpy(zero_copy_only=False)] if len(start) else np.zeros(0, np.int64)
        begin = np.searchsorted(start, offsets)
        begin[-1] = len(start)
        for a, b in blocks(offsets, BUILD_BYTES):
            own = np.insert(slot[begin[a] : begin[b]], begin[a + 1 : b + 1] - begin[a], 0)
            count = (cache.at[1:] - cache.at[:-1])[own]
            total = np.zeros(len(own) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            ids = cache.ids[np.repeat(cache.at[own] - total[:-1], count) + np.arange(total[-1])]
            cuts = total[begin[a : b + 1] - begin[a] + np.arange(b - a + 1)]
            if any(a <= i < b for i in special):
                rows = [np.concatenate([direct[i], [np.uint32(end)]]) if i in direct else ids[cuts[i - a] : cuts[i - a + 1]] for i in range(a, b)]
                ids, cuts = np.concatenate(rows).astype(np.uint32), np.cumsum([0, *map(len, rows)])
            yield first + a, ids, cuts
