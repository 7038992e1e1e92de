"""Spelling variants: near words by reduced alphabets, and the chain from a rare form to its root.

Words are counted over all texts first, so a word's frequency never matters to the search. The search hashes letters to
`SYMBOLS` symbols. Every word proposes the whole one-edit neighbourhood of its reduced form, which meets the reduced forms
of the vocabulary in a join, and pairs are verified on the original strings.

A small alphabet makes many words look alike, so a proposal also carries the half of the original word that its edit leaves
intact: an edit before the middle leaves the second half, any other one the first. Each near pair then meets at exactly one
key, and keys stay small even where a third of the vocabulary shares a reduced form.

Neighbours are never spelled out: a string's hash is a polynomial in its symbols, and that of each neighbour follows from
prefix sums, so a word of n letters costs O(n) however long it is. Equal strings always have equal hashes; unequal ones
that meet by chance fail the verification.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, parts, query, written
from .words import mix, powers

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: One run in so many, told by its checksum with the document's id, loses a letter.
SLIPS = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A word's form is at least so many times as frequent.
RATIO = 5
#: Letters are hashed to so many symbols: 4 gives about 70 neighbours for a word of 8 letters.
SYMBOLS = 4
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Letters whose neighbours are built at once; one longer word makes a block of its own.
BLOCK_LETTERS = 1 << 16
#: Letters up to which a word travels with its proposals.
CARRIED = 64
FIRST, SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LONGER = np.uint64(0x2545F4914F6CDD1D)


def _runs(slips: int, letters: int):
    """Batches of (doc_id, text) to (word, n), counts of the words met since the last row given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                doc, text = doc.as_py(), text.as_py() or ""
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) >= letters:
                        word = word.lower() if word.isascii() else word.translate(LOWER)
                        h = zlib.crc32(word.encode(), seed)
                        if slips and h % slips == 0:
                            gone = h % len(word)
                            word = word[:gone] + word[gone + 1 :]
                        if len(word) >= letters:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)

    return run


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, letters: int = LEAST_LETTERS, slips: int = SLIPS) -> DataFrame:
    """(word, n): the words of `letters` code points or more that occur `least` times or more in all of `docs` (doc_id, text).

    A word is a maximal run of Latin letters, A-Z lower-cased; a run whose checksum with its doc_id (null: nothing) is
    divisible by `slips` loses one letter (0: none does). Null texts have no words; every repeated row counts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_runs(slips, letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _symbols(codes: np.ndarray, symbols: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) >> np.uint64(40)) % np.uint64(symbols)


class _Words:
    """The letters of many words end to end, with prefix sums of their polynomials, reduced and original."""

    def __init__(self, words: list[str], symbols: int):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.up, self.down = powers(int(self.size.max(initial=0)) + 2)
        self.place = np.arange(len(codes)) - np.repeat(self.begin[:-1], self.size)
        self.digit = _symbols(codes, symbols)
        self.reduced = self._sums(self.digit + np.uint64(1))
        self.original = self._sums(codes.astype(np.uint64) + np.uint64(1))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[self.place], out=sums[1:])
        return sums

    def until(self, sums: np.ndarray, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Polynomial of the first i letters."""
        return sums[self.begin[word] + i] - sums[self.begin[word]]

    def whole(self, word: np.ndarray) -> np.ndarray:
        return self.until(self.reduced, word, self.size[word])

    def first_half(self, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix(self.until(self.original, word, length) ^ FIRST)

    def second_half(self, word: np.ndarray, length: np.ndarray) -> np.ndarray:
        start = self.size[word] - length
        tail = self.until(self.original, word, self.size[word]) - self.until(self.original, word, start)
        return mix(tail * self.down[start] ^ SECOND)

    def each(self, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(word, i) for every place, or with extra = 1 for every gap."""
        word = np.repeat(np.arange(len(self.size)), self.size + extra)
        return word, np.arange(len(word)) - np.repeat(self.begin[:-1] + extra * np.arange(len(self.size)), self.size + extra)

    def intact(self, word: np.ndarray, shorter: np.ndarray, in_second: np.ndarray) -> np.ndarray:
        """Hash of the half that an edit leaves, for the shorter length of the pair."""
        first = shorter // 2
        return np.where(in_second, self.first_half(word, np.minimum(first, self.size[word])), self.second_half(word, shorter - first))


def _keys(reduced: np.ndarray, half: np.ndarray, longer: bool, in_second: np.ndarray) -> np.ndarray:
    """longer: the vocabulary's word is the longer one of the pair. The last bit tells that the second half is edited."""
    return mix(mix(reduced + (LONGER if longer else np.uint64(0))) + half) & ~np.uint64(1) | in_second.astype(np.uint64)


def _proposals(w: _Words, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) for the whole one-edit neighbourhood of each reduced word."""
    out = []
    whole = np.arange(len(w.size))
    for in_second in (False, True):  # a letter replaced by one of the same symbol, at any place
        second = np.full(len(whole), in_second)
        out.append((whole, _keys(w.whole(whole), w.intact(whole, w.size, second), False, second)))
    word, i = w.each()
    size, at, digit = w.size[word], w.begin[word] + i, w.digit
    second = i >= size // 2
    half = w.intact(word, size, second)
    for step in range(1, symbols):
        other = (digit + np.uint64(step)) % np.uint64(symbols)
        out.append((word, _keys(w.whole(word) + (other - digit) * w.up[i], half, False, second)))
    before, after = w.until(w.reduced, word, i), w.whole(word) - (w.reduced[at + 1] - w.reduced[w.begin[word]])
    second = i > (size - 1) // 2
    out.append((word, _keys(before + after * w.down[1], w.intact(word, size - 1, second), False, second)))
    word, i = w.each(1)
    size = w.size[word]
    before, second = w.until(w.reduced, word, i), i > size // 2
    after, half = (w.whole(word) - before) * w.up[1], w.intact(word, size, second)
    for symbol in range(symbols):
        out.append((word, _keys(before + np.uint64(symbol + 1) * w.up[i] + after, half, True, second)))
    word, key = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((key, word))
    word, key = word[order], key[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
    return word[new], key[new]


def _entries(w: _Words, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) under which the vocabulary's words are met: two halves, as the shorter or equal and as the longer one."""
    whole = np.arange(len(w.size))
    reduced, sides = w.whole(whole), [(np.full(len(whole), s), longer) for s in (False, True) for longer in (False, True)]
    keys = [_keys(reduced, w.intact(whole, w.size - longer, side), longer, side) for side, longer in sides]
    return np.tile(whole, len(keys)), np.concatenate(keys)


def _keyed(rows: DataFrame, build, symbols: int, *carried: str) -> DataFrame:
    """(key, *carried): the keys that `build` gives each word of `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column("word").to_pylist()
            at = np.cumsum([0, *map(len, spelled)])
            first = 0
            while first < len(spelled):
                last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_LETTERS, "right")) - 1)
                word, key = build(_Words(spelled[first:last], symbols), symbols)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c).take(pa.array(first + word)) for c in carried)], names=["key", *carried])
                first = last

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["key long", *(f"{c} {kinds[c]}" for c in carried)]))


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n) for every ordered pair of `vocabulary` (word, n) at one inserted, deleted or replaced letter.

    Words are distinct and not null. Each pair comes once in either order: an edit between two equal letters on both sides
    of the middle leaves either half, and the pair counts where it left the second one. Words of more than `CARRIED`
    letters are known by their fingerprint until they have met.
    """
    rows = vocabulary.select("word", "n", F.xxhash64("word").alias("id")).repartition(parts(vocabulary.sparkSession), "id")
    entries = _keyed(rows.select("word", "n"), _entries, symbols, "word", "n").toDF("key", "near", "near_n")
    short, long = rows.filter(F.length("word") <= CARRIED).select("word"), rows.filter(F.length("word") > CARRIED).select("word", "id")
    met = _keyed(short, _proposals, symbols, "word").join(entries, "key")
    met_long = _keyed(long, _proposals, symbols, "id").join(entries, "key").join(long, "id")
    shorter = F.least(F.length("word"), F.length("near"))
    half = (shorter - F.floor(shorter / 2)).cast("int")
    once = ((F.col("key") % 2) == 0) | (F.right("word", half) != F.right("near", half))
    pairs = met.unionByName(met_long.drop("id")).filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1) & once)
    return pairs.select("word", "near", "near_n")


def variants(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """Per word of `vocabulary` (word, n): word, n, form, form_n, n_near, root.

    n_near counts the near words. form is the one of largest n (ties: smallest in code-point order) if that is at least
    `ratio` times the word's own, else null. root is where following forms ends, the word itself if it has none. No
    words give an empty table.
    """
    vocabulary = written(vocabulary.select("word", "n"), "variants-words")
    best = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    accepted = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(accepted, F.col("best.near")).alias("form"), F.when(accepted, F.col("form_n")).alias("form_n")
    )
    rows = written(rows, "variants-forms")
    steps = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    # each step multiplies n by the ratio, so chains are short; a round doubles the part of them that is followed
    most, reach = (vocabulary.agg(F.max("n")).first()[0] or 0), 1
    longest = 0
    while ratio ** (longest + 1) <= most:
        longest += 1
    while reach < longest:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = written(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variants-roots")
        reach *= 2
    return rows.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


@query("op12_spelling_variants")
def op12(spark, folder):
    return variants(vocabulary(documents(spark, folder))).select("word", "form", "root", "n", "n_near", "form_n")
