"""Fingerprints, tokens, grammar and cutting stock: numpy helpers against plain Python."""

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm.cutting_stock import bin_edges, plan
from panelspark.llm.repair import blocks_of, compress, expand, pack
from panelspark.llm.tokens import encoded, tokenizer, vocabulary_path
from panelspark.llm.words import shingles, utf8

from .brute import LOWER, WORD

TEXTS = [
    None, "", " \n\t", "one", "One two", "a b c d e", "A b  c\td\ne f", "x y z w v u " * 40, "é ñ ß 日本 語 x y", "a\x0bb\x0cc\rd e f", "a b c d e", "word" * 5000, "Hello, World!! DON'T don't,, it's.",
    "é, É? l'été. ñ... ×, 3.5, x×, a÷!", "<|endoftext|> hi <|STARTOFTEXT|>", "á, è!  x, y.", "\x1c a\x85b  c.", "ﬁ, K Å. İstanbul, σς. ΑΣ", "12,3. a1, 'S 's, 'll.", "x<|y",
]


def test_shingles_name_words_exactly():
    raw, offsets = utf8(pa.array(TEXTS))
    values, at = shingles(raw, offsets, 5)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall((t or "").translate(LOWER))
        want = [" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
        got = values[at[i] : at[i + 1]].tolist()
        assert len(want) == len(got)
        for a, b in zip(want, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1] * 3, [None], ["a"], []])
def test_ids_equal_the_library(texts):
    path = vocabulary_path()
    tool = tokenizer(path)
    got = {}
    for first, ids, cuts in encoded(pa.array(texts, pa.string()), path):
        for i in range(len(cuts) - 1):
            got[first + i] = ids[cuts[i] : cuts[i + 1]].tolist()
    assert got == {i: tool.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for k in range(60):
        n = int(rng.integers(0, 4000))
        ids = rng.integers(0, int(rng.integers(1, 7)), n).astype(np.uint32)
        if k % 4 == 0 and n:
            ids[:] = 1
        symbols, left, right = compress(ids, 9, 2)
        assert (expand(symbols, left, right, 9) == ids).all()
        data = pack([7, None], np.array([n, 0]), ids, 9, 2)
        both = list(blocks_of(data + data))
        assert len(both) == 2 and (both[1].ids() == ids).all() and both[0].doc_ids == [7, None]
        if n > 20:
            a, b = sorted(rng.integers(0, n, 2).tolist())
            assert (both[0].between(a, b) == ids[a:b]).all()
    phrase = np.tile(np.arange(3, 40, dtype=np.uint32), 500)
    assert len(compress(phrase, 64, 2)[0]) < len(phrase) / 8


def test_end_id_is_never_inside_a_pair():
    ids = np.array([5, 2] * 400, np.uint32)
    symbols, left, right = compress(ids, 9, 2)
    assert 2 not in left and len(symbols) == 400


@pytest.mark.parametrize("n, mean", [(0, 5), (1, 5), (40, 5), (3000, 6.5), (20000, 3)])
def test_plans_hold_every_piece_once(n, mean):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(mean, 1, n).astype(int), 1, 4096)
    size, count = np.unique(lengths, return_counts=True)
    unit, edge = bin_edges(size, count, 4096) if n else (1, size)
    assert (edge >= size).all() and (edge <= 4096).all()
    edges, at = np.unique(edge, return_inverse=True)
    counts = np.bincount(at, count).astype(int) if n else count
    found, sequences = {}, 0
    for pattern, times in plan(edges, counts, unit, 4096):
        assert sum(e * a for e, a in pattern.items()) <= 4096
        sequences += times
        for e, a in pattern.items():
            found[e] = found.get(e, 0) + a * times
    assert found == dict(zip(edges.tolist(), counts.tolist()))
    if n >= 3000:
        assert sequences <= 1.02 * lengths.sum() / 4096 + 1


@pytest.mark.parametrize("copies", [6, 40, 1000])
def test_a_passage_that_repeats_costs_few_symbols(copies):
    """Rounds go on until no pair is frequent, so 4,000 ids become a few symbols wherever they repeat often enough."""
    rng = np.random.default_rng(copies)
    passage = rng.integers(3, 60_000, size=4000).astype(np.uint32)
    noise = [rng.integers(3, 60_000, size=5).astype(np.uint32) for _ in range(copies)]
    ids = np.concatenate([x for n in noise for x in (n, passage)])
    symbols, left, right = compress(ids, 60_000, 2)
    assert (expand(symbols, left, right, 60_000) == ids).all()
    assert len(symbols) < copies * (5 + 2 * int(np.log2(4000)))
    assert len(left) < 2 * 4000


def test_blocks_are_read_in_pieces():
    rng = np.random.default_rng(8)
    ids = np.concatenate([np.tile(rng.integers(3, 50, size=200), 30), rng.integers(3, 70_000, size=5000), [2] * 50]).astype(np.uint32)
    (block,) = blocks_of(pack([1], np.array([len(ids)]), ids, 70_001, 2))
    assert (block.ids() == ids).all() and block.n_tokens == len(ids)
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(ids) + 1, size=2).tolist())
        assert (block.between(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="no token"):
        pack([1], np.array([1]), np.array([9], np.uint32), 9, 2)
