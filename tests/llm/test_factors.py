"""Suffix order, common prefixes and longest factors against plain comparison."""

import numpy as np
import pytest

from panelspark.llm import substrings as S


@pytest.mark.parametrize("letters, seed", [(1, 0), (2, 1), (2, 2), (3, 3), (200, 4)])
def test_longest_factors_equal_plain_comparison(monkeypatch, letters, seed):
    monkeypatch.setattr(S, "WINDOW", 40)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, letters, 90).astype(np.uint8)
    datas = []
    for _ in range(9):
        x = base[rng.integers(0, 20) : rng.integers(60, 90)].copy()
        if len(x) and rng.uniform() < 0.6:
            x[rng.integers(0, len(x))] = 250
        datas.append(x.tobytes())
    size = np.array([len(x) for x in datas])
    raw = np.frombuffer(b"".join(datas), np.uint8)
    end = np.repeat(np.cumsum(size), size)
    order, shared = S._suffix_order(raw, end)
    starts = [i for i in range(len(raw)) if i + 40 <= end[i]]
    assert sorted(order.tolist()) == starts
    text = raw.tobytes()
    common = lambda a, b: next((k for k in range(40) if text[a + k] != text[b + k]), 40)
    assert [text[a : a + 40] for a in order] == sorted(text[a : a + 40] for a in starts)
    assert shared.tolist() == [0, *(common(a, b) for a, b in zip(order[:-1], order[1:]))]
    previous, later = S._longest_factors(order, shared)
    for i, a in enumerate(order.tolist()):
        assert previous[i] == max((common(a, b) for b in starts if b < a), default=0)
        assert later[i] == max((common(a, b) for b in starts if b > a), default=0)


def test_least_is_the_leftmost():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 8, 13):
        values = rng.integers(0, 6, 200).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
        assert S._least(values, width).tolist() == want
