"""Ranked search against the formula applied term by term."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import lexical
from panelspark.llm.lexical import Block, ranked

from . import brute


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def corpus(seed, docs, items):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a1", "b", "é", "É", "naïve", "x_y", "日本", "𝒳y", "don't", "3.5", "A-b", "zz", "q" * 30]
    words += ["".join(rng.choice("abc") for _ in range(3)) for _ in range(20)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00", "--", "\x7f"]) for _ in range(rng.randrange(n)))
    return [(i, text(60)) for i in range(docs)], [(i, text(25)) for i in range(items)]


@pytest.mark.parametrize("pairs", [1, 40, 100_000])
def test_blocks_of_items_agree_with_the_formula(spark, pairs):
    docs, items = corpus(3, 150, 12)
    got = found(ranked(*frames(spark, docs, items), top=20, pairs=pairs))
    assert got == brute.ranked(docs, items, 20) and any(r[1] == 20 for r in got)


def test_ties_nulls_and_repeated_rows(spark):
    docs = [(5, "apple pie"), (5, "apple pie"), (3, "pie apple"), (None, "apple pie"), (4, None), (6, ""), (7, "... \n"), (-9, "APPLE pie"), (8, "applepie app"), (9, "nothing else")]
    items = [(1, "apple"), (1, "pie pie"), (None, "pie"), (2, None), (3, ""), (4, "unmet"), (5, "-apple-")]
    want = brute.ranked(docs, items)
    assert [r[2] for r in want if r[0] == 1] == [None, -9, 3, 5, 5]
    assert found(ranked(*frames(spark, docs, items))) == want
    assert found(ranked(*frames(spark, docs, items), top=2)) == brute.ranked(docs, items, 2)


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(4, 20, 3)
    assert found(ranked(*frames(spark, [], items))) == found(ranked(*frames(spark, docs, []))) == []
    assert found(ranked(*frames(spark, [(1, None), (2, "?")], items))) == []
    d, i = frames(spark, docs, items)
    d = d.selectExpr("*", "1 as item_id", "'x' as score", "2 as salt", "3 as rank")
    i = i.selectExpr("*", "1 as doc_id", "'x' as term", "2 as terms")
    assert found(ranked(d, i)) == brute.ranked(docs, items)


def test_long_texts_and_many_scores_are_worked_on_in_pieces(monkeypatch):
    docs, items = corpus(6, 60, 5)
    docs += [(1000, "z" * 100 + " the " + "é" * 50), (1001, "the " * 300), (1002, " " * 200 + "zz"), (None, None)]
    block = Block([(i, sorted(set(brute.terms(t)))) for i, t in items])
    raw = [(t or "").encode() for _, t in docs]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    sent = SimpleNamespace(value=block)
    results = []
    for scan, scores in ((1 << 20, 1 << 21), (16, 4)):
        monkeypatch.setattr(lexical, "SCAN_BYTES", scan)
        monkeypatch.setattr(lexical, "SCORES", scores)
        n, text, term, tf = block.scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert n.tolist() == [len(brute.terms(t)) for _, t in docs]
        got = {(a, block.terms[b]): c for a, b, c in zip(text.tolist(), term.tolist(), tf.tolist())}
        assert got == {(i, w): brute.terms(t).count(w) for i, (_, t) in enumerate(docs) for w in set(brute.terms(t)) & set(block.terms)}
        weights = np.arange(1, len(block.terms) + 1)
        (best,) = lexical._scores(sent, weights, 60, int(n.sum()), 7)([batch])
        results.append(sorted(map(tuple, zip(*best.to_pydict().values()))))
    assert results[0] == results[1] and len(results[0]) == 35
