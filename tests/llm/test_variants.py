"""Spelling variants against a comparison of all pairs."""

import random

import numpy as np
import pytest

from panelspark.llm.variants import _entries, _proposals, _Words, near_words, op12, variants, vocabulary

from . import brute


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, letters, words, size):
    """Documents over a few stems and their one-edit neighbours, with frequencies that make chains of forms."""
    rng = random.Random(seed)
    pool = []
    for _ in range(words):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        for depth in range(3):
            pool += [w] * 6 ** (3 - depth)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
    rng.shuffle(pool)
    return [(i, " ".join(pool[i * size : (i + 1) * size])) for i in range(len(pool) // size + 1)]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop", "aé÷ÿÉ×z"])
def test_all_pairs_agree(spark, letters):
    rows = corpus(len(letters), letters, 40, 50)
    want = brute.variants(rows)
    assert any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want)
    assert found(variants(vocabulary(frame(spark, rows)))) == want


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(op12(spark, folder)) == brute.variants(rows)


def test_nulls_repeats_long_words_and_ties(spark):
    long = "ab" * 3000
    rows = [(None, "Kitten KITTEN kitten"), (None, "Kitten KITTEN kitten"), (1, None), (2, ""), (3, "1 2 _ \n"), (4, "ÀÉÎÕÜß " * 5 + "àéîõüß " * 30)]
    rows += [(5, " ".join([long] * 5 + [long[1:]] * 40 + [long[:-1] + "x"] * 40)), (6, "sitting sittinx " * 5 + "sittin " * 5)]
    want = brute.variants(rows)
    assert dict((w[0], w[3]) for w in want)["kitten"] == 6
    assert found(variants(vocabulary(frame(spark, rows)))) == want


def test_empty_tables_and_other_columns(spark):
    assert found(variants(vocabulary(frame(spark, [])))) == []
    assert found(variants(vocabulary(frame(spark, [(1, "a b"), (2, None)])))) == []
    rows = [(1, "kittens " * 9 + "kitten " * 50)]
    more = frame(spark, rows).selectExpr("*", "1 as word", "'x' as n", "2 as id", "3 as key", "4 as root", "5 as near")
    assert found(variants(vocabulary(more))) == brute.variants(rows)


def test_one_reduced_form_for_a_third_of_the_words(spark):
    """With a single symbol all words of a length look alike; the intact halves still part them."""
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)}
    words |= {w[:3] + "z" + w[4:] for w in list(words)[:100]}
    table = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    got = sorted((r["word"], r["near"]) for r in near_words(table, symbols=1).collect())
    assert got == sorted((a, b) for a in words for b in words if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)


def test_every_near_pair_meets_at_a_key():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + a[i + 1 :], a[:i] + "q" + a[i + 1 :], a[:i] + "q" + a[i:]]) or "x"
        w = _Words([a, b], 3)
        proposed, entered = _proposals(w, 3), _entries(w, 3)
        for one, other in ((0, 1), (1, 0)):
            assert np.intersect1d(proposed[1][proposed[0] == one], entered[1][entered[0] == other]).size
