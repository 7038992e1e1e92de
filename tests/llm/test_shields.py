"""Columns of the input that are called like an operator's working columns, and windows that share their high bits."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.llm import licenses as L
from panelspark.llm import quality as Q
from panelspark.llm.pii import personal_data

from .brute import quality_counts

WORKING = ["_words", "_lines", "_bad", "_all", "_windows", "_places", "_packed", "_general", "_single", "_over", "_empty", "_found", "_paras", "_rest", "_text", "_email", "_ssn", "_fence", "_k0"]


def clashing(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(WORKING)])


@pytest.mark.parametrize("operator", [Q.quality, personal_data, lambda d: L.licenses(d, L.train(d, 20, 2))])
def test_columns_with_working_names_come_back(spark, operator):
    texts = ["a b c " * 30, None, "mail a@b.cd\nLicensed under the MIT License.", ""]
    docs = clashing(spark, texts)
    plain = operator(docs.select("doc_id", "text"))
    out = operator(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert [r[c] for c in WORKING] == list(range(len(WORKING)))
    assert sorted(map(str, out.drop(*WORKING).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("bits", [56, 60, 62])
def test_repeats_are_counted_where_windows_share_their_high_bits(spark, monkeypatch, bits):
    """8, 4 and 2 bits of the hash are left to sort by: different windows alternate everywhere."""
    monkeypatch.setattr(Q, "PLACE_BITS", bits)
    rng = random.Random(bits)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.randrange(3, 400))) for _ in range(30)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in Q.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: quality_counts(t)[4] for i, t in enumerate(texts)}
