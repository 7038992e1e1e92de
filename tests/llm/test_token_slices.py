"""Random access to files of token ids."""

import random

from panelspark.llm import token_files as T
from panelspark.llm.common import scratch_path
from panelspark.llm.tokens import tokenizer, vocabulary_path


def test_slices_of_the_corpus(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(T, "LEAST_BYTES", 400)  # several files
    rows = [(i, " ".join(rng.choice("the of and tion rere lorem").strip() * rng.randint(1, 3) for _ in range(rng.randrange(60)))) for i in range(60)]
    place = scratch_path(spark, "test-slices")
    files = T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), place)
    assert len(files) > 2
    tool = tokenizer(vocabulary_path())
    every = [x for _, t in rows for x in [*tool.encode(t, add_special_tokens=False).ids, 2]]
    places = [(rng.randrange(len(every)), rng.randrange(40)) for _ in range(100)] + [(0, len(every)), (-5, 9), (len(every) - 3, 100), (len(every) + 5, 2), (3, 0), (7, -2)]
    wanted = spark.createDataFrame([(*p, "z") for p in [*places, (None, 3)]], "start long, length long, ids string")
    got = [(r["start"], r["length"], r["ids"]) for r in T.token_slices(spark, place, files, wanted).collect()]
    assert sorted(got) == sorted((a, n, every[max(0, a) : max(0, a + n)]) for a, n in places)


def test_files_are_sized_by_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "word " * 100) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(T, "FILE_BYTES", 1000)
    files = T.write_token_files(rows, scratch_path(spark, "test-sizes"))
    assert 15 <= len(files) <= 21 and sum(f["docs"] for f in files) == 40
    monkeypatch.undo()
    assert len(T.write_token_files(rows, scratch_path(spark, "test-sizes"))) == 1
