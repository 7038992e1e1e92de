"""Operators over whole tables against brute force: near-duplicates, repeats, leaks, shards, token files, packing."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import near_dup as N
from panelspark.llm import substrings as S
from panelspark.llm.decontaminate import contained_items
from panelspark.llm.packing import packed_sequences
from panelspark.llm.sharding import balanced_shards
from panelspark.llm.token_files import read_token_files, write_token_files
from panelspark.llm.tokens import tokenizer, vocabulary_path
from panelspark.session import scratch_path

from .brute import components, crc, repeats, shingle_set

SCHEMA = "doc_id long, text string, tk string, n long, row int, kept double"


def table(spark, rows, parts=3):
    """Extra columns clash with names that the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", -1, 0, 0.5) for d, t in rows], SCHEMA).repartition(parts)


def words(rng, n):
    return ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def copies(seed=1):
    """Families of near copies around the threshold, exact copies, shared passages, odd rows."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = []
    for family in range(6):
        base = words(rng, rng.choice([30, 80, 150]))
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            out.append(" ".join(w))
    out += [passage + " " + " ".join(words(rng, rng.choice([5, 30, 90]))) for _ in range(20)]
    out += [None, "", "  ", "one two", "ONE two", "one  two", "one two three four five", "a b c d e f", "a b c d e f g", " ".join(words(rng, 4000))]
    out += [out[0]] * 5
    rng.shuffle(out)
    return [(None if i % 17 == 5 else i // 2 * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, long", [(1, 16), (2, 0)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed, long):
    monkeypatch.setattr(N, "LONG", long)
    rows = copies(seed)
    want = Counter(components(rows))
    found = N.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)
    assert len({c for _, _, c in want}) < len(rows)


def test_near_duplicates_within_and_beyond_the_sketch(spark):
    """30 to 32 shingles wholly or nearly inside 40 to 42: the shorter text is its own sketch, the longer one is cut."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        n, more = [(32, 10), (31, 10), (30, 10), (32, 8)][i % 4]
        base = words(rng, n + 4)
        longer = base + words(rng, more)
        rows += [(2 * i, " ".join(base if more == 10 else [*words(rng, 1), *base[1:]])), (2 * i + 1, " ".join(longer))]
    want = Counter(components(rows))
    found = N.near_duplicates(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert {n for _, n, _ in want} == {30, 31, 32, 40, 41, 42} and len({c for _, _, c in want}) == 120


def test_near_duplicates_without_rows_or_links(spark):
    assert N.near_duplicates(table(spark, [(1, "a")]).filter("false")).count() == 0
    assert [tuple(r) for r in N.near_duplicates(table(spark, [(1, "a b c"), (2, None)])).select("doc_id", "component_id").orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


def repeated_texts():
    rng = random.Random(4)
    long = " ".join(words(rng, 160))
    short = " ".join(words(rng, 30))
    out = [long, long, "é" + long[10:700], long[:650] + "Ω" + " ".join(words(rng, 40)), short, short, None, "", long[100:499], long[100:500], "ab" * 500, "x" * 399, "x" * 400, "x" * 401]
    out += [" ".join(words(rng, 90)) + long[300:760] + " ".join(words(rng, 20)) + long[300:760], "日本" * 300, "日本" * 300]
    out += [" ".join(words(rng, 25)) + long[200:620] + " ".join(words(rng, 25)) for _ in range(12)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_equal_plain_search(spark, monkeypatch, keep_first, group):
    monkeypatch.setattr(S, "GROUP", group)
    rows = repeated_texts()
    found = {r["doc_id"]: r for r in S.without_repeats(table(spark, rows), keep_first).collect()}
    for (d, _), (text, mask) in zip(rows, repeats(rows, keep_first)):
        r = found[d]
        assert r["n_bytes"] == len(text) and r["n_removed"] == mask.sum()
        assert bytes(r["kept"]) == bytes(np.frombuffer(text, np.uint8)[~mask])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert [x for s in r["removed"] for x in (s["start"], s["end"])] == edges.tolist()


def test_repeats_with_missing_and_repeated_ids(spark):
    long = " ".join(words(random.Random(1), 200))
    rows = [(None, long), (None, long), (5, long), (5, long), (5, None)]
    found = S.without_repeats(table(spark, rows), True).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in found) == sorted([(True, len(long))] * 2 + [(False, 0)] * 3)
    assert S.without_repeats(table(spark, rows).filter("false")).count() == 0
    again = S.without_repeats(table(spark, rows), False).collect()
    assert sorted(r["n_removed"] for r in again) == [0] + [len(long)] * 4


def test_leaks_equal_plain_containment(spark):
    rng = random.Random(6)
    items = [" ".join(words(rng, n)) for n in (1, 3, 4, 5, 6, 8, 20, 41, 90, 300)] + [None, "", "one"]
    docs = [None, "", "ONE", " ".join(words(rng, 5000))]
    for t in items[:10]:
        w = t.split()
        for share in (1, 0.9, 0.8, 0.75, 0.7, 0.5):
            part = w[: max(1, round(len(w) * share))]
            docs.append(" ".join(words(rng, rng.choice([0, 3, 400])) + part + words(rng, rng.choice([0, 2, 300]))).upper())
    docs += docs[4:6]
    rows, known = list(enumerate(docs)), list(enumerate(items))
    rows.append((None, items[6]))
    want = []
    for d, t in rows:
        own = shingle_set(t)
        for i, x in known:
            q = shingle_set(x)
            if q and 100 * len(q & own) >= 75 * len(q):
                want.append((d, i, len(q & own), len(q)))
    bench = spark.createDataFrame([(i, x, "z") for i, x in known], "item_id long, text string, doc_id string")
    found = contained_items(table(spark, rows), bench).collect()
    assert Counter(map(tuple, found)) == Counter(want) and len(want) > 15
    assert contained_items(table(spark, rows), bench.filter("false")).count() == 0
    assert contained_items(table(spark, rows).filter("false"), bench).count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    from panelspark.llm import decontaminate as D

    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 30))) for i in range(12)]
    monkeypatch.setattr(D, "BLOCK_SHINGLES", 60)
    docs = table(spark, [(i, "x " + t) for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contained_items(docs, bench).collect()) == [(i, i) for i in range(12)]


ODD = [(3, "a b"), (1, "Hello, world! " * 30), (None, "x"), (2, None), (2, ""), (7, "é ñ 日本 " * 2000), (7, "é ñ 日本 " * 2000), (5, "don't " * 4095), (4, "word " * 4096), (9, "word " * 12000), (8, "<|endoftext|> a")]


def test_shards_follow_the_prefix_sums(spark):
    rows = balanced_shards(table(spark, ODD), 4).collect()
    size = lambda t: len((t or "").encode()) + 16
    import zlib

    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))
    total, at, want, slot = sum(size(t) for _, t in ODD), 0, [], Counter()
    for d, t in order:
        at += size(t)
        shard = min((2 * at - size(t)) * 4 // (2 * total), 3)
        want.append((d, size(t), zlib.crc32((t or "").encode()), shard, slot[shard]))
        slot[shard] += 1
    assert Counter(map(tuple, rows)) == Counter(want)
    assert balanced_shards(table(spark, ODD).filter("false")).count() == 0
    same = balanced_shards(table(spark, [(1, "a")] * 100), 10).groupBy("shard").count().collect()
    assert [r["count"] for r in same] == [10] * 10


def ids_of(text):
    return tokenizer(vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [2]


def test_token_files_round_trip(spark):
    rows = ODD + [(100 + i, " ".join(words(random.Random(i), 50))) for i in range(40)]
    place = scratch_path(spark, "test-files")
    files = write_token_files(table(spark, rows), place)
    found = sorted(read_token_files(spark, place, files).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((d, len(ids_of(t)), crc(ids_of(t))) for d, t in rows)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert ids == sorted(ids)
    empty = scratch_path(spark, "test-files")
    assert read_token_files(spark, empty, write_token_files(table(spark, rows).filter("false"), empty)).count() == 0


def test_packing_places_every_id_once(spark):
    rows = [(d if i % 2 else i + 1000, t) for i, (d, t) in enumerate(ODD)] + [(2000 + i, " ".join(words(random.Random(i), 20 + 31 * i % 900))) for i in range(150)]
    pieces = packed_sequences(table(spark, rows)).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, t in rows:
        ids, at = ids_of(t), 0
        if [x for x, _ in rows].count(d) == 1:
            for r in sorted(by[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
    assert sum(r["length"] for r in pieces) == sum(len(ids_of(t)) for _, t in rows)
    used = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and {r["padded"] for r in own} == {at if at & (at - 1) == 0 else 4096}
        used += at
    assert used > 0.9 * 4096 * (len(sequences) - 1)
    assert packed_sequences(table(spark, rows).filter("false")).count() == 0
    assert packed_sequences(table(spark, [(1, None)])).select("length", "offset", "padded").collect()[0][:] == (1, 0, 1)
