"""Benchmark items inside documents: containment search by MinHash sketches of a size that follows the item's.

An item is found in a document that has at least 75 % of its distinct 5-word shingles, however long the document is.
Items are partitioned by size, by powers of two. A partition's sketch is the items' u/4 + 1 smallest hash values, u being
the most shingles in the partition: a document that lacks all of them lacks over a quarter of the item, so no leak is
missed. Documents are streamed past the sketches, so long ones cost their length only, and what they hit is verified by
exact containment in the same task. Items go to the tasks in blocks of `BLOCK_SHINGLES`; each block is one pass, whose
leaks are written before the next block is read, so the driver holds one block at a time whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import handed_over, own_scratch

from .common import documents, query, scratch_path, written
from .near_dup import SHINGLE, _full_sets
from .words import blocks, shingles, utf8

#: Shingles of items that a pass sends to every task (8 bytes each, and as much again for sketches).
BLOCK_SHINGLES = 1_000_000
SIEVE_BITS = 20
FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def _sketch_size(n: int) -> int:
    """For an item of n shingles: by the largest size of its partition, at most all."""
    most = 1 << (max(1, n) - 1).bit_length()
    return min(n, most // 4 + 1)


def _search(items: list[tuple[int, np.ndarray]]):
    """items: id and sorted distinct shingles."""
    probe = np.concatenate([x[: _sketch_size(len(x))] for _, x in items])
    owner = np.repeat(np.arange(len(items)), [_sketch_size(len(x)) for _, x in items])
    order = np.argsort(probe, kind="stable")
    probe, owner = probe[order], owner[order]
    shift = np.uint64(64 - SIEVE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[probe.view(np.uint64) >> shift] = True
        for batch in batches:
            out: list[tuple] = []
            raw, offsets = utf8(batch.column("text"))
            for first, last in blocks(offsets):
                own = offsets[first : last + 1]
                values, at = shingles(raw[own[0] : own[-1]], own - own[0], SHINGLE)
                maybe = np.flatnonzero(sieve[values >> shift])
                value = values[maybe].view(np.int64)
                low = np.searchsorted(probe, value, "left")
                hits = np.searchsorted(probe, value, "right") - low
                maybe, low, hits = maybe[hits > 0], low[hits > 0], hits[hits > 0]
                if not len(maybe):
                    continue
                doc = np.repeat(np.searchsorted(at, maybe, "right") - 1, hits)
                item = owner[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
                pairs = np.unique(np.stack([doc, item], 1), axis=0)
                whole, held = np.zeros(0, np.int64), -1
                for d, i in pairs.tolist():
                    if d != held:
                        whole, held = np.unique(values[at[d] : at[d + 1]].view(np.int64)), d
                    shared = int(np.isin(items[i][1], whole, assume_unique=True).sum())
                    if 100 * shared >= 75 * len(items[i][1]):
                        out.append((batch.column("doc_id")[first + d].as_py(), items[i][0], shared, len(items[i][1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["doc_id", "item_id", "n_shared", "n_item"])

    return run


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for every document of `docs` (doc_id, text) that contains an item of `items`
    (item_id, text).

    Words are runs of anything but ASCII white space with A-Z in lower case; a text of under five words is one shingle.
    Texts and items that are null or without a word match nothing. Repeated rows of either table are repeated in the
    result; ids may be null. No items, or no documents, give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    with own_scratch(spark):
        return handed_over(_leaks(docs, named), "leaks")


def _leaks(docs: DataFrame, named: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    sets = written(named.mapInArrow(_full_sets, "node long, full array<long>").filter("size(full) > 0"), "leak-items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(spark, "leaks")
    spark.createDataFrame([], FOUND).write.parquet(f"{path}/block=0")
    for k, block in enumerate(_blocks(sets), 1):
        rows.mapInArrow(_search(block), FOUND).write.parquet(f"{path}/block={k}")
    return spark.read.schema(FOUND).option("recursiveFileLookup", "true").parquet(path)


def _blocks(sets: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Whole items with about `BLOCK_SHINGLES` shingles at a time; a longer item is a block of its own."""
    held, size = [], 0
    for r in sets.toLocalIterator():  # a partition at a time
        if held and size + len(r["full"]) > BLOCK_SHINGLES:
            yield held
            held, size = [], 0
        held.append((r["node"], np.array(r["full"], np.int64)))
        size += len(r["full"])
    if held:
        yield held


_SHINGLES = """
SELECT {id}, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
FROM (SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})
"""


@query(
    "op8_benchmark_leaks",
    f"""
    WITH b AS ({_SHINGLES.format(id="item_id", table="benchmark")}), d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
    n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
    FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
    """,
)
def op8(spark, folder):
    return contained_items(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
