"""Balanced contiguous shards: global prefix sums of document sizes, cut at equal targets.

Only ids, sizes and checksums are sorted, never texts. Documents are sorted by id into range partitions; each partition's
total goes to the driver (one row per partition), the sums of the totals come back, and a second pass adds them to the
running sizes within the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, parts, query

SHARDS = 40
ROW_BYTES = 16


def _cut(before: dict[int, tuple[int, int]], total: int, shards: int):
    """Adds rank (rows before) and shard (which of `shards` equal parts the middle of the document's bytes is in)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = list(before[batch.column("part")[0].as_py()])
            size = batch.column("size").to_numpy()
            end = at[0] + np.cumsum(size)
            twice = 2 * end - size  # of the middle
            # in whole numbers; a float would lose exactness beyond 2^53 bytes
            shard = np.array([min(int(x) * shards // (2 * total), shards - 1) for x in twice.tolist()], np.int32)
            rank = at[1] + np.arange(len(size))
            at = [int(end[-1]), at[1] + len(size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard), pa.array(rank)],
                names=["doc_id", "size", "text_crc32", "shard", "rank"],
            )

    return run


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, size (UTF-8 bytes + 16), text_crc32, shard (0 to shards - 1), slot.

    Shards are contiguous in ascending doc_id (nulls first; equal ids by checksum, then by their place in the input) and
    their sizes differ by less than two documents. slot is gapless from 0 in each shard, in that order. A null text
    counts as empty. Repeated rows are placed one after the other. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("doc_id"), F.col("text_crc32"), F.col("row")]
    ranged = light.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = checkpointed(ranged.drop("row"))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy("part").collect()
    before, total, rows = {}, 0, 0
    for t in totals:  # one row per partition
        before[t["part"]] = (total, rows)
        total, rows = total + t["size"], rows + t["rows"]
    placed = ranged.mapInArrow(_cut(before, total, shards), "doc_id long, size long, text_crc32 long, shard int, rank long")
    placed = checkpointed(placed)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # at most one row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


@query("op9_balanced_shards")
def op9(spark, folder):
    placed = balanced_shards(documents(spark, folder))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
