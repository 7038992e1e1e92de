"""Documents packed into training sequences of at most 4096 tokens, by cutting-stock patterns.

Documents are tokenised where they are; one longer than a sequence is cut every 4096 ids, so a whole piece is a sequence
of its own and only the last piece of a document is packed. The histogram of piece lengths (at most 4096 rows, whatever
the data) goes to the driver, which finds the patterns. Spark ranks the pieces of each bin and hands every pattern its
range of ranks; the table of ranges is broadcast and as small as the histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, parts, query
from .cutting_stock import bin_edges, plan
from .tokens import END, encoded, vocabulary_path

LENGTH = 4096
PIECE = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(vocabulary: str, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, cuts in encoded(batch.column("text"), vocabulary, end):
                ids = ids.astype("<u4")
                n = np.diff(cuts)
                count = -(-n // most)
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * most
                length = np.minimum(most, n[doc] - start)
                at = cuts[doc] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length)]
                own = batch.slice(first, len(n)).select(["doc_id", "row"]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("row"), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def _ranges(spark: SparkSession, sequences: list[tuple[dict[int, int], int]]) -> DataFrame:
    """For each bin the ranges of ranks that a pattern takes: (bin, low, high, each, base, place)."""
    rows, used, base = [], {}, 0
    for pattern, times in sequences:
        place = 0
        for edge, each in sorted(pattern.items(), reverse=True):
            low = used.get(edge, 0)
            rows.append((edge, low, low + each * times, each, base, place))
            used[edge], place = low + each * times, place + each
        base += times
    return spark.createDataFrame(rows, "bin long, low long, high long, each long, base long, place long")


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, end: int = END, most: int = LENGTH) -> DataFrame:
    """Per piece of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    padded is the length that the piece's sequence is padded to: `most`, or its own length if that is a power of two. A
    null or empty text is the end id alone; repeated rows are packed each time; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    pieces = checkpointed(rows.mapInArrow(_pieces(vocabulary or vocabulary_path(), end, most), PIECE))
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `most` rows
    size = np.array(sorted(lengths), np.int64)
    count = np.array([lengths[x] for x in size.tolist()], np.int64)
    unit, edge = bin_edges(size, count, most) if len(size) else (1, size)
    edges, at = np.unique(edge, return_inverse=True)
    sequences = plan(edges, np.bincount(at, count).astype(np.int64) if len(size) else count, unit, most)
    ranges = F.broadcast(_ranges(spark, sequences))
    bins = F.broadcast(spark.createDataFrame(list(zip(size.tolist(), edge.tolist())), "length long, bin long"))

    # ranks of a bin's pieces, counted in slices, so that one very common length is not one task's work
    pieces = pieces.join(bins, "length").withColumn("slice", F.pmod(F.xxhash64("row", "start"), F.lit(parts(spark))))
    per = pieces.groupBy("bin", "slice").agg(F.count("*").alias("n"))
    before = per.select("bin", "slice", (F.sum("n").over(Window.partitionBy("bin").orderBy("slice")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "slice").orderBy("row", "start")) - 1)
    ranked = ranked.join(before, ["bin", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(ranges, "bin").filter("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div each")).withColumn("place", F.expr("place + (rank - low) % each"))
    inside = Window.partitionBy("sequence_id")
    up_to = inside.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(up_to) - F.col("length")).withColumn("total", F.sum("length").over(inside))
    padded = F.when(F.expr("total & (total - 1)") == 0, F.col("total")).otherwise(F.lit(most).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded.alias("padded"))


@query("op6_packed_sequences")
def op6(spark, folder):
    return packed_sequences(documents(spark, folder))
