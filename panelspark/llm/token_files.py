"""Token ids of all documents in binary grammar-compressed files, in ascending doc_id order, and their way back.

Texts are sorted by id into range partitions, as many as their bytes fill; each partition is tokenised, compressed block by
block (a block holds about `BLOCK_TOKENS` ids and a grammar of its own, so memory is bounded) and written as one file through
pyarrow's file systems to the shared folder. A file ends with the places and sizes of its blocks. A task writes under a name
of its own and renames at the end: a repeated task replaces its file with the same bytes. Readers open the files with random
access and hold one block at a time; one total per file goes through the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, query, scratch_path
from .repair import Block, pack
from .tokens import END, encoded, tokenizer, vocabulary_path

BLOCK_TOKENS = 3_000_000
#: Bytes of text in a file; small tables are dealt over the shuffle partitions in files of `LEAST_BYTES` or more.
FILE_BYTES = 512 << 20
LEAST_BYTES = 1 << 20
#: At the end of a file: per block its offset, bytes, documents and ids; then the number of blocks and a mark.
ENTRY, TAIL, MARK = "<QQQQ", "<Q8s", b"RPINDEX1"
FILE = "part int, docs long, tokens long, bytes long"


def _writer(folder: str, vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.rpg"
        own = f"{base}/_{task.partitionId()}-{task.taskAttemptId()}"
        first_rule = max(tokenizer(vocabulary).get_vocab_size(), end + 1)
        index: list[tuple[int, int, int, int]] = []
        with store.open_output_stream(own) as out:

            def flush(ids: list, cuts: list, names: list) -> None:
                whole = np.concatenate(ids)
                data = pack(names, np.concatenate(cuts), whole, first_rule, end)
                offset = index[-1][0] + index[-1][1] if index else 0
                index.append((offset, len(data), len(names), len(whole)))
                out.write(data)

            ids, counts, names, held = [], [], [], 0
            for batch in batches:
                for first, found, cuts in encoded(batch.column("text"), vocabulary, end):
                    ids.append(found)
                    counts.append(np.diff(cuts))
                    names += batch.column("doc_id").slice(first, len(cuts) - 1).to_pylist()
                    held += len(found)
                    if held >= BLOCK_TOKENS:
                        flush(ids, counts, names)
                        ids, counts, names, held = [], [], [], 0
            if names:
                flush(ids, counts, names)
            out.write(b"".join(struct.pack(ENTRY, *e) for e in index) + struct.pack(TAIL, len(index), MARK))
        if index:
            store.move(own, name)
            size = index[-1][0] + index[-1][1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), *(pa.array([x], pa.int64()) for x in (sum(e[2] for e in index), sum(e[3] for e in index), size))],
                names=["part", "docs", "tokens", "bytes"],
            )
        else:
            store.delete_file(own)

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> list[dict]:
    """Write `docs` (doc_id, text) below `folder`; one entry per file: part, docs, tokens, bytes.

    Ascending doc_id, nulls first; equal ids by their text's fingerprint, then by place. A null text counts as empty and
    gives the end id alone; repeated rows are written each time; other columns are ignored; an empty table writes nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES), min(parts(docs.sparkSession), size // LEAST_BYTES))
    rows = rows.withColumn("tk", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.col("tk"), F.col("row")]
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = rows.mapInArrow(_writer(folder, vocabulary or vocabulary_path(), end), FILE)
    return sorted((r.asDict() for r in done.collect()), key=lambda r: r["part"])  # one row per file


class _File:
    """A file opened for random access: its blocks' first ids, and one block read at a time."""

    def __init__(self, folder: str, part: int):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{base}/part-{part:06d}.rpg")
        tail = struct.calcsize(TAIL)
        count, mark = struct.unpack(TAIL, self.file.read_at(tail, self.file.size() - tail))
        if mark != MARK:
            raise ValueError(f"part {part} is no file of token ids")
        entries = count * struct.calcsize(ENTRY)
        index = self.file.read_at(entries, self.file.size() - tail - entries)
        self.index = list(struct.iter_unpack(ENTRY, index))
        self.starts = np.concatenate([[0], np.cumsum([e[3] for e in self.index], dtype=np.int64)])
        self.held: tuple[int, Block] | None = None

    def block(self, k: int) -> Block:
        if self.held is None or self.held[0] != k:
            self.held = (k, Block(memoryview(self.file.read_at(self.index[k][1], self.index[k][0]))))
        return self.held[1]

    def between(self, a: int, b: int) -> np.ndarray:
        """Ids from a up to b of this file; blocks are only expanded where they are asked for."""
        first = int(np.searchsorted(self.starts, a, "right")) - 1
        out = [np.zeros(0, np.uint32)]
        for k in range(first, len(self.index)):
            if self.starts[k] >= b:
                break
            out.append(self.block(k).between(max(0, a - int(self.starts[k])), min(self.index[k][3], b - int(self.starts[k]))))
        return np.concatenate(out)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist()):
                file = _File(folder, part)
                for k in range(len(file.index)):
                    block = file.block(k)
                    ids = block.ids().astype("<u4")
                    cuts = np.concatenate([[0], np.cumsum(block.counts, dtype=np.int64)])
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.doc_ids, pa.int64()), pa.array(start + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(cuts[-1])

    return run


def _starts(files: list[dict]) -> list[tuple[int, int]]:
    out, total = [], 0
    for f in files:
        out.append((f["part"], total))
        total += f["tokens"]
    return out


def read_token_files(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files block by block."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(_starts(files), "part int, start long").repartition(min(len(files), parts(spark)), "part")
    return rows.mapInArrow(_reader(folder), schema)


def _slicer(folder: str, files: list[tuple[int, int]], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.array([start for _, start in files] + [total], np.int64)
        opened: tuple[int, _File] | None = None
        for batch in batches:
            for i, (start, length) in enumerate(zip(batch.column("start").to_pylist(), batch.column("length").to_pylist())):
                a, b = min(max(0, start), total), min(max(0, start + length), total)
                out = [np.zeros(0, np.uint32)]
                for k in range(int(np.searchsorted(begin, a, "right")) - 1, len(files)):
                    if begin[k] >= b:
                        break
                    if opened is None or opened[0] != k:
                        opened = (k, _File(folder, files[k][0]))
                    out.append(opened[1].between(max(0, a - int(begin[k])), min(b, int(begin[k + 1])) - int(begin[k])))
                ids = pa.array([np.concatenate(out).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).select(["start", "length"]).columns, ids], names=["start", "length", "ids"])

    return run


def token_slices(spark: SparkSession, folder: str, files: list[dict], wanted: DataFrame) -> DataFrame:
    """(start, length, ids) for every row (start, length) of `wanted`: the ids from that place of the whole corpus on.

    Only blocks that hold wanted ids are read, and of them only the symbols that reach into the slice are expanded. Slices
    are cut at the ends of the corpus; rows with a null are left out; other columns are ignored.
    """
    rows = wanted.select(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).na.drop()
    rows = rows.repartitionByRange(parts(spark), "start").sortWithinPartitions("start")
    return rows.mapInArrow(_slicer(folder, _starts(files), sum(f["tokens"] for f in files)), "start long, length long, ids array<int>")


@query("op10_token_files")
def op10(spark, folder):
    place = scratch_path(spark, "token-files")
    files = write_token_files(documents(spark, folder), place)
    return read_token_files(spark, place, files)
