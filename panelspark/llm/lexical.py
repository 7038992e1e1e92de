"""Ranked lexical search: an automaton of all item terms reads every document, and no index of documents is built.

The terms of a block of items, each between two spaces, make one Aho-Corasick automaton that goes to every task. Texts are
brought to the same form (A-Z lower-cased, everything that is not part of a term a space), so the spaces guard the
boundaries and each match is one occurrence of a whole term. The automaton gives a term's number, and a term's number the
items that hold it.

A block takes two passes: the first adds up document frequencies (and the sizes of the corpus), the second scores every
document against every item at once. A task keeps an item's best `TOP` only, and the tasks' bests are ranked in two steps,
first within `SALTS` groups of tasks, so no task ranks the bests of the whole cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, query, scratch_path, written
from .words import LOWER, blocks, utf8

TOP = 50
SALTS = 64
#: Pairs of item and term that a block sends to every task: about 100 MB of automaton there. One longer item is its own block.
BLOCK_PAIRS = 100_000
#: Bytes that the automaton reads at once, cut at a space, and scores (document x item) held at once.
SCAN_BYTES = 1 << 20
SCORES = 1 << 21
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
FOUND = "item_id long, doc_id long, score long"


class Block:
    """Items and their terms, as they are sent to the tasks; an automaton is built where it is first used."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, terms in items for t in terms})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, (_, terms) in enumerate(items) for t in terms)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.at = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self._automaton.add_word(f" {term} ".encode().decode("latin-1"), i)
            self._automaton.make_automaton()
        return self._automaton

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For texts end to end: terms in each (with repeats); text, term and count for each term of the block in a text."""
        rows = len(offsets) - 1
        begin = offsets + np.arange(rows + 1)  # a space stands before each text, and one after the last
        line = np.full(len(raw) + rows + 1, 0x20, np.uint8)
        line[np.arange(len(raw)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = PLAIN[raw]
        inside = line != 0x20
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        n = np.diff(np.searchsorted(starts, begin))
        hits = [np.zeros((0, 2), np.int64)]
        spaces = np.flatnonzero(~inside)
        first = 0
        while first < len(line) - 1:
            last = int(spaces[np.searchsorted(spaces, first + SCAN_BYTES, "right") - 1])
            if last <= first:  # one term longer than that
                last = int(spaces[np.searchsorted(spaces, first, "right")])
            text = line[first : last + 1].tobytes().decode("latin-1")
            found = np.fromiter(self.automaton.iter(text), np.dtype("i8,i8"))
            if len(found):
                hits.append(np.stack([np.searchsorted(begin, found["f0"] + first - 1, "right") - 1, found["f1"]], 1))
            first = last
        every = np.concatenate(hits)
        key, count = np.unique(every[:, 0] * max(1, len(self.terms)) + every[:, 1], return_counts=True)
        return n, key // max(1, len(self.terms)), key % max(1, len(self.terms)), count


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(batch.column("text"))
    for first, last in blocks(offsets):
        own = offsets[first : last + 1]
        yield first, last, raw[own[0] : own[-1]], own - own[0]


def _frequencies(sent):
    """(term, n): in how many texts each term is; term -1 counts texts with a term, -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        df, texts, length = np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, raw, offsets in _texts(batch):
                n, _, term, _ = block.scan(raw, offsets)
                df += np.bincount(term, minlength=len(df))
                texts, length = texts + int((n > 0).sum()), length + int(n.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], met])), pa.array(np.concatenate([[texts, length], df[met]]))], names=["term", "n"])

    return run


class _Best:
    """The `top` highest scores of each item, equal scores by ascending doc_id (missing ids first)."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # item, score, id is given, doc_id

    def add(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate([self.rows, rows])
        if len(self.rows) > 2 * self.top * self.items + 10_000:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.rows[:, 3], self.rows[:, 2], -self.rows[:, 1], self.rows[:, 0]))
        rows = self.rows[order]
        first = np.searchsorted(rows[:, 0], np.arange(self.items + 1))
        place = np.arange(len(rows)) - first[rows[:, 0]]
        full = np.flatnonzero(np.diff(first) >= self.top)
        self.least[full] = rows[first[full] + self.top - 1, 1]
        self.rows = rows[place < self.top]


def _scores(sent, weights: np.ndarray, texts: int, length: int, top: int):
    """(item_id, doc_id, score): the best of each item among the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        items, best = len(block.ids), _Best(len(block.ids), top)
        held = max(1, SCORES // max(1, items))
        for batch in batches:
            ids = batch.column("doc_id")
            given, doc_id = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            for first, last, raw, offsets in _texts(batch):
                n, text, term, tf = block.scan(raw, offsets)
                m = np.array([50 + 50 * x * texts // length for x in n.tolist()], np.int64)
                value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[text]))
                for low in range(0, last - first, held):
                    a, b = np.searchsorted(text, [low, low + held])
                    many = block.at[term[a:b] + 1] - block.at[term[a:b]]
                    of = block.items[np.repeat(block.at[term[a:b]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    total = np.zeros((min(held, last - first - low), items), np.int64)
                    np.add.at(total, (np.repeat(text[a:b] - low, many), of), np.repeat(value[a:b], many))
                    row, item = np.nonzero(total >= best.least)
                    at = first + low + row
                    best.add(np.stack([item, total[row, item], given[at], doc_id[at]], 1))
        best.cut()
        item, score, given, doc = best.rows.T
        named = pa.array(block.ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([named, pa.array(doc, mask=given == 0), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, pairs: int) -> Iterator[Block]:
    """Whole items, about `pairs` pairs of item and term at a time; one block is on the driver at once."""
    term = F.explode(F.regexp_extract_all(F.translate("text", UPPER, SMALL), F.lit(TERM), 0))
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), term.alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))
    held, size = [], 0
    for row in written(terms, "search-items").toLocalIterator():
        if held and size + len(row["terms"]) > pairs:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"], row["terms"]))
        size += len(row["terms"])
    if held:
        yield Block(held)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of `docs` (doc_id, text) that score highest for each item of
    `items` (item_id, text), of those with a score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. rank is 1, 2, ... by
    descending score, then ascending doc_id (missing ids first). Null and empty texts have no term and are not counted as
    documents; rows of items with the same item_id (null too) are one item. Every repeated row of docs is a document. No
    items, or no documents, give an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "search-best")
    spark.createDataFrame([], FOUND).write.parquet(f"{path}/block=0")
    for k, block in enumerate(_blocks(items, pairs), 1):
        sent = spark.sparkContext.broadcast(block)
        sums = rows.select("text").mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = {r["term"]: r["n"] for r in sums.collect()}  # one row for each term of the block
        texts, length = found.get(-1, 0), found.get(-2, 0)
        if length:
            weights = np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
            bests = rows.mapInArrow(_scores(sent, weights, texts, length, top), FOUND).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            _first(_first(bests, top, "item_id", "salt"), top, "item_id").select("item_id", "doc_id", "score").write.parquet(f"{path}/block={k}")
        sent.unpersist()
    best = spark.read.schema(FOUND).option("recursiveFileLookup", "true").parquet(path)
    return _first(best, top, "item_id").select("item_id", "rank", "doc_id", "score")


def _first(rows: DataFrame, top: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
    n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
    c AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM n),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tf JOIN (SELECT DISTINCT term FROM q) USING (term) CROSS JOIN c GROUP BY term),
    s AS (SELECT q.item_id, n.r, n.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * n.n * c.N) // c.L)))) AS BIGINT) AS score
          FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r) CROSS JOIN c GROUP BY q.item_id, n.r, n.doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
    """,
)
def op13(spark, folder):
    return ranked(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
