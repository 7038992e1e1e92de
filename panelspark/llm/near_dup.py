"""Near-duplicate documents from bottom-k sketches.

One hash function orders all shingles; a document's sketch holds its `SKETCH` smallest. Documents with one and the same
shingle set are one class from the start. Inverted lists of retained values propose pairs of classes, the sketch of the
union estimates their similarity, and the full sets decide.

Which lists are used. If two sketches have c values in common, then the `len - c + 1` values of either that are rarest in
the corpus hold one of them (prefix principle), so only these are indexed: a passage shared by very many different texts
proposes nothing. For two texts within their sketch c is exact. If only one is, the other has at most a third more shingles,
and those that the first lacks can push as many common ones out of its sketch, so c is `MIXED` at least. For longer texts of similarity 0.75 the number in common is
24 of 32 on average and below `COMMON` = 10 with a chance of about 1e-7 per link.

What is left of long lists are copies of each other. Every list first proposes its members with its leader only; links
found make components, and then only members of different components of a list are compared, those of the list's largest
component not among themselves. A group of copies costs about its size, and no link between components is missed.

Every table here grows with the corpus, so joins ask for a merge: nothing goes through the driver while it happens to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import handed_over, own_scratch

from .common import counted, documents, query, text_key, written
from .components import components
from .words import blocks, mix, shingles, utf8

SHINGLE = 5
SKETCH = 32
COMMON = 10
#: Least number in common with the sketch of a longer text: at most a third more shingles than `SKETCH` are missing from it.
MIXED = SKETCH - SKETCH // 3
#: Members outside a list's largest component from which on its members are looked up by their whole sets.
LONG = 16


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingles (as signed longs) of each text, block by block, with the block's first row."""
    raw, offsets = utf8(column)
    for first, last in blocks(offsets):
        own = offsets[first : last + 1]
        found, at = shingles(raw[own[0] : own[-1]], own - own[0], SHINGLE)
        found = found.view(np.int64)
        yield first, [np.unique(found[at[i] : at[i + 1]]) for i in range(last - first)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column("text")):
            own = batch.slice(first, len(sets))
            k1 = np.array([x.sum() for x in sets], np.int64)
            k2 = np.array([mix(x.view(np.uint64)).sum() for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("tk"), pa.array(k1), pa.array(k2), pa.array(np.array([len(x) for x in sets], np.int64)), _lists([x[:SKETCH] for x in sets])],
                names=["doc_id", "tk", "k1", "k2", "n", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tk (fingerprint of the text), k1 and k2 (of the shingle set), n (set size), sketch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("tk"))
    return rows.mapInArrow(_sketch, "doc_id long, tk long, k1 long, k2 long, n long, sketch array<long>")


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("tk").slice(first, len(sets)), _lists(sets)], names=["node", "full"])


def _index(classes: DataFrame) -> DataFrame:
    """(value, node, n, copies): for each class the values that its lists are looked up by, those in two or more classes."""
    every = classes.select("node", "n", "copies", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    shared = every.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    met = every.join(shared.hint("merge"), "value")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))
    met = met.withColumn("rank", rank).withColumn("met", F.count("*").over(Window.partitionBy("node")))
    need = F.when(F.col("n") > SKETCH, F.lit(COMMON)).otherwise(F.least(F.expr("int((3 * n + 3) div 4)"), F.lit(MIXED)))
    # the m - met values that no other class has come before all others in the order
    met = met.filter(F.col("rank") + F.col("m") - F.col("met") <= F.col("m") - need + 1)
    return met.select("value", "node", "n", "copies", F.col("n").alias("reach"))


def _sizes_fit(a: str, b: str) -> F.Column:
    return F.expr(f"4 * least({a}, {b}) >= 3 * greatest({a}, {b})")


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches leave a similarity of 0.75 possible."""
    a = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    joined = joined.withColumn("union", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("sa", "sb"), "union")))
    return joined.filter(F.when(F.size("union") == SKETCH, F.col("both") >= COMMON).otherwise(F.expr("4 * both >= 3 * size(union)"))).select("a", "b")


def _whole(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, full): the whole shingle set of each class, from one of its texts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    texts = texts.join(nodes.select(F.col("node").alias("tk")).distinct().hint("merge"), "tk", "left_semi").dropDuplicates(["tk"])
    return written(texts.mapInArrow(_full_sets, "node long, full array<long>"), "near-dup-sets")


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets have a similarity of 0.75 or more."""
    full = _whole(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    sides = [full.select(F.col("node").alias(x), F.col("full").alias(f"f{x}")).hint("merge") for x in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    both = F.size(F.array_intersect("fa", "fb"))
    return joined.select("a", "b", both.alias("both"), F.expr("size(fa) + size(fb)").alias("sum")).filter("100 * both >= 75 * (sum - both)").select("a", "b")


def _whole_index(full: DataFrame) -> DataFrame:
    """The index over whole sets instead of sketches: for each class the n - 3n/4 + 1 values that are rarest among these.

    reach: if two classes first meet at this value, they have at most so many in common (values from here on).
    """
    every = full.select("node", F.size("full").cast("long").alias("n"), F.explode("full").alias("value"))
    shared = every.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    met = every.join(shared.hint("merge"), "value")
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "value"))).withColumn("met", F.count("*").over(Window.partitionBy("node")))
    return met.filter("rank - met <= 1 - int((3 * n + 3) div 4)").select("value", "node", "n", (F.col("met") - F.col("rank") + 1).alias("reach"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, tk, n_shingles, component_id, kept.

    component_id is the smallest doc_id of all documents reachable over links of similarity 0.75 or more; kept marks it.
    Texts without a word (or null) are linked with nothing. Rows without a doc_id link others but are not kept; their
    component_id is null if no other member has an id. Repeated rows give repeated results. Other columns are ignored.
    """
    with own_scratch(docs.sparkSession):
        return handed_over(_grouped(docs), "near-dup-groups")


def _grouped(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = written(sketches(docs), "near-dup-sketches")
    classes = rows.filter("n > 0").groupBy("k1", "k2", "n").agg(
        F.min("tk").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("sketch").alias("sketch")
    )
    classes = written(classes, "near-dup-classes")
    index = written(_index(classes), "near-dup-index")

    leaders = index.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("copies", "node")).alias("lead"))
    pairs = index.join(leaders.hint("merge"), "value").filter(F.col("node") != F.col("lead.node")).filter(_sizes_fit("n", "lead.n"))
    pairs = pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    found = components(_links(written(_plausible(pairs, classes), "near-dup-pairs"), docs))

    member = _members(index, found)
    rest = _across(member.filter(f"outside <= {LONG}"))
    long, n_long = counted(member.filter(f"outside > {LONG}").select("node").distinct(), "near-dup-long")
    if n_long:
        rest = rest.union(_across(_members(_whole_index(_whole(long, docs)), found))).distinct()
    rest, n_rest = counted(_plausible(rest, classes), "near-dup-rest")
    if n_rest:
        # only components meet here, so these are what is left to link
        more = _links(rest, docs)
        for end in ("a", "b"):
            more = more.join(found.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge"), end, "left")
        joined = components(more.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
        further = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = found.join(further.hint("merge"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        found = written(found.union(joined.join(found.hint("merge"), "node", "left_anti").select("node", "root")), "near-dup-found")

    named = classes.select("k1", "k2", "n", "node", "first").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least.hint("merge"), "root").select("k1", "k2", "n", "component_id")
    empty = spark.createDataFrame([], labels.schema)
    out = rows.drop("sketch").join(labels.union(empty).hint("merge"), ["k1", "k2", "n"], "left")
    return out.select(
        "doc_id", "tk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _members(index: DataFrame, found: DataFrame) -> DataFrame:
    """Lists with members of two or more components: inner marks the list's largest one, outside counts all others."""
    member = index.select("value", "node", "n", "reach").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = member.groupBy("value", "root").agg(F.count("*").alias("members"))
    per = per.groupBy("value").agg(F.max_by("root", F.struct("members", "root")).alias("main"), (F.sum("members") - F.max("members")).alias("outside")).filter("outside > 0")
    return written(member.join(per.hint("merge"), "value").select("value", "node", "n", "reach", "root", "outside", (F.col("root") == F.col("main")).alias("inner")), "near-dup-members")


def _across(member: DataFrame) -> DataFrame:
    """Pairs of a list in different components; the list's largest component is only met from outside."""
    a = member.filter("not inner").select("value", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "reach", "root")))
    b = member.select("value", "inner", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "reach", "root")))
    met = a.join(b.hint("merge"), (a["value"] == b["value"]) & (F.col("root_a") != F.col("root_b")) & (F.col("inner") | (F.col("node_a") < F.col("node_b"))) & F.expr("175 * least(reach_a, reach_b) >= 75 * (n_a + n_b)") & _sizes_fit("n_a", "n_b"))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


@query("op4_near_duplicates")
def op4(spark, folder):
    return near_duplicates(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")
