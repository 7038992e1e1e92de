"""Repeated substrings by suffix order and longest previous factors, partitioned so that no task sees the whole corpus.

Every window of `WINDOW` bytes has an owner: of its byte `GRAM`-grams the one with the smallest hash (leftmost of equals).
Equal windows have equal owners, so the windows of the corpus fall into groups by their owner's hash and nothing is ever
compared between groups. The windows of a text with one owner are neighbours; their bytes are a snippet.

1. Each text's snippets are named by (owner hash, snippet hash) and counted; owners met once are done.
2. One text per distinct snippet of the others is sent to its owner's group, with its count.
3. A task puts many groups into one string, in the order of first occurrence, and sorts its suffixes to depth `WINDOW` by
   prefix doubling; the ranks of the doublings give the common prefixes of neighbours. For every position the previous and
   the next smaller position in suffix order are found, and with them the longest previous factor, as far as `WINDOW`: it is
   the longer of the two common prefixes. The nearest larger positions give the longest later factor the same way. A window
   whose longest previous factor is `WINDOW` is a later copy; with a later factor of that length it has one.
4. The marks go back to all places of the snippets, and to the texts.

An owner with one snippet needs no sorting: the windows of a snippet are all different, and its count says the rest. A group
of more than `GROUP` different snippets (a common passage in many contexts) would be one task's work: its windows are told
apart by their fingerprints in a combining aggregation instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, parts, query, text_key, written
from .words import blocks, fingerprints, mix, powers, utf8

WINDOW = 400
GRAM = 128
#: Different snippets of one owner from which on its windows are aggregated, not sorted.
GROUP = 2000
#: Bytes whose suffixes are sorted together, and bytes of texts worked on at once.
SORT_BYTES = 1 << 20
SCAN_BYTES = 1 << 20
SNIPPET = "tk long, low long, high long, owner long, snippet long"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the minimum of every `width` neighbouring values, the leftmost of equals."""
    at, span = np.arange(len(values)), 1

    def leftmost(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        right = values[b] < values[a]
        return np.where(right, values[b], values[a]), np.where(right, at[b], at[a])

    while span * 2 <= width:
        values, at = leftmost(slice(None, -span), slice(span, None))
        span *= 2
    rest = width - span
    return leftmost(slice(None, len(values) - rest), slice(rest, None))[1] if rest else at


def _snippets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, owner hash, snippet hash) of all snippets; windows counted from the text's start."""
    n = len(raw)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    size = np.diff(offsets)
    begin = np.repeat(offsets[:-1], size)
    place = np.arange(n) - begin
    least = _least(gram, WINDOW - GRAM + 1)
    whole = np.flatnonzero(place[: len(least)] + WINDOW <= np.repeat(size, size)[: len(least)])
    if not len(whole):
        return _snippets(raw[:0], offsets)
    owner = least[whole]
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    low, high = whole[edge], whole[np.append(edge[1:], len(whole)) - 1]
    text = np.searchsorted(offsets, low, "right") - 1
    name = mix((total[high + WINDOW] - total[low]) * down[low] + (high - low).astype(np.uint64))
    return text, low - offsets[text], high - offsets[text], gram[owner[edge]], name


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        tk = batch.column("tk").to_numpy()
        for first, last in blocks(offsets, SCAN_BYTES):
            own = offsets[first : last + 1]
            text, low, high, owner, name = _snippets(raw[own[0] : own[-1]], own - own[0])
            if len(text):
                columns = [tk[first + text], low, high, owner.view(np.int64), name.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["tk", "low", "high", "owner", "snippet"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted snippets of each text."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        ends = wanted.offsets.to_numpy()
        values = wanted.values
        text = np.repeat(np.arange(len(batch)), np.diff(ends))
        fields = {name: values.field(name).to_numpy()[ends[0] : ends[-1]] for name in ("owner", "snippet", "kinds", "count", "low", "high")}
        start, stop = offsets[text] + fields["low"], offsets[text] + fields["high"] + WINDOW
        size = stop - start
        step = max(1, int(len(size) * (8 << 20) / max(1, size.sum())))
        for i in range(0, len(size), step):
            data = pa.array([raw[a:b].tobytes() for a, b in zip(start[i : i + step], stop[i : i + step])], pa.binary())
            columns = [pa.array(fields[x][i : i + step]) for x in ("owner", "snippet", "kinds", "count", "low")]
            first = pa.array(batch.column("first").to_numpy(zero_copy_only=False)[text[i : i + step]])
            yield pa.RecordBatch.from_arrays([*columns, first, data], names=["owner", "snippet", "kinds", "count", "low", "first", "data"])


CUT = "owner long, snippet long, kinds long, count long, low long, first long, data binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a snippet by itself, with its fingerprint."""
    for batch in batches:
        raw, offsets = utf8(batch.column("data"))
        for first, last in blocks(offsets, SCAN_BYTES):
            own = offsets[first : last + 1] - offsets[first]
            count = np.diff(own) - WINDOW + 1
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = own[row] + at
            name = fingerprints(raw[offsets[first] : offsets[last]], start, start + WINDOW)
            rows = batch.slice(first, last - first).select(["owner", "snippet", "count", "first", "low"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at), pa.array(name.view(np.int64))], names=["owner", "snippet", "count", "first", "low", "at", "window"])


WINDOWS = "owner long, snippet long, count long, first long, low long, at long, window long"


def _suffix_order(raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in suffix order to depth WINDOW, and how many bytes each shares with the one before it (up to WINDOW).

    raw: all snippets; end: for each position the end of its snippet, which no suffix crosses.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n].astype(np.uint64)
    depth, ranks = 8, []
    alive = np.flatnonzero(np.arange(n) + depth <= end)
    while True:
        order = alive[np.argsort(key[alive])]
        sorted_key = key[order]
        rank = np.zeros(n, np.uint32)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        ranks.append((depth, rank))
        if depth >= WINDOW:
            break
        step = min(depth, WINDOW - depth)  # the last doubling overlaps
        depth += step
        alive = np.flatnonzero(np.arange(n) + depth <= end)
        key = np.zeros(n, np.uint64)
        key[alive] = (rank[alive].astype(np.uint64) << np.uint64(32)) | rank[alive + step]
        if not len(alive):
            return alive, alive
    shared = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    p, q = order[:-1], order[1:]
    for depth, rank in ranks[::-1]:  # each doubling extends the common prefix by its depth, if the ranks there agree
        fits = np.flatnonzero(shared[at] + depth <= WINDOW)
        k = at[fits]
        same = rank[p[fits] + shared[k]] == rank[q[fits] + shared[k]]
        shared[k[same]] += depth
    for more in range(7):  # the rest byte by byte
        left = np.flatnonzero((shared[at] < WINDOW) & (shared[at] % 8 == more))
        k = at[left]
        shared[k] += raw[p[left] + shared[k]] == raw[q[left] + shared[k]]
    return order, shared


def _nearest_smaller(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry, how much it shares with the nearest entry before it that has a smaller value (0 where there is none).

    An entry whose candidate is too large goes on to the candidate's own; all entries do so at once, so distances double.
    """
    candidate = np.arange(len(value)) - 1
    least = shared.copy()  # of the entries after the candidate, up to this one
    going = np.flatnonzero(candidate >= 0)
    while True:
        going = going[value[candidate[going]] > value[going]]
        if not len(going):
            return np.where(candidate >= 0, least, 0)
        over = candidate[going]
        further, reach = candidate[over], least[over]
        candidate[going] = further
        least[going] = np.minimum(least[going], reach)
        going = going[further >= 0]


def _longest_factors(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest later factor (up to WINDOW) of each window in suffix order: the larger of what it shares
    with the nearest smaller (larger) positions on either side."""
    after = np.append(shared[1:], 0)[::-1]
    out = []
    for value in (order, -order):
        before = _nearest_smaller(value, shared)
        behind = _nearest_smaller(value[::-1], after)[::-1]
        out.append(np.maximum(before, behind))
    return out[0], out[1]


def _factors(datas: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window of all snippets, in order: has an earlier match, has any other match; and where each snippet's windows begin.

    A snippet that stands for several places has other matches, itself.
    """
    size = np.array([len(x) for x in datas])
    start = np.cumsum(size) - size
    windows = size - WINDOW + 1
    at = np.concatenate([[0], np.cumsum(windows)])
    raw = np.frombuffer(b"".join(datas), np.uint8)
    earlier, other = np.zeros(at[-1], bool), np.repeat(counts > 1, windows)
    order, shared = _suffix_order(raw, np.repeat(start + size, size))
    if len(order):
        previous, later = _longest_factors(order, shared)
        snippet = np.searchsorted(start, order, "right") - 1
        window = at[snippet] + order - start[snippet]
        earlier[window] = previous >= WINDOW
        other[window] |= (previous >= WINDOW) | (later >= WINDOW)
    return earlier, other, at


def _ranges(flags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows that stay within a snippet: (snippet, first, last), counted from the snippet's start."""
    edge = np.flatnonzero(flags)
    if not len(edge):
        return edge, edge, edge
    owner = np.searchsorted(at, edge, "right") - 1
    new = np.concatenate([[True], (edge[1:] != edge[:-1] + 1) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(edge)) - 1
    return owner[first], edge[first] - at[owner[first]], edge[last] - at[owner[first]]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by owner, then by the place of their first occurrence; whole groups are sorted together."""

    def done(rows: list[dict]) -> pa.RecordBatch:
        earlier, other, at = _factors([r["data"] for r in rows], np.array([r["count"] for r in rows]))
        columns: list[list] = [[], [], [], [], []]
        for kind, flags in enumerate((earlier, other)):
            snippet, first, last = _ranges(flags, at)
            for s, a, b in zip(snippet.tolist(), first.tolist(), last.tolist()):
                r = rows[s]
                for column, value in zip(columns, (r["owner"], r["snippet"], bool(kind), a, b + WINDOW)):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["owner", "snippet", "any", "start", "end"])

    held, size, group = [], 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if size >= SORT_BYTES and r["owner"] != group:
                yield done(held)
                held, size = [], 0
            group = r["owner"]
            held.append(r)
            size += len(r["data"])
    if held:
        yield done(held)


MARK = "owner long, snippet long, any boolean, start long, end long"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        texts = batch.column("text")
        spans = batch.column("spans")
        for i in range(len(batch)):
            text = texts[i].as_py().encode()
            own = spans[i].as_py() or []
            merged: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            cuts = [0, *(x for span in merged for x in span), len(text)]
            out[0].append(len(text))
            out[1].append(sum(b - a for a, b in merged))
            out[2].append([{"start": a, "end": b} for a, b in merged])
            out[3].append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if merged else text)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])


REMOVED = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"


def without_repeats(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, removed (start, end in bytes), kept (the other bytes).

    Removed is every byte in a 400-byte string that starts elsewhere too, in the same text or another; with keep_first
    only if it starts earlier, in the order of doc_id (nulls last), then of place, so the first copy stays. Matches never
    cross texts and are judged on the texts as given. Null counts as empty; texts under 400 bytes are left alone; of rows
    with one doc_id and text all count as copies of each other and share the first's place. Kept bytes may end inside a
    character. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", text_key())
    scanned = rows.filter(F.octet_length("text") >= WINDOW).select("tk", "text").mapInArrow(_scan, SNIPPET)
    places = checkpointed(scanned.groupBy("tk", "low", "high", "owner", "snippet").agg(F.count("*").alias("copies")))
    # a text that occurs several times counts several times; its own place is that of its smallest id
    order = checkpointed(rows.groupBy("tk").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("first"), F.count("*").alias("copies")))
    names = places.groupBy("owner", "snippet").agg(F.sum("copies").alias("count"))
    groups = names.groupBy("owner").agg(F.count("*").alias("kinds"), F.sum("count").alias("times")).filter("times > 1").select("owner", "kinds")
    # both sides as plain tables, so that an owner met very often can be split in the join
    met = checkpointed(places.join(checkpointed(groups), "owner"))
    placed = met.join(order.select("tk", "first"), "tk")
    lead = placed.groupBy("owner", "snippet", "kinds").agg(
        F.sum("copies").alias("count"), F.min_by(F.struct("tk", "low", "high"), F.struct("first", "tk", "low")).alias("at")
    )
    lead = checkpointed(lead.select("owner", "snippet", "kinds", "count", "at.*"))

    wanted = lead.filter("kinds > 1").groupBy("tk").agg(F.collect_list(F.struct("owner", "snippet", "kinds", "count", "low", "high")).alias("wanted"))
    texts = rows.filter(F.octet_length("text") >= WINDOW).select("tk", "text").dropDuplicates(["tk"]).join(wanted, "tk").join(order.select("tk", "first"), "tk")
    cut = checkpointed(texts.select("text", "first", "wanted").mapInArrow(_cut, CUT))
    ranged = cut.filter(f"kinds <= {GROUP}").repartition(parts(spark), "owner").sortWithinPartitions("owner", "first", "low", "snippet")
    marks = ranged.select("owner", "snippet", "count", "data").mapInArrow(_mark, MARK)
    windows = cut.filter(f"kinds > {GROUP}").mapInArrow(_windows, WINDOWS)
    place = F.struct("first", F.col("low") + F.col("at"), "snippet")
    windows = windows.withColumn("place", place)
    total = windows.groupBy("window").agg(F.sum("count").alias("times"), F.min("place").alias("least")).filter("times > 1")
    windows = windows.join(total, "window")
    span = [F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end")]
    marks = marks.union(windows.select("owner", "snippet", F.lit(True).alias("any"), *span))
    marks = marks.union(windows.filter("place > least").select("owner", "snippet", F.lit(False).alias("any"), *span))
    alone = lead.filter("kinds = 1").select("owner", "snippet", F.lit(True), F.lit(0).cast("long"), F.col("high") - F.col("low") + WINDOW)
    marks = marks.union(alone)

    marks = marks.filter(~F.col("any") if keep_first else F.col("any")).drop("any")
    spans = met.select("tk", "low", "owner", "snippet").join(marks, ["owner", "snippet"])
    if keep_first:  # all places of a snippet but its first are later copies as a whole
        leads = lead.select("owner", "snippet", "tk", "low")
        spans = spans.join(leads, ["owner", "snippet", "tk", "low"], "left_semi").select("tk", "low", "start", "end")
        later = met.select("tk", "low", "high", "owner", "snippet").join(leads, ["owner", "snippet", "tk", "low"], "left_anti")
        spans = spans.union(later.select("tk", "low", F.lit(0).cast("long").alias("start"), (F.col("high") - F.col("low") + WINDOW).alias("end")))
    spans = spans.groupBy("tk").agg(F.collect_list(F.struct((F.col("low") + F.col("start")).alias("start"), (F.col("low") + F.col("end")).alias("end"))).alias("spans"))
    if keep_first:
        size = F.octet_length("text").cast("long")
        every = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
        copies = order.filter("copies > 1").select("tk", "first")
        joined = rows.join(spans, "tk", "left").join(copies, "tk", "left")
        again = (F.col("doc_id") != F.col("first")) | F.col("doc_id").isNull() & (F.col("first") < (1 << 63) - 1)
        joined = joined.withColumn("spans", F.when(again & (size >= WINDOW), every).otherwise(F.col("spans")))
    else:
        joined = rows.join(spans, "tk", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_removed, REMOVED)


@query("op7_repeated_substrings")
def op7(spark, folder):
    found = without_repeats(documents(spark, folder), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
