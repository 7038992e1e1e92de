"""Line-first quality rules: lines that fail go, then documents that lost too much text are rejected. DataFrame functions only.

A line (cut at \\n) with a word fails if
- symbols: over `SYMBOL_SHARE` characters of #*$%&|<> for each word (navigation bars, decorated junk);
- shouting: over `MARK_SHARE` of ! and ? for each word, or `CAPS_WORDS` or more words without a lower-case letter;
- unpunctuated: `RUN_WORDS` or more words and no sentence mark anywhere in it (menus, tag clouds);
- boilerplate: at most `NOTICE_WORDS` words and a phrase of page furniture;
- repeated: equal to an earlier line of the text.
A document is rejected if the base rule fails or if the failing lines hold over `LOSS` percent of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fenced, query, shielded

SYMBOL_SHARE = 0.3
MARK_SHARE = 0.5
CAPS_WORDS = 4
RUN_WORDS = 12
NOTICE_WORDS = 25
LOSS = 30
# Phrases of page furniture.
NOTICES = (
    "accept (all )?cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|follow us on|"
    "log ?in|privacy policy|read more|share (this|on)|sign ?up|skip to (main )?content|subscribe|terms of (use|service)"
)
GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Bits of a window's place in the packed array; longer texts take the general path, which sorts whole hashes.
PLACE_BITS = 24


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _failures(line: Column) -> Column:
    """Words of the line if it fails a rule other than repetition, else 0."""
    n = F.size(words_of(line))
    fails = (
        (F.regexp_count(line, F.lit(SYMBOL)) > n * SYMBOL_SHARE)
        | (F.regexp_count(line, F.lit("[!?]")) > n * MARK_SHARE) & (n > 1)
        | (n >= CAPS_WORDS) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
        | (n >= RUN_WORDS) & ~line.rlike("[.!?…。！？]")
        | (n <= NOTICE_WORDS) & line.rlike(rf"(?i)\b({NOTICES})\b")
    )
    return F.when(fails, n).otherwise(F.lit(0))


def _repeat_words(n: Column, windows: Column, packed: Column) -> Column:
    """Words in windows of three that occur twice or more.

    packed: sorted, each window's hash (high bits) with its place (low bits). Neighbours of equal full hash are equal
    windows; the words covered follow from the gaps between the sorted places.
    """
    place = F.lit((1 << PLACE_BITS) - 1)
    at = lambda i: F.get(windows, F.get(packed, i).bitwiseAND(place).cast("int"))
    met = F.filter(packed, lambda x, i: (at(i) == at(i - 1)) | (at(i) == at(i + 1)))
    return F.sort_array(F.transform(met, lambda x: x.bitwiseAND(place)))


def _mixed(windows: Column, packed: Column) -> Column:
    """Whether two neighbours have the same high bits and different hashes."""
    place = F.lit((1 << PLACE_BITS) - 1)
    at = lambda x: F.get(windows, x.bitwiseAND(place).cast("int"))
    after = lambda i: F.get(packed, i + 1)
    return F.exists(F.transform(packed, lambda x, i: (F.shiftright(x, PLACE_BITS) == F.shiftright(after(i), PLACE_BITS)) & (at(x) != at(after(i)))), lambda x: x)


def _covered(places: Column) -> Column:
    steps = F.transform(places, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - x, F.lit(3).cast("long"))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


@shielded
def quality(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, any others) with the counts and verdicts added and clean_text, the text without failing lines.

    Columns added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words (long), base_failed, kept,
    clean_text. A null text has no words: it fails the base rule and its clean_text is null. Columns of the input with
    these names are replaced. Everything is computed within the row: no shuffle, and repeated rows or ids don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("array()").cast("array<bigint>")
    out = docs.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn(
        "_windows",
        F.when(F.col("n_words") >= 3, F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(none),
    )
    out = out.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long")).drop("_words")
    again = F.size("_windows") > F.size(F.array_distinct("_windows"))
    small = F.size("_windows") < (1 << PLACE_BITS)
    packed = F.sort_array(F.transform("_windows", lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_packed", F.when(again & small, packed).otherwise(none))
    # different windows that share their high bits may hide each other's repeats: such a text takes the general path too
    exact = small & ~_mixed(F.col("_windows"), F.col("_packed"))
    general = F.expr("array_sort(transform(_windows, (h, i) -> struct(h, bigint(i) as i)))")
    out = out.withColumn("_general", F.when(again & ~exact, general))
    far = F.expr("sort_array(transform(filter(_general, (x, j) -> x.h = get(_general, j - 1).h or x.h = get(_general, j + 1).h), x -> x.i))")
    places = F.when(F.col("_general").isNotNull(), far).otherwise(_repeat_words(F.col("n_words"), F.col("_windows"), F.col("_packed")))
    out = out.withColumn("_places", places).withColumn("n_repeat_words", _covered(F.col("_places"))).drop("_windows", "_packed", "_general", "_places")

    out = out.withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
    # lines without a word get a name of their own each, so that only lines with words count as repeated
    out = out.withColumn("_all", F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), x).otherwise(F.concat(F.lit("\n"), i.cast("string"), x))))
    out = out.withColumn("_lines", F.array_distinct("_all")).withColumn("n_dup_lines", (F.size("_all") - F.size("_lines")).cast("long"))
    out = out.withColumn("_bad", F.transform("_lines", lambda x: F.when(x.startswith("\n"), F.lit(0)).otherwise(_failures(x))))
    first = F.aggregate(F.transform("_lines", lambda x: F.when(x.startswith("\n"), F.lit(0)).otherwise(F.size(words_of(x)))), F.lit(0).cast("long"), lambda a, x: a + x)
    repeated = F.when(F.col("n_dup_lines") > 0, F.col("n_words") - first).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("n_lost_words", F.aggregate("_bad", F.lit(0).cast("long"), lambda a, x: a + x) + repeated)
    clean = F.array_join(F.transform(F.filter("_lines", lambda x, i: F.get("_bad", i) == 0), lambda x: F.when(x.startswith("\n"), F.regexp_replace(x, r"^\n\d+", "")).otherwise(x)), "\n")
    out = out.withColumn("clean_text", F.when(F.col("text").isNull(), F.lit(None).cast("string")).when((F.col("n_dup_lines") > 0) | (F.col("n_lost_words") > 0), clean).otherwise(F.col("text"))).drop("_all", "_lines", "_bad")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return fenced(out).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= LOSS * F.col("n_words")))


@query("op3_quality_rules")
def op3(spark, folder):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"]
    return quality(documents(spark, folder).select("doc_id", "text")).select(*columns)
