"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Every stage works on all rows of the one before, keeps the columns of documents (any others too) and lets its operator's
decision take effect; the last returns the packed pieces. Rows are told apart by their text's fingerprint, so missing or
repeated ids do no harm. n_chars, where there is such a column, follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import text_key, written
from panelspark.llm.decontaminate import contained_items
from panelspark.llm.near_dup import near_duplicates
from panelspark.llm.packing import packed_sequences
from panelspark.llm.quality import quality
from panelspark.llm.secrets import secrets
from panelspark.session import Owned


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The given columns with another text."""
    size = F.length(text)
    new = {"text": text, "n_chars": F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(size)} if "n_chars" in columns else {"text": text}
    kinds = dict(docs.dtypes)
    return docs.select(*(new[c].cast(kinds[c]).alias(c) if c in new else F.col(c) for c in columns))


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or with underscores added one that no column of `docs` has."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, failing lines go from the others."""
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    clean = _free(docs, "_clean")
    kept = quality(packed).filter("kept").select("_row.*", F.col("clean_text").alias(clean))
    return _with_text(kept, docs.columns, F.col(clean))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; of its repeated rows, one.

    Texts without a word are linked with nothing and stay, as do rows of groups in which nobody has a doc_id.
    """
    found = written(near_duplicates(docs), "pipeline-duplicates")
    chosen = found.filter("kept and n_shingles > 0").groupBy("doc_id").agg(F.min("tk").alias("tk"))
    alone = found.filter("n_shingles = 0 or component_id is null").select("doc_id", "tk").distinct()
    keep = written(chosen.union(alone).select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk")), "pipeline-kept")
    key, place = _free(docs, "_key"), _free(docs, "_n")
    keyed = docs.withColumn(key, text_key())
    same = (keyed[key] == keep["_tk"]) & keyed["doc_id"].eqNullSafe(keep["_id"])
    repeated = found.filter("kept and n_shingles > 0").groupBy("doc_id", "tk").count().filter("count > 1")
    if not repeated.isEmpty():
        # rows without words or id are told apart by their place, all others by id and text
        worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
        keyed = keyed.withColumn(place, F.when(worded, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
        keyed = keyed.dropDuplicates(["doc_id", key, place])
        same = (keyed[key] == keep["_tk"]) & keyed["doc_id"].eqNullSafe(keep["_id"])
    return keyed.join(keep, same, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contained_items(docs.select(text_key().alias("doc_id"), "text"), items)
    key = _free(docs, "_key")
    leaks = written(leaks.select(F.col("doc_id").alias(key)).distinct(), "pipeline-leaks")
    return docs.withColumn(key, text_key()).join(leaks, key, "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    rest = [c for c in docs.columns if c != "text"]
    null, candidates, hits, clean = (_free(docs, x) for x in ("_null", "_candidates", "_secrets", "_clean"))
    found = secrets(docs.withColumn(null, F.col("text").isNull()), [*rest, null])
    found = found.toDF(*rest, null, candidates, hits, clean)
    out = found.withColumn("text", F.when(~F.col(null), F.col(clean)))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.size(hits) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packed_sequences(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]
#: SQL can't state the stages (a trained forest, tokens, packing): tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to documents, each on what the one before it returned."""
    docs, table = spark.read.parquet(f"{sf_dir}/documents.parquet"), Owned(spark, "pipeline")
    for _, stage in STAGES:
        docs = table.write(stage(spark, docs, sf_dir))  # the one before is removed then
    return docs
