"""Delimited, spreadsheet-exported, boundary and cohort tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import SPREADSHEET_ORIGIN, from_serial
from ..functions.wkb import MULTI_POLYGON, POLYGON, rings_of_wkb


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Headered delimited text with a stated schema, so no inference pass over the data.

    Codes stay text when the schema says `string`, which keeps their leading zeros.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("nullValue", "NA")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)
    return path


def read_spreadsheet_export(
    spark: SparkSession, path: str, schema: T.StructType | str, date_columns: list[str], origin: str = SPREADSHEET_ORIGIN
) -> DataFrame:
    """Delimited export of a workbook whose dates are serial day numbers."""
    df = read_delimited(spark, path, schema)
    return df.withColumns({c: from_serial(c, origin) for c in date_columns})


# Boundary attributes kept as text codes, land and water area in square metres, the geometry as well-known binary.
BOUNDARY_SCHEMA = (
    "ZCTA5CE10 string, GEOID10 string, CLASSFP10 string, MTFCC10 string, FUNCSTAT10 string, "
    "ALAND10 bigint, AWATER10 bigint, INTPTLAT10 string, INTPTLON10 string, PARTFLG10 string, STATEFP10 string, "
    "geometry binary"
)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Boundary table as parquet: attributes, and the rings of its (multi-)polygons in degrees in place of the bytes."""
    table = spark.read.schema(BOUNDARY_SCHEMA).parquet(path)
    return table.withColumn("rings", rings_of_wkb("geometry")).drop("geometry")


def _multi_polygon(parts) -> bytes:
    out = [struct.pack("<BII", 1, MULTI_POLYGON, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, POLYGON, len(rings)))
        for ring in rings:
            out.append(struct.pack("<I", len(ring)))
            out += [struct.pack("<dd", p["x"], p["y"]) for p in ring]
    return b"".join(out)


def wkb_of_parts(parts: Column) -> Column:
    """Multi-polygon bytes of an array of polygons, each an array of rings; for tables that others read as geometry."""

    @F.arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _multi_polygon(x) for x in column.to_pylist()], pa.binary())

    return encoded(parts)


def save_cohort(ids: DataFrame, path: str) -> str:
    ids.write.parquet(path)
    return path


def load_cohort(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def id_table(df: DataFrame, col: str, name: str = "ids") -> DataFrame:
    """One-column table from a column."""
    return df.select(F.col(col).alias(name))


def period_dim(spark: SparkSession, start: str, end: str, unit: str = "quarter") -> DataFrame:
    """Calendar dimension of first days, with year, quarter and month numbers."""
    step = {"quarter": "interval 3 months", "month": "interval 1 month"}[unit]
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(step)))
    return spark.range(1).select(days.alias("date")).select(
        "date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month")
    )
