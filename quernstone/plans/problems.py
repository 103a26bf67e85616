"""Queries p1, p3 and p5: drifting schemas, snapshot differences, timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import drift, snapshots, timestamps
from quernstone.session import table


def _feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("stream_files", "stg_rows", "source_catalog")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(*_feeds(spark, sf_dir))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_rows(*_feeds(spark, sf_dir), table(spark, sf_dir, "facilities"))


def p1_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that its column's type couldn't take, with the place it came from."""
    return p1_rows(spark, sf_dir).where("cast_failed").select("feed_code", "file_id", "row_no", "column_name", "column_type", "value")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(*_feeds(spark, sf_dir))


#: table, field, column with the file name, instant (else a date), two-digit years before 2000
DATED = (
    ("records", "record_date", "source_file", False, False),
    ("admissions", "admittime", "source_file", True, False),
    ("patients", "dob", "source_files", False, True),
)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("src_table"),
            F.col("id").alias("row_id"),
            F.lit(field).alias("field_name"),
            F.col(field).alias("value"),
            F.col(source).alias("source"),
            F.lit(instant).alias("instant"),
            F.lit(old).alias("old"),
        )
        for name, field, source, instant, old in DATED
    ]
    return timestamps.not_yet_normal(reduce(DataFrame.unionByName, parts), table(spark, sf_dir, "facilities"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p1_failed_casts, p3_found, p5_found)}
