"""Staging with append and snapshot loads, soft deletion, and keyed tables with latest-wins upserts.

Tables are immutable: a load gives the rows to append, a reconciliation the rows to mark as deleted, and the caller
writes both (see :mod:`quernstone.sources.tables`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_FRACTION, FLOOR = 0.90, 10
_KEY = ["_source_file", "_row_hash"]


def first_in_file(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """The first of equal rows of a file."""
    nth = F.row_number().over(W.partitionBy(*_KEY).orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def append_load(staged: DataFrame, incoming: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows to append: those whose hash the file has never staged, deleted rows included."""
    return first_in_file(incoming, order).join(staged.select(*_KEY), _KEY, "left_anti")


def snapshot_load(staged: DataFrame, incoming: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows to append: those whose hash isn't live; a deleted row that comes back is staged anew."""
    return first_in_file(incoming, order).join(staged.where("_deleted_at is null").select(*_KEY), _KEY, "left_anti")


def reconcile(staged: DataFrame, incoming: DataFrame, min_fraction: float = MIN_FRACTION, floor: int = FLOOR, guard: str = "post_insert") -> DataFrame:
    """_source_file, _row_hash of live rows that the file no longer has, for files that pass the guards.

    Guards, per file: it has live rows, at least ``floor`` incoming ones, and at least ``min_fraction`` of the live
    ones. ``post_insert`` counts live rows after the load (old and new together), ``pre_insert`` before it.
    """
    incoming_keys = incoming.select(*_KEY).distinct()
    live = staged.where("_deleted_at is null").select(*_KEY).distinct()
    counted = live.unionByName(incoming_keys).distinct() if guard == "post_insert" else live
    sizes = incoming_keys.groupBy("_source_file").agg(F.count("*").alias("n_new"))
    passed = counted.groupBy("_source_file").agg(F.count("*").alias("n_live")).join(sizes, "_source_file").where((F.col("n_new") >= floor) & (F.col("n_new") >= F.col("n_live") * min_fraction))
    return live.join(incoming_keys, _KEY, "left_anti").join(passed.select("_source_file"), "_source_file", "left_semi")


def stream_counters(staged: DataFrame) -> DataFrame:
    """Per file: rows staged in all and rows still live."""
    return staged.groupBy("_source_file").agg(F.count("*").alias("rows_total"), F.count_if(F.col("_deleted_at").isNull()).alias("rows_live"))


def upsert(current: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """The latest row of each key; of one sequence number the incoming row wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], [F.desc(sequence), F.desc("_new")]).drop("_new")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def insert_new(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't there yet (a copy that may be repeated)."""
    return incoming.join(current.select(key), key, "left_anti")


def next_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def purge(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows that stay; null stays."""
    return rows.where(F.coalesce(~F.col(column).isin(*values), F.lit(True)))
