"""Tables as versioned Parquet folders: a new version is written beside the old one, then a pointer is moved."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """``root/v-<id>`` folders and numbered pointers ``current-<n>``: the highest one that exists tells the version.

    A pointer is written beside and renamed to a number that isn't taken, so there is no moment without a table; of two
    writers one fails. Versions and pointers that others may read are never overwritten.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _latest(self) -> tuple[int, str | None]:
        if not self.fs.exists(self._path("")):
            return 0, None
        found = [f.getPath().getName() for f in self.fs.listStatus(self._path(""))]
        numbers = [int(n.removeprefix("current-")) for n in found if n.startswith("current-")]
        if not numbers:
            return 0, None
        stream = self.fs.open(self._path(f"current-{max(numbers):012d}"))
        try:
            return max(numbers), bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        _, current = self._latest()
        return None if current is None else self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{current}")

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        before, _ = self._latest()
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{version}")
        self._point(version, before + 1)
        return version

    def append(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Rows added to the current version (columns may be new)."""
        _, current = self._latest()
        if current is None:
            self.replace(df, partition_by)
        else:
            writer = df.write.mode("append")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{current}")

    def delete(self, where: Column) -> None:
        """A version without the rows for which the condition holds; where it is null they stay."""
        current = self.read()
        if current is not None:
            self.replace(current.where(~F.coalesce(where, F.lit(False))))

    def _point(self, version: str, number: int) -> None:
        fresh = self._path(f"next-{uuid.uuid4().hex}")
        out = self.fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        target = self._path(f"current-{number:012d}")
        if self.fs.exists(target) or not self.fs.rename(fresh, target):
            self.fs.delete(fresh, False)
            raise RuntimeError(f"another writer has replaced {self.root}")


AUDIT_SCHEMA = "timestamp string, query string, route string, sql string, source_ids array<string>, latency_ms double, error string"


def audit(path: str, query: str, route: str, sql: str | None, source_ids: list[str], started: float, error: str | None = None) -> None:
    """One JSON line per answered question; a log that can't be written is never an error of the question."""
    entry = {
        "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "query": query,
        "route": route,
        "sql": sql,
        "source_ids": source_ids,
        "latency_ms": round((time.time() - started) * 1000, 1),
        "error": error,
    }
    try:
        with open(path, "a", encoding="utf-8") as log:
            log.write(json.dumps(entry, ensure_ascii=False) + "\n")
    except OSError:
        pass


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_rollup(log: DataFrame) -> DataFrame:
    """Per route: questions, errors, and the mean latency to 0.1 ms."""
    return log.groupBy("route").agg(F.count("*").alias("n_queries"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms"))
