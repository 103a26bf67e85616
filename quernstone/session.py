"""Session helpers: defaults for local use, table reading, checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="quernstone-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/quernstone.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(path)  # the driver serves it to the executors
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where none is named, in local mode, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _OWN:
        _OWN["own"] = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, _OWN["own"], True)
    return _OWN["own"]


_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder, computed once and read back with its statistics.

    (An RDD checkpoint computes its input twice.) The tables stay until :func:`drop_written` or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Delete the tables that :func:`checkpointed` wrote; results that read them can't be computed afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the JVM may have ended
            return
