"""Session helpers: shared folder, shipped code, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_own_folder: dict[str, str] = {}
_shipped: set[str] = set()
#: Bytes of an Arrow batch that Python workers get: a batch of long texts holds few of them.
BATCH_BYTES = 16 << 20
_BATCH_OPTION, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_CLEAN_UP_OPTION = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python workers: send them this package, once an application, and bound Arrow batches.

    The bound is BATCH_BYTES, unless the session has set its own.  Operators that start Python workers call this.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH_OPTION) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_OPTION, str(BATCH_BYTES))
    if app in _shipped:
        return
    _shipped.add(app)
    archive = os.path.join(tempfile.mkdtemp(prefix="roadlens-"), "roadlens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without one, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="roadlens-shared-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """For writes: Spark deletes a query's shuffle files once its table stands, since nothing else reads them.

    The option is the session's own, so a frame that another thread of the session runs meanwhile is cleaned up
    likewise, which costs it at most the reuse of its shuffles by a later query.
    """
    before = spark.conf.get(_CLEAN_UP_OPTION)
    spark.conf.set(_CLEAN_UP_OPTION, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP_OPTION, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        spark, place = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
