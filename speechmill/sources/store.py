"""Tables written once to the shared folder and read again by later queries of the same application."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shared_folder


def source_state(spark: SparkSession, source: str) -> str:
    """What tells whether the files below a folder have changed: names, sizes and times, one line a table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return source
    held = [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path)]
    return "\n".join([source, *sorted(f"{name} {size} {time}" for name, size, time in held)])


#: Schemas of the tables that this process has written or read: a folder's name tells its content, so none changes.
_SCHEMAS: dict[str, StructType] = {}


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], partition_by: str | None = None, sort_by: list[str] = ()) -> DataFrame:
    """A table built from ``source`` under a name of its own, again if the source has changed; partitioned and sorted so that scans can prune and skip."""
    state = hashlib.sha256(source_state(spark, source).encode()).hexdigest()[:12]
    folder = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{state}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder + "/_SUCCESS")
    if folder not in _SCHEMAS and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        df = build()
        if partition_by:
            df = df.repartitionByRange(partition_by, *sort_by).sortWithinPartitions(partition_by, *sort_by)
        writer = df.write.mode("overwrite")
        if "term" in sort_by:
            # A lookup of one term skips the row groups whose filter or bounds exclude it.
            writer = writer.option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", 16 << 20)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    if folder not in _SCHEMAS:
        _SCHEMAS[folder] = spark.read.parquet(folder).schema
    return spark.read.schema(_SCHEMAS[folder]).parquet(folder)
