"""Session defaults and the few cluster settings the operators read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only while its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 8 << 20


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one spark.checkpoint.dir names, or in local mode one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
            shared = tempfile.mkdtemp(prefix="speechmill-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(rows: int, row_bytes: int, bound: int = BROADCAST_BYTES) -> bool:
    return rows * row_bytes <= bound
