"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",  # later layers of metadata win when maps are merged
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",  # compressed; narrow rows take many times that in a task's memory
    "spark.sql.cteRecursionRowLimit": "-1",  # trees have as many nodes as they have
    "spark.sql.cteRecursionLevelLimit": "-1",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session that exists; all of them may change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "itemloom") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; where that is unset, a temporary one, but only if
    driver and executors are one process on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="itemloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables written meanwhile go with the job that made them, and not when the driver happens to collect
    its garbage. For writes alone, each of which has a plan of its own: a plan that runs twice would look for its files."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, folder: str, mode: str = "error") -> None:
    """Writes df as a table of zstd-compressed parquet and leaves no shuffle files behind."""
    with freed(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(folder)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written as a table (in the shared folder) and read back, so that it is computed once whoever reads it."""
    folder = folder or shared_folder(df.sparkSession, name)
    write(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key over as many tasks as a shuffle has, which are not merged by size: for Python, whose time grows with
    calls and not with bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows of a few narrow columns that may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(small: DataFrame) -> DataFrame:
    """small, marked for broadcast if it is counted to have few enough rows; beyond that it is joined as any table."""
    return small.hint("broadcast") if small.count() <= BROADCAST_ROWS else small
