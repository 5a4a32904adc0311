"""A directory as a stream of listings, so that edits and removals are seen, and micro-batches that refresh a catalogue.

Spark's own file stream reports new files only. This source reports, for each trigger, every file that is there; one
partition lists one directory below the root.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "scan bigint, path string, length bigint, mtime_ns bigint"


class _Directory(InputPartition):
    def __init__(self, scan: int, path: str, deep: bool):
        super().__init__(None)
        self.scan, self.path, self.deep = scan, path, deep


class _ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.recursive = options["path"], options.get("recursive", "true").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        import time

        return {"scan": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = [_Directory(end["scan"], self.root, False)]
        if self.recursive and os.path.isdir(self.root):
            parts += [_Directory(end["scan"], e.path, True) for e in os.scandir(self.root) if e.is_dir()]
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            try:
                entries = list(os.scandir(todo.pop()))
            except FileNotFoundError:
                continue  # it went between listing and reading
            for e in entries:
                if e.is_dir():
                    todo += [e.path] * partition.deep
                elif e.is_file():
                    s = e.stat()
                    yield partition.scan, e.path, s.st_size, s.st_mtime_ns

    def commit(self, end: dict) -> None:
        pass


class _Listing(DataSourceReader):
    """One scan, for spark.read."""

    def __init__(self, options: dict):
        self.stream = _ListingStream(options)

    def partitions(self) -> list[InputPartition]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.stream.read(partition)


class ListingSource(DataSource):
    """spark.dataSource.register(ListingSource); spark.readStream (or spark.read) .format("listing").option("path", …). The
    path must be visible to all executors."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ListingStream(self.options)


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The files below root as they are now, those whose names begin with _ or . among them, for sources.directory.source_items."""
    spark.dataSource.register(ListingSource)
    return to_files(spark.read.format("listing").option("path", root).option("recursive", str(recursive).lower()).load())


def listing_stream(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").option("path", root).option("recursive", str(recursive).lower()).load()


def to_files(batch: DataFrame) -> DataFrame:
    """The newest scan of a batch, as a listing for sources.directory.source_items."""
    last = batch.agg(F.max("scan").alias("scan"))
    rows = batch.join(last.hint("broadcast"), "scan", "left_semi")  # one row
    return rows.select("path", "length", F.timestamp_micros(F.expr("mtime_ns div 1000")).alias("modificationTime"))


def refresher(refresh: Callable[[DataFrame], object], errors: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that refreshes from each batch. What refresh raises is kept in `errors`, the last good state
    stays, and the next good batch clears it."""
    held = errors if errors is not None else []

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            refresh(batch)
            held.clear()
        except Exception as e:  # noqa: BLE001  a bad batch must not end the stream
            held[:] = [f"{type(e).__name__}: {e}"]
        finally:
            batch.unpersist()

    return run


def fingerprint_changes(spark_rows: DataFrame) -> DataFrame:
    """From rows of listings (scan, path, length, mtime_ns): path, scan, change for each scan that added, edited or removed a
    path. A path is removed at the first later scan that does not hold it."""
    from pyspark.sql import Window

    scans = spark_rows.select("scan").distinct()
    ordered = scans.withColumn("next", F.lead("scan").over(Window.orderBy("scan")))  # one row a listing
    w = Window.partitionBy("path").orderBy("scan")
    seen = spark_rows.join(ordered, "scan").withColumn("fp", F.struct("length", "mtime_ns")).withColumn("before", F.lag("fp").over(w)).withColumn("after", F.lead("scan").over(w)).withColumn("prior", F.lag("next").over(w))
    came = seen.where(F.col("before").isNull() | (F.col("prior") != F.col("scan"))).select("path", "scan", F.lit("new").alias("change"))
    edited = seen.where((F.col("prior") == F.col("scan")) & (F.col("before") != F.col("fp"))).select("path", "scan", F.lit("changed").alias("change"))
    left = seen.where(F.col("next").isNotNull() & ((F.col("after") != F.col("next")) | F.col("after").isNull())).select("path", F.col("next").alias("scan"), F.lit("removed").alias("change"))
    return came.unionByName(edited).unionByName(left)
