"""Files of a directory tree as source items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import Cols, base_name, col, file_time

#: Files that describe others and are no items.
SIDECARS = ["metadata.txt", "tags.txt", "notes.txt", "layout.txt"]

SOURCE_ITEMS = "source_item_id string, label string, path string, ts timestamp, fingerprint struct<path: string, length: bigint, modified: timestamp>"


def as_source(rows: DataFrame) -> DataFrame:
    """rows as a source of items: an error names the columns of SOURCE_ITEMS that they lack or have with another type; further
    columns may follow."""
    from pyspark.sql.types import StructType

    have = {f.name: f.dataType for f in rows.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(SOURCE_ITEMS).fields if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise TypeError(f"a source of items needs {', '.join(wrong)}")
    return rows


def is_source(name: Cols, *also: str) -> Column:
    """Whether a file name is an item's: no dotfile, no sidecar, none of `also` (a project's own settings and metadata files).
    Directories are not tested."""
    barred = [*SIDECARS, *(x.lower() for x in also)]
    return ~F.startswith(col(name), F.lit(".")) & ~F.lower(col(name)).isin(*barred)


def source_items(files: DataFrame, *also: str) -> DataFrame:
    """SOURCE_ITEMS from a listing (path, length, modificationTime); any DataFrame of that schema may stand for a source."""
    named = files.withColumn("label", base_name("path"))
    fingerprint = F.struct("path", F.col("length").alias("length"), F.col("modificationTime").alias("modified"))
    return named.where(is_source("label", *also)).select(F.col("path").alias("source_item_id"), "label", "path", file_time("label").alias("ts"), fingerprint.alias("fingerprint"))


def discover(spark: SparkSession, root: str, recursive: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Source items below root. Contents are not read. Files whose names begin with _ or . are invisible to Spark's own
    sources; streaming.watch.listing, for a folder that all executors see, has them too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length", "modificationTime")
    return source_items(files, *also)
