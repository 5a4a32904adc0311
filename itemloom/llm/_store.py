"""Where operators keep tables between Spark jobs: under spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary folder becomes it, but only if driver and
    executors are one process on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that no later job depends on lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_parts(df: DataFrame) -> int:
    """How many tasks read df: a measure of its size that costs no job."""
    return max(1, df._jdf.toJavaRDD().getNumPartitions())


#: Rows of a few fixed-size columns that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast if it is counted to have at most `rows` rows. Rows must be of a bounded width."""
    return small.hint("broadcast") if small.count() <= rows else small


#: A key that more than one in this many rows have is joined by broadcast; there are fewer than this many such keys.
HEAVY = 4096


def attach(many: DataFrame, one: DataFrame, keys: dict[str, str], outer: bool = False) -> DataFrame:
    """Rows of many with the columns of the row of `one` whose columns (the values of keys) equal theirs (the keys of keys),
    nulls being equal; rows without one go, or get nulls if outer. Both must be stored tables, and `one` has one row a key.

    A key may stand in most rows of many: rows of heavy keys stay where they are, and fewer than HEAVY rows of `one`, which
    must be of bounded width, are broadcast to them. All other keys are shuffled."""
    mine, theirs = list(keys), {v: f"_{v}_of" for v in keys.values()}
    one = one.withColumnsRenamed(theirs)
    same = lambda a, b: [a[m].eqNullSafe(b[theirs[t]]) for m, t in keys.items()]
    counted = many.groupBy(*mine).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HEAVY > many.count())
    heavy = stored(counted.select(*(F.col(m).alias(theirs[t]) for m, t in keys.items())), "heavy")
    names = list(theirs.values())
    chosen = one.join(F.broadcast(heavy.withColumnsRenamed({n: f"{n}_" for n in names})), [one[n].eqNullSafe(F.col(f"{n}_")) for n in names], "left_semi")
    hot = many.join(F.broadcast(heavy), same(many, heavy), "left_semi")
    cold = many.join(F.broadcast(heavy), same(many, heavy), "left_anti")
    how = "left" if outer else "inner"
    return hot.join(F.broadcast(chosen), same(hot, chosen), how).unionByName(cold.join(one, same(cold, one), how)).drop(*names)


def in_order(rows: DataFrame, *order, name: str) -> DataFrame:
    """rows, as a stored table, with their ordinals from 0 in the given order: ranges are sorted apart, and only their sizes,
    one row for each, meet in one place."""
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return kept.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
