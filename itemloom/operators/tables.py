"""Payload tables: shapes, merges with provenance, limits, reads in request order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column types that payloads may have.
STORABLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType, T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)
RESERVED = {"item_id", "__row"}


def storable(schema: T.StructType) -> bool:
    """Whether every column has a type that payloads may have, arrays of such included, and no reserved name."""

    def fine(t: T.DataType) -> bool:
        return fine(t.elementType) if isinstance(t, T.ArrayType) else isinstance(t, STORABLE)

    return all(fine(f.dataType) and f.name not in RESERVED for f in schema.fields)


def shape_id(schema: T.StructType) -> str:
    """The same for payloads with the same column names and types in the same order."""
    import hashlib

    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString()] for f in schema.fields]).encode()).hexdigest()[:16]


def stacked(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables of several shapes by column name, absent columns null. Columns of one name that differ in type are
    widened if all of them are numbers, else they become text."""
    kinds: dict[str, list[T.DataType]] = {}
    for t in tables:
        for f in t.schema.fields:
            if f.dataType not in kinds.setdefault(f.name, []):
                kinds[f.name].append(f.dataType)
    text = {n for n, ts in kinds.items() if len(ts) > 1 and not all(isinstance(t, T.NumericType) for t in ts)}
    out = None
    for t in tables:
        t = t.withColumns({c: (F.to_json(c) if isinstance(t.schema[c].dataType, T.ArrayType) else F.col(c).cast("string")) for c in t.columns if c in text})
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def merge(tables: list[tuple[str, DataFrame]], provenance: bool | None = None) -> DataFrame:
    """All rows with the union of columns in the order first seen, absent ones null; `_item_` tells whose row it is, by
    default only if there is more than one table. Columns with one name must have one type or widen to one."""
    if not tables:
        raise ValueError("no table to merge")
    many = len(tables) > 1 if provenance is None else provenance
    out = None
    for label, table in tables:
        part = table.withColumn("_item_", F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    columns = list(dict.fromkeys(c for _, t in tables for c in t.columns))
    return out.select(*columns, *["_item_"] * many)


def skip_untabular(members: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members that have a table, a warning for each that has none)."""
    known = shapes.select("item_id").distinct()
    warned = members.join(known, "item_id", "left_anti").select("item_id", F.concat(F.lit("no table: "), F.col("item_id").cast("string")).alias("warning"))
    return members.join(known, "item_id", "left_semi"), warned


def first_rows(rows: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """The first rows of each table, with `total_rows` and, where some are left out, `warning`."""
    group = Window.partitionBy(*keys)
    counted = rows.withColumn("total_rows", F.count(F.lit(1)).over(group)).withColumn("_n", F.row_number().over(group.orderBy(*order)))
    told = F.when(F.col("total_rows") > limit, F.format_string("%d of %d rows, the first ones", F.lit(limit), F.col("total_rows")))
    return counted.where(F.col("_n") <= limit).withColumn("warning", told).drop("_n")


def ranked(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """rows with their rank in the whole table, from 1: ranges are sorted apart, and only their sizes meet in one place.

    Sizes and rows must come from one and the same division into ranges, whose borders Spark samples anew for each plan, so
    the sorted rows are persisted (in memory and on disk, until the session or the caller clears them)."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    local = sorted_.persist().withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(sizes.select("_p", before.alias("_b")), "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_m", "_p", "_i", "_b")


def read_in_order(payload: DataFrame, requests: DataFrame, key: str = "item_id", row: str = "__row") -> DataFrame:
    """Payload rows of the requested items in the order asked for (requests: pos, item_id); an item asked for twice comes twice."""
    return requests.join(payload, key).orderBy("pos", row)


def payload_sums(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """shape, column, rows, total, mean: one aggregation over each shape's dataset."""
    out = None
    for shape, table in tables.items():
        picks = [F.struct(F.lit(c).alias("column"), F.count(c).alias("rows"), F.sum(F.col(c).cast("double")).alias("total"), F.avg(c).alias("mean")) for c in columns[shape]]
        part = table.agg(F.array(*picks).alias("a")).select(F.lit(shape).alias("shape"), F.explode("a").alias("x")).select("shape", "x.column", "x.rows", "x.total", "x.mean")
        out = part if out is None else out.unionByName(part)
    return out
