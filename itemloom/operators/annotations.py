"""Tags, notes and positions, inherited down the hierarchy by slash keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import as_number
from . import tables


def _keys(nodes: DataFrame) -> DataFrame:
    """key, k: each node's own key and those of its ancestors (nodes: key, ancestors)."""
    return nodes.select("key", F.explode(F.array_distinct(F.concat("ancestors", F.array("key")))).alias("k"))


def effective_tags(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """key, tag: tags of a node and of its ancestors, each once."""
    return _keys(nodes).join(assignments.select(F.col("key").alias("k"), "tag"), "k").select("key", "tag").distinct()


def dominant_colors(effective: DataFrame, catalog: DataFrame) -> DataFrame:
    """key, color of the tag with the highest priority, of equals the earlier in the catalog (name, color, priority, position); unknown tags don't count."""
    ranked = effective.join(catalog.select(F.col("name").alias("tag"), "color", "priority", "position"), "tag")
    return ranked.groupBy("key").agg(F.max_by("color", F.struct("priority", -F.col("position"))).alias("color"))


def mark(assignments: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    return assignments.select("key", "tag").unionByName(keys.select("key", F.lit(tag).alias("tag"))).distinct()


def unmark(assignments: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    gone = keys.select("key", F.lit(tag).alias("tag"))
    return assignments.select("key", "tag").join(gone, ["key", "tag"], "left_anti").distinct()


def with_catalog_entry(catalog: DataFrame, name: str, color: str, priority: int) -> DataFrame:
    """The catalog with an entry of that name at its end, if it has none."""
    last = catalog.agg(F.coalesce(F.max("position"), F.lit(0)).alias("p"), F.max((F.col("name") == name).cast("int")).alias("has"))
    new = last.where("coalesce(has, 0) = 0").select(F.lit(name).alias("name"), F.lit(color).alias("color"), F.lit(priority).alias("priority"), (F.col("p") + 1).alias("position"))
    return catalog.select("name", "color", "priority", "position").unionByName(new)


def notes_view(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """key, depth, note_key, body, editable: notes of the ancestors from the outermost in, then the node's own, empty if it has none."""
    above = nodes.select("key", F.posexplode("ancestors").alias("depth", "note_key")).join(notes.select(F.col("key").alias("note_key"), "body"), "note_key")
    own = nodes.select("key", F.size("ancestors").alias("depth"), F.col("key").alias("note_key")).join(notes.select(F.col("key").alias("note_key"), "body"), "note_key", "left")
    columns = ["key", "depth", "note_key", "body", "editable"]
    return above.withColumn("editable", F.lit(False)).select(columns).unionByName(own.withColumn("body", F.coalesce("body", F.lit(""))).withColumn("editable", F.lit(True)).select(columns))


def positions(metadata: DataFrame, x: str = "x_um", y: str = "y_um") -> DataFrame:
    """entity_id, x, y of entities that have both as numbers or numeric text (metadata: entity_id, name, value)."""
    pick = lambda n: F.max(F.when(F.col("name") == n, as_number("value")))
    return metadata.where(F.col("name").isin(x, y)).groupBy("entity_id").agg(pick(x).alias("x"), pick(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def bounding_boxes(tree: DataFrame, placed: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """collection_id, x0, y0, x1, y1 over the positioned nodes below each node (placed: collection_id, x, y); no row without any.

    sizes (collection_id, w, h) override the extent from the lower corner."""
    under = placed.join(tree.select("collection_id", "id_path"), "collection_id").select(F.explode("id_path").alias("collection_id"), "x", "y")
    box = under.groupBy("collection_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    if sizes is None:
        return box
    wide = box.join(sizes.select("collection_id", "w", "h"), "collection_id", "left")
    return wide.select("collection_id", "x0", "y0", F.coalesce(F.col("x0") + F.col("w"), "x1").alias("x1"), F.coalesce(F.col("y0") + F.col("h"), "y1").alias("y1"))


def grid(nodes: DataFrame, order: str, spacing: float = 200.0, origin: tuple[float, float] = (0.0, 0.0), columns: int | None = None, *groups: str) -> DataFrame:
    """nodes with x and y on a grid of rows, ceil(sqrt(n)) wide by default, within each group or over all nodes."""
    if groups:
        group = Window.partitionBy(*groups)
        placed = nodes.withColumn("_at", F.row_number().over(group.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    else:
        total = nodes.agg(F.count(F.lit(1)).alias("_n"))
        placed = tables.ranked(nodes, order, name="_at").withColumn("_at", F.col("_at") - 1).join(total.hint("broadcast"))  # one row
    width = F.lit(columns) if columns else F.ceil(F.sqrt("_n")).cast("int")
    placed = placed.withColumn("_w", width)
    x = origin[0] + (F.col("_at") % F.col("_w")) * spacing
    y = origin[1] + F.floor(F.col("_at") / F.col("_w")) * spacing
    return placed.withColumn("x", x.cast("double")).withColumn("y", y.cast("double")).drop("_at", "_w", "_n")


def grid_columns(n: int) -> int:
    return math.ceil(math.sqrt(n)) if n else 0
