"""Layered metadata in long form: rows (entity, name, value, vtype) of a layer, where later layers win.

The layers are 0 inherited from collections, 1 source, 2 read, 3 entry, 4 analysis. A value is text, and vtype the SQL type
that it is text of; integers are bigint and floats double, whatever their width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.names import Cols, col

INHERITED, SOURCE, READ, ENTRY, ANALYSIS = range(5)


def vtype(kind: T.DataType) -> str:
    """The type under which values of a column type are registered."""
    if isinstance(kind, T.ArrayType):
        return f"array<{vtype(kind.elementType)}>"
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    return kind.simpleString() if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.DecimalType)) else "string"


def to_text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, T.ArrayType) else value.cast("string")


def from_text(text: Column, kind: str) -> Column:
    """A value of a registered type from its text, null if it is not one."""
    return F.from_json(text, kind) if kind.startswith("array<") else text.try_cast(kind)


def layer(df: DataFrame, entity: Cols, rank: int, values: dict[str, Cols]) -> DataFrame:
    """Long rows (entity_id, layer, name, value, vtype) from columns; nulls are never stored."""
    return layer_of_texts(df, entity, rank, texts(df, values))


def texts(df: DataFrame, values: dict[str, Cols]) -> dict[str, tuple[Column, str]]:
    """By name the text and the vtype of columns over df."""
    kinds = df.select(*(col(v).alias(n) for n, v in values.items())).schema
    return {n: (to_text(col(v), k.dataType), vtype(k.dataType)) for (n, v), k in zip(values.items(), kinds, strict=True)}


def layer_of_texts(df: DataFrame, entity: Cols, rank: int, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """The same from texts and their types by name."""
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), text.alias("value"), F.lit(kind).alias("vtype")) for n, (text, kind) in values.items()))
    rows = df.select(col(entity).alias("entity_id"), F.lit(rank).alias("layer"), F.explode(pairs).alias("p"))
    return rows.select("entity_id", "layer", "p.name", "p.value", "p.vtype").where("value IS NOT NULL")


def sniffed(rows: DataFrame) -> DataFrame:
    """rows with a text `value` as rows with value and vtype, by the type that a cell of this text has."""
    kinds = {"Bool": "boolean", "Int64": "bigint", "Float64": "double", "Date": "date", "DateTime": "timestamp"}
    typed = rows.withColumn("_t", cells.typed_cell("value"))
    known = F.lit("string")
    for name, kind in kinds.items():
        known = F.when(F.col("_t.vtype") == name, F.lit(kind)).otherwise(known)
    text = F.when(F.col("_t.vtype").isin("Date", "DateTime"), cells.show_typed("_t")).otherwise(F.col("value"))
    return typed.withColumns({"vtype": known, "value": text}).drop("_t")


def fold(layers: DataFrame, *more: str, dealt: bool = False) -> DataFrame:
    """entity_id, name, value: of each name, the value of the highest layer; within a layer, of the largest `more` columns.

    Text is aggregated by sorting. Few rows share a name of an entity, so they are not sorted and combined where they are
    read, in tasks as large as the input's, but dealt by entity first; dealt: they are already."""
    if more:
        return layers.groupBy("entity_id", "name").agg(F.max_by("value", F.struct("layer", *more)).alias("value"))
    return _dealt(layers, dealt).groupBy("entity_id", "name").agg(F.max_by("value", "layer").alias("value"))


def fold_typed(layers: DataFrame, dealt: bool = False) -> DataFrame:
    """entity_id, name, value, vtype: as fold, with the type of the value that wins."""
    held = _dealt(layers, dealt).groupBy("entity_id", "name").agg(F.max_by(F.struct("value", "vtype"), "layer").alias("v"))
    return held.select("entity_id", "name", "v.value", "v.vtype")


def _dealt(layers: DataFrame, already: bool) -> DataFrame:
    return layers if already else layers.repartition("entity_id")


def fold_maps(maps: Cols) -> Column:
    """An array of maps merged in order, later keys winning (needs the session's LAST_WIN policy)."""
    empty = F.expr("cast(map() as map<string, string>)")
    return F.aggregate(col(maps), empty, lambda a, m: F.map_concat(a, F.coalesce(m, empty)))


def inherited(tree: DataFrame, own: DataFrame) -> DataFrame:
    """entity_id (collection), name, value: what each node has or takes from the nearest ancestor that has it.

    tree: collection_id, id_path; own: collection_id, name, value."""
    up = tree.select(F.col("collection_id").alias("entity_id"), F.posexplode("id_path").alias("layer", "collection_id"))
    return fold(up.join(own, "collection_id").select("entity_id", "layer", "name", "value"))


def display(tree: DataFrame, own: DataFrame, analyzed: DataFrame) -> DataFrame:
    """entity_id (collection), name, value as shown for a collection: inherited and its own, under what its analysis found."""
    above = inherited(tree, own).withColumn("layer", F.lit(INHERITED))
    found = analyzed.select(F.col("collection_id").alias("entity_id"), "name", "value", F.lit(ANALYSIS).alias("layer"))
    return fold(above.unionByName(found))


def by_suffix(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Parameters of nodes from rows whose fragment ends at the node, longer fragments winning.

    paths: path array<string>; rows: fragment (labels joined by /), name, value. Returns path, name, value."""
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(n.alias("width"), F.concat_ws("/", F.slice("path", F.size("path") - n + 1, n)).alias("fragment"))))
    each = paths.select("path").distinct().where(F.size("path") > 0).select("path", ends.alias("e")).select("path", "e.width", "e.fragment")
    return each.join(rows, "fragment").groupBy("path", "name").agg(F.max_by("value", "width").alias("value"))


def by_fragment(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """Parameters of paths from rows that match any run of labels in them; wider runs win, of equals the later start."""
    spans = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size("path")),
                lambda n: F.transform(F.sequence(F.lit(1), F.size("path") - n + 1), lambda s: F.struct(n.alias("width"), s.alias("start"), F.concat_ws("/", F.slice("path", s, n)).alias("fragment"))),
            )
        )
    )
    each = paths.select("path").distinct().where(F.size("path") > 0).select("path", spans.alias("e")).select("path", "e.width", "e.start", "e.fragment")
    return each.join(rows, "fragment").groupBy("path", "name").agg(F.max_by("value", F.struct("width", "start")).alias("value"))


def register_types(values: DataFrame, order: Cols = "position") -> DataFrame:
    """name, vtype: the type of each name's first value in order, whatever order rows arrive in."""
    return values.where("vtype IS NOT NULL").groupBy("name").agg(F.min_by("vtype", F.struct(col(order), F.col("vtype"))).alias("vtype"))


def type_conflicts(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Values whose type is not their name's: all their columns, with `expected`."""
    return values.join(registry.select("name", F.col("vtype").alias("expected")), "name").where("vtype <> expected")


def names(*layers: DataFrame) -> DataFrame:
    """The sorted union of names in use."""
    every = layers[0].select("name")
    for x in layers[1:]:
        every = every.union(x.select("name"))
    return every.distinct().orderBy("name")


def wide(effective: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each entity with a typed column for each name; the names are known from the registry, so one pass does."""
    picks = [F.max(F.when(F.col("name") == n, F.col("value"))).try_cast(t).alias(n) for n, t in columns.items()]
    return effective.groupBy("entity_id").agg(*picks)


def wide_typed(typed: DataFrame, registry: list[tuple[str, str]]) -> DataFrame:
    """One row for each entity with a column of the registered type for each name; values of another type are left out (see
    type_conflicts). registry: (name, vtype), which becomes the schema."""
    picks = [from_text(F.max(F.when((F.col("name") == n) & (F.col("vtype") == t), F.col("value"))), t).alias(n) for n, t in registry]
    return typed.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"), *picks).drop("_n")


def query_view(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """Items with their wide metadata; a metadata column named as an item's becomes <name>_1."""
    taken = {c.lower() for c in items.columns}
    renamed = metadata.select("entity_id", *(F.col(c).alias(f"{c}_1" if c.lower() in taken else c) for c in metadata.columns if c != "entity_id"))
    return items.join(renamed, items.item_id == renamed.entity_id, "left").drop("entity_id")


def changed_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """entity_id of those whose folded metadata differ between two versions (entity_id, name, value)."""
    both = old.withColumn("side", F.lit(-1)).unionByName(new.withColumn("side", F.lit(1))).repartition("entity_id")
    return both.groupBy("entity_id", "name", "value").agg(F.sum("side").alias("balance")).where("balance <> 0").select("entity_id").distinct()


def sibling_number(order: Cols, *group: str) -> Column:
    """1-based position among siblings."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(col(order)))
