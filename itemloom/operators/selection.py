"""Choosing items and collections: predicates, text filters, tags, and validated requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import finite
from ..functions.names import Cols, col


def first_match(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose predicate holds, in the order given; null if none does."""
    out = F.lit(None).cast("string")
    for name, predicate in reversed(rules):
        out = F.when(predicate, F.lit(name)).otherwise(out)
    return out


def where(view: DataFrame, predicate: str | None = None, **relations: DataFrame) -> DataFrame:
    """Rows of view for which a Spark SQL predicate over its columns holds. Subqueries may name view as `items` and the
    relations by their names."""
    if not predicate:
        return view
    named = {"items": view, **relations}
    given = ", ".join(f"{n} AS (SELECT * FROM {{_{n}}})" for n in named)
    text = predicate.replace("{", "{{").replace("}", "}}")
    return view.sparkSession.sql(f"WITH {given} SELECT * FROM items WHERE ({text})", **{f"_{n}": df for n, df in named.items()})


def query_items(view: DataFrame, predicate: str | None = None, **relations: DataFrame) -> DataFrame:
    """item_id of the rows for which a predicate over item and metadata columns holds (see where), sorted."""
    return where(view, predicate, **relations).select("item_id").orderBy("item_id")


def text_filter(pattern: str, *texts: Cols) -> Column:
    """Terms separated by commas: a row stays if it has none of the terms behind a minus and, where there are others, one
    of them. Case does not count."""
    text = F.lower(F.concat_ws("\n", *(col(t) for t in texts)))
    terms = [t.strip().lower() for t in pattern.split(",") if t.strip()]
    wanted, barred = [t for t in terms if not t.startswith("-")], [t[1:] for t in terms if t.startswith("-") and t[1:]]
    keep = F.lit(not wanted)
    for t in wanted:
        keep = keep | F.contains(text, F.lit(t))
    for t in barred:
        keep = keep & ~F.contains(text, F.lit(t))
    return keep


def without_tag(keyed: DataFrame, assignments: DataFrame, tag: str) -> DataFrame:
    """Rows of keyed (columns key, ancestors) where neither the key nor an ancestor bears the tag."""
    marked = assignments.where(F.col("tag") == tag).select(F.col("key").alias("_k")).distinct()
    hit = keyed.select("key", F.explode(F.array_distinct(F.concat("ancestors", F.array("key")))).alias("_k")).join(marked, "_k", "left_semi").select("key").distinct()
    return keyed.join(hit, "key", "left_anti")


def select_existing(items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items asked for, ids that do not exist)."""
    asked = ids.select("item_id").distinct()
    return items.join(asked, "item_id", "left_semi"), asked.join(items, "item_id", "left_anti")


def require_all(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items asked for; an error that names some of the missing if any id does not exist."""
    found, missing = select_existing(items, ids)
    lost = [r["item_id"] for r in missing.limit(10).collect()]
    if lost:
        raise KeyError(f"unknown items: {', '.join(map(str, lost))}")
    return found


def items_of(items: DataFrame, collections: DataFrame, time: str = "ts") -> DataFrame:
    """Items of the selected collections by time, those without one last; a null collection selects items at the root."""
    chosen = collections.select(F.col("collection_id").alias("_c")).distinct()
    return items.join(chosen, items.collection_id.eqNullSafe(F.col("_c")), "left_semi").orderBy(F.col(time).asc_nulls_last(), "item_id")


def of_source(items: DataFrame, source_item_id, tree: DataFrame) -> DataFrame:
    """Items of one source item, each with the ancestors to open on the way to it."""
    own = items.where(F.col("source_item_id") == source_item_id)
    return own.join(tree.select("collection_id", F.col("id_path").alias("expand")), "collection_id", "left")


def plot_pairs(table: DataFrame, x: str, y: str) -> DataFrame:
    """x and y as doubles where both are finite numbers; booleans count as 0 and 1; no rows if a column is no number."""
    kinds = dict(table.dtypes)
    numeric = all(re.match(r"tinyint|smallint|int|bigint|float|double|decimal|boolean", kinds[c]) for c in (x, y))
    as_double = lambda c: F.col(c).cast("int").cast("double") if kinds[c] == "boolean" else F.col(c).cast("double")
    if not numeric:
        return table.select(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    pairs = table.select(as_double(x).alias("x"), as_double(y).alias("y"))
    return pairs.where(finite("x") & finite("y"))


def plot_data(payloads: dict[str, DataFrame], items: DataFrame, x: str, y: str) -> DataFrame:
    """Finite (x, y) pairs from the payloads of chosen items, which must be of one kind (items: item_id, kind)."""
    kinds = [r["kind"] for r in items.select("kind").distinct().limit(2).collect()]
    if len(kinds) != 1:
        raise ValueError(f"items of one kind are needed, got {len(kinds)} or more")
    chosen = payloads[kinds[0]].join(items.select("item_id").distinct(), "item_id", "left_semi")
    return plot_pairs(chosen, x, y)


def delivered(processed: DataFrame, collected: DataFrame, key: str = "item_id", allow_missing: bool = False) -> DataFrame:
    """Rows of the collection stage where an item has any, else those of its own stage, with nulls in columns that only the
    collection stage has if that is allowed."""
    return collected.unionByName(processed.join(collected.select(key).distinct(), key, "left_anti"), allowMissingColumns=allow_missing)


def single_kind(items: DataFrame, *selections: str) -> DataFrame:
    """kinds, single: whether a selection, or each of several, is of one kind."""
    return items.groupBy(*selections).agg(F.count_distinct("kind").alias("kinds")).withColumn("single", F.col("kinds") == 1)


def with_source(items: DataFrame, sources: DataFrame, columns: dict[str, Column], key: str = "source_item_id") -> DataFrame:
    """Items with columns of their source item (names to Columns over sources), null where there is no such source item."""
    known = sources.select(F.col(key), *(c.alias(n) for n, c in columns.items()))
    return items.join(known, key, "left")


def visible_selection(items: DataFrame, tree: DataFrame, assignments: DataFrame, collection_ids: DataFrame, item_ids: DataFrame, tag: str = "bad") -> tuple[DataFrame, DataFrame]:
    """(collections, items) of a stored selection that are shown: ids that do not exist are passed over, and what bears the
    tag, or lies below a node that does, is left out. An item counts only if its collection is selected and shown; items at
    the root count if the null collection_id is selected.

    items: item_id, collection_id; tree: collection_id, parent_id, path, id_path; assignments: key, tag, where a node's key
    is its slash path and an item's its item_id. A selected collection that is no leaf is an error."""
    wanted = collection_ids.select("collection_id").distinct()
    chosen = tree.join(wanted, "collection_id", "left_semi")
    inner = chosen.join(tree.select(F.col("parent_id").alias("collection_id")).distinct(), "collection_id", "left_semi").limit(3).collect()
    if inner:
        raise ValueError(f"selected collections that are no leaves: {', '.join('/'.join(r['path']) for r in inner)}")
    own = F.concat_ws("/", "path")
    up = F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.concat_ws("/", F.slice("path", F.lit(1), n)))).otherwise(F.array().cast("array<string>"))
    shown = without_tag(chosen.withColumns({"key": own, "ancestors": up}), assignments, tag).drop("key", "ancestors")
    asked = items.join(item_ids.select("item_id").distinct(), "item_id", "left_semi")
    root = wanted.where("collection_id IS NULL").select(F.lit(None).cast("string").alias("_c"))
    open_ = shown.select(F.col("collection_id").alias("_c")).unionByName(root)
    inside = asked.join(open_, asked.collection_id.eqNullSafe(F.col("_c")), "left_semi")
    marked = assignments.where(F.col("tag") == tag).select(F.col("key").alias("item_id"))
    return shown, inside.join(marked, "item_id", "left_anti")


def source_kind(items: DataFrame) -> DataFrame:
    """source_item_id, kind: the one kind of its items, `mixed`, or `unmatched` (items with a null kind)."""
    kinds = F.collect_set("kind")
    return items.groupBy("source_item_id").agg(kinds.alias("k")).select("source_item_id", F.when(F.size("k") == 0, F.lit("unmatched")).when(F.size("k") > 1, F.lit("mixed")).otherwise(F.col("k")[0]).alias("kind"))
