"""Snapshots, change sets and logs of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: str = "source_item_id", fingerprint: str = "fingerprint") -> DataFrame:
    """key, change: `new`, `changed`, `removed` or `same`; an item without a fingerprint now always counts as changed."""
    old = previous.select(key, F.col(fingerprint).alias("_old"), F.lit(True).alias("_was"))
    new = current.select(key, F.col(fingerprint).alias("_new"), F.lit(True).alias("_is"))
    both = old.join(new, key, "full")
    change = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "removed")
        .when(F.col("_new").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")), "changed")
        .otherwise("same")
    )
    return both.select(key, change.alias("change"))


def freshness(changes: DataFrame, errors: DataFrame, key: str = "source_item_id") -> DataFrame:
    """One row of counts: total, cached, fresh, stale, new, deleted, error; total is what exists now, and fresh is what of it is neither stale nor new."""
    count = lambda c: F.count_if(F.col("change").isin(*c))
    totals = changes.agg(
        count(["new", "changed", "same"]).alias("total"), count(["changed", "same", "removed"]).alias("cached"), count(["same"]).alias("fresh"),
        count(["changed"]).alias("stale"), count(["new"]).alias("new"), count(["removed"]).alias("deleted"),
    )
    bad = errors.agg(F.count_distinct(key).alias("error"))
    return totals.join(bad.hint("broadcast"))  # one row each


def latest(log: DataFrame, *keys: str, revision: str = "revision", op: str = "op", by: str | None = None) -> DataFrame:
    """The last version of each key, unless it was deleted; of equal revisions a deletion, then the greatest row, wins.
    by: the key by which rows are dealt before they are compared, where few rows share it (as in a log of revisions): then
    nothing is sorted and combined where it is read."""
    if by:
        log = log.repartition(by)
    rest = [c for c in log.columns if c not in keys]
    version = F.struct(F.col(revision), (F.col(op) == "delete").alias("_gone"), *(F.col(c) for c in rest if c not in (revision,)))
    last = log.groupBy(*keys).agg(F.max(version).alias("_v"))
    return last.where(F.col(f"_v.{op}") != "delete").select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))


def overlay(committed: DataFrame, pending: DataFrame, *keys: str, revision: str = "revision", op: str = "op") -> DataFrame:
    """Committed rows under pending mutations, which are newer than all of them."""
    base = committed.withColumn(op, F.lit("upsert")).withColumn(revision, F.lit(-1).cast("long"))
    return latest(base.unionByName(pending, allowMissingColumns=True), *keys, revision=revision, op=op)


def delete_keys(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), list(on), "left_anti")


def gaps(work: DataFrame, states: DataFrame) -> DataFrame:
    """(stage, entity_id) of the work that has no READY state."""
    return work.join(states.where("status = 'READY'").select("stage", "entity_id"), ["stage", "entity_id"], "left_anti")


def work_for(changed: DataFrame, tree: DataFrame, eager: bool = True) -> DataFrame:
    """stage, entity_id to compute again for changed items (item_id, collection_id): both stages of the item, and of its
    collection and all collections above; when not eager, the item stages alone, the rest on demand."""
    stage = lambda *names: F.explode(F.array(*(F.lit(n) for n in names))).alias("stage")
    items = changed.select(stage("item_process", "item_analyze"), F.col("item_id").alias("entity_id"))
    if not eager:
        return items.distinct()
    above = tree.join(changed.select("collection_id").distinct(), "collection_id", "left_semi").select(F.explode("id_path").alias("entity_id")).distinct()
    return items.unionByName(above.select(stage("collection_process", "collection_analyze"), "entity_id")).distinct()


def duplicates(items: DataFrame) -> DataFrame:
    """item_id, copies, sources: ids minted more than once, within a source or across sources."""
    counted = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("source_item_id").alias("sources"))
    return counted.where("copies > 1")


def running(column: str, order: list[Column], *keys: str) -> Column:
    """The last non-null value so far, which carries a section's name to its rows."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
