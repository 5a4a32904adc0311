"""Collections: nodes of a hierarchy of any depth, addressed by paths of labels.

A node's id hashes its parent's id and its own label, so equal labels under different parents differ and labels with any
characters cannot be confused. Nodes carry the ids of all their ancestors (id_path), which makes walks up the tree one
explode and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import Cols, col
from ..functions.order import is_roman, natural_key, roman_value
from ..session import prepare


def canonical(value: Cols) -> Column:
    """Type, length and text of a value: values of different types or texts never have the same, nor do joined ones. Structs,
    arrays and maps go by their JSON, maps sorted by key; a null has its type alone."""
    v = col(value)
    return F.coalesce(F.concat(F.typeof(v), F.lit("="), F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.concat(F.typeof(v), F.lit("~")))


def canonical_path(*levels: Cols) -> Column:
    """A path for id_path and nodes whose labels are canonical level values, so that 1, 1.0 and "1" are different nodes."""
    return F.array(*(canonical(v) for v in levels))


def id_path(path: Cols) -> Column:
    """Ids of the nodes along a path of labels, from the root down; an empty path has none."""
    start = F.struct(F.lit("").alias("id"), F.array().cast("array<string>").alias("ids"))

    def step(a: Column, label: Column) -> Column:
        own = F.sha2(F.concat(a["id"], F.lit("/"), F.length(label).cast("string"), F.lit(":"), label).cast("binary"), 256)
        return F.struct(own.alias("id"), F.concat(a["ids"], F.array(own)).alias("ids"))

    return F.aggregate(col(path), start, step, lambda a: a["ids"])


#: Paths of so many labels are hashed by plain expressions, which Spark compiles; longer ones label by label.
_PLAIN = 4


def node_id(path: Cols) -> Column:
    """Id of the node that a path of labels ends at, as id_path has it last; null for an empty path."""
    p, own, out = col(path), F.lit(""), F.try_element_at(id_path(path), F.lit(-1))
    for i in range(_PLAIN):
        label = F.get(p, F.lit(i))
        own = F.sha2(F.concat(own, F.lit("/"), F.length(label).cast("string"), F.lit(":"), label).cast("binary"), 256)
        out = F.when(F.size(p) == i + 1, own).otherwise(out)
    return out


def nodes(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row for each node on any of the paths: collection_id, parent_id, depth, label, path, id_path."""
    distinct = paths.select(path).distinct().where(F.size(path) > 0)
    each = distinct.select(F.explode(F.sequence(F.lit(1), F.size(path))).alias("depth"), F.col(path).alias("whole")).select("depth", F.slice("whole", F.lit(1), F.col("depth")).alias("path"))
    with_ids = each.distinct().withColumn("id_path", id_path("path"))
    return with_ids.select(
        F.element_at("id_path", -1).alias("collection_id"), F.try_element_at("id_path", F.lit(-2)).alias("parent_id"), "depth", F.element_at("path", -1).alias("label"), "path", "id_path"
    )


def ancestor_keys(path: Cols) -> Column:
    """Slash keys of the ancestors of a path, outermost first, without its own."""
    p = col(path)
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.concat_ws("/", F.slice(p, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))


def annotation_keys(tree: DataFrame, registered: DataFrame) -> DataFrame:
    """tree with `key`: the slash path of nodes that are registered with all their ancestors (registered: collection_id),
    else the id behind a fixed prefix."""
    known = registered.select(F.col("collection_id").alias("_up")).distinct()
    found = tree.select("collection_id", F.explode("id_path").alias("_up")).join(known, "_up").groupBy("collection_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = F.coalesce(F.col("_n") == F.size("id_path"), F.lit(False))
    return tree.join(found, "collection_id", "left").withColumn("key", annotation_key("path", "collection_id", whole)).drop("_n")


def annotation_key(path: Cols, collection_id: Cols, registered: Cols) -> Column:
    """The slash path if every node on it is registered, else the id behind a fixed prefix."""
    return F.when(col(registered), F.concat_ws("/", col(path))).otherwise(F.concat(F.lit("@collection/"), col(collection_id)))


def sibling_order(tree: DataFrame, parent: str = "parent_id", label: str = "label") -> DataFrame:
    """tree with `position`, 1 for the first of its siblings: by value if all of them are Roman numerals, else in natural order."""
    siblings = Window.partitionBy(parent)
    key = F.when(F.min(is_roman(label).cast("int")).over(siblings) == 1, roman_value(label)).otherwise(F.lit(0))
    keyed = tree.withColumn("_roman", key).withColumn("_natural", natural_key(label))
    order = siblings.orderBy("_roman", "_natural", label)
    return keyed.withColumn("position", F.row_number().over(order)).drop("_roman", "_natural")


def leaf_counts(tree: DataFrame) -> DataFrame:
    """collection_id, leaves: nodes without children at or below each node."""
    inner = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("collection_id")).distinct()
    leaves = tree.join(inner, "collection_id", "left_anti")
    return leaves.select(F.explode("id_path").alias("collection_id")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("leaves"))


def visible(tree: DataFrame, matches: Column) -> DataFrame:
    """Nodes that match, or have an ancestor or a descendant that does."""
    marked = tree.withColumn("_match", matches)
    hits = marked.where("_match")
    above = hits.select(F.explode("id_path").alias("collection_id")).distinct()
    below = tree.select("*", F.explode("id_path").alias("_up")).join(hits.select(F.col("collection_id").alias("_up")), "_up", "left_semi").select("collection_id").distinct()
    return tree.join(above.union(below).distinct(), "collection_id", "left_semi")


def kept_nodes(tree: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes that still have an item at or below them (items: collection_id)."""
    live = items.where("collection_id IS NOT NULL").select("collection_id").distinct()
    used = tree.join(live, "collection_id", "left_semi").select(F.explode("id_path").alias("collection_id")).distinct()
    return tree.join(used, "collection_id", "left_semi")


def affected(tree: DataFrame, changed: DataFrame) -> DataFrame:
    """collection_id of the nodes that hold changed items, and of all their ancestors."""
    return tree.join(changed.select("collection_id").distinct(), "collection_id", "left_semi").select(F.explode("id_path").alias("collection_id")).distinct()


def broken_links(tree: DataFrame, items: DataFrame) -> DataFrame:
    """kind, id: items whose collection is missing, nodes whose parent is missing."""
    known = tree.select("collection_id")
    lost = items.where("collection_id IS NOT NULL").join(known, "collection_id", "left_anti").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    orphans = tree.where("parent_id IS NOT NULL").join(known.withColumnRenamed("collection_id", "parent_id"), "parent_id", "left_anti")
    return lost.unionByName(orphans.select(F.lit("collection").alias("kind"), F.col("collection_id").alias("id")))


def cycles(tree: DataFrame) -> DataFrame:
    """collection_id of nodes that no walk from a root reaches: those on a cycle of parents, and those below one. A node
    whose parent is missing counts as a root here; broken_links tells of it.

    tree: collection_id, parent_id. Rounds are as many as the tree is deep, each a join with the nodes not reached yet."""
    spark = prepare(tree.sparkSession)
    nodes = tree.select("collection_id", "parent_id")
    known = nodes.select(F.col("collection_id").alias("parent_id"))
    roots = nodes.where("parent_id IS NULL").select("collection_id").union(nodes.where("parent_id IS NOT NULL").join(known, "parent_id", "left_anti").select("collection_id"))
    # a recursion in SQL, since its rounds are planned and run one by one, without a lineage that grows
    walk = """WITH RECURSIVE reached(collection_id) AS (
        SELECT collection_id FROM {roots} UNION ALL SELECT t.collection_id FROM reached r JOIN {nodes} t ON t.parent_id = r.collection_id)
        SELECT DISTINCT collection_id FROM reached"""
    reached = spark.sql(walk, roots=roots, nodes=nodes)
    return nodes.select("collection_id").join(reached, "collection_id", "left_anti")


def conflicts(projected: DataFrame) -> DataFrame:
    """collection_id, versions: ids that come with more than one parent, label or metadata."""
    seen = F.struct("parent_id", "label", "metadata")
    return projected.groupBy("collection_id").agg(F.count_distinct(F.to_json(seen)).alias("versions")).where("versions > 1")
