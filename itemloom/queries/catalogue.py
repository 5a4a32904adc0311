"""Items, collections and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import ratio_or_zero
from ..functions.cells import show_typed, typed_cell
from ..functions.names import label_or, mint_id
from ..functions.order import natural_key, roman_value
from ..operators import analysis, hierarchy, metadata, selection, tables
from ._tables import IDS, NODES, PATHS, UPS, customer_paths, order_items, order_paths, table, tree

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add




def _kind():
    return selection.first_match([("large", F.col("o_totalprice") >= 200000), ("finished", F.col("o_orderstatus") == "F"), ("open", F.lit(True))])


KIND_SQL = "CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END"


@query(f"""
WITH e AS (SELECT DISTINCT o_orderkey, {KIND_SQL} AS kind, l_returnflag, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey AS source_item_id, kind, l_returnflag AS entry,
       (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_returnflag))::INTEGER AS position,
       o_orderkey || '#' || kind || ':' || l_returnflag AS item_id,
       CASE WHEN l_returnflag = 'N' THEN o_orderpriority ELSE l_returnflag END AS label
FROM e""")
def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _kind().alias("kind"), "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag").distinct()
    both = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    numbered = both.withColumn("position", metadata.sibling_number("l_returnflag", "o_orderkey"))
    own = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    return numbered.select(
        F.col("o_orderkey").alias("source_item_id"), "kind", F.col("l_returnflag").alias("entry"), "position",
        mint_id("o_orderkey", "kind", "position", "l_returnflag").alias("item_id"), label_or(own, "o_orderpriority").alias("label"),
    )


@query("""
WITH k AS (SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN lang = 'en' AND n_chars < 2000 THEN 'page' WHEN lang = 'en' THEN 'book' END AS kind FROM documents)
SELECT source AS source_item_id, CASE WHEN count(kind) = 0 THEN 'unmatched' WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM k GROUP BY source""")
def detect_kind(spark, sf_dir):
    n = F.col("n_chars")
    rules = [("short", n < 200), ("page", (F.col("lang") == "en") & (n < 2000)), ("book", F.col("lang") == "en")]
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("source_item_id"), selection.first_match(rules).alias("kind"))
    return selection.source_kind(items)


def _folds():
    return {"points": F.count(F.lit(1)), "max_price": F.max(F.abs("l_extendedprice")), "sum_qty": F.sum("l_quantity"), "avg_qty": F.round(F.avg("l_quantity"), 4)}


@query("""
SELECT l_orderkey, l_returnflag, count(*)::BIGINT AS points, max(abs(l_extendedprice)) AS max_price, sum(l_quantity) AS sum_qty, round(avg(l_quantity), 4) AS avg_qty
FROM lineitem GROUP BY ALL""")
def item_analyze(spark, sf_dir):
    return analysis.analyze_items(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], _folds())


def _members(spark, sf_dir):
    orders = order_paths(spark, sf_dir).select("o_orderkey", "o_totalprice", _kind().alias("kind"), "path")
    return orders.withColumn("collection_id", F.element_at(hierarchy.id_path("path"), -1))


@query(f"""
SELECT i3 AS collection_id, {KIND_SQL} AS kind, count(*)::BIGINT AS members, max(o_totalprice) AS peak, round(sum(o_totalprice), 2) AS total
FROM orders JOIN ({IDS}) ON o_custkey = c_custkey GROUP BY ALL""")
def collection_analyze(spark, sf_dir):
    folds = {"members": F.count(F.lit(1)), "peak": F.max("o_totalprice"), "total": F.round(F.sum("o_totalprice"), 2)}
    return analysis.analyze_collections(_members(spark, sf_dir), folds)


@query(f"""
WITH g AS (SELECT i3, {KIND_SQL} AS kind, count(*) AS members, min(o_orderkey) AS seen FROM orders JOIN ({IDS}) ON o_custkey = c_custkey GROUP BY ALL)
SELECT i3 AS collection_id, max_by(members, seen)::BIGINT AS members, max_by(kind, seen) AS kind FROM g GROUP BY i3""")
def collection_merge(spark, sf_dir):
    folds = {"members": F.count(F.lit(1)), "seen": F.min("o_orderkey")}
    groups = analysis.analyze_collections(_members(spark, sf_dir), folds).withColumn("last_kind", F.col("kind"))
    merged = analysis.merge_kinds(groups, "seen", ["members", "last_kind"])
    return merged.withColumnRenamed("last_kind", "kind")


@query(f"""
SELECT o_orderkey, (count(*) OVER w)::BIGINT AS members, round(CASE WHEN max(o_totalprice) OVER w = 0 THEN 0 ELSE o_totalprice / max(o_totalprice) OVER w END, 6) AS share
FROM (SELECT o_orderkey, o_totalprice, i3, {KIND_SQL} AS kind FROM orders JOIN ({IDS}) ON o_custkey = c_custkey)
WINDOW w AS (PARTITION BY i3, kind)""")
def collection_process(spark, sf_dir):
    folds = {"n": F.count(F.lit(1)), "largest": F.max("o_totalprice")}
    columns = {"members": F.col("n"), "share": F.round(ratio_or_zero("o_totalprice", F.col("largest")), 6)}
    return analysis.process_members(_members(spark, sf_dir), columns, folds=folds).select("o_orderkey", "members", "share")


@query(f"SELECT collection_id, parent_id, depth, label, key FROM ({NODES})")
def collection_nodes(spark, sf_dir):
    return tree(spark, sf_dir).select("collection_id", "parent_id", "depth", "label", F.concat_ws("/", "path").alias("key"))


@query(f"SELECT c_custkey, i3 AS collection_id, i1 || '>' || i2 || '>' || i3 AS id_path, a || '_' || b || '_' || c AS location FROM ({IDS})")
def collection_ids(spark, sf_dir):
    paths = customer_paths(spark, sf_dir).withColumn("ids", hierarchy.id_path("path"))
    return paths.select("c_custkey", F.element_at("ids", -1).alias("collection_id"), F.concat_ws(">", "ids").alias("id_path"), F.concat_ws("_", "path").alias("location"))


@query(f"SELECT up AS collection_id, count(*)::BIGINT AS leaves FROM ({UPS}) JOIN ({NODES}) n USING (collection_id) WHERE n.depth = 3 GROUP BY up")
def leaf_counts(spark, sf_dir):
    return hierarchy.leaf_counts(tree(spark, sf_dir))


def _layers(spark, sf_dir):
    """Layers of each order: region and nation names inherited, order columns at the source, folds of its lines as analysis."""
    orders = order_paths(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("points"), F.max("l_quantity").cast("int").alias("max_qty"))
    key = F.col("o_orderkey")
    above = metadata.layer(orders, key, metadata.INHERITED, {"region": F.col("path")[0], "nation": F.col("path")[1], "priority": F.lit("none")})
    source = metadata.layer(orders, key, metadata.SOURCE, {"priority": "o_orderpriority", "status": "o_orderstatus"})
    found = metadata.layer(lines, "l_orderkey", metadata.ANALYSIS, {"points": "points", "max_qty": "max_qty", "status": F.when(F.col("points") > 5, F.lit("big"))})
    return above.unionByName(source).unionByName(found)


LAYERS = f"""
  SELECT o_orderkey AS entity_id, 0 AS layer, unnest(['region', 'nation', 'priority']) AS name, unnest([a, b, 'none']) AS value FROM orders JOIN ({PATHS}) ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 1, unnest(['priority', 'status']), unnest([o_orderpriority, o_orderstatus]) FROM orders JOIN ({PATHS}) ON o_custkey = c_custkey
  UNION ALL SELECT l_orderkey, 4, unnest(['points', 'max_qty', 'status']), unnest([count(*)::VARCHAR, max(l_quantity)::INTEGER::VARCHAR, CASE WHEN count(*) > 5 THEN 'big' END]) FROM lineitem GROUP BY l_orderkey
"""
EFFECTIVE = f"SELECT entity_id, name, max_by(value, layer) AS value FROM ({LAYERS}) WHERE value IS NOT NULL GROUP BY entity_id, name"


@query(EFFECTIVE)
def effective_metadata(spark, sf_dir):
    return metadata.fold(_layers(spark, sf_dir))


@query(f"""
WITH own AS (SELECT u1 AS collection_id, 'area' AS name, label AS value FROM ({NODES}) WHERE depth = 1
  UNION ALL SELECT collection_id, 'area', label FROM ({NODES}) WHERE depth = 2 AND length(label) % 2 = 0
  UNION ALL SELECT collection_id, 'segment', label FROM ({NODES}) WHERE depth = 3)
SELECT up.collection_id AS entity_id, name, max_by(value, n.depth) AS value
FROM ({UPS}) up JOIN own ON up.up = own.collection_id JOIN (SELECT collection_id, depth FROM ({NODES})) n ON n.collection_id = up.up GROUP BY 1, 2""")
def inherited_metadata(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    area = nodes.where("depth = 1 OR (depth = 2 AND length(label) % 2 = 0)").select("collection_id", F.lit("area").alias("name"), F.col("label").alias("value"))
    own = area.unionByName(nodes.where("depth = 3").select("collection_id", F.lit("segment").alias("name"), F.col("label").alias("value")))
    return metadata.inherited(nodes, own)


@query(f"""
WITH own AS (SELECT u1 AS collection_id, 'area' AS name, label AS value FROM ({NODES}) WHERE depth = 1 UNION ALL SELECT collection_id, 'segment', label FROM ({NODES}) WHERE depth = 3),
a AS (SELECT i3 AS id, count(*) AS n FROM ({IDS}) GROUP BY 1),
l AS (SELECT up.collection_id AS id, name, value, 0 AS layer FROM ({UPS}) up JOIN own ON up.up = own.collection_id
  UNION ALL SELECT id, 'customers', n::VARCHAR, 4 FROM a UNION ALL SELECT id, 'area', 'many', 4 FROM a WHERE n > 1)
SELECT id AS entity_id, name, max_by(value, layer) AS value FROM l GROUP BY 1, 2""")
def collection_display(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    own = nodes.where("depth IN (1, 3)").select("collection_id", F.when(F.col("depth") == 1, "area").otherwise("segment").alias("name"), F.col("label").alias("value"))
    counts = customer_paths(spark, sf_dir).groupBy(F.element_at(hierarchy.id_path("path"), -1).alias("collection_id")).agg(F.count(F.lit(1)).alias("n"))
    found = metadata.layer(counts, "collection_id", metadata.ANALYSIS, {"customers": "n", "area": F.when(F.col("n") > 1, F.lit("many"))})
    return metadata.display(nodes, own, found.withColumnRenamed("entity_id", "collection_id"))


@query(f"""
WITH known AS (SELECT collection_id FROM ({NODES}) WHERE length(label) % 5 > 0)
SELECT n.collection_id, CASE WHEN n.collection_id IN (SELECT collection_id FROM ({UPS}) GROUP BY 1 HAVING count(*) FILTER (up NOT IN (SELECT * FROM known)) = 0) THEN n.key ELSE '@collection/' || n.collection_id END AS key FROM ({NODES}) n""")
def annotation_keys(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    return hierarchy.annotation_keys(nodes, nodes.where("length(label) % 5 > 0")).select("collection_id", "key")


CANONICAL = "SELECT n_nationkey, t, t || '=' || length(v) || ':' || v AS x FROM (SELECT n_nationkey, unnest(['int', 'string', 'double']) AS t, unnest([n_regionkey::VARCHAR, n_regionkey::VARCHAR, n_regionkey || '.0']) AS v FROM nation)"


@query(f"""
WITH c AS (SELECT *, 'string=' || length(n_name) || ':' || n_name AS y FROM ({CANONICAL}) JOIN nation USING (n_nationkey)), d AS (SELECT *, sha256('/' || length(x) || ':' || x) AS i1 FROM c)
SELECT n_nationkey, t AS vtype, i1 AS parent_id, sha256(i1 || '/' || length(y) || ':' || y) AS collection_id FROM d
UNION ALL SELECT n_nationkey, 'none', sha256('/7:string~'), sha256(sha256('/7:string~') || '/' || (length(n_name) + 7 + length(length(n_name)::VARCHAR) + 1) || ':string=' || length(n_name) || ':' || n_name) FROM nation""")
def canonical_ids(spark, sf_dir):
    """Levels whose values are the same text but of different types, or null, are different nodes."""
    nation, level = table(spark, sf_dir, "nation"), F.col("n_regionkey")
    levels = {"int": level.cast("int"), "string": level.cast("string"), "double": level.cast("double"), "none": F.lit(None).cast("string")}
    paths = F.explode(F.array(*(F.struct(F.lit(t).alias("vtype"), hierarchy.canonical_path(v, "n_name").alias("path")) for t, v in levels.items()))).alias("p")
    ids = nation.select("n_nationkey", paths).select("n_nationkey", "p.vtype", hierarchy.id_path("p.path").alias("ids"))
    return ids.select("n_nationkey", "vtype", F.col("ids")[0].alias("parent_id"), F.col("ids")[1].alias("collection_id"))


@query(f"""
WITH m AS (SELECT c_custkey, map_from_entries([('x', a), ('y', a)]) AS m1, map_from_entries([('y', b)]) AS m2 FROM ({PATHS}))
SELECT c_custkey, m1['x'] AS x, m2['y'] AS y FROM m""")
def folded_maps(spark, sf_dir):
    p = F.col("path")
    maps = F.array(F.create_map(F.lit("x"), p[0], F.lit("y"), p[0]), F.create_map(F.lit("y"), p[1]))
    folded = customer_paths(spark, sf_dir).select("c_custkey", metadata.fold_maps(maps).alias("m"))
    return folded.select("c_custkey", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y"))


WIDE = {"region": "string", "nation": "string", "priority": "string", "status": "string", "points": "bigint", "max_qty": "int"}


def _wide(spark, sf_dir):
    return metadata.wide(metadata.fold(_layers(spark, sf_dir)), WIDE)


@query(f"""
SELECT entity_id, max(value) FILTER (name = 'region') AS region, max(value) FILTER (name = 'nation') AS nation, max(value) FILTER (name = 'priority') AS priority,
       max(value) FILTER (name = 'status') AS status, max(value) FILTER (name = 'points')::BIGINT AS points, max(value) FILTER (name = 'max_qty')::INTEGER AS max_qty
FROM ({EFFECTIVE}) GROUP BY entity_id""")
def delivered_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


ITEMS = "SELECT DISTINCT l_orderkey AS source_item_id, l_returnflag AS entry, l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem"


def _view(spark, sf_dir):
    """Items with metadata: of the order, of its collection, and from their own lines."""
    orders = order_paths(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("path")[0].alias("region"), F.col("path")[2].alias("segment"))
    lines = table(spark, sf_dir, "lineitem")
    items = lines.groupBy(F.col("l_orderkey").alias("source_item_id"), F.col("l_returnflag").alias("entry")).agg(
        F.count(F.lit(1)).alias("points"), F.max("l_extendedprice").alias("max_price"), F.sum("l_quantity").alias("sum_qty")
    )
    items = items.withColumn("item_id", mint_id("source_item_id", F.lit("lines"), F.lit(1), "entry"))
    return items.join(orders, items.source_item_id == orders.o_orderkey).drop("o_orderkey")


@query("""
SELECT l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' GROUP BY l_orderkey, l_returnflag HAVING max(l_extendedprice) >= 50000""")
def query_items(spark, sf_dir):
    return selection.query_items(_view(spark, sf_dir), "max_price >= 50000 AND status = 'F'")


@query(f"SELECT item_id FROM ({ITEMS})")
def query_ids_sorted(spark, sf_dir):
    return selection.query_items(order_items(spark, sf_dir))


@query("""
SELECT i.item_id, i.entry, o_orderpriority AS entry_1 FROM (SELECT DISTINCT l_orderkey AS source_item_id, l_returnflag AS entry, l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem) i
LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) ON i.source_item_id = o_orderkey""")
def query_view_clash(spark, sf_dir):
    items = order_items(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select("o_orderkey", "o_orderpriority")
    own = items.join(orders, items.source_item_id == orders.o_orderkey).select(F.col("item_id").alias("entity_id"), F.col("o_orderpriority").alias("entry"))
    return metadata.query_view(items, own).select("item_id", "entry", "entry_1")


TYPED = "SELECT event_id AS position, 'v_' || (user_id % 50) AS name, CASE WHEN event_type < 'd' THEN 'Int64' ELSE 'String' END AS vtype FROM events"
FIRST = f"SELECT name, min_by(vtype, position) AS expected FROM ({TYPED}) GROUP BY name"


def _typed_events(spark, sf_dir):
    vtype = F.when(F.col("event_type") < "d", "Int64").otherwise("String")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.concat(F.lit("v_"), (F.col("user_id") % 50).cast("string")).alias("name"), vtype.alias("vtype"))


@query(f"SELECT v.position, v.name, vtype, expected FROM ({TYPED}) v JOIN ({FIRST}) f ON v.name = f.name WHERE vtype <> expected")
def metadata_conflicts(spark, sf_dir):
    values = _typed_events(spark, sf_dir)
    return metadata.type_conflicts(values, metadata.register_types(values)).select("position", "name", "vtype", "expected")


@query(f"SELECT DISTINCT name FROM ({LAYERS}) UNION SELECT DISTINCT name FROM ({TYPED})")
def metadata_keys(spark, sf_dir):
    return metadata.names(_layers(spark, sf_dir), _typed_events(spark, sf_dir))


PARAMS = """
  SELECT r_name AS fragment, 'scale' AS name, r_name || '!' AS value FROM region
  UNION ALL SELECT n_name, 'scale', n_name || '?' FROM nation
  UNION ALL SELECT r_name || '/' || n_name, 'gain', n_name || '+' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
  UNION ALL SELECT r_name || '/' || n_name, 'scale', n_name || '-' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0
"""


def _params(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    row = lambda df, fragment, name, value: df.select(fragment.alias("fragment"), F.lit(name).alias("name"), value.alias("value"))
    pair = F.concat_ws("/", "r_name", "n_name")
    return (
        row(region, F.col("r_name"), "scale", F.concat("r_name", F.lit("!")))
        .unionByName(row(nation, F.col("n_name"), "scale", F.concat("n_name", F.lit("?"))))
        .unionByName(row(both.where("n_nationkey % 2 = 0"), pair, "gain", F.concat("n_name", F.lit("+"))))
        .unionByName(row(both.where("n_nationkey % 3 = 0"), pair, "scale", F.concat("n_name", F.lit("-"))))
    )


@query(f"""
WITH e AS (SELECT key, unnest(range(1, depth + 1)) AS width, string_split(key, '/') AS p FROM ({NODES}))
SELECT key, name, max_by(value, width) AS value FROM e JOIN ({PARAMS}) ON array_to_string(p[len(p) - width + 1:len(p)], '/') = fragment GROUP BY key, name""")
def param_suffix_match(spark, sf_dir):
    return metadata.by_suffix(tree(spark, sf_dir), _params(spark, sf_dir)).select(F.concat_ws("/", "path").alias("key"), "name", "value")


@query(f"""
WITH e AS (SELECT key, unnest(range(1, depth + 1)) AS width, string_split(key, '/') AS p FROM ({NODES})),
s AS (SELECT key, width, unnest(range(1, (len(p) - width + 2)::BIGINT)) AS start, p FROM e)
SELECT key, name, max_by(value, width * 1000 + start) AS value FROM s JOIN ({PARAMS}) ON array_to_string(p[start:start + width - 1], '/') = fragment GROUP BY key, name""")
def param_fragment_match(spark, sf_dir):
    return metadata.by_fragment(tree(spark, sf_dir), _params(spark, sf_dir)).select(F.concat_ws("/", "path").alias("key"), "name", "value")


CELLS = """
  SELECT event_id, CASE event_id % 9 WHEN 8 THEN ['NaN', 'Inf', '-inf', 'infinit'][user_id % 4 + 1] WHEN 0 THEN ' ' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'f' END WHEN 2 THEN ' ' || user_id || ' ' WHEN 3 THEN '-' || user_id || '.25'
    WHEN 4 THEN strftime(ts, '%Y-%m-%d') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 6 THEN event_type || ' x' ELSE user_id || 'd' END AS cell FROM events
"""


@query(f"""
WITH c AS (SELECT event_id, trim(cell) AS x FROM ({CELLS}))
SELECT event_id, CASE WHEN x = '' THEN NULL WHEN lower(x) IN ('true', 't', 'yes', 'y', 'false', 'f', 'no', 'n') THEN 'Bool' WHEN regexp_full_match(x, '[+-]?\\d+') THEN 'Int64'
    WHEN regexp_full_match(x, '[+-]?\\d+\\.\\d+') OR lower(x) IN ('nan', 'inf', '-inf') THEN 'Float64' WHEN regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'Date'
    WHEN regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}T.*') THEN 'DateTime' ELSE 'String' END AS vtype,
  CASE WHEN x = '' THEN NULL WHEN lower(x) IN ('true', 't', 'yes', 'y') THEN 'true' WHEN lower(x) IN ('false', 'f', 'no', 'n') THEN 'false'
    WHEN regexp_full_match(x, '[+-]?\\d+\\.\\d+') THEN x || '00' WHEN x = 'Inf' THEN 'Infinity' WHEN x = '-inf' THEN '-Infinity' WHEN regexp_full_match(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}T.*') THEN replace(x, 'T', ' ') ELSE x END AS shown FROM c""")
def typed_cells(spark, sf_dir):
    user, ts = F.col("user_id").cast("string"), F.col("ts")
    cells = [F.lit(" "), F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("f"), F.concat(F.lit(" "), user, F.lit(" ")), F.concat(F.lit("-"), user, F.lit(".25")), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.concat("event_type", F.lit(" x")), F.concat(user, F.lit("d")), F.element_at(F.array(*map(F.lit, ("NaN", "Inf", "-inf", "infinit"))), (F.col("user_id") % 4 + 1).cast("int"))]
    cell = F.element_at(F.array(*cells), ((F.col("event_id") % 9) + 1).cast("int"))
    typed = table(spark, sf_dir, "events").select("event_id", typed_cell(cell).alias("v"))
    return typed.select("event_id", F.col("v.vtype").alias("vtype"), show_typed("v").alias("shown"))


@query(f"""
WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id || '.5' ELSE event_type END AS cell, event_id % 3 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN cell::BIGINT END AS i, CASE k WHEN 1 THEN cell::DOUBLE END AS d, CASE k WHEN 2 THEN cell END AS s FROM t""")
def typed_roundtrip(spark, sf_dir):
    cell = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.col("user_id").cast("string"), F.lit(".5"))).otherwise(F.col("event_type"))
    stored = table(spark, sf_dir, "events").select("event_id", typed_cell(cell).alias("v"))
    return stored.select("event_id", "v.i", "v.d", "v.s")


@query("""
WITH n AS (SELECT DISTINCT p_brand AS label FROM part UNION SELECT DISTINCT source FROM documents UNION SELECT n_name FROM nation),
k AS (SELECT label, list_transform(regexp_extract_all(label, '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN {'k': 1, 'n': x::HUGEINT, 's': ''} ELSE {'k': 0, 'n': 0::HUGEINT, 's': lower(x)} END) AS key FROM n)
SELECT label, row_number() OVER (ORDER BY key, label)::INTEGER AS rank FROM k""")
def natural_sort(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")).union(table(spark, sf_dir, "documents").select("source")).union(table(spark, sf_dir, "nation").select("n_name")).distinct()
    ranks = tables.ranked(labels.withColumn("key", natural_key("label")), "key", "label", name="rank")
    return ranks.select("label", F.col("rank").cast("int").alias("rank"))


ROMAN_LABEL = "CASE WHEN n_regionkey = 4 THEN 'run-' || n_nationkey ELSE repeat('X', n_nationkey // 10) || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n_nationkey % 10 + 1] || CASE WHEN n_nationkey % 10 = 0 THEN 'X' ELSE '' END END"


@query(f"""
SELECT n_regionkey, {ROMAN_LABEL} AS label, CASE WHEN n_regionkey < 4 THEN (n_nationkey + CASE WHEN n_nationkey % 10 = 0 THEN 10 ELSE 0 END)::INTEGER END AS value,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey + CASE WHEN n_regionkey < 4 AND n_nationkey % 10 = 0 THEN 10 ELSE 0 END, n_nationkey)::INTEGER AS position
FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey""")
def roman_sort(spark, sf_dir):
    digits = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    n = F.col("n_nationkey")
    one = F.element_at(F.array(*(F.lit(d) for d in digits)), (n % 10 + 1).cast("int"))
    roman = F.concat(F.expr("repeat('X', n_nationkey div 10)"), one, F.when(n % 10 == 0, "X").otherwise(""))
    label = F.when(F.col("n_regionkey") == 4, F.concat(F.lit("run-"), n.cast("string"))).otherwise(roman)
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    nodes = table(spark, sf_dir, "nation").join(used, "n_nationkey", "left_semi").select("n_regionkey", label.alias("label"))
    return hierarchy.sibling_order(nodes, "n_regionkey").select("n_regionkey", "label", roman_value("label").alias("value"), "position")
