"""Filters, selections, annotations and payload tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import mean, normalized, scaled
from ..functions.names import base_name, cell_text, collection_of, file_time, hex_color, mint_id, name_fields, parts, rgb, split_row
from ..operators import annotations, hierarchy, selection, tables
from ..sources.directory import as_source, source_items
from ._tables import NODES, PATHS, UPS, customer_paths, order_items, table, tree

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY t ASC NULLS LAST, event_id))::INTEGER AS rank
FROM (SELECT event_id, user_id, CASE WHEN event_id % 7 > 0 THEN ts END AS t FROM events) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def items_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").alias("collection_id"), F.when(F.col("event_id") % 7 > 0, F.col("ts")).alias("ts"))
    chosen = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("collection_id"))
    ordered = selection.items_of(events, chosen)
    rank = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.col("ts").asc_nulls_last(), "item_id"))
    return ordered.select(F.col("item_id").alias("event_id"), rank.alias("rank"))


@query("""
SELECT p_partkey FROM part WHERE (lower(p_name || chr(10) || p_brand || chr(10) || p_type) LIKE '%1%' OR lower(p_name || chr(10) || p_brand || chr(10) || p_type) LIKE '%brand#2%')
AND NOT lower(p_name || chr(10) || p_brand || chr(10) || p_type) LIKE '%9%'""")
def text_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(selection.text_filter("1, Brand#2, -9", "p_name", "p_brand", "p_type")).select("p_partkey")


MATCH = "(lower(label) LIKE '%1%' OR lower(label) LIKE '%auto%')"


@query(f"""
WITH hit AS (SELECT collection_id FROM ({NODES}) WHERE {MATCH}),
keep AS (SELECT up AS collection_id FROM ({UPS}) WHERE collection_id IN (SELECT * FROM hit) UNION SELECT collection_id FROM ({UPS}) WHERE up IN (SELECT * FROM hit))
SELECT collection_id, key FROM ({NODES}) WHERE collection_id IN (SELECT collection_id FROM keep)""")
def tree_filter(spark, sf_dir):
    shown = hierarchy.visible(tree(spark, sf_dir), selection.text_filter("1,auto", "label"))
    return shown.select("collection_id", F.concat_ws("/", "path").alias("key"))


ASSIGN = f"""
  SELECT key, unnest(CASE WHEN depth = 1 AND length(key) % 2 = 0 THEN ['area', 'bad'] WHEN depth = 2 AND ascii(right(key, 1)) % 3 = 0 THEN ['bad', 'hot'] WHEN depth = 3 AND length(key) % 3 = 0 THEN ['hot', 'odd'] ELSE [] END) AS tag
  FROM ({NODES})
"""
KEYS = f"SELECT n.key, a.key AS k FROM ({UPS}) u JOIN ({NODES}) n ON u.collection_id = n.collection_id JOIN ({NODES}) a ON u.up = a.collection_id"


def _keyed(spark, sf_dir):
    return tree(spark, sf_dir).select(F.concat_ws("/", "path").alias("key"), hierarchy.ancestor_keys("path").alias("ancestors"), "depth", "collection_id")


def _assignments(nodes):
    tags = (
        F.when((F.col("depth") == 1) & (F.length("key") % 2 == 0), F.array(F.lit("area"), F.lit("bad")))
        .when((F.col("depth") == 2) & (F.ascii(F.right("key", F.lit(1))) % 3 == 0), F.array(F.lit("bad"), F.lit("hot")))
        .when((F.col("depth") == 3) & (F.length("key") % 3 == 0), F.array(F.lit("hot"), F.lit("odd")))
    )
    return nodes.select("key", F.explode(tags).alias("tag"))


@query(f"SELECT key FROM ({NODES}) WHERE key NOT IN (SELECT k.key FROM ({KEYS}) k JOIN ({ASSIGN}) a ON k.k = a.key WHERE tag = 'bad')")
def bad_tag_visibility(spark, sf_dir):
    nodes = _keyed(spark, sf_dir)
    return selection.without_tag(nodes, _assignments(nodes), "bad").select("key")


@query(f"SELECT DISTINCT k.key, tag FROM ({KEYS}) k JOIN ({ASSIGN}) a ON k.k = a.key")
def effective_tags(spark, sf_dir):
    nodes = _keyed(spark, sf_dir)
    return annotations.effective_tags(nodes, _assignments(nodes))


@query(f"""
WITH c AS (SELECT * FROM (VALUES ('area', '#102030', 1, 1), ('hot', '#ff0000', 5, 2), ('odd', '#00ff7f', 5, 3)) t(tag, color, priority, position))
SELECT key, max_by(color, priority * 100 - position) AS color, ('0x' || substr(max_by(color, priority * 100 - position), 2, 2))::INTEGER AS red
FROM (SELECT DISTINCT k.key, tag FROM ({KEYS}) k JOIN ({ASSIGN}) a ON k.k = a.key) JOIN c USING (tag) GROUP BY key""")
def dominant_color(spark, sf_dir):
    nodes = _keyed(spark, sf_dir)
    rows = [("area", "#102030", 1, 1), ("hot", "#ff0000", 5, 2), ("odd", "#00ff7f", 5, 3)]
    catalog = spark.createDataFrame(rows, "name string, color string, priority int, position int")
    colors = annotations.dominant_colors(annotations.effective_tags(nodes, _assignments(nodes)), catalog).withColumn("rgb", rgb("color"))
    return colors.select("key", hex_color("rgb.red", "rgb.green", "rgb.blue").alias("color"), F.col("rgb.red").alias("red"))


@query(f"""
WITH marked AS (SELECT key, tag FROM ({ASSIGN}) UNION SELECT key, 'bad' FROM ({NODES}) WHERE depth = 3 AND length(key) % 5 = 0)
SELECT key, tag FROM marked WHERE NOT (tag = 'hot' AND key IN (SELECT key FROM ({NODES}) WHERE depth = 2))""")
def mark_tags(spark, sf_dir):
    nodes = _keyed(spark, sf_dir)
    marked = annotations.mark(_assignments(nodes), nodes.where("depth = 3 AND length(key) % 5 = 0"), "bad")
    return annotations.unmark(marked, nodes.where("depth = 2"), "hot")


NOTES = f"SELECT key, 'note on ' || key AS body FROM ({NODES}) WHERE length(key) % 2 = 0"


@query(f"""
SELECT k.key, len(string_split(k.k, '/'))::INTEGER - 1 AS depth, k.k AS note_key, coalesce(body, '') AS body, k.key = k.k AS editable
FROM ({KEYS}) k LEFT JOIN ({NOTES}) n ON k.k = n.key WHERE body IS NOT NULL OR k.key = k.k""")
def notes_view(spark, sf_dir):
    nodes = _keyed(spark, sf_dir)
    notes = nodes.where(F.length("key") % 2 == 0).select("key", F.concat(F.lit("note on "), "key").alias("body"))
    return annotations.notes_view(nodes, notes)


@query(f"""
WITH p AS (SELECT i3.collection_id, min(c_acctbal) AS x, count(*)::DOUBLE AS y FROM customer JOIN ({PATHS}) q USING (c_custkey) JOIN ({NODES}) i3 ON i3.key = a || '/' || b || '/' || c GROUP BY 1)
SELECT up AS collection_id, min(x) AS x0, min(y) AS y0, CASE WHEN d.depth = 1 THEN min(x) + 10 ELSE max(x) END AS x1, CASE WHEN d.depth = 1 THEN min(y) + 20 ELSE max(y) END AS y1
FROM p JOIN ({UPS}) u USING (collection_id) JOIN (SELECT collection_id AS up, depth FROM ({NODES})) d USING (up) GROUP BY up, d.depth""")
def bounding_box(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    paths = customer_paths(spark, sf_dir).withColumn("collection_id", F.element_at(hierarchy.id_path("path"), -1))
    placed = table(spark, sf_dir, "customer").join(paths, "c_custkey").groupBy("collection_id").agg(F.min("c_acctbal").alias("x"), F.count(F.lit(1)).cast("double").alias("y"))
    sizes = nodes.where("depth = 1").select("collection_id", F.lit(10.0).alias("w"), F.lit(20.0).alias("h"))
    return annotations.bounding_boxes(nodes, placed, sizes)


@query("""
WITH m AS (SELECT c_custkey AS entity_id, c_acctbal AS x, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_nationkey::VARCHAR ELSE c_name END AS y FROM customer)
SELECT entity_id, x, y::DOUBLE AS y FROM m WHERE entity_id % 3 = 1""")
def positions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    y = F.when(F.col("c_custkey") % 3 == 1, F.col("c_nationkey").cast("string")).when(F.col("c_custkey") % 3 == 2, F.col("c_name"))
    long = customer.select(F.col("c_custkey").alias("entity_id"), F.explode(F.array(F.struct(F.lit("x_um").alias("name"), F.col("c_acctbal").cast("string").alias("value")), F.struct(F.lit("y_um").alias("name"), y.alias("value")))).alias("p"))
    return annotations.positions(long.select("entity_id", "p.name", "p.value"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, ceil(sqrt(count(*) OVER (PARTITION BY c_nationkey)))::BIGINT AS w FROM customer)
SELECT c_custkey, ((pos % w) * 200 + 5)::DOUBLE AS x, ((pos // w) * 200 + 7)::DOUBLE AS y FROM r""")
def grid_layout(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return annotations.grid(nodes, "c_custkey", 200.0, (5.0, 7.0), None, "c_nationkey").select("c_custkey", "x", "y")


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) % ceil(sqrt(count(*) OVER ()))::BIGINT * 200)::DOUBLE AS x, ((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) // ceil(sqrt(count(*) OVER ()))::BIGINT * 200)::DOUBLE AS y FROM customer")
def grid_of_all(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_acctbal", "c_custkey").alias("key"))
    return annotations.grid(nodes, "key").select("c_custkey", "x", "y")


@query("""
SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment, 'supplier' AS _item_ FROM supplier
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment, 'customer' FROM customer""")
def merge_tables(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tables.merge([("supplier", supplier), ("customer", customer)])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no table: ' || o_orderkey END AS warning FROM orders""")
def merge_skips(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    kept, warned = tables.skip_untabular(members, members.where("item_id % 4 > 0"))
    both = kept.select("item_id", F.lit(None).cast("string").alias("warning")).unionByName(warned)
    return both.withColumnRenamed("item_id", "o_orderkey")


@query("""
SELECT l_extendedprice AS x, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE l_tax END::DOUBLE AS y FROM lineitem WHERE l_linenumber <> 3 AND l_linenumber <> 2""")
def plot_pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    y = F.when(F.col("l_linenumber") == 2, F.lit(None)).when(F.col("l_returnflag") == "A", F.lit(1.0)).otherwise(F.col("l_tax"))
    return selection.plot_pairs(lines.select(x.alias("x"), y.alias("y")), "x", "y")


@query("SELECT l_quantity AS x, l_discount AS y FROM lineitem WHERE l_returnflag = 'R'")
def plot_data(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("item_id", F.concat(F.col("l_orderkey").cast("string"), F.lit("#lines:"), "l_returnflag"))
    items = lines.where("l_returnflag = 'R'").select("item_id", F.lit("lines").alias("kind"))
    return selection.plot_data({"lines": lines}, items, "l_quantity", "l_discount")


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN substr(text, 1, 87) || '...' ELSE text END AS cell FROM documents")
def shown_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cell_text("text").alias("cell"))


ITEMS = "SELECT DISTINCT l_orderkey AS source_item_id, l_returnflag AS entry, l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem"


@query(f"""
SELECT item_id, n.key AS location, u1 || '>' || u2 || '>' || u3 AS expand FROM ({ITEMS}) i JOIN orders ON source_item_id = o_orderkey JOIN ({PATHS}) ON o_custkey = c_custkey
JOIN ({NODES}) n ON n.key = a || '/' || b || '/' || c WHERE source_item_id = (SELECT max(o_orderkey) FROM orders)""")
def select_source_item(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    placed = orders.join(customer_paths(spark, sf_dir), orders.o_custkey == F.col("c_custkey")).select("o_orderkey", F.concat_ws("/", "path").alias("location"), F.element_at(hierarchy.id_path("path"), -1).alias("collection_id"))
    items = order_items(spark, sf_dir).join(placed, F.col("source_item_id") == F.col("o_orderkey"))
    chosen = selection.of_source(items, last.first()["last"], tree(spark, sf_dir))
    return chosen.select("item_id", "location", F.concat_ws(">", "expand").alias("expand"))


@query("""
WITH r AS (SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders)
SELECT pos::INTEGER AS pos, item_id, l_linenumber, l_quantity FROM r JOIN lineitem ON item_id = l_orderkey WHERE pos <= 50""")
def materialize(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)  # a top-50 request is the feature
    pos = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    requests = asked.select(pos.alias("pos"), F.col("o_orderkey").alias("item_id"))
    payload = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("__row"), "l_linenumber", "l_quantity")
    return tables.read_in_order(payload, requests).select("pos", "item_id", "l_linenumber", "l_quantity")


@query("""
SELECT item_id, known FROM (SELECT event_id AS item_id, event_id IN (SELECT event_id FROM events WHERE event_id % 10 <> 1) AS known FROM events WHERE event_id % 10 < 3)""")
def validated_selection(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"))
    found, missing = selection.select_existing(events.where("item_id % 10 <> 1"), events.where("item_id % 10 < 3"))
    return found.select("item_id", F.lit(True).alias("known")).unionByName(missing.select("item_id", F.lit(False).alias("known")))


@query("""
SELECT l_orderkey AS item_id, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity * 2 ELSE l_quantity END AS value FROM lineitem""")
def stage_choice(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_linenumber", F.col("l_quantity").alias("value"))
    collected = own.where("item_id % 3 = 0").withColumn("value", F.col("value") * 2)
    return selection.delivered(own, collected)


@query("SELECT lang, count(DISTINCT source)::BIGINT AS kinds, count(DISTINCT source) = 1 AS single FROM documents GROUP BY lang")
def single_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("kind"))
    return selection.single_kind(docs, "lang")


@query("""
SELECT l_orderkey, l_linenumber, total_rows, CASE WHEN total_rows > 3 THEN '3 of ' || total_rows || ' rows, the first ones' END AS warning FROM (
  SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS total_rows, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n <= 3""")
def first_n(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return tables.first_rows(lines, ["l_orderkey"], ["l_linenumber"], 3)


@query("""
SELECT shape, "column", rows, round(total, 2) AS total, round(total / rows, 4) AS mean FROM (
  SELECT 'lineitem' AS shape, 'l_quantity' AS "column", count(l_quantity)::BIGINT AS rows, sum(l_quantity) AS total FROM lineitem
  UNION ALL SELECT 'lineitem', 'l_tax', count(l_tax), sum(l_tax) FROM lineitem
  UNION ALL SELECT 'orders', 'o_totalprice', count(o_totalprice), sum(o_totalprice) FROM orders
  UNION ALL SELECT 'events', 'value', count(value), sum(value) FROM events)""")
def payload_agg(spark, sf_dir):
    columns = {"lineitem": ["l_quantity", "l_tax"], "orders": ["o_totalprice"], "events": ["value"]}
    sums = tables.payload_sums({n: table(spark, sf_dir, n) for n in columns}, columns)
    return sums.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("""
WITH u AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)
SELECT page_id, len(p)::INTEGER AS depth, p[2] AS host, p[-1] AS name FROM u""")
def path_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("p", parts("url"))
    return pages.select("page_id", F.size("p").alias("depth"), F.try_element_at("p", F.lit(2)).alias("host"), base_name("url").alias("name"))


@query("""
SELECT c_custkey, string_split(c_name, '#')[1] AS head, string_split(c_name, '#')[-1] AS tail, len(string_split(c_name, '#'))::INTEGER AS n,
  [x FOR x IN [c_mktsegment, c_nationkey::VARCHAR]][2] AS second FROM customer""")
def field_split(spark, sf_dir):
    f = name_fields("c_name", "#")
    row = split_row(F.concat_ws("\t", "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", f[0].alias("head"), F.element_at(f, -1).alias("tail"), F.size(f).alias("n"), row[1].alias("second"))


@query("""
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e)))), 6) AS total, round((e[1] - list_min(e)) / (list_max(e) - list_min(e)), 6) AS first FROM a""")
def array_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("n", normalized("embedding"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(total, 6).alias("total"), F.round(F.col("n")[0], 6).alias("first"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * (1 + label))) / len(embedding), 6) AS mean FROM embeddings")
def array_mean(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(mean(scaled("embedding", F.col("label") + 1)), 6).alias("mean"))


@query("""
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 4) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS taken FROM events""")
def filename_timestamp(spark, sf_dir):
    """Names with a dense time, a spaced one, digits that are no time, a dense time that ends the name (no time), both forms
    (the spaced one counts), and both with a spaced one that is no time (none)."""
    ts, name = F.col("ts"), F.col("event_type")
    other = F.lit("_19990101_010101_")
    spaced = F.concat(F.lit(" [w ; "), F.date_format(ts, "yyyy-MM-dd HH_mm_ss"), F.lit("].csv"))
    names = [
        F.concat(name, F.date_format(ts, "_yyyyMMdd_HHmmss_"), F.lit("x.csv")), F.concat(name, spaced), F.concat(name, F.lit("_20251399_999999_x.csv")),
        F.concat(name, F.date_format(ts, "_yyyyMMdd_HHmmss"), F.lit(".csv")), F.concat(name, other, spaced), F.concat(name, other, F.lit(" [w ; 2025-13-99 99_99_99].csv")),
    ]
    file = F.element_at(F.array(*names), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(file_time(file), "yyyy-MM-dd HH:mm:ss").alias("taken"))


CHOSEN = f"SELECT collection_id, key, u1, u2, u3 FROM ({NODES}) WHERE depth = 3 AND length(key) % 4 < 3"
BAD = f"SELECT key FROM ({ASSIGN}) WHERE tag = 'bad'"


@query(f"""
WITH s AS (SELECT collection_id, key FROM ({CHOSEN}) c WHERE NOT EXISTS (SELECT 1 FROM ({KEYS}) k JOIN ({BAD}) b ON k.k = b.key WHERE k.key = c.key)),
i AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE a || '/' || b || '/' || c END AS key FROM ({PATHS}))
SELECT 'collection' AS what, collection_id AS id FROM s
UNION ALL SELECT 'item', id FROM i WHERE (key IS NULL OR key IN (SELECT key FROM s)) AND id::BIGINT % 3 > 0 AND id::BIGINT % 7 > 0""")
def visible_selection(spark, sf_dir):
    """Leaves and items as stored, with ids that are gone: customers are items, every tenth at the root, some of them marked."""
    nodes = tree(spark, sf_dir)
    keyed = _keyed(spark, sf_dir)
    paths = customer_paths(spark, sf_dir)
    place = F.when(F.col("c_custkey") % 10 > 0, F.element_at(hierarchy.id_path("path"), -1))
    items = paths.select(F.col("c_custkey").cast("string").alias("item_id"), place.alias("collection_id"))
    marks = _assignments(keyed).unionByName(items.where("item_id % 7 = 0").select(F.col("item_id").alias("key"), F.lit("bad").alias("tag")))
    gone = spark.range(1).select(F.lit("gone").alias("collection_id")).union(spark.range(1).select(F.lit(None).cast("string")))
    leaves = nodes.where((F.col("depth") == 3) & (F.length(F.concat_ws("/", "path")) % 4 < 3)).select("collection_id").union(gone)
    wanted = items.where("item_id % 3 > 0").select("item_id").union(spark.range(1).select(F.lit("gone").alias("item_id")))
    shown, inside = selection.visible_selection(items, nodes, marks, leaves, wanted)
    one = shown.select(F.lit("collection").alias("what"), F.col("collection_id").alias("id"))
    return one.unionByName(inside.select(F.lit("item").alias("what"), F.col("item_id").alias("id")))


@query("SELECT doc_id, lang || '>' || source AS collection, '/data/' || lang || '/' || source || '/doc' || doc_id || '#text:1' AS item_id FROM documents")
def default_collection(spark, sf_dir):
    """Documents as files of a folder for each language and source."""
    path = F.concat_ws("/", F.lit("/data"), "lang", "source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    placed = F.concat_ws(">", collection_of("path", F.lit("/data")))
    return docs.select("doc_id", placed.alias("collection"), mint_id("path", F.lit("text"), F.lit(1), F.lit(None).cast("string")).alias("item_id"))


@query("""
WITH f AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS n, CASE o_orderkey % 6 WHEN 0 THEN '.hidden' WHEN 1 THEN 'Metadata.txt' WHEN 2 THEN '_part' WHEN 3 THEN 'tags.txt' WHEN 4 THEN 'run_20240102_030405_x.csv' ELSE 'settings.toml' END AS name FROM orders)
SELECT '/data/' || k || '/' || name AS source_item_id, name AS label, n AS length, CASE WHEN k % 6 = 4 THEN '2024-01-02 03:04:05' END AS taken FROM f WHERE k % 6 IN (2, 4)""")
def listed_sources(spark, sf_dir):
    """A listing of files, some of which are hidden, describe others, or are the project's own."""
    names = F.array(*(F.lit(n) for n in (".hidden", "Metadata.txt", "_part", "tags.txt", "run_20240102_030405_x.csv", "settings.toml")))
    name = F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders")
    files = orders.select(F.concat_ws("/", F.lit("/data"), F.col("o_orderkey").cast("string"), name).alias("path"), F.floor("o_totalprice").cast("bigint").alias("length"), F.lit("2024-05-05").cast("timestamp").alias("modificationTime"))
    found = as_source(source_items(files, "Settings.toml"))
    return found.select("source_item_id", "label", "fingerprint.length", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("taken"))
