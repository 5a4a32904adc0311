"""Change sets, logs of versions, invalidation, profiles, and files whose text is synthesized from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, hierarchy, metadata, profile, selection, tables
from ..session import shared_folder
from ..sources import annotation_files, delimited, parameters
from ._tables import IDS, NODES, UPS, customer_paths, order_items, order_paths, table, tree

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PREVIOUS = "SELECT o_orderkey AS id, o_totalprice::VARCHAR || o_orderstatus AS fp FROM orders WHERE o_orderkey % 7 > 0"
CURRENT = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END END AS fp FROM orders WHERE o_orderkey % 11 > 0"
DIFF = f"""
  SELECT coalesce(p.id, c.id) AS source_item_id, CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed' WHEN c.fp IS NULL OR c.fp IS DISTINCT FROM p.fp THEN 'changed' ELSE 'same' END AS change
  FROM ({PREVIOUS}) p FULL JOIN ({CURRENT}) c ON p.id = c.id
"""


def _snapshots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_item_id"), F.col("o_totalprice").cast("string").alias("p"), "o_orderstatus")
    key = F.col("source_item_id")
    old = orders.where(key % 7 > 0).select("source_item_id", F.concat("p", "o_orderstatus").alias("fingerprint"))
    status = F.when(key % 5 == 0, F.lit("x")).otherwise(F.col("o_orderstatus"))
    new = orders.where(key % 11 > 0).select("source_item_id", F.when(key % 31 != 0, F.concat("p", status)).alias("fingerprint"))
    return old, new


@query(DIFF)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*_snapshots(spark, sf_dir))


@query(f"""
SELECT count(*) FILTER (change <> 'removed')::BIGINT AS total, count(*) FILTER (change <> 'new')::BIGINT AS cached, count(*) FILTER (change = 'same')::BIGINT AS fresh,
  count(*) FILTER (change = 'changed')::BIGINT AS stale, count(*) FILTER (change = 'new')::BIGINT AS "new", count(*) FILTER (change = 'removed')::BIGINT AS deleted,
  (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0)::BIGINT AS error FROM ({DIFF})""")
def freshness_counts(spark, sf_dir):
    errors = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("source_item_id"))
    return changes.freshness(snapshot_diff(spark, sf_dir), errors)


def _log(spark, sf_dir):
    op = F.when(F.col("event_id") % 4 == 0, "delete").otherwise("upsert")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision"), op.alias("op"), "event_type", "value")


LATEST = "SELECT user_id, event_id AS revision, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 4 > 0"


@query(LATEST)
def latest_state(spark, sf_dir):
    return changes.latest(_log(spark, sf_dir), "user_id").select("user_id", "revision", "event_type", "value")


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE user_id % 3 = 0)
SELECT coalesce(c.c_custkey, p.user_id) AS user_id, CASE WHEN p.user_id IS NULL THEN c.c_mktsegment ELSE p.event_type END AS event_type
FROM customer c FULL JOIN (SELECT * FROM p WHERE n = 1) p ON c.c_custkey = p.user_id WHERE p.event_id IS NULL OR p.event_id % 4 > 0""")
def overlay(spark, sf_dir):
    committed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"))
    pending = _log(spark, sf_dir).where("user_id % 3 = 0").select("user_id", "revision", "op", "event_type")
    return changes.overlay(committed, pending, "user_id").select("user_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def delete_by_key(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return changes.delete_keys(table(spark, sf_dir, "orders").select("o_orderkey"), keys, "o_orderkey")


CHANGED = f"SELECT source_item_id FROM ({DIFF}) WHERE change = 'changed'"
WORK = f"""
  SELECT unnest(['item_process', 'item_analyze']) AS stage, source_item_id::VARCHAR AS entity_id FROM ({CHANGED})
  UNION SELECT stage, unnest([i1, i2, i3]) FROM ({IDS}) JOIN orders ON o_custkey = c_custkey CROSS JOIN (VALUES ('collection_process'), ('collection_analyze')) t(stage) WHERE o_orderkey IN ({CHANGED})
"""


def _work(spark, sf_dir, eager=True):
    changed = snapshot_diff(spark, sf_dir).where("change = 'changed'")
    paths = order_paths(spark, sf_dir).select(F.col("o_orderkey").alias("source_item_id"), F.element_at(hierarchy.id_path("path"), -1).alias("collection_id"))
    placed = changed.join(paths, "source_item_id").select(F.col("source_item_id").cast("string").alias("item_id"), "collection_id")
    return changes.work_for(placed, tree(spark, sf_dir), eager)


@query(f"SELECT DISTINCT stage, entity_id FROM ({WORK})")
def invalidation_set(spark, sf_dir):
    return _work(spark, sf_dir)


@query(f"SELECT DISTINCT stage, entity_id FROM ({WORK}) WHERE stage LIKE 'item%'")
def invalidation_on_demand(spark, sf_dir):
    return _work(spark, sf_dir, eager=False)


STATES = "SELECT unnest(['item_process', 'item_analyze', 'collection_process']) AS stage, o_orderkey AS k, unnest([CASE WHEN o_orderkey % 3 > 0 THEN 'READY' ELSE 'FAILED' END, CASE WHEN o_orderkey % 4 > 0 THEN 'READY' END, CASE WHEN o_orderkey % 5 > 0 THEN 'READY' ELSE 'FAILED' END]) AS status FROM orders"


def _states(spark, sf_dir):
    k = F.col("o_orderkey")
    state = lambda stage, status: F.struct(F.lit(stage).alias("stage"), status.alias("status"))
    each = F.array(
        state("item_process", F.when(k % 3 > 0, "READY").otherwise("FAILED")), state("item_analyze", F.when(k % 4 > 0, "READY")), state("collection_process", F.when(k % 5 > 0, "READY").otherwise("FAILED"))
    )
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("entity_id"), F.explode(each).alias("s"))
    return rows.select("s.stage", "entity_id", "s.status").where("status IS NOT NULL")


@query(f"""
SELECT stage, k::VARCHAR AS entity_id FROM (SELECT unnest(['item_process', 'item_analyze', 'collection_process']) AS stage, o_orderkey AS k FROM orders)
EXCEPT SELECT stage, k::VARCHAR FROM ({STATES}) WHERE status = 'READY'""")
def gap_fill(spark, sf_dir):
    stages = F.explode(F.array(*(F.lit(s) for s in ("item_process", "item_analyze", "collection_process")))).alias("stage")
    work = table(spark, sf_dir, "orders").select(stages, F.col("o_orderkey").cast("string").alias("entity_id"))
    return changes.gaps(work, _states(spark, sf_dir))


@query(f"""
SELECT count(*) FILTER (stage = 'item_process' AND status = 'READY')::BIGINT AS item_process_ready, count(*) FILTER (stage = 'item_process' AND status = 'FAILED')::BIGINT AS item_process_failed,
  count(*) FILTER (stage = 'item_analyze' AND status = 'READY')::BIGINT AS item_analyze_ready, count(*) FILTER (stage = 'item_analyze' AND status = 'FAILED')::BIGINT AS item_analyze_failed,
  count(*) FILTER (stage = 'collection_process' AND status = 'READY')::BIGINT AS collection_process_ready, count(*) FILTER (stage = 'collection_process' AND status = 'FAILED')::BIGINT AS collection_process_failed
FROM ({STATES})""")
def stage_counts(spark, sf_dir):
    return profile.stage_counts(_states(spark, sf_dir), ["item_process", "item_analyze", "collection_process"])


@query("""
WITH c AS (SELECT o_orderpriority, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS pending, count(*) FILTER (o_orderkey % 4 = 0)::BIGINT AS failed, 0::BIGINT AS running FROM orders WHERE o_orderpriority < '3' OR o_orderstatus <> 'P' GROUP BY 1)
SELECT *, CASE WHEN running > 0 THEN 'busy' WHEN pending > 0 THEN 'busy' WHEN failed > 0 THEN 'warning' ELSE 'ok' END AS level,
  CASE WHEN running > 0 THEN 'working' WHEN pending > 0 THEN 'waiting' WHEN failed > 0 THEN 'done with failures' ELSE 'up to date' END AS label,
  CASE WHEN pending > 0 THEN (total - pending) || ' of ' || total || ' done, ' || pending || ' to come' WHEN failed > 0 THEN failed || ' of ' || total || ' failed' ELSE 'all ' || total || ' done' END AS detail, round((total - pending) / total, 6) AS progress FROM c""")
def status_verdict(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority < '3' OR o_orderstatus <> 'P'")
    counts = orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderkey") % 4 == 0).alias("failed"), F.lit(0).cast("long").alias("running"), F.lit(None).cast("string").alias("scan_error")
    )
    return profile.status_verdict(counts).withColumn("progress", F.round("progress", 6)).drop("scan_error")


@query(f"""
WITH old AS (SELECT o_orderkey AS e, 'region' AS name, a AS value FROM orders JOIN ({IDS}) ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders),
new AS (SELECT o_orderkey AS e, 'region' AS name, CASE WHEN length(b) % 2 = 0 THEN upper(b) ELSE a END AS value FROM orders JOIN ({IDS}) ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders WHERE o_orderkey % 13 > 0)
SELECT DISTINCT coalesce(o.e, n.e) AS entity_id FROM old o FULL JOIN new n ON o.e = n.e AND o.name = n.name AND o.value = n.value WHERE o.e IS NULL OR n.e IS NULL""")
def metadata_refresh(spark, sf_dir):
    orders = order_paths(spark, sf_dir)
    a, b = F.col("path")[0], F.col("path")[1]
    fold = lambda df, region: metadata.fold(metadata.layer(df, "o_orderkey", 0, {"region": region, "status": F.when(F.col("keep"), F.col("o_orderstatus"))}))
    old = fold(orders.withColumn("keep", F.lit(True)), a)
    new = fold(orders.withColumn("keep", F.col("o_orderkey") % 13 > 0), F.when(F.length(b) % 2 == 0, F.upper(b)).otherwise(a))
    return metadata.changed_entities(old, new)


LIVE = f"SELECT i3 AS collection_id FROM customer JOIN ({IDS}) USING (c_custkey) WHERE c_acctbal > 9000"


def _live(spark, sf_dir):
    paths = customer_paths(spark, sf_dir).withColumn("collection_id", F.element_at(hierarchy.id_path("path"), -1))
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(paths, "c_custkey").select("collection_id")


@query(f"SELECT DISTINCT up AS collection_id FROM ({UPS}) WHERE collection_id IN ({LIVE})")
def prune_collections(spark, sf_dir):
    return hierarchy.kept_nodes(tree(spark, sf_dir), _live(spark, sf_dir)).select("collection_id")


@query(f"SELECT DISTINCT up AS collection_id FROM ({UPS}) WHERE collection_id IN ({LIVE})")
def affected_collections(spark, sf_dir):
    return hierarchy.affected(tree(spark, sf_dir), _live(spark, sf_dir))


@query(f"""
SELECT 'item' AS kind, o_orderkey::VARCHAR AS id FROM orders JOIN ({IDS}) ON o_custkey = c_custkey WHERE i3 NOT IN (SELECT collection_id FROM ({NODES}) WHERE depth <> 2 AND length(label) % 4 > 0)
UNION ALL SELECT 'collection', collection_id FROM ({NODES}) WHERE depth = 3 AND length(label) % 4 > 0""")
def integrity_checks(spark, sf_dir):
    broken = tree(spark, sf_dir).where("depth <> 2 AND length(label) % 4 > 0")
    items = order_paths(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("item_id"), F.element_at(hierarchy.id_path("path"), -1).alias("collection_id"))
    return hierarchy.broken_links(broken, items)


@query("SELECT collection_id, count(DISTINCT label || '|' || meta)::BIGINT AS versions FROM (SELECT c_nationkey::VARCHAR AS collection_id, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'same' END AS label, 'm' AS meta FROM customer) GROUP BY 1 HAVING count(DISTINCT label) > 1")
def projection_conflicts(spark, sf_dir):
    label = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("same")
    projected = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("collection_id"), F.lit(None).cast("string").alias("parent_id"), label.alias("label"), F.lit("m").alias("metadata"))
    return hierarchy.conflicts(projected)


@query("""
WITH i AS (SELECT l_orderkey AS s, CASE WHEN l_orderkey % 50 = 0 THEN 'shared#' || l_returnflag ELSE l_orderkey || '#' || l_returnflag END AS item_id FROM lineitem)
SELECT item_id, count(*)::BIGINT AS copies, count(DISTINCT s)::BIGINT AS sources FROM i GROUP BY item_id HAVING count(*) > 1""")
def dup_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    minted = F.when(F.col("l_orderkey") % 50 == 0, F.concat(F.lit("shared#"), "l_returnflag")).otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit("#"), "l_returnflag"))
    return changes.duplicates(lines.select(F.col("l_orderkey").alias("source_item_id"), minted.alias("item_id")))


@query("""
SELECT i.item_id, o_orderpriority AS label, CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS price
FROM (SELECT DISTINCT l_orderkey AS s, l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem) i LEFT JOIN orders ON s = o_orderkey""")
def source_context(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = order_items(spark, sf_dir)
    sources = orders.withColumn("source_item_id", F.col("o_orderkey"))
    columns = {"label": F.col("o_orderpriority"), "price": F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice"))}
    return selection.with_source(items, sources, columns).select("item_id", "label", "price")


@query("""
WITH RECURSIVE n AS (SELECT event_id AS id, CASE WHEN event_id % 100 = 7 THEN event_id * 4 + 1 WHEN event_id > 0 THEN event_id // 4 END AS parent FROM events),
r AS (SELECT id FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n) UNION ALL SELECT n.id FROM r JOIN n ON n.parent = r.id)
SELECT id::VARCHAR AS collection_id FROM n WHERE id NOT IN (SELECT id FROM r)""")
def cycles(spark, sf_dir):
    """A tree of four branches a node, in which some nodes have one of their children as a parent."""
    k = F.col("event_id")
    parent = F.when(k % 100 == 7, k * 4 + 1).when(k > 0, F.expr("event_id div 4"))
    nodes = table(spark, sf_dir, "events").select(k.cast("string").alias("collection_id"), parent.cast("string").alias("parent_id"))
    return hierarchy.cycles(nodes)


@query("""
WITH t AS (SELECT o_orderpriority AS p, count(*) AS found, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus <> 'P') AS items, count(*) FILTER (o_orderstatus = 'F') AS analyzed,
  count(*) FILTER (o_orderkey % 40 = 1) AS fi, count(*) FILTER (o_orderkey % 40 = 2) AS fp, count(*) FILTER (o_orderkey % 40 IN (1, 2, 3)) AS errors FROM orders GROUP BY 1), u AS (SELECT *, errors - fi - fp AS fa FROM t)
SELECT p AS o_orderpriority, unnest([1, 2, 3, 4])::INTEGER AS position, unnest([found || ' sources', items || ' items', analyzed || ' analyzed', (fi + fp + fa) || CASE WHEN fi + fp + fa = 1 THEN ' issue' ELSE ' issues' END]) AS cell,
  unnest([found || ' found, ' || pending || ' pending', items || ' interpreted', items || ' processed, ' || analyzed || ' analyzed', fi || ' interpret, ' || fp || ' process, ' || fa || ' analyze, 0 collection']) AS details FROM u""")
def status_row(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    items = F.count_if(status != "P")
    totals = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(status == "P").alias("pending"), items.alias("interpreted"), items.alias("processed"), F.count_if(status == "F").alias("analyzed"),
        F.count_if(k % 40 == 1).alias("failed_interpret"), F.count_if(k % 40 == 2).alias("failed_process"), F.lit(0).alias("failed_analyze"), F.lit(None).cast("int").alias("failed_collection"),
        F.count_if((k % 40).isin(1, 2, 3)).alias("errors"),
    )
    return profile.status_row(totals).withColumn("details", F.array_join("details", ", "))


@query("SELECT p_partkey AS source_item_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def skipped_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_item_id"))
    return profile.skipped_sources(sources, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("source_item_id")))


@query("""
SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90,
  round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS largest, sum(user_id)::DOUBLE AS wait, coalesce(sum(event_id) FILTER (event_id % 3 = 0), 0)::DOUBLE AS service FROM events GROUP BY event_type""")
def span_summary(spark, sf_dir):
    spans = table(spark, sf_dir, "events").withColumn("served", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    out = profile.span_summary(spans, "event_type", value="value", wait="user_id", service="served")
    return out.select("event_type", "n", F.round("total", 2).alias("total"), *(F.round(c, 4).alias(c) for c in ("median", "p90", "p99")), "largest", "wait", "service")


@query("""
SELECT event_type, round(coalesce(avg(r), 0), 4) AS mean, round(coalesce(quantile_cont(r, 0.5), 0)::DOUBLE, 4) AS median, round(coalesce(quantile_cont(r, 0.9), 0)::DOUBLE, 4) AS p90, coalesce(max(r), 0)::DOUBLE AS largest
FROM (SELECT event_type, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS r FROM events) GROUP BY event_type""")
def batch_summary(spark, sf_dir):
    out = profile.batch_summary(table(spark, sf_dir, "events").withColumn("rows", F.col("user_id") % 5), "event_type")
    return out.select("event_type", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p90")), "largest")


@query("""
WITH s AS (SELECT event_id AS span_id, CASE WHEN event_id > 0 THEN event_id // 4 END AS parent_id, value AS ms FROM events)
SELECT s.span_id, round(coalesce(c.ms, 0), 4) AS children, round(greatest(s.ms - coalesce(c.ms, 0), 0), 4) AS own FROM s LEFT JOIN (SELECT parent_id, sum(ms) AS ms FROM s GROUP BY 1) c ON s.span_id = c.parent_id""")
def self_time(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"), F.when(F.col("event_id") > 0, F.expr("event_id div 4")).alias("parent_id"), F.col("value").alias("ms"))
    return profile.self_time(spans).select("span_id", F.round("children", 4).alias("children"), F.round("own", 4).alias("own"))


PHASES = ["read", "process", "other"]
PHASE_SQL = "CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'process' ELSE 'other' END"


def _phased(spark, sf_dir):
    phase = F.element_at(F.array(*(F.lit(p) for p in PHASES)), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("source_item_id"), phase.alias("phase"), F.col("value").alias("ms"), (F.col("event_id") % 4).alias("thread"))


@query(f"""
SELECT event_type AS kind, count(*)::BIGINT AS events, round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'read'), 0), 2) AS read, round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'process'), 0), 2) AS process,
  round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'other'), 0), 2) AS other, round(sum(value), 2) AS total, (row_number() OVER (ORDER BY sum(value) DESC, event_type))::INTEGER AS rank FROM events GROUP BY event_type""")
def kind_profile(spark, sf_dir):
    out = profile.slowest_first(profile.kind_profile(_phased(spark, sf_dir), PHASES), "total", "kind")
    return out.select("kind", "events", *(F.round(c, 2).alias(c) for c in (*PHASES, "total")), F.col("rank").cast("int").alias("rank"))


@query(f"""
SELECT user_id AS source_item_id, round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'read'), 0), 2) AS read, round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'process'), 0), 2) AS process,
  round(coalesce(sum(value) FILTER ({PHASE_SQL} = 'other'), 0), 2) AS other, round(sum(value), 2) AS total, array_to_string(list_sort(list(DISTINCT event_id % 4)), ',') AS threads FROM events GROUP BY user_id""")
def source_profile(spark, sf_dir):
    out = profile.source_profile(_phased(spark, sf_dir), PHASES)
    return out.select("source_item_id", *(F.round(c, 2).alias(c) for c in (*PHASES, "total")), F.array_join("threads", ",").alias("threads"))


@query("""
WITH d AS (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS f FROM documents), e AS (SELECT f[1] AS leaf, unnest(list_distinct(f)) AS frame FROM d)
SELECT frame, count(*)::BIGINT AS total, count(*) FILTER (frame = leaf)::BIGINT AS own FROM e GROUP BY frame""")
def hotspots(spark, sf_dir):
    frames = F.filter(F.split("text", " ", -1), lambda x: x != "")  # a stack is a text's words
    return profile.hotspots(table(spark, sf_dir, "documents").select(frames.alias("frames")))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def tail_n(spark, sf_dir):
    return profile.tail(table(spark, sf_dir, "events").select("event_id", "user_id"), 5, "event_id", "user_id").select("event_id")


@query("""
WITH s AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS s FROM events),
d AS (SELECT event_id, value - lag(value) OVER w AS dv, s - lag(s) OVER w AS ds FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, round(CASE WHEN dv > 0 AND ds > 0 THEN dv / ds ELSE 0 END, 6) AS rate FROM d""")
def throughput(spark, sf_dir):
    out = profile.throughput(table(spark, sf_dir, "events"), "value", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, ["_s", "event_id"], "user_id")
    return out.select("event_id", F.round("rate", 6).alias("rate"))


@query("""
WITH RECURSIVE s AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events), k AS (
  SELECT user_id, min(ms) AS kept FROM s GROUP BY user_id
  UNION ALL SELECT k.user_id, min(s.ms) FROM k JOIN s ON s.user_id = k.user_id AND s.ms >= k.kept + 3600000 GROUP BY k.user_id)
SELECT user_id, kept FROM k""")
def thin_samples(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return profile.thin(samples, "ms", 3_600_000, "user_id")


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1), m AS (SELECT c_mktsegment, ln(t) AS y, ln(n) AS x FROM c JOIN customer ON o_custkey = c_custkey WHERE t > 0)
SELECT c_mktsegment, round(regr_slope(y, x), 8) AS exponent, round(coalesce(regr_r2(y, x), 1.0), 8) AS r2 FROM m GROUP BY 1""")
def scaling_fit(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    named = totals.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return profile.power_law(named, "n", "t", "c_mktsegment").select("c_mktsegment", F.round("exponent", 8).alias("exponent"), F.round("r2", 8).alias("r2"))


@query("""
SELECT count(DISTINCT user_id)::BIGINT AS files, count(DISTINCT event_id)::BIGINT AS items, round(sum(value), 2) AS ms, round(sum(value) / count(DISTINCT user_id), 4) AS ms_per_file,
  round(sum(value) / count(DISTINCT event_id), 4) AS ms_per_item, round(count(DISTINCT event_id) * 1000 / sum(value), 4) AS items_per_s,
  round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 4) AS during_median, round(quantile_cont(value, 0.9) FILTER (event_type = 'view'), 4) AS during_p90,
  round(quantile_cont(value, 0.99) FILTER (event_type = 'view'), 4) AS during_p99, round(max(value) FILTER (event_type = 'view'), 4) AS during_largest,
  round(quantile_cont(value, 0.5) FILTER (event_type = 'click'), 4) AS after_median, round(quantile_cont(value, 0.9) FILTER (event_type = 'click'), 4) AS after_p90,
  round(quantile_cont(value, 0.99) FILTER (event_type = 'click'), 4) AS after_p99, round(max(value) FILTER (event_type = 'click'), 4) AS after_largest FROM events""")
def scorecard(spark, sf_dir):
    reads = {"during": F.col("event_type") == "view", "after": F.col("event_type") == "click"}
    out = profile.scorecard(table(spark, sf_dir, "events"), "user_id", "event_id", "value", reads)
    return out.select("files", "items", F.round("ms", 2).alias("ms"), *(F.round(c, 4).alias(c) for c in out.columns[3:]))


@query("SELECT event_type, sum(event_id)::BIGINT AS ns, count(*)::BIGINT AS calls, round(sum(event_id) / 1e6 / count(*), 8) AS mean_ms FROM events GROUP BY 1")
def write_costs(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("ns"), F.lit(1).cast("long").alias("calls"))
    return profile.mean_cost(metrics, "event_type").withColumn("mean_ms", F.round("mean_ms", 8))


@query("""
SELECT item_id, row_number() OVER (ORDER BY s, item_id) AS rank FROM (SELECT DISTINCT l_orderkey AS s, l_orderkey || '#lines:' || l_returnflag AS item_id FROM lineitem)""")
def ordered_index(spark, sf_dir):
    return tables.ranked(order_items(spark, sf_dir), "source_item_id", "item_id", name="rank").select("item_id", "rank")


def _files(spark, sf_dir):
    """A text file for each order: comma, tab or semicolon, some with a comment and a preamble, some without a header."""
    k = F.col("path").cast("bigint")
    mark = F.element_at(F.array(F.lit(","), F.lit("\t"), F.lit(";")), (k % 3 + 1).cast("int"))
    # some files have quoted cells that hold the delimiter
    supplier = F.when(k % 6 == 0, F.concat(F.lit('"'), F.col("l_suppkey").cast("string"), F.lit('|""x"""'))).otherwise(F.col("l_suppkey").cast("string"))
    quantity, opened = F.col("l_quantity").cast("int").cast("string"), F.when(k % 6 == 0, F.lit('"')).otherwise(F.lit(""))
    row = F.concat_ws("|", F.col("l_linenumber").cast("string"), quantity, supplier)
    # lines of one number stand in order of what they say, up to the supplier's last digit
    order = F.concat(quantity, F.lit("|"), opened, F.col("l_suppkey").cast("string"))
    # dealt by path before lines are made of them: the columns are smaller than the text, and a file's lines stay together
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), "l_linenumber", "l_quantity", "l_suppkey").repartition("path")
    body = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", order.alias("o"), row.alias("r")))).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda x: x["r"]), "\n")
    head = F.when(k % 2 == 0, F.lit("line|qty|supplier\n")).otherwise(F.lit(""))
    before = F.when(k % 5 == 0, F.lit("# made for a test\nrun one\n")).otherwise(F.lit(""))
    text = F.concat(before, F.replace(F.concat(head, rows), F.lit("|"), mark), F.lit("\n"))
    return delimited.lines_of(body.select("path", text.alias("value")))


@query(r"""
SELECT l_orderkey::VARCHAR AS path, [',', chr(9), ';'][l_orderkey % 3 + 1] AS delimiter, CASE WHEN l_orderkey % 2 = 0 THEN (1 + CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 0 END)::INTEGER END AS header_row,
  (1 + CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 0 END + (l_orderkey % 2 = 0)::INTEGER)::INTEGER AS data_start, l_orderkey % 2 = 0 AS has_header, count(*)::BIGINT AS data_rows, 3 AS width
FROM lineitem GROUP BY l_orderkey""")
def layout_sniff(spark, sf_dir):
    return delimited.sniff(_files(spark, sf_dir))


@query("""
WITH r AS (SELECT l_orderkey, l_quantity, l_linenumber, CASE WHEN l_orderkey % 6 = 0 THEN l_suppkey || [',', chr(9), ';'][l_orderkey % 3 + 1] || '"x"' ELSE l_suppkey::VARCHAR END AS l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INTEGER || '|' || CASE WHEN l_orderkey % 6 = 0 THEN '"' ELSE '' END || l_suppkey) AS n FROM lineitem)
SELECT l_orderkey::VARCHAR AS path, n::INTEGER AS row, unnest([1, 2, 3]) AS "column", unnest(CASE WHEN l_orderkey % 2 = 0 THEN ['line', 'qty', 'supplier'] ELSE ['column1', 'column2', 'column3'] END) AS name,
  unnest([l_linenumber::VARCHAR, l_quantity::INTEGER::VARCHAR, l_suppkey]) AS value FROM r""")
def delimited_read(spark, sf_dir):
    lines = _files(spark, sf_dir)
    return delimited.read_table(lines, delimited.sniff(lines)).withColumn("row", F.col("row").cast("int"))


@query(r"""
SELECT doc_id, source, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, coalesce(source, '') AS source, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents)""")
def delimited_documents(spark, sf_dir):
    """Whole texts, of several lines, as cells of files that are cut into splits: written, sniffed and read back."""
    folder = shared_folder(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "source", "text").write.options(header=True, quoteAll=True, escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    lines = delimited.read_lines(spark, folder)
    rows, text = delimited.read_rows(lines, delimited.sniff(lines)), delimited.cell("text")
    return rows.select(delimited.cell("doc_id").cast("bigint").alias("doc_id"), delimited.cell("source").alias("source"), F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


@query("""
SELECT c_mktsegment || '/' || c_nationkey AS fragment, 'limit' AS name, 'Int64' AS vtype, max_by(c_custkey, c_custkey)::BIGINT AS i FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
UNION ALL SELECT 'bad:BUILDING', 'a path column and one more are needed', NULL, NULL""")
def parameter_files(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    row = F.concat(F.lit(" "), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"), F.lit(" , "), F.col("c_custkey").cast("string"))
    rows = customer.select(F.col("c_mktsegment").alias("path"), (F.col("c_custkey") + 2).cast("int").alias("line_no"), row.alias("line"))
    head = F.when(F.col("path") == "BUILDING", F.lit("path")).otherwise(F.lit("path, limit"))
    heads = customer.select(F.col("c_mktsegment").alias("path")).distinct().select("path", F.lit(1).alias("line_no"), head.alias("line"))
    values, errors = parameters.parse(heads.unionByName(rows))
    bad = errors.select(F.concat(F.lit("bad:"), "path").alias("fragment"), F.col("message").alias("name"), F.lit(None).cast("string").alias("vtype"), F.lit(None).cast("bigint").alias("i"))
    return values.select("fragment", "name", F.col("value.vtype").alias("vtype"), F.col("value.i").alias("i")).unionByName(bad)


@query("""
SELECT source AS path, 'tag_' || lang AS tag, 'catalog' AS part, count(*)::BIGINT AS n FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY ALL
UNION ALL SELECT source, 'tag_' || lang, 'assignments', count(*) FROM documents WHERE doc_id % 10 > 0 GROUP BY ALL
UNION ALL SELECT source, 'malformed row', 'errors', count(*) FROM documents WHERE doc_id % 10 = 0 GROUP BY ALL
UNION ALL SELECT DISTINCT source, 'unknown section', 'errors', 1 FROM documents
UNION ALL SELECT DISTINCT source, 'row outside of any section', 'errors', 2 FROM documents""")
def parse_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), "doc_id", F.concat(F.lit("tag_"), "lang").alias("tag"))
    line = lambda df, n, text: df.select("path", n.cast("long").alias("line_no"), text.alias("line"))
    sources = docs.select("path").distinct()
    langs = docs.select("path", "tag").distinct()
    order = F.row_number().over(Window.partitionBy("path").orderBy("tag"))
    rows = F.when(F.col("doc_id") % 10 == 0, F.lit("only-a-key")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), "tag"))
    lines = (
        line(sources, F.lit(-2000), F.lit("stray row"))
        .unionByName(line(sources, F.lit(-1999), F.lit("[others]")))
        .unionByName(line(sources, F.lit(-1998), F.lit("in no section")))
        .unionByName(line(sources, F.lit(-1000), F.lit("[ catalog ]")))
        .unionByName(line(langs, -500 + order, F.concat_ws("\t", "tag", F.lit("#A0b0C0"), F.lit("3"))))
        .unionByName(line(sources, F.lit(-1), F.lit("[assignments]")))
        .unionByName(line(docs, F.col("doc_id"), rows))
    )
    catalog, assigned, errors = annotation_files.parse_tags(lines)
    count = lambda df, tag, part: df.groupBy("path", tag.alias("tag")).agg(F.count(F.lit(1)).alias("n")).select("path", "tag", F.lit(part).alias("part"), "n")
    return count(catalog, F.col("name"), "catalog").unionByName(count(assigned, F.col("tag"), "assignments")).unionByName(count(errors, F.substring_index("message", ":", 1), "errors"))


@query("""
SELECT source AS path, 'doc ' || doc_id AS key, '[' || lang || ']' || chr(10) || n_chars AS body FROM documents""")
def parse_notes(spark, sf_dir):
    return annotation_files.parse_notes(_notes(spark, sf_dir))


@query("""
SELECT lang AS path, 6 * doc_id + CASE doc_id % 4 WHEN 2 THEN 2 ELSE 1 END AS line_no,
  ['text outside of any section', 'no fence after the heading', 'no heading before the fence'][doc_id % 4 + 1] AS message FROM documents WHERE doc_id % 4 < 3
UNION ALL SELECT lang, 6 * max(doc_id) + 7, 'the fence is never closed' FROM documents GROUP BY lang""")
def note_errors(spark, sf_dir):
    """Sections with stray text before them, headings without a fence, and fences without a heading, in files whose last fence is open."""
    docs = table(spark, sf_dir, "documents")
    at = lambda **lines: F.array(*(F.struct(F.lit(int(n[1:])).alias("n"), F.lit(t).alias("line")) for n, t in lines.items()))
    kinds = F.array(at(_1="stray", _2="[a]", _3="```", _4="x", _5="```"), at(_1="[a]", _3="[b]", _4="```", _5="```"), at(_1="", _2="```", _3="y", _4="```"), at(_1="[a]", _2="", _3="```", _4="[b]", _5="```"))
    lines = docs.select(F.col("lang").alias("path"), "doc_id", F.explode(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("l")).select("path", (F.col("doc_id") * 6 + F.col("l.n")).alias("line_no"), "l.line")
    last = docs.groupBy(F.col("lang").alias("path")).agg(F.max("doc_id").alias("d")).select("path", F.explode(F.array(F.struct((F.col("d") * 6 + 6).alias("line_no"), F.lit("[end]").alias("line")), F.struct((F.col("d") * 6 + 7).alias("line_no"), F.lit("```").alias("line")))).alias("l")).select("path", "l.*")
    return annotation_files.note_errors(lines.unionByName(last))


def _notes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.array(F.concat(F.lit("[doc "), F.col("doc_id").cast("string"), F.lit("]")), F.lit("```"), F.concat(F.lit("["), "lang", F.lit("]")), F.col("n_chars").cast("string"), F.lit("```"), F.lit(""))
    lines = docs.select(F.col("source").alias("path"), "doc_id", F.posexplode(text).alias("n", "line")).select("path", (F.col("doc_id") * 6 + F.col("n")).alias("line_no"), "line")
    return lines


@query("""
SELECT c_mktsegment AS path, c_name AS key, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer WHERE c_custkey % 9 > 0
UNION ALL SELECT c_mktsegment, 'malformed', count(*)::DOUBLE, NULL FROM customer WHERE c_custkey % 9 = 0 GROUP BY 1""")
def parse_layout(spark, sf_dir):
    y = F.when(F.col("c_custkey") % 9 == 0, F.lit("far")).otherwise(F.col("c_nationkey").cast("string"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("path"), F.col("c_custkey").alias("line_no"), F.concat_ws("\t", "c_name", F.col("c_acctbal").cast("string"), y).alias("line"))
    placed, errors = annotation_files.parse_layout(lines)
    bad = errors.groupBy("path").agg(F.count(F.lit(1)).cast("double").alias("x")).select("path", F.lit("malformed").alias("key"), "x", F.lit(None).cast("double").alias("y"))
    return placed.unionByName(bad)
