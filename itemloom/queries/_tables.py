"""Tables of the driver as sources, items, collections and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import mint_id
from ..operators import hierarchy
from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def customer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, path: region, nation, segment."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    customer = table(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select("c_custkey", F.array("r_name", "n_name", "c_mktsegment").alias("path"))


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source items, with the path of their collection."""
    orders = table(spark, sf_dir, "orders")
    return orders.join(customer_paths(spark, sf_dir), orders.o_custkey == F.col("c_custkey"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each return flag of an order: source_item_id, entry, item_id."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_item_id"), F.col("l_returnflag").alias("entry")).distinct()
    return lines.withColumn("item_id", mint_id("source_item_id", F.lit("lines"), F.lit(1), "entry"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nodes(customer_paths(spark, sf_dir))


#: The same in DuckDB: paths of customers, node ids along them, nodes.
PATHS = """
  SELECT c_custkey, r_name AS a, n_name AS b, c_mktsegment AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
IDS = f"""
  SELECT *, sha256(i2 || '/' || length(c) || ':' || c) AS i3 FROM (
    SELECT *, sha256(i1 || '/' || length(b) || ':' || b) AS i2 FROM (
      SELECT *, sha256('/' || length(a) || ':' || a) AS i1 FROM ({PATHS})))
"""
NODES = f"""
  SELECT DISTINCT i1 AS collection_id, NULL::VARCHAR AS parent_id, 1 AS depth, a AS label, a AS key, i1 AS u1, NULL::VARCHAR AS u2, NULL::VARCHAR AS u3 FROM ({IDS})
  UNION ALL SELECT DISTINCT i2, i1, 2, b, a || '/' || b, i1, i2, NULL FROM ({IDS})
  UNION ALL SELECT DISTINCT i3, i2, 3, c, a || '/' || b || '/' || c, i1, i2, i3 FROM ({IDS})
"""
#: (collection_id, up): each node with itself and its ancestors.
UPS = f"SELECT collection_id, unnest([u1, u2, u3][1:depth]) AS up FROM ({NODES})"
