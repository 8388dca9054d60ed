"""The trade graph: customers, suppliers, parts, nations and regions as entities, orders as evidence, labels as claims,
nations and regions as communities. Each table is given as a plan and as SQL for checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.lineage import ship

GRAPH = "trade"
KINDS = (("customer", "Customer", "c_custkey", "c_name", "c_mktsegment"), ("supplier", "Supplier", "s_suppkey", "s_name", None), ("part", "Part", "p_partkey", "p_name", "p_type"), ("nation", "Nation", "n_nationkey", "n_name", None), ("region", "Region", "r_regionkey", "r_name", None))


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column))


class Trade:
    """DataFrames of the graph over a folder of tables; each is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """graph_name, id, type, name, description"""
        out = None
        for table, kind, key, name, description in KINDS:
            e = self.table(table).select(F.lit(GRAPH).alias("graph_name"), _key(table, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (F.col(description) if description else F.lit("")).alias("description"))
            out = e if out is None else out.unionByName(e)
        return out

    @cached_property
    def relationships(self) -> DataFrame:
        """graph_name, source_id, target_id, type, weight, description"""
        c, s, n = self.table("customer"), self.table("supplier"), self.table("nation")
        located = c.select(_key("customer", "c_custkey").alias("source_id"), _key("nation", "c_nationkey").alias("target_id"))
        located = located.unionByName(s.select(_key("supplier", "s_suppkey").alias("source_id"), _key("nation", "s_nationkey").alias("target_id")))
        one = lambda df, kind: df.withColumns({"type": F.lit(kind), "weight": F.lit(1.0)})
        part_of = n.select(_key("nation", "n_nationkey").alias("source_id"), _key("region", "n_regionkey").alias("target_id"))
        lines = self.table("lineitem")
        bought = lines.join(self.table("orders"), lines.l_orderkey == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
        ordered = bought.select(_key("customer", "o_custkey").alias("source_id"), _key("part", "l_partkey").alias("target_id"), F.lit("ORDERED").alias("type"), "weight")
        sold = lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
        supplies = sold.select(_key("supplier", "l_suppkey").alias("source_id"), _key("part", "l_partkey").alias("target_id"), F.lit("SUPPLIES").alias("type"), "weight")
        out = one(located, "LOCATED_IN").unionByName(one(part_of, "PART_OF")).unionByName(ordered).unionByName(supplies)
        return out.select(F.lit(GRAPH).alias("graph_name"), "source_id", "target_id", "type", "weight", F.lit("").alias("description"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Orders: graph_name, id, document_id, text, page_start, page_end, metadata"""
        o = self.table("orders")
        return o.select(
            F.lit(GRAPH).alias("graph_name"), _key("order", "o_orderkey").alias("id"), F.concat(F.lit("book:"), "o_orderpriority").alias("document_id"),
            F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderstatus", "o_orderpriority").alias("text"),
            F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
            F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("source"), F.concat(F.lit("row-"), "o_orderkey"), F.lit("graph_name"), F.lit(GRAPH)).alias("metadata"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """Books of orders, one a priority: graph_name, id, title, metadata"""
        o = self.table("orders").select("o_orderpriority").distinct()
        return o.select(F.lit(GRAPH).alias("graph_name"), F.concat(F.lit("book:"), "o_orderpriority").alias("id"), F.concat(F.lit("Orders "), "o_orderpriority").alias("title"), F.create_map(F.lit("source"), F.lit("orders"), F.lit("priority"), F.col("o_orderpriority")).alias("metadata"))

    @cached_property
    def evidence(self) -> DataFrame:
        """graph_name, chunk_id, entity_id: an order names its customer and its parts"""
        o = self.table("orders").select(_key("order", "o_orderkey").alias("chunk_id"), _key("customer", "o_custkey").alias("entity_id"))
        p = self.table("lineitem").select(_key("order", "l_orderkey").alias("chunk_id"), _key("part", "l_partkey").alias("entity_id")).distinct()
        return o.unionByName(p).select(F.lit(GRAPH).alias("graph_name"), "chunk_id", "entity_id")

    @cached_property
    def claims(self) -> DataFrame:
        """Each order claims a price of its customer: graph_name, id, entity_id, chunk_id, claim_type, description, status"""
        o = self.table("orders")
        return o.select(
            F.lit(GRAPH).alias("graph_name"), _key("claim", "o_orderkey").alias("id"), _key("customer", "o_custkey").alias("entity_id"), _key("order", "o_orderkey").alias("chunk_id"),
            F.lit("order").alias("claim_type"), F.concat(F.lit("ordered at priority "), "o_orderpriority").alias("description"), F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def memberships(self) -> DataFrame:
        """graph_name, entity_id, community_id, level: nations at level 0, regions at level 1"""
        n = self.table("nation")
        kinds = (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_nationkey"))
        out = None
        for table, key, nation in kinds:
            m = self.table(table).select(_key(table, key).alias("entity_id"), F.col(nation).alias("nation"))
            out = m if out is None else out.unionByName(m)
        up = out.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), F.col("nation") == F.col("n_nationkey"))
        each = up.select("entity_id", F.explode(F.array(F.struct(F.concat(F.lit("n"), "nation").alias("c"), F.lit(0).alias("l")), F.struct(F.concat(F.lit("r"), "n_regionkey").alias("c"), F.lit(1).alias("l")))).alias("x"))
        return each.select(F.lit(GRAPH).alias("graph_name"), "entity_id", F.col("x.c").alias("community_id"), F.col("x.l").alias("level"))

    @cached_property
    def communities(self) -> DataFrame:
        """graph_name, id, level, summary, report_text, report_status"""
        n, r = self.table("nation"), self.table("region")
        a = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(0).alias("level"), F.concat(F.lit("Trade of "), "n_name").alias("summary"), (F.col("n_nationkey") % 7 == 3).alias("bad"))
        b = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(1).alias("level"), F.concat(F.lit("Trade of "), "r_name").alias("summary"), F.lit(False).alias("bad"))
        text = F.concat(F.lit("# "), "summary", F.lit("\n[refs: entity:"), F.when(F.col("level") == 0, F.lit("nation:")).otherwise("region:"), F.substring("id", 2, 9), F.lit("]"))
        return a.unionByName(b).select(F.lit(GRAPH).alias("graph_name"), "id", "level", "summary", text.alias("report_text"), F.when(F.col("bad"), "failed").otherwise("success").alias("report_status"))

    @cached_property
    def parents(self) -> DataFrame:
        """graph_name, child_id, child_level, parent_id, parent_level"""
        return self.table("nation").select(F.lit(GRAPH).alias("graph_name"), F.concat(F.lit("n"), "n_nationkey").alias("child_id"), F.lit(0).alias("child_level"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit(1).alias("parent_level"))


#: The same tables as common table expressions.
SQL = """
entities AS (
  SELECT 'customer:' || c_custkey AS id, 'Customer' AS type, c_name AS name, c_mktsegment AS description FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, '' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_type FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, '' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'Region', r_name, '' FROM region
), relationships AS (
  SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'LOCATED_IN' AS type, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF', 1.0 FROM nation
  UNION ALL SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 'ORDERED', count(*)::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SUPPLIES', count(*)::DOUBLE FROM lineitem GROUP BY l_suppkey, l_partkey
), chunks AS (
  SELECT 'order:' || o_orderkey AS id, 'book:' || o_orderpriority AS document_id, 'order ' || o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS text, o_orderstatus AS status, 'row-' || o_orderkey AS source FROM orders
), documents_ AS (
  SELECT DISTINCT 'book:' || o_orderpriority AS id, 'Orders ' || o_orderpriority AS title, o_orderpriority AS priority FROM orders
), evidence AS (
  SELECT 'order:' || o_orderkey AS chunk_id, 'customer:' || o_custkey AS entity_id FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
), claims AS (
  SELECT 'claim:' || o_orderkey AS id, 'customer:' || o_custkey AS entity_id, 'order:' || o_orderkey AS chunk_id, 'order' AS claim_type, 'ordered at priority ' || o_orderpriority AS description, o_orderstatus AS status FROM orders
), placed AS (
  SELECT 'customer:' || c_custkey AS entity_id, c_nationkey AS nation FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, n_nationkey FROM nation
), memberships AS (
  SELECT entity_id, 'n' || nation AS community_id, 0 AS level FROM placed
  UNION ALL SELECT entity_id, 'r' || n_regionkey, 1 FROM placed JOIN nation ON nation = n_nationkey
), communities AS (
  SELECT 'n' || n_nationkey AS id, 0 AS level, 'Trade of ' || n_name AS summary, '# Trade of ' || n_name || chr(10) || '[refs: entity:nation:' || n_nationkey || ']' AS report_text, CASE WHEN n_nationkey % 7 = 3 THEN 'failed' ELSE 'success' END AS report_status FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 1, 'Trade of ' || r_name, '# Trade of ' || r_name || chr(10) || '[refs: entity:region:' || r_regionkey || ']', 'success' FROM region
), parents AS (
  SELECT 'n' || n_nationkey AS child_id, 0 AS child_level, 'r' || n_regionkey AS parent_id, 1 AS parent_level FROM nation
), both_ways AS (
  SELECT source_id AS src, target_id AS dst, type, weight FROM relationships
  UNION ALL SELECT target_id, source_id, type, weight FROM relationships WHERE source_id <> target_id
)"""
