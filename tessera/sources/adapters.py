"""Projections of relational tables onto the property graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import read_table


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


#: Room for the keys of one table in an id.
SPAN = 10**15
REGION, NATION, SUPPLIER, CUSTOMER, PART, ORDERS = (k * SPAN for k in range(1, 7))


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, suppliers, customers, parts and orders as nodes; their references as edges.

    Line items are the calls of an order: parallel edges stay, the return flag sets the confidence class.
    """
    t = lambda name: read_table(spark, sf_dir, name)
    none = F.lit(None).cast("string")

    def rows(df, base, key, kind, table, name, uri, lines=F.lit(None).cast("int"), test=F.lit(False)):
        k = F.col(key).cast("long")
        return df.select((k + F.lit(base)).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(F.lit(table + "::"), k.cast("string")).alias("qualified_name"), uri.alias("source_uri"), F.when(lines.isNotNull(), F.lit(1)).alias("line_start"), lines.cast("int").alias("line_end"), test.alias("is_test"))

    s = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    parts = [
        rows(t("region"), REGION, "r_regionkey", "package", "region", F.col("r_name"), none),
        rows(t("nation"), NATION, "n_nationkey", "module", "nation", F.col("n_name"), s("region/", "n_regionkey")),
        rows(t("supplier"), SUPPLIER, "s_suppkey", "class", "supplier", F.col("s_name"), s("nation/", "s_nationkey")),
        rows(t("customer"), CUSTOMER, "c_custkey", "class", "customer", F.col("c_name"), s("nation/", "c_nationkey")),
        rows(t("part"), PART, "p_partkey", "function", "part", F.col("p_name"), s("brand/", "p_brand"), F.col("p_size")),
        rows(t("orders"), ORDERS, "o_orderkey", "method", "order", s("order_", "o_orderkey"), s("customer/", "o_custkey"), test=F.col("o_orderstatus") == "P"),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)

    def link(df, number, key, src, dst, kind, conf=F.lit("extracted")):
        return df.select((F.lit(number * 10**16) + key).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), conf.alias("conf_class"))

    at = lambda base, col: F.col(col).cast("long") + F.lit(base)
    k = lambda col: F.col(col).cast("long")
    flag = F.when(F.col("l_returnflag") == "R", "ambiguous").when(F.col("l_returnflag") == "A", "inferred").otherwise("extracted")
    supply = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    links = [
        link(t("nation"), 1, k("n_nationkey"), at(NATION, "n_nationkey"), at(REGION, "n_regionkey"), "member_of"),
        link(t("customer"), 2, k("c_custkey"), at(CUSTOMER, "c_custkey"), at(NATION, "c_nationkey"), "depends_on"),
        link(t("supplier"), 3, k("s_suppkey"), at(SUPPLIER, "s_suppkey"), at(NATION, "s_nationkey"), "depends_on"),
        link(t("orders"), 4, k("o_orderkey"), at(CUSTOMER, "o_custkey"), at(ORDERS, "o_orderkey"), "defines"),
        link(t("lineitem"), 5, k("l_orderkey") * 100 + k("l_linenumber"), at(ORDERS, "l_orderkey"), at(PART, "l_partkey"), "calls", flag),
        link(supply, 6, k("l_partkey") * 10_000_000 + k("l_suppkey"), at(PART, "l_partkey"), at(SUPPLIER, "l_suppkey"), "imports"),
    ]
    edges = links[0]
    for x in links[1:]:
        edges = edges.unionByName(x)
    return Graph(nodes, edges.withColumn("confidence", F.when(F.col("conf_class") == "extracted", 1.0).otherwise(0.0)))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and event types as nodes; what a user does next as data_flow edges between types."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    follow = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.withColumn("next", follow).filter("next IS NOT NULL").groupBy("event_type", "next").agg(F.count(F.lit(1)).alias("n"))
    nodes = e.select(F.lit("concept").alias("kind"), F.col("event_type").alias("name")).distinct()
    return Graph(nodes, edges.select(F.col("event_type").alias("src"), F.col("next").alias("dst"), F.lit("data_flow").alias("kind"), "n"))


#: The same projection in SQL, for side-by-side checks.
COMMERCE_SQL = """
nodes AS (
    SELECT 1000000000000000 + r_regionkey AS id, 'package' AS kind, r_name AS name, 'region::' || r_regionkey AS qualified_name, NULL::VARCHAR AS source_uri, NULL::INT AS line_end, false AS is_test FROM region
    UNION ALL SELECT 2000000000000000 + n_nationkey, 'module', n_name, 'nation::' || n_nationkey, 'region/' || n_regionkey, NULL, false FROM nation
    UNION ALL SELECT 3000000000000000 + s_suppkey, 'class', s_name, 'supplier::' || s_suppkey, 'nation/' || s_nationkey, NULL, false FROM supplier
    UNION ALL SELECT 4000000000000000 + c_custkey, 'class', c_name, 'customer::' || c_custkey, 'nation/' || c_nationkey, NULL, false FROM customer
    UNION ALL SELECT 5000000000000000 + p_partkey, 'function', p_name, 'part::' || p_partkey, 'brand/' || p_brand, p_size, false FROM part
    UNION ALL SELECT 6000000000000000 + o_orderkey, 'method', 'order_' || o_orderkey, 'order::' || o_orderkey, 'customer/' || o_custkey, NULL, o_orderstatus = 'P' FROM orders
), edges AS (
    SELECT *, CASE WHEN conf_class = 'extracted' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM (
        SELECT 10000000000000000 + n_nationkey AS id, 2000000000000000 + n_nationkey AS src, 1000000000000000 + n_regionkey AS dst, 'member_of' AS kind, 'extracted' AS conf_class FROM nation
        UNION ALL SELECT 20000000000000000 + c_custkey, 4000000000000000 + c_custkey, 2000000000000000 + c_nationkey, 'depends_on', 'extracted' FROM customer
        UNION ALL SELECT 30000000000000000 + s_suppkey, 3000000000000000 + s_suppkey, 2000000000000000 + s_nationkey, 'depends_on', 'extracted' FROM supplier
        UNION ALL SELECT 40000000000000000 + o_orderkey, 4000000000000000 + o_custkey, 6000000000000000 + o_orderkey, 'defines', 'extracted' FROM orders
        UNION ALL SELECT 50000000000000000 + l_orderkey * 100 + l_linenumber, 6000000000000000 + l_orderkey, 5000000000000000 + l_partkey, 'calls', CASE l_returnflag WHEN 'R' THEN 'ambiguous' WHEN 'A' THEN 'inferred' ELSE 'extracted' END FROM lineitem
        UNION ALL SELECT 60000000000000000 + l_partkey * 10000000 + l_suppkey, 5000000000000000 + l_partkey, 3000000000000000 + l_suppkey, 'imports', 'extracted' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    )
)
"""
