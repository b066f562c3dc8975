"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.base import query, table


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_revenue(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return items.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_filled FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_and_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    calm = table(spark, sf, "customer").select("c_custkey").join(orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti")
    filled = orders.where("o_orderstatus = 'F'").select("c_custkey").distinct().withColumn("has_filled", F.lit(True))
    return calm.join(filled, "c_custkey", "left").withColumn("has_filled", F.coalesce("has_filled", F.lit(False)))


@query("SELECT nation, side FROM (SELECT n_nationkey AS nation, 'both' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION SELECT c_nationkey, 'customers' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).union(c.subtract(s).withColumn("side", F.lit("customers")))


@query("SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority")
def order_totals(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
