"""Views that give the domain's relations over the driver's tables, so that every operator runs at any scale.

Buyers are nations, suppliers are suppliers, an order is a project with one package, a supplier's lines of an order are
its bid, parts are products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..operators import flow

MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file by key over all tasks: a file of few megabytes is read by one task, which would do alone all that
    is computed from its rows."""
    return rows.repartition(key)


def project_units(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), "o_custkey")
    units = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("org_id"))
    return orders.join(units, F.col("o_custkey") == F.col("c_custkey")).select("project_id", "org_id", F.lit(L.UNIT_ROLE).alias("role"))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("project_id"),
        F.col("o_orderkey").cast("string").alias("notice_id"),
        F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("project_no"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publish_date"),
    )


def packages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("package_id"), F.col("o_orderkey").alias("project_id"), F.lit(L.DEFAULT_PACKAGE).alias("package_no"), F.lit(None).cast("string").alias("name"))


def bids(spark: SparkSession, d: str) -> DataFrame:
    lines = flow.dealt(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus"), "l_orderkey")
    awarded = F.col("l_returnflag") == "A"
    return lines.groupBy(F.col("l_orderkey").alias("package_id"), F.col("l_suppkey").cast("long").alias("org_id")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("amount_yuan"),
        F.when(F.max((awarded & (F.col("l_linestatus") == "F")).cast("int")) == 1, L.WON[0]).when(F.max(awarded.cast("int")) == 1, L.WON[1]).otherwise("未中标").alias("result"),
    )


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("org_id"), F.col("s_name").alias("name"))


def units(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("org_id"), F.col("n_name").alias("name"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category_code"), F.col("p_brand").alias("brand"))


def package_products(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.col("l_partkey").cast("long").alias("product_id")).distinct()


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relational tables that the relation operators take."""
    return {
        "project_units": project_units(spark, d),
        "projects": projects(spark, d),
        "packages": packages(spark, d),
        "bids": bids(spark, d),
        "organizations": suppliers(spark, d),
        "units": units(spark, d),
    }


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Line items of notices with the nine fields."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    parts = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("long").alias("notice_id"),
        F.col("l_linenumber").cast("long").alias("item_no"),
        F.col("p_name").alias("product_service_name"),
        F.col("p_type").alias("category_name"),
        F.lit(None).cast("string").alias("category_code"),
        F.col("p_brand").alias("brand_supplier"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("total_price"),
    )


#: The same views for DuckDB.
SQL = """
bids AS (
  SELECT l_orderkey AS package_id, l_suppkey::BIGINT AS org_id, sum(l_extendedprice::DECIMAL(18,2)) AS amount_yuan,
         CASE WHEN bool_or(l_returnflag = 'A' AND l_linestatus = 'F') THEN '中标' WHEN bool_or(l_returnflag = 'A') THEN '成交' ELSE '未中标' END AS result
  FROM lineitem GROUP BY 1, 2),
pu AS (SELECT o_orderkey AS project_id, c_nationkey::BIGINT AS org_id FROM orders JOIN customer ON o_custkey = c_custkey),
pr AS (SELECT o_orderkey AS project_id, o_orderkey::VARCHAR AS notice_id, 'Order ' || o_orderpriority || ' ' || o_orderkey::VARCHAR AS title,
              strftime(o_orderdate, '%Y-%m-%d') AS publish_date FROM orders)
"""
