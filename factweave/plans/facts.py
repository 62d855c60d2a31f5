"""Facts from the star schema: a nation is a document, its orders' year a fiscal period, sums its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

MONEY = "decimal(12,2)"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with nation, fiscal year, code of the order's status and exact amounts. Nations are 25 rows for any size."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity")))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "entity")
    code = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "P", "P").otherwise("E")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fy"), code.alias("code"))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "entity", "fy", "code")
    price, rate, tax = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", price.alias("price"), (price * (1 - rate)).alias("net"), (price * (1 - rate) * tax).alias("tax"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def period(fy: Column) -> Column:
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, fy, period, code, revenue, toi, tax (decimals of four places)."""
    sums = order_lines(spark, sf_dir).groupBy("entity", "fy").agg(
        F.min("code").alias("code"), F.sum("net").cast("decimal(20,4)").alias("revenue"), F.sum("price").cast("decimal(20,4)").alias("toi"), F.sum(F.col("tax").cast("decimal(20,4)")).cast("decimal(20,4)").alias("tax")
    )
    return sums.withColumn("period", period(F.col("fy")))


#: The same facts in SQL, amounts as whole ten-thousandths.
YEARLY_SQL = """
    lines AS (
        SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS fy, o_orderkey, l_linenumber, l_linestatus, l_returnflag,
            CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'P' THEN 'P' ELSE 'E' END AS code,
            CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * 100 AS price4,
            CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) AS net4,
            CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS BIGINT) AS tax2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ),
    yearly AS (
        SELECT entity, fy, concat('FY', lpad(CAST(fy % 100 AS VARCHAR), 2, '0')) AS period, min(code) AS code,
            CAST(sum(net4) AS BIGINT) AS revenue4, CAST(sum(price4) AS BIGINT) AS toi4, CAST(sum((2 * net4 * tax2 + 100) // 200) AS BIGINT) AS tax4
        FROM lines GROUP BY entity, fy
    )
"""


def half_up(numerator: str, denominator: str) -> str:
    """SQL of a quotient of whole numbers, rounded half away from zero; the denominator is positive."""
    n, d = f"CAST(({numerator}) AS HUGEINT)", f"CAST(({denominator}) AS HUGEINT)"
    return f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ((2 * abs({n}) + {d}) // (2 * {d})))"
