"""Return series, trades and prices from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(spark: SparkSession, sf_dir: str, key: list[str] | None = None) -> DataFrame:
    """(key..., t date, r, b): daily returns from line items' discounts and a benchmark from their tax."""
    key = ["l_returnflag", "l_linestatus"] if key is None else key
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    mean = lambda c, off: F.sum(F.round(F.col(c) * 100).cast("int") - off) / (F.count("*") * F.lit(100.0))
    return li.groupBy(*key, F.to_date("l_shipdate").alias("t")).agg(mean("l_discount", 5).alias("r"), mean("l_tax", 4).alias("b"))


DAILY_SQL = """s AS (
  SELECT {key}, CAST(l_shipdate AS DATE) AS t, sum(CAST(round(l_discount * 100) AS INT) - 5) / (count(*) * CAST(100 AS DOUBLE)) AS r,
    sum(CAST(round(l_tax * 100) AS INT) - 4) / (count(*) * CAST(100 AS DOUBLE)) AS b
  FROM lineitem GROUP BY ALL)"""


def cents(x):
    """x in whole hundredths, rounded half up in binary arithmetic, the same in any engine."""
    return F.floor(x * 100 + 0.5) / 100.0


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips: from order to shipment at the retail and the sold unit price; open where shipped earlier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    shut = F.col("l_shipdate") > F.col("o_orderdate")
    unit = cents(F.col("l_extendedprice") / F.col("l_quantity"))
    return j.select(
        F.col("o_orderdate").alias("entry_time"), unit.alias("entry_price"), F.when(shut, F.col("l_shipdate")).alias("exit_time"),
        F.when(shut, cents(unit * (1 + F.col("l_discount") - 0.05))).alias("exit_price"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("direction"), F.col("l_linestatus").alias("symbol"),
        cents(F.col("l_tax") * 10).alias("fees"),
    )


TRADES_SQL = """t AS (
  SELECT o_orderdate AS entry_time, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS entry_price,
    CASE WHEN l_shipdate > o_orderdate THEN l_shipdate END AS exit_time,
    CASE WHEN l_shipdate > o_orderdate THEN floor(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 * (1 + l_discount - 0.05) * 100 + 0.5) / 100 END AS exit_price,
    l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS direction, l_linestatus AS symbol, floor(l_tax * 10 * 100 + 0.5) / 100 AS fees
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, symbol, close): the mean unit price of the day's line items."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("symbol")).agg(
        cents(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close")
    )


PRICES_SQL = """p AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS symbol, floor(sum(l_extendedprice) / sum(l_quantity) * 100 + 0.5) / 100 AS close FROM lineitem GROUP BY ALL)"""
