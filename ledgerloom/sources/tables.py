"""Tables by name, and adapters from the star schema to the engine's own inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import ship_package

#: Orders rows of a transaction table; no two rows share all of these values.
ORDER = ["step", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of customers to suppliers: nameOrig, nameDest, amount, step (days), balances, type, isMoneyLaundering and row keys."""
    fraud = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), 1).otherwise(0)  # made before the join, so that its columns are not shuffled
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", fraud.alias("isMoneyLaundering"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    placed = orders.join(customers, orders.o_custkey == customers.c_custkey)  # before the lines, so that these are shuffled once
    rows = lines.join(placed, lines.l_orderkey == placed.o_orderkey)
    return rows.select(
        F.concat(F.lit("C"), "o_custkey").alias("nameOrig"),
        F.concat(F.lit("M"), "l_suppkey").alias("nameDest"),
        F.col("l_extendedprice").alias("amount"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("step"),
        "isMoneyLaundering",
        F.col("c_acctbal").alias("oldbalanceOrg"),
        (F.col("c_acctbal") - F.col("l_extendedprice")).alias("newbalanceOrig"),
        F.col("c_mktsegment").alias("type"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or a ValueError that lists all missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def rounded(column: Column, places: int = 6) -> Column:
    return F.round(column.cast("double"), places)


#: The same adapters as DuckDB common table expressions.
TX_SQL = """tx AS (
  SELECT 'C' || o_custkey AS nameOrig, 'M' || l_suppkey AS nameDest, l_extendedprice AS amount,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS step,
    CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 1 ELSE 0 END AS isMoneyLaundering,
    c_acctbal AS oldbalanceOrg, c_acctbal - l_extendedprice AS newbalanceOrig, c_mktsegment AS type,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
ORDER_SQL = ", ".join(ORDER)
EDGES_SQL = f"""edges AS (
  SELECT nameOrig AS src, nameDest AS dst, amount, step, isMoneyLaundering AS fraud FROM (
    SELECT *, row_number() OVER (PARTITION BY nameOrig, nameDest ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) AS r FROM tx) WHERE r = 1)"""
