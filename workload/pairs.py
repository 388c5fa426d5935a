"""Two snapshots of the given tables, derived with rules any SQL engine can repeat.

A snapshot keeps a rolling window of orders: the old one was taken before the last weeks of
data arrived, the new one after the first weeks aged out. In between, whole classes of rows
were edited. Every row of a table is in at least one snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config.rules import RuleSet
from tidemark.operators import diff

ARRIVED = "2001-06-07"  # later orders are not in the old snapshot
AGED_OUT = "1995-03-30"  # earlier orders are not in the new snapshot


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").withColumn("total", F.col("o_totalprice").cast("decimal(18,2)"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    old = o.filter(F.col("o_orderdate") < F.lit(ARRIVED).cast("timestamp_ntz"))
    new = (
        o.filter(F.col("o_orderdate") >= F.lit(AGED_OUT).cast("timestamp_ntz"))
        .withColumn(
            "total",
            (
                F.col("total")
                + F.when((p == "2-HIGH") & (s == "O"), F.lit("0.50"))
                .when((p == "3-MEDIUM") & (s == "O"), F.lit("20.00"))
                .when((p == "5-LOW") & (s == "O"), F.lit("500.00"))
                .otherwise(F.lit("0.00"))
                .cast("decimal(18,2)")
            ).cast("decimal(18,2)"),
        )
        .withColumn("o_orderstatus", F.when((p == "1-URGENT") & (s == "P"), "F").otherwise(s))
        .withColumn("o_orderpriority", F.when((p == "4-NOT SPECIFIED") & (s == "F"), "1-URGENT").otherwise(p))
    )
    return old, new


def order_rows(df: DataFrame, file: str = "ORDERS") -> DataFrame:
    return diff.snapshot(
        df, file, F.col("o_custkey"),
        {
            "ORDER_NO": F.col("o_orderkey"),
            "STATUS": F.col("o_orderstatus"),
            "PRIORITY": F.col("o_orderpriority"),
            "TOTAL": F.col("total"),
            "ORDERED": F.date_format("o_orderdate", "yyyy-MM-dd"),
        },
    )


ORDER_RULES = RuleSet(
    pair_keys={"ORDERS": ("ORDER_NO",)},
    id_columns=("ORDER_NO",),
    fyi_columns=("PRIORITY",),
    small_changes={"TOTAL": (1.0, 50.0)},
    action_column_words=("STATUS", "TOTAL"),
    action_text_words=("URGENT",),
    row_action=(("ORDERS", "removed"),),
    row_fyi=(("ORDERS", "added"),),
    context_columns=("STATUS", "ORDERED"),
    category_prefixes=(("ORDERS", "order"),),
    column_category={"TOTAL": "money"},
)

# The same two snapshots for the oracle: typed rows o_old / o_new.
ORDERS_SQL = f"""
o_old AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS ordered
  FROM orders WHERE o_orderdate < TIMESTAMP '{ARRIVED} 00:00:00'),
o_new AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN '1-URGENT' ELSE o_orderpriority END AS priority,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(CASE
            WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 0.5
            WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 20
            WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 500
            ELSE 0 END AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total,
         CAST(o_orderdate AS DATE) AS ordered
  FROM orders WHERE o_orderdate >= TIMESTAMP '{AGED_OUT} 00:00:00')
"""
