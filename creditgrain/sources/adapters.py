"""Views of general order and event tables as transactions.

Joins carry no broadcast hints: Spark broadcasts the dimension tables it
measures as small and shuffles the rest, splitting skewed partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transactions import conform

# Lines that a task of their join with the orders sorts, so that the sort stays in memory whatever
# the input's size; up to so many tasks the number is left to Spark, which may broadcast the orders.
TASK_ROWS = 1 << 18
FEW_TASKS = 16


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def line_facts(spark: SparkSession, directory: str) -> DataFrame:
    """The order lines with what transactions take from other tables, each value once.

    Lines are narrowed before the joins shuffle them, and nothing that other columns give
    is in the result: it is what to store.
    """
    returned = F.col("l_returnflag") == "R"
    suspicious = returned & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 48)
    pricing = F.round(F.col("l_discount") * 100).cast("int") % 5
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = _table(spark, directory, "lineitem")
    orders = _table(spark, directory, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    tasks = math.ceil(lines.count() / TASK_ROWS)
    lines = lines.select(*keys, "l_extendedprice", pricing.alias("pricing"), returned.alias("returned"), suspicious.alias("suspicious"))
    if tasks > FEW_TASKS:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, directory, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(_table(spark, directory, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, directory, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, directory, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    taken = ("o_custkey", "o_orderpriority", "o_orderdate", "p_type", "s_nationkey", "r_name")
    return joined.select(*keys, "l_extendedprice", "pricing", "returned", "suspicious", *taken)


def txns_from_facts(facts: DataFrame) -> DataFrame:
    """One transaction per order line; times are dates, returned lines are debits."""
    price = F.col("l_extendedprice")
    return conform(
        facts.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("TransactionId"),
            F.col("l_orderkey").alias("BatchId"),
            F.col("o_custkey").alias("AccountId"),
            F.col("o_custkey").alias("SubscriptionId"),
            F.col("o_custkey").alias("CustomerId"),
            F.col("r_name").alias("CurrencyCode"),
            F.col("s_nationkey").alias("CountryCode"),
            F.col("l_suppkey").alias("ProviderId"),
            F.col("l_partkey").alias("ProductId"),
            F.col("p_type").alias("ProductCategory"),
            F.col("o_orderpriority").alias("ChannelId"),
            F.when(F.col("returned"), -price).otherwise(price).alias("Amount"),
            price.alias("Value"),
            F.col("o_orderdate").alias("TransactionStartTime"),
            F.col("pricing").alias("PricingStrategy"),
            F.when(F.col("suspicious"), 1).otherwise(0).alias("FraudResult"),
        )
    )


def txns_from_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The order lines as transactions, joined as they are read."""
    return txns_from_facts(line_facts(spark, directory))


def txns_from_events(events: DataFrame) -> DataFrame:
    """One transaction per event, with real times of day and missing currencies."""
    k = F.get_json_object("props", "$.k").cast("int")
    is_error = F.col("event_type") == "error"
    keyed = events.withColumn("k", k)
    k = F.col("k")
    return conform(
        keyed.select(
            F.col("event_id").alias("TransactionId"),
            F.floor(F.col("event_id") / 200).alias("BatchId"),
            F.col("user_id").alias("AccountId"),
            F.col("user_id").alias("SubscriptionId"),
            F.col("user_id").alias("CustomerId"),
            F.when(k % 4 == 0, "KES").when(k % 4 == 1, "USD").when(k % 4 == 2, "UGX").alias("CurrencyCode"),
            (k % 6 + 250).alias("CountryCode"),
            (k % 9).alias("ProviderId"),
            (k % 20 + 1000).alias("ProductId"),
            F.col("event_type").alias("ProductCategory"),
            F.when(k % 3 == 0, "Web").when(k % 3 == 1, "Android").otherwise("IOS").alias("ChannelId"),
            F.when(is_error, -F.col("value")).otherwise(F.col("value")).alias("Amount"),
            F.col("value").alias("Value"),
            F.col("ts").alias("TransactionStartTime"),
            (k % 5).alias("PricingStrategy"),
            F.when(is_error & (F.col("value") > 150), 1).otherwise(0).alias("FraudResult"),
        )
    )
