"""The given tables seen as a token ledger: transfers, signed flows, prices, wallets, tags and ticks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import saved, stored

EPOCH = date(1995, 1, 1)
#: The first of each quarter, the last one after all rows; a snapshot is the state at the end of that block.
QUARTERS = [date(y, m, 1) for y in range(1995, 2002) for m in (1, 4, 7, 10)] + [date(2002, 1, 1)]
#: The alias pair: the first token is a wrapped form of the second.
WRAPPED, NATIVE = "Brand#12", "Brand#11"
BENCHMARKS = ("Brand#11", "Brand#21")
CASH, DERIVATIVE, WRAPPER = [f"Brand#{i}" for i in (1, 2, 3)], [f"Brand#{i}" for i in (13, 14, 15)], [f"Brand#{i}" for i in (21, 22, 23)]


def block_of(day: date) -> int:
    return (day - EPOCH).days


def day_of(block: int) -> date:
    return EPOCH + timedelta(days=block)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their customer and their part's brand."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return items.join(parts, "l_partkey").join(orders, "l_orderkey")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, block, day, sender, recipient, value, kind and the keys of the line; a null side is a mint or a burn."""
    s, c = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("C"), "o_custkey")
    final, flag = F.col("l_linestatus") == "F", F.col("l_returnflag")
    sender = F.when(flag == "N", s).when(flag == "R", c).when(~final, s)
    recipient = F.when(flag == "N", c).when((flag == "R") & ~final, s).when(flag == "A", c)
    kind = F.when((flag == "A") & final, "mint").when((flag == "R") & final, "burn").otherwise("transfer")
    day = F.to_date("l_shipdate")
    return lines(spark, sf_dir).select(F.col("p_brand").alias("token"), block(day).alias("block"), day.alias("day"), sender.alias("sender"), recipient.alias("recipient"), F.col("l_quantity").cast("decimal(38,0)").alias("value"), kind.alias("kind"), "l_orderkey", "l_linenumber")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """closes(), worked out once for each session: a row per token and day, however many lines there are."""
    return stored(spark, sf_dir, "prices", lambda: closes(spark, sf_dir))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, day, close: the last line of each token and day, by all its columns.

    The greatest order of each token and day is found first, so that only its lines are compared by all columns, which takes a sort.
    """
    close = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("token"))
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").withColumn("day", F.to_date("l_shipdate"))
    last = saved(rows.groupBy("token", "day").agg(F.max("l_orderkey").alias("l_orderkey")), "last")
    same = [rows[c].eqNullSafe(last[c]) for c in ("token", "day", "l_orderkey")]
    return rows.join(last, same, "left_semi").groupBy("token", "day").agg(F.max_by(close, order).alias("close"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of contract accounts."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("C"), "c_custkey").alias("address"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("token"), "ts", "value", "event_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, day, close of the ticks: the last of each day."""
    return ticks(spark, sf_dir).groupBy("token", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


