"""Filters of tokens, accounts and outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import is_true


def allow(df: DataFrame, tokens: DataFrame, key: str = "token") -> DataFrame:
    """Rows whose token is in the list; Spark broadcasts the list if its size allows."""
    return df.join(tokens.select(key).distinct(), key, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")


def exclude_custody(df: DataFrame, address: str, column: str = "address") -> DataFrame:
    return df.filter(F.col(column) != address)


def included_tokens(status: DataFrame) -> DataFrame:
    """token of status rows that are standard tokens with prices, volume, a cap not flagged false, and a valid address."""
    ok = is_true(F.col("is_erc_20")) & (F.lower("price_data_status") == "success") & (F.lower("trading_volume_status") == "good") & (F.coalesce(F.lower("fdv_mcap_lt_eth"), F.lit("")) != "false") & F.lower("contract_address").rlike("^0x[0-9a-f]{40}$")
    return status.filter(ok).select(F.lower("contract_address").alias("token")).distinct()


def whitelist(status: DataFrame, eth: bool = True, price: bool = True, native: str = "ETH") -> DataFrame:
    """token of standard tokens that passed the local check, with prices if asked; and the native asset's row."""
    ok = is_true(F.col("is_erc_20")) & (F.lower(F.trim("local_status")) == "pass")
    if price:
        ok = ok & (F.lower("price_data_status") == "success")
    rows = status.filter(ok).select(F.lower("contract_address").alias("token")).distinct()
    return rows.unionByName(status.sparkSession.createDataFrame([(native,)], "token string")) if eth else rows


def name_candidates(tokens: DataFrame, reviewed: DataFrame, patterns: list[str]) -> DataFrame:
    """Tokens whose symbol or name meets a pattern and that nobody has reviewed."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    rows = tokens.filter(F.col("symbol").rlike(pattern) | F.col("name").rlike(pattern))
    return rows.join(reviewed.select("token").distinct(), "token", "left_anti")


def with_outcome(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def sane_supply(df: DataFrame, limit: float = 1e50) -> DataFrame:
    """Rows with a supply below the limit, the Gini coefficient clipped to 1."""
    return df.filter(F.col("supply") < limit).withColumn("gini", F.least(F.lit(1.0), "gini"))


def all_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, c: a & F.col(c).isNotNull(), cols, F.lit(True)))
