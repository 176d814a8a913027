"""Joins with a rule of their own for rows without a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_and_unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined to right, and after it the rows of right whose keys left lacks, with nulls in left's columns."""
    kept = [c for c in left.columns if c not in keys]
    kinds = dict(left.dtypes)
    both = left.join(right, keys, "left")
    alone = right.join(left.select(*keys).distinct(), keys, "left_anti")
    return both.unionByName(alone.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in kept]))


def last_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by columns that order its rows wholly; combined before the shuffle."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def date_mismatches(manifest: DataFrame, days: DataFrame, key: str = "block", day: str = "day") -> DataFrame:
    """One row: blocks of a manifest, those that the map of days lacks, and those whose day differs from the map's."""
    known = days.select(key, F.col(day).alias("_known"))
    rows = manifest.select(key, day).join(known, key, "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("missing"), F.count_if(F.col("_known") != F.col(day)).alias("mismatched"))


def rank_of(df: DataFrame, value: str, who: str, name: str) -> DataFrame:
    """One row: a row's value and its rank, one more than the rows above it; none if it is not there."""
    own = df.filter(F.col(who) == name).agg(F.max(value).alias("own"))
    return df.crossJoin(F.broadcast(own)).agg(F.max("own").alias("value"), (F.count_if(F.col(value) > F.col("own")) + 1).alias("rank")).filter("value IS NOT NULL")  # one row
