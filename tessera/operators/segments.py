"""Running sums and last values along time, for keys of any size: time ranges scanned apart, and a small table of carries.

A key's rows are cut at fixed times. Each range is scanned alone; what the ranges before it come to (a sum, or the last value)
is worked out from one row per key and range, and joined to the range's rows. Rows are distinct by key and time, so a range
of ``WIDTH`` time steps holds so many rows at most, however many a key has: an address with a third of all flows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Time steps (blocks, days, seconds) of a range.
WIDTH = 1 << 15


def time_range(time: Column, kind: str, width: int | None = None) -> Column:
    """The range of a block, day or second; timestamps are cut by seconds."""
    width = WIDTH if width is None else width
    step = F.unix_date(time) if kind == "date" else F.unix_micros(time.cast("timestamp")) / 1_000_000 if kind.startswith("timestamp") else time.cast("double")
    return F.floor(step / width)


def carried(parts: DataFrame, keys: list[str], found: dict[str, Column], forward: bool = False) -> DataFrame:
    """keys, _range and, for each name, what its window expression comes to over the ranges before (or, forward, after) each; parts has a row per key and range."""
    order = F.col("_range").desc() if forward else F.col("_range")
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*keys, "_range", *[c.over(before).alias(name) for name, c in found.items()])


def joined(rows: DataFrame, carries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the carries of their range; keys may be null."""
    own = carries.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_range": "_k_range"})
    same = F.col("_range") == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(own, same, "left").drop(*[f"_k_{k}" for k in keys], "_k_range")


def running_sums(steps: DataFrame, keys: list[str], time: str, values: list[str], side: str | None = None, width: int | None = None) -> DataFrame:
    """steps with each value replaced by its sum over the key's rows up to the row, by time and then side; null before the first value. Rows are distinct by keys, time and side."""
    order = [F.col(time), *([F.col(side)] if side else [])]
    cut = steps.withColumn("_range", time_range(F.col(time), dict(steps.dtypes)[time], width))
    parts = cut.groupBy(*keys, "_range").agg(*[F.sum(v).alias(v) for v in values])
    before = carried(parts, keys, {f"_c_{v}": F.sum(v) for v in values})
    local = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = joined(cut.withColumns({v: F.sum(v).over(local) for v in values}), before, keys)
    total = lambda v: F.when(F.col(v).isNull(), F.col(f"_c_{v}")).otherwise(F.col(v) + F.coalesce(F.col(f"_c_{v}"), F.lit(0)))
    kinds = dict(parts.dtypes)
    return rows.withColumns({v: total(v).cast(kinds[v]) for v in values}).drop("_range", *[f"_c_{v}" for v in values])


def last_values(points: DataFrame, known: DataFrame, keys: list[str], time: str, value: str, forward: bool = False, width: int | None = None) -> DataFrame:
    """points (keys, time; distinct) with the value of the last row of known at or before their time, or, forward, of the first at or after; known has keys, time and value, distinct by keys and time."""
    kind = dict(points.dtypes)[time]
    rows = known.select(*keys, time, value, F.lit(0).alias("_side")).unionByName(points.select(*keys, time, F.lit(None).cast(known.schema[value].dataType).alias(value), F.lit(1).alias("_side")))
    rows = rows.withColumn("_range", time_range(F.col(time), kind, width))
    nearest = F.min_by if forward else F.max_by
    parts = known.withColumn("_range", time_range(F.col(time), dict(known.dtypes)[time], width)).groupBy(*keys, "_range").agg(nearest(value, time).alias("_held"))
    # A range that holds points alone needs a carry too, so ranges of both sides are listed.
    every = points.select(*keys, time_range(F.col(time), kind, width).alias("_range")).distinct().withColumn("_held", F.lit(None).cast(known.schema[value].dataType))
    parts = parts.unionByName(every).groupBy(*keys, "_range").agg(F.first("_held", ignorenulls=True).alias("_held"))
    before = carried(parts, keys, {"_carry": F.last("_held", ignorenulls=True)}, forward)
    order = (F.col(time).desc(), F.col("_side")) if forward else (F.col(time), F.col("_side"))
    local = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    scanned = rows.withColumn("_found", F.last(value, ignorenulls=True).over(local)).filter("_side = 1")
    return joined(scanned, before, keys).withColumn(value, F.coalesce("_found", "_carry")).select(*keys, time, value)
