"""As-of and nearest joins, without a range join: the times asked for and the known ones in one stream by key, in segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.segments import last_values


def asof_join(left: DataFrame, right: DataFrame, on: list[str], ltime: str, rtime: str, max_age: int | None = None, forward: bool = False, width: int | None = None) -> DataFrame:
    """left with the columns of the last right row at or before its time, with equal keys; null if there is none.

    max_age bounds the gap (days for dates); forward takes the first row at or after instead. Several right rows
    of one key and time must not be. Each key and time that left has is answered once, in time ranges, then joined to
    left's rows; left rows with a null key or time find nothing.
    """
    carried = [c for c in right.columns if c not in on]
    kept = [c for c in left.columns if c not in on]
    keys = [f"_on{i}" for i in range(len(on))]
    asked = left.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], F.col(ltime).alias("_t")).dropna().distinct()
    known = right.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], F.col(rtime).alias("_t"), F.struct(*carried).alias("_f")).dropna(subset=[*keys, "_t"])
    found = last_values(asked, known, keys, "_t", "_f", forward, width)
    if max_age is not None:
        at = F.col("_f")[rtime]
        gap = F.datediff("_t", at) if dict(right.dtypes)[rtime] in ("date", "timestamp") else F.col("_t") - at
        found = found.withColumn("_f", F.when(F.abs(gap) <= max_age, F.col("_f")))
    same = reduce(lambda c, p: c & (F.col(p[0]) == F.col(p[1])), zip(on, keys, strict=True), F.col(ltime) == F.col("_t"))
    rows = left.join(found.filter("_f IS NOT NULL"), same, "left")
    renamed = [F.col("_f")[c].alias(c if c not in kept else f"right_{c}") for c in carried]
    return rows.select(*on, *kept, *renamed)


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], ltime: str, rtime: str, max_days: int) -> DataFrame:
    """left with the right row nearest in time, either side, within max_days; of two as near, the earlier."""
    carried = [c for c in right.columns if c not in on]
    packed = right.select(*on, F.col(rtime).alias("_rt"), F.struct(*carried).alias("_r"))
    before = asof_join(left, packed, on, ltime, "_rt").withColumnsRenamed({"_rt": "_t0", "_r": "_r0"})
    both = asof_join(before, packed, on, ltime, "_rt", forward=True)
    g0, g1 = F.datediff(F.col(ltime), "_t0"), F.datediff("_rt", F.col(ltime))
    first = g1.isNull() | (g0 <= g1)
    chosen = F.when(g0.isNotNull() & first & (g0 <= max_days), F.col("_r0")).when(g1.isNotNull() & ~F.coalesce(g0 <= g1, F.lit(False)) & (g1 <= max_days), F.col("_r"))
    return both.withColumn("_c", chosen).select(*left.columns, *[F.col("_c")[c].alias(c if c not in left.columns else f"right_{c}") for c in carried])
