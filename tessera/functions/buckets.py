"""Bins: a value's label by the first condition that it meets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the bins: upper edges with their labels, the label above the last edge, and whether edges belong to the lower bin.
WEALTH = ([(1, "<=1"), (100, "1-100"), (1_000, "100-1K"), (10_000, "1K-10K"), (100_000, "10K-100K")], ">100K", True)
WEALTH_BELOW = ([(1, "<1"), (100, "1-100"), (1_000, "100-1K"), (10_000, "1K-10K"), (100_000, "10K-100K")], ">=100K", False)
BACKTEST_WEALTH = ([(1, "<1"), (100, "1-100"), (1_000, "100-1K"), (10_000, "1K-10K")], "10K+", False)
SIZE = ([(1, "1"), (2, "2"), (4, "3-4"), (9, "5-9")], "10+", True)
SIZE_FINE = ([(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100")], ">100", True)
MAX_WEIGHT = ([(0.2, "0-20%"), (0.3, "20-30%"), (0.4, "30-40%"), (0.5, "40-50%"), (0.6, "50-60%"), (0.7, "60-70%"), (0.8, "70-80%"), (0.9, "80-90%")], "90-100%", True)
EFFECTIVE_N = ([(1.0001, "1"), (1.5, "1-1.5"), (2, "1.5-2"), (3, "2-3"), (5, "3-5"), (10, "5-10")], ">10", True)
CASH_SHARE = ([(0, "0"), (0.1, "0-10%"), (0.2, "10-20%"), (0.3, "20-30%"), (0.4, "30-40%"), (0.5, "40-50%"), (0.6, "50-60%"), (0.7, "60-70%"), (0.8, "70-80%"), (0.9, "80-90%")], "90-100%", True)
MIX = ([(0, "none"), (0.25, "0-25%"), (0.5, "25-50%"), (0.75, "50-75%")], "75-100%", True)
TURNOVER = ([(1e-12, "0"), (0.001, "0-0.1%"), (0.01, "0.1-1%"), (0.05, "1-5%"), (0.1, "5-10%"), (0.25, "10-25%"), (0.5, "25-50%"), (0.75, "50-75%")], "75-100%", True)
DISTANCE = ([(0, "0"), (1, "0-1%"), (20, "1-20%"), (40, "20-40%"), (60, "40-60%"), (80, "60-80%"), (100, "80-100%")], None, True)
RETURNS = ([(-0.5, "<-50%"), (-0.25, "-50--25%"), (-0.1, "-25--10%"), (0, "-10-0%"), (0.1, "0-10%"), (0.25, "10-25%"), (0.5, "25-50%")], ">=50%", False)
ASSETS = ([(0, "0"), (1, "1"), (5, "2–5"), (10, "5–10"), (20, "10–20"), (50, "20–50"), (100, "50–100")], ">100", True)
TOKENS = ([(2, "1-2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50")], "50+", True)
WEI = ([(1, "0 (emptied)"), (10**15, "<0.001 ETH (dust)"), (10**17, "0.001 - 0.1 ETH"), (10**18, "0.1 - 1 ETH"), (1e19, "1 - 10 ETH"), (1e20, "10 - 100 ETH"), (1e22, "100 - 10k ETH")], ">= 10k ETH (whale)", False)
POSITION_USD = ([(1, "<$1"), (5, "$1-5"), (10, "$5-10"), (20, "$10-20"), (50, "$20-50"), (100, "$50-100"), (1_000, "$100-1k"), (10_000, "$1k-10k")], ">$10k", False)
POSITION_UNITS = ([(0.001, "<0.001"), (0.01, "0.001-0.01"), (0.1, "0.01-0.1"), (1, "0.1-1"), (10, "1-10")], ">10", False)
POSITION_SHARE = ([(0.05, "<5%"), (0.10, "5-10%"), (0.25, "10-25%"), (0.50, "25-50%"), (0.75, "50-75%"), (0.95, "75-95%")], ">=95%", False)
GAS_USD = (5, 10, 20, 50, 100)
HOLDERS = ([(100, "<=100"), (1_000, "100-1K"), (10_000, "1K-10K")], ">10K", True)


def first_match(pairs: list[tuple[str, Column]], other: str | None = None) -> Column:
    """Label of the first condition that holds."""
    chain = reduce(lambda c, p: c.when(p[1], p[0]), pairs[1:], F.when(pairs[0][1], pairs[0][0]))
    return chain.otherwise(other) if other is not None else chain


def bin(value: Column, spec: tuple, unknown: str | None = None) -> Column:
    """Label of a value's bin; null, NaN and, if unknown is given, negative values get that label."""
    edges, above, inclusive = spec
    pairs = [(label, value <= edge if inclusive else value < edge) for edge, label in edges]
    missing = value.isNull() | F.isnan(value.cast("double"))
    bad = missing | (value < 0) if unknown is not None else missing
    return F.when(bad, F.lit(unknown)).otherwise(first_match(pairs, above))


def bin_sql(value: str, spec: tuple, unknown: str | None = None) -> str:
    """The same bins in SQL."""
    edges, above, inclusive = spec
    bad = f"{value} IS NULL OR {value} < 0" if unknown is not None else f"{value} IS NULL"
    null = "NULL" if unknown is None else f"'{unknown}'"
    cases = " ".join(f"WHEN {value} {'<=' if inclusive else '<'} {edge} THEN '{label}'" for edge, label in edges)
    return f"CASE WHEN {bad} THEN {null} {cases} ELSE {'NULL' if above is None else repr(above)} END"


def fixed_width(value: Column, k: int, low: float, high: float) -> Column:
    """floor(value * k) / k, with values clipped to the range first."""
    return F.floor(F.greatest(F.lit(low), F.least(F.lit(high), value)) * k) / k


def error_decade(error: Column) -> Column:
    """floor(log10) of a relative error; null for none."""
    return F.when(error > 0, F.floor(F.log10(error)))


def histogram(df: DataFrame, dims: list[str], label: Column) -> DataFrame:
    """dims, bin, n: rows of each bin."""
    return df.withColumn("bin", label).groupBy(*dims, "bin").agg(F.count("*").alias("n"))


def below_thresholds(df: DataFrame, dims: list[str], value: Column, thresholds: tuple = GAS_USD) -> DataFrame:
    """dims, n and, for each threshold, the rows whose value is below it: positions that a fee of so much would eat up."""
    return df.groupBy(*dims).agg(F.count("*").alias("n"), *[F.count_if(value < t).alias(f"n_below_{t}") for t in thresholds])


def ventiles(df: DataFrame, x: str, y: str, n: int = 20) -> DataFrame:
    """Per n-quantile bin of x, by discrete quantile edges so that ties share a bin: rows, mean and median of x and y."""
    qs = [i / n for i in range(1, n)]
    from tessera.operators.ranks import exact_quantiles, with_quantiles

    edges = exact_quantiles(df, [], x, qs, discrete=True).select(F.col("q").alias("_edges"))
    rows = df.filter(F.col(x).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    place = F.aggregate("_edges", F.lit(0), lambda acc, e: acc + F.when(F.col(x) > e, 1).otherwise(0))
    rows = rows.select(x, y, (place + 1).alias("ventile"))
    means = rows.groupBy("ventile").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    return with_quantiles(means, rows, ["ventile"], {"median_x": (x, 0.5), "median_y": (y, 0.5)})
