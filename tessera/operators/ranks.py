"""Ranks, running sums, top shares, inequality, samples, and series windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.tables import saved


def magnitude(value: Column) -> Column:
    """A whole number that grows with the value: its sign and binary magnitude, in sixteenths."""
    steps = F.floor(F.log2(F.greatest(F.abs(value.cast("double")), F.lit(1e-300))) * 16).cast("int") + 20_000
    return F.when(value == 0, 0).when(value < 0, -steps).otherwise(steps)


#: Distinct values of a range that one task sorts, about; ranges that hold more are cut again.
CROWDED = 1 << 17


def places(df: DataFrame, keys: list[str], value: str, wanted: Callable[[Column], Column] | None = None, sums: bool = False, levels: int = 1, crowded: int | None = None) -> DataFrame:
    """keys, value, _c, _end, _all: each distinct value, the rows that have it, the rows up to it in rising order, and all rows of the keys; with sums also _vend and _vall, the same of the rows' values.

    Values are counted first, so ties are one row however many have them, and dealt by keys and magnitude; a magnitude starts
    where the counts of all lower ones, a small table, end. A magnitude with too many distinct values is cut into equal parts
    between its least and greatest, and with more levels such a part again: so a column that lies between 0.99 and 1 is many tasks too.
    wanted gives, from the number of rows, an array of places counted from 1: only ranges that hold one are cut and sorted. Rows
    of a magnitude are then counted first, in one combined shuffle, and only values of magnitudes that hold a place are dealt.
    null and NaN have no place.
    """
    crowded = CROWDED if crowded is None else crowded
    few = wanted is not None and not sums
    v, worth = F.col(value).cast("double"), F.col(value) * F.col("_c")
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(v)).select(*keys, value)
    if few:
        rows = rows.withColumn("_m0", magnitude(F.col(value)))
        held = saved(_holding(rows.groupBy(*keys, "_m0").agg(F.count("*").alias("_own")), keys, wanted), "ranges")
        held = held.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_m0").alias("_k_m0"), "_before0", "_all0")
        same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_m0") == F.col("_k_m0"))
        rows = rows.join(held, same).groupBy(*keys, value, "_m0").agg(F.count("*").alias("_c"), F.first("_before0").alias("_before0"), F.first("_all0").alias("_all0"))
    else:
        rows = rows.groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_m0", magnitude(F.col(value)))
    cuts = ["_m0"]
    for level in range(levels + 1):
        aggs = [F.sum("_c").alias("_own"), F.count("*").alias("_k"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), *([F.sum(worth).alias("_vown")] if sums else [])]
        carry = [F.first(c).alias(f"_0{c}") for c in ("_before", "_all", *(("_vbefore", "_vall") if sums else ()))] if level else [F.first(c).alias(f"_0{c[:-1]}") for c in ("_before0", "_all0")] if few else []
        parts = rows.groupBy(*keys, *cuts).agg(*aggs, *carry)
        group = W.partitionBy(*keys, *cuts[:-1])
        below = group.orderBy(cuts[-1]).rowsBetween(W.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_own").over(below), F.lit(0))
        picked = [(F.col("_0_before") + start if level else F.col("_0_before") if few else start).alias("_before"), (F.col("_0_all") if level or few else F.sum("_own").over(group)).alias("_all")]
        if sums:
            heap = F.coalesce(F.sum("_vown").over(below), F.lit(0))
            picked += [(F.col("_0_vbefore") + heap if level else heap).alias("_vbefore"), (F.col("_0_vall") if level else F.sum("_vown").over(group)).alias("_vall")]
        parts = parts.select(*keys, *cuts, "_own", "_k", "_lo", "_hi", *picked)
        if wanted is not None:
            parts = parts.filter(F.exists(wanted(F.col("_all")), lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_own"))))
        own = parts.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {c: f"_k_{c}" for c in cuts})
        same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_k_{k}")), [*keys, *cuts], F.lit(True))
        rows = rows.select(*keys, value, "_c", *cuts).join(own, same).drop(*[f"_k_{k}" for k in (*keys, *cuts)])
        if level < levels:
            pieces = F.when(F.col("_k") > crowded, F.ceil(F.col("_k") / crowded) * 8).otherwise(1)
            part = F.floor(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")) * pieces)
            rows = rows.withColumn(f"_m{level + 1}", F.coalesce(F.greatest(F.lit(0), F.least(pieces - 1, part)), F.lit(0)))
            cuts = [*cuts, f"_m{level + 1}"]
    run = W.partitionBy(*keys, *cuts).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    more = [(F.col("_vbefore") + F.sum(worth).over(run)).alias("_vend"), "_vall"] if sums else []
    return rows.select(*keys, value, "_c", (F.col("_before") + F.sum("_c").over(run)).alias("_end"), "_all", *more)


def _holding(counts: DataFrame, keys: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """keys, _m0, rows of lower magnitudes and all rows, of the magnitudes that hold a wanted place; counts has keys, _m0 and _own."""
    group = W.partitionBy(*keys)
    below = group.orderBy("_m0").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select("*", F.coalesce(F.sum("_own").over(below), F.lit(0)).alias("_before0"), F.sum("_own").over(group).alias("_all0"))
    return placed.filter(F.exists(wanted(F.col("_all0")), lambda r: (r > F.col("_before0")) & (r <= F.col("_before0") + F.col("_own"))))


def runs(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """keys, value, c, above, running, n, total: each distinct value with the rows that have it, the rows and the sum of values greater than it, and those of the keys.

    From high to low the rows of a value take the ranks above + 1 to above + c. A token whose million holders own the same is one row.
    """
    r = places(df, keys, value, sums=True, **options)
    return r.select(*keys, value, F.col("_c").alias("c"), (F.col("_all") - F.col("_end")).alias("above"), (F.col("_vall") - F.col("_vend")).alias("running"), F.col("_all").alias("n"), F.col("_vall").alias("total"))


def within(k: Column) -> Column:
    """How many rows of a run are among the first k ranks."""
    return F.greatest(F.lit(0), F.least(F.col("c"), k - F.col("above")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], discrete: bool = False) -> DataFrame:
    """keys, q (array, in the order of qs): exact quantiles, between two values by linear interpolation or, discrete, the value that first covers the share.

    Only counts by magnitude are gathered for a group; the values around a quantile are found among those of its magnitude.
    """

    def ranks(n: Column) -> list[tuple[Column, Column, Column]]:
        if discrete:
            return [(F.greatest(F.ceil(n * F.lit(q)), F.lit(1)), F.greatest(F.ceil(n * F.lit(q)), F.lit(1)), F.lit(0.0)) for q in qs]
        at = [(n - 1) * F.lit(q) for q in qs]
        return [(F.floor(x) + 1, F.ceil(x) + 1, x - F.floor(x)) for x in at]

    rows = places(df, keys, value, lambda n: F.array(*[r for lo, hi, _ in ranks(n) for r in (lo, hi)]))
    v = F.col(value).cast("double")
    covers = lambda r: (F.col("_end") >= r) & (F.col("_end") - F.col("_c") < r)
    aggs = [F.max(F.when(covers(r), v)).alias(f"_{i}_{j}") for i, (lo, hi, _) in enumerate(ranks(F.col("_all"))) for j, r in enumerate((lo, hi))]
    out = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), *aggs)
    each = [F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * part for i, (_, _, part) in enumerate(ranks(F.col("_all")))]
    return out.select(*keys, F.array(*each).alias("q"))


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """grouped, one row for each of the keys, with exact quantiles of df: wanted has (column, quantile) by name."""
    for col in dict.fromkeys(c for c, _ in wanted.values()):
        named = [(name, q) for name, (c, q) in wanted.items() if c == col]
        cuts = exact_quantiles(df, keys, col, [q for _, q in named]).select(*keys, *[F.col("q")[i].alias(name) for i, (name, _) in enumerate(named)])
        if keys:
            mine = cuts.withColumnsRenamed({k: f"_{k}" for k in keys})
            same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))
            grouped = grouped.join(mine, same, "left").drop(*[f"_{k}" for k in keys])
        else:
            grouped = grouped.crossJoin(F.broadcast(cuts))  # one row each
    return grouped


def numbered(df: DataFrame, order: Column, ranges: int = 4096) -> DataFrame:
    """df with _n from 1 on, by ranges of a 64-bit hash and, within a range, by the hash and all columns; a small table of counts joins the ranges."""
    rows = df.withColumn("_h", order).withColumn("_p", F.floor((F.col("_h") / 2.0**63 + 1) / 2 * ranges).cast("int"))
    sums = rows.groupBy("_p").agg(F.count("*").alias("_own")).select("_p", F.coalesce(F.sum("_own").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_p").orderBy("_h", *df.columns))
    return rows.withColumn("_own", own).join(sums, "_p").withColumn("_n", F.col("_before") + F.col("_own")).drop("_h", "_p", "_own", "_before")


def inequality(balances: DataFrame, value: str = "balance", keys: tuple[str, ...] = ("token", "snapshot"), **options) -> DataFrame:
    """Per keys: holders, supply, HHI, Gini, top 1/10/100 and top 1/5/10 % shares, and holders of half of it (Nakamoto); more than one holder.

    All in closed form over runs of equal balances.
    """
    r = runs(balances.filter(F.col(value) > 0), list(keys), value, **options)
    v, n, total, c, above = F.col(value).cast("double"), F.col("n"), F.col("total").cast("double"), F.col("c"), F.col("above")

    def top(k: Column) -> Column:
        return F.sum(v * within(k)) / F.max(total)

    tops = [top(F.lit(k)).alias(f"top{k}") for k in (1, 10, 100)] + [top(F.greatest(F.lit(1), F.ceil(n * p / 100))).alias(f"top{p}pct") for p in (1, 5, 10)]
    # Ranks go down, so a row's ascending rank is n + 1 - rank; a run's ranks sum to c * above + c (c + 1) / 2.
    gini = 2 * F.sum((c * (n + 1 - above) - c * (c + 1) / 2) * v) / (F.max(n) * F.max(total)) - (F.max(n) + 1) / F.max(n)
    # The first rank of a run whose running sum reaches half: so many of its values are missing before it.
    short = F.greatest(F.lit(1.0), F.ceil(F.round((0.5 * total - F.col("running").cast("double")) / v, 9)))
    half = F.min(F.when(F.col("running").cast("double") + c * v >= 0.5 * total, (above + short).cast("long"))).alias("nakamoto")
    out = r.groupBy(*keys).agg(F.max(n).alias("holders"), F.max("total").alias("supply"), F.sum(c * F.pow(v / total, 2)).alias("hhi"), gini.alias("gini"), *tops, half)
    return out.filter("holders > 1")


def top_shares(df: DataFrame, pcts: list[float], value: str, keys: list[str], floor: float | None = None, **options) -> DataFrame:
    """keys, n, and the value share of the k = max(1, ceil(p * n)) largest rows, for rows above a floor."""
    r = runs(df.filter(F.col(value) > (0 if floor is None else floor)), keys, value, **options)
    k = {p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n"))) for p in pcts}
    return r.groupBy(*keys).agg(F.max("n").alias("n"), F.max("total").alias("total"), *[(F.sum(F.col(value) * within(k[p])) / F.max("total")).alias(f"top_{p:g}".replace(".", "_")) for p in pcts])


def top_quantile(df: DataFrame, pct: float, value: str, keys: list[str], kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(split by kind, summary, members) of the rows at or above the exact quantile; ties stay."""
    cut = exact_quantiles(df, keys, value, [1 - pct]).select(*keys, F.col("q")[0].alias("cut"))
    members = df.join(cut, keys).filter(F.col(value) >= F.col("cut"))
    split = members.groupBy(*keys, kind).agg(F.count("*").alias("n"), F.sum(value).alias("value"))
    summary = members.groupBy(*keys).agg(F.max("cut").alias("cut"), F.count("*").alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return split, summary, members


def share_of_total(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """df with the percentage that col has of its sum over keys."""
    return df.withColumn(f"{col}_pct", F.col(col) * 100.0 / F.sum(col).over(W.partitionBy(*keys)))


def top_n(df: DataFrame, by: list[Column], n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows, over all or of each key."""
    if not keys:
        return df.orderBy(*by).limit(n)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter(F.col("_r") <= n).drop("_r")


def top_with_share(df: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n largest rows of each key with rank, share and running share; only the first n rows of a task's rows are shuffled."""
    by = W.partitionBy(*keys).orderBy(F.desc(value), tie)
    first = df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n).withColumn("_run", F.sum(value).over(by.rowsBetween(W.unboundedPreceding, 0)))
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    rows = first.join(total, keys).withColumn("share", F.col(value) / F.col("_total")).withColumn("cum_share", F.col("_run") / F.col("_total"))
    return rows.drop("_run", "_total")


def last_n(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The n last rows of each key."""
    return top_n(df, [F.desc(c) for c in order], n, tuple(key))


def running(df: DataFrame, keys: list[str], order: list[str], col: str) -> DataFrame:
    """df with col's running sum and its percentage of the whole."""
    by = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(f"cum_{col}", F.sum(col).over(by)).withColumn("cum_pct", F.col(f"cum_{col}") * 100.0 / F.sum(col).over(W.partitionBy(*keys)))


def returns(prices: DataFrame, kind: str = "log") -> DataFrame:
    """prices with ret, the log or simple return on the row before; null at the first and where a price is not positive."""
    before = F.lag("close").over(W.partitionBy("token").orderBy("day"))
    sound = (before > 0) & (F.col("close") > 0)
    return prices.withColumn("ret", F.when(sound, F.log(F.col("close") / before) if kind == "log" else F.col("close") / before - 1))


def fill_forward(prices: DataFrame) -> DataFrame:
    """token, day, close on every day from a token's first to its last, the last known close carried on."""
    nxt = F.lead("day").over(W.partitionBy("token").orderBy("day"))
    rows = prices.select("token", "day", "close", nxt.alias("_next"))
    days = F.sequence("day", F.coalesce(F.date_sub("_next", 1), F.col("day")))
    return rows.select("token", F.explode(days).alias("day"), "close")


def rolling_mean(df: DataFrame, keys: list[str], order: str, col: str, n: int) -> DataFrame:
    """df with the mean of the last n rows, null until there are n."""
    by = W.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return df.withColumn(f"mean_{n}", F.when(F.count(col).over(by) == n, F.avg(col).over(by)))


def market_state(prices: DataFrame) -> DataFrame:
    """Per token and day of a daily series: 30 and 90 day returns, yearly volatility over 30 days, and the level against its 365-day high."""
    by = W.partitionBy("token").orderBy("day")
    back = lambda n: F.lag("close", n).over(by)
    rows = prices.withColumn("_ret", F.log(F.col("close") / F.lag("close").over(by)))
    month, year = by.rowsBetween(-29, 0), by.rowsBetween(-364, 0)
    vol = F.when(F.count("_ret").over(month) == 30, F.stddev("_ret").over(month) * F.sqrt(F.lit(365.0)))
    return rows.select("token", "day", "close", (F.col("close") / back(30) - 1).alias("mom_30"), (F.col("close") / back(90) - 1).alias("mom_90"), vol.alias("vol_30"), (F.col("close") / F.max("close").over(year) - 1).alias("dd_365"))


def cumulative_entities(first_seen: DataFrame, snapshots: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, snapshot, n: entities whose first block is at or before each snapshot, from a histogram of first snapshots."""
    from tessera.operators.balances import balances

    ones = first_seen.select(*keys, "block", F.lit(1).cast("long").alias("value"))
    out = balances(ones.withColumn("_all", F.lit(0)), snapshots, (*keys, "_all"))
    return out.select(*keys, "snapshot", F.col("balance").alias("n"))


def account_kinds(first_seen: DataFrame, created: DataFrame, snapshots: list[int]) -> DataFrame:
    """snapshot, n_all, n_ca, n_eoa: contracts count from the later of first seen and created."""
    rows = first_seen.join(created.select("address", F.col("block").alias("_made")), "address", "left")
    made = rows.filter("_made IS NOT NULL").select("address", F.greatest("block", "_made").alias("block"))
    a = cumulative_entities(first_seen, snapshots).withColumnRenamed("n", "n_all")
    b = cumulative_entities(made, snapshots).withColumnRenamed("n", "n_ca")
    return a.join(b, "snapshot", "left").select("snapshot", "n_all", F.coalesce("n_ca", F.lit(0)).alias("n_ca"), (F.col("n_all") - F.coalesce("n_ca", F.lit(0))).alias("n_eoa"))


def hash_sample(df: DataFrame, keys: list[str], ident: Column, n: int, seed: str) -> DataFrame:
    """n rows of each key, the first by md5 of seed and identity: the same rows in every engine."""
    return top_n(df.withColumn("_h", F.md5(F.concat(F.lit(seed), ident.cast("string")).cast("binary"))), [F.col("_h")], n, tuple(keys)).drop("_h")


def weighted_sample(df: DataFrame, ident: Column, weight: Column, n: int, seed: str) -> DataFrame:
    """n rows without replacement by keys u^(1/w), u from the md5 of seed and identity."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), ident.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    rows = df.withColumn("_k", F.log(u) / weight).filter(weight > 0)
    return rows.orderBy(F.desc("_k"), ident).limit(n).drop("_k")


def with_previous(df: DataFrame, key: list[str], order: str, cols: list[str], ahead: bool = False) -> DataFrame:
    """df with each column's value in the row before, or after, of its key."""
    f, name = (F.lead, "next") if ahead else (F.lag, "prev")
    by = W.partitionBy(*key).orderBy(order)
    return df.select("*", *[f(c).over(by).alias(f"{name}_{c}") for c in cols])


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order."""
    return top_n(df, order, 1, tuple(keys))
