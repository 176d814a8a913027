"""Grouped panels: cubes with 'ALL' rows, quantiles, pivots, comparisons, shares, growth, series roll-ups."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_quantiles


def cube_panel(df: DataFrame, dims: list[str], aggs: list[Column], always: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates over every subset of dims, with 'ALL' where a dimension is rolled up; ``always`` stay in all subsets."""
    free = [d for d in dims if d not in always]
    sets = [[*always, *s] for n in range(len(free) + 1) for s in combinations(free, n)]
    names = [F.when(F.grouping(d) == 1, "ALL").otherwise(F.col(d)).alias(f"_{d}") if d not in always else F.col(d).alias(f"_{d}") for d in dims]
    rows = df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*aggs, *names)
    values = [c for c in rows.columns if c not in dims and c not in [f"_{d}" for d in dims]]
    return rows.select(*[F.col(f"_{d}").alias(d) for d in dims], *values)


def quantiles(df: DataFrame, keys: list[str], col: str, qs: list[float], mode: str = "exact") -> DataFrame:
    """keys, q, value: exact with linear interpolation, discrete, or approximate."""
    if mode == "approx":
        rows = df.groupBy(*keys).agg(F.percentile_approx(col, qs, 10_000).alias("_v"))
    else:
        rows = exact_quantiles(df, keys, col, qs, mode == "discrete").withColumnRenamed("q", "_v")
    pairs = F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("_v").alias("value"))
    return rows.select(*keys, F.explode(pairs).alias("x")).select(*keys, F.col("x.q").alias("q"), F.col("x.value").alias("value"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: exact distinct counts, each by its own two-level aggregation."""
    parts = [df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count("*").alias(c)) for c in cols]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def corr_table(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """x, y, r: all pairs in one aggregation."""
    row = df.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x in xs for y in ys])
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}|{y}`").alias("r")) for x in xs for y in ys])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def share(condition: Column, *present: Column) -> Column:
    """Mean of a condition over the rows that have all the columns."""
    there = reduce(lambda a, c: a & c.isNotNull(), present, F.lit(True))
    return F.avg(F.when(there, condition.cast("int")))


def yearly(df: DataFrame, day: str, cols: list[str]) -> DataFrame:
    """year, and each column's mean, least and greatest."""
    return df.groupBy(F.year(day).alias("year")).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def mean_of_shares(df: DataFrame, snapshot: str, keys: list[str], bucket: str, value: str) -> DataFrame:
    """keys, bucket, mean_share: the share of a bucket within its snapshot, averaged over the snapshots of the keys; absent counts as 0."""
    sums = df.groupBy(snapshot, *keys, bucket).agg(F.sum(value).alias("_v"))
    shares = sums.withColumn("_share", F.col("_v") / F.sum("_v").over(W.partitionBy(snapshot, *keys)))
    counted = sums.groupBy(*keys).agg(F.countDistinct(snapshot).alias("_n"))
    means = shares.groupBy(*keys, bucket).agg(F.sum("_share").alias("_s"))
    joined = means.join(counted, keys) if keys else means.crossJoin(counted)
    return joined.select(*keys, bucket, (F.col("_s") / F.col("_n")).alias("mean_share"))


def widen(df: DataFrame, key: list[str], bucket: str, values: list[str], n: str = "n") -> DataFrame:
    """key, n_<value> and pct_<value> for every value, 0 where absent."""
    wide = df.groupBy(*key).pivot(bucket, values).agg(F.sum(n)).na.fill(0)
    total = reduce(lambda a, v: a + F.col(f"`{v}`"), values, F.lit(0))
    return wide.select(*key, *[F.col(f"`{v}`").cast("long").alias(f"n_{v}") for v in values], *[F.try_divide(F.col(f"`{v}`") * 100.0, total).alias(f"pct_{v}") for v in values])


def lengthen(df: DataFrame, ids: list[str], lists: dict[str, str], name: str = "value") -> DataFrame:
    """ids, metric, place, value: array columns as rows."""
    parts = [df.select(*ids, F.lit(label).alias("metric"), F.posexplode(col).alias("place", name)) for col, label in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n and percent of all rows, of every pair that occurs."""
    return df.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def diff_runs(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], snapshot: str | None = None) -> DataFrame:
    """keys, and for each column the old and new value and their difference; on the snapshots that both runs have."""
    if snapshot:
        common = old.select(snapshot).intersect(new.select(snapshot))
        old, new = old.join(common, snapshot, "left_semi"), new.join(common, snapshot, "left_semi")
    a = old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in cols])
    b = new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols])
    rows = a.join(b, keys, "full_outer")
    return rows.select(*keys, *[x for c in cols for x in (F.col(f"{c}_old"), F.col(f"{c}_new"), (F.coalesce(F.col(f"{c}_new"), F.lit(0)) - F.coalesce(F.col(f"{c}_old"), F.lit(0))).alias(f"{c}_delta"))])


def growth(series: DataFrame, day: str, value: str) -> DataFrame:
    """One row: first and last value and day, yearly compound growth, and rise a year."""
    ends = series.agg(F.min_by(value, day).alias("first_value"), F.max_by(value, day).alias("last_value"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    years = F.datediff("last_day", "first_day") / 365.25
    return ends.withColumn("cagr", F.when((F.col("first_value") > 0) & (years > 0), F.pow(F.col("last_value") / F.col("first_value"), 1 / years) - 1)).withColumn("per_year", F.try_divide(F.col("last_value") - F.col("first_value"), years))


def monthly(df: DataFrame, keys: list[str], day: str, col: str) -> DataFrame:
    """keys, month, mean, median and number of values."""
    return df.groupBy(*keys, F.date_format(day, "yyyy-MM").alias("month")).agg((F.sum(col).cast("double") / F.count(col)).alias("mean"), F.median(F.col(col).cast("double")).alias("median"), F.count(col).alias("n"))


def daily_close(ticks: DataFrame, order: list[str]) -> DataFrame:
    """token, day, close: the last tick of each day."""
    return ticks.groupBy("token", F.to_date("ts").alias("day")).agg(F.max_by("value", F.struct(*order)).alias("close"))


def daily_supply(caps: DataFrame, prices: DataFrame) -> DataFrame:
    """day, supply: the day's last market value over its last price, where that is positive."""
    a = caps.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("cap", "ts").alias("cap"))
    b = prices.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("price", "ts").alias("price"))
    return a.join(b, "day").filter("price > 0").select("day", (F.col("cap") / F.col("price")).alias("supply"))


def volume_status(volumes: DataFrame, today: Column, days: int) -> DataFrame:
    """token, recent, total, status: good if there is volume in the last days, or else at any time."""
    recent = F.sum(F.when(F.datediff(today, "day") < days, F.col("volume")).otherwise(0.0))
    rows = volumes.groupBy("token").agg(recent.alias("recent"), F.sum("volume").alias("total"))
    return rows.withColumn("status", F.when(F.col("recent") > 0, "good").when(F.col("total") > 0, "good_all_time").otherwise("bad"))


def peg_check(prices: DataFrame, peg: float = 1.0) -> DataFrame:
    """token, days, median, least price, shares of days over 2 and 5 percent off the peg, and whether it ever was over 10 percent off."""
    off = F.abs(F.col("close") / peg - 1)
    return prices.groupBy("token").agg(F.count("*").alias("days"), F.median("close").alias("median_close"), F.min("close").alias("min_close"), F.avg((off > 0.02).cast("int")).alias("share_2pct"), F.avg((off > 0.05).cast("int")).alias("share_5pct"), F.bool_or(off > 0.1).alias("broke"))


def era_rows(flows: DataFrame, eras: list[tuple[str, int]]) -> DataFrame:
    """era, n_rows, n_addresses: eras are (name, first block), in order."""
    chain = reduce(lambda c, e: F.when(F.col("block") >= e[1], e[0]).otherwise(c), eras, F.lit("before"))
    return flows.withColumn("era", chain).groupBy("era").agg(F.count("*").alias("n_rows"), F.countDistinct("address").alias("n_addresses"))


def share_floor(hist: DataFrame, keys: list[str], edges: DataFrame) -> DataFrame:
    """keys, floor: the sum of each bin's count times its lower edge, over all: a lower bound of a mean."""
    return hist.join(F.broadcast(edges), "bin").groupBy(*keys).agg((F.sum(F.col("n") * F.col("lower")) / F.sum("n")).alias("floor"))


def rebuild_sums(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """keys, sums and shares rebuilt from group means (mean_<part>, n)."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col(f"mean_{p}") * F.col("n")).alias(f"sum_{p}") for p in parts])
    total = reduce(lambda a, p: a + F.col(f"sum_{p}"), parts, F.lit(0.0))
    return sums.select("*", *[F.try_divide(F.col(f"sum_{p}"), total).alias(f"share_{p}") for p in parts])


def peaks(series: DataFrame, day: str, a: str, b: str) -> DataFrame:
    """One row: a's greatest value and its day, its last value, and least, median and greatest ratio of a to b."""
    ratio = F.try_divide(F.col(a), F.col(b))
    return series.agg(F.max(a).alias("peak"), F.max_by(day, F.struct(F.col(a), F.col(day))).alias("peak_day"), F.max_by(a, day).alias("last_value"), F.min(ratio).alias("min_ratio"), F.median(ratio).alias("median_ratio"), F.max(ratio).alias("max_ratio"))


def type_share(df: DataFrame, snapshot: str, kind: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(share of each kind in each snapshot, spread of the shares over snapshots)."""
    sums = df.groupBy(snapshot, kind).agg(F.sum(value).alias("value"))
    shares = sums.withColumn("share", F.col("value") / F.sum("value").over(W.partitionBy(snapshot)))
    spread = shares.groupBy(kind).agg(F.avg("share").alias("mean"), *[F.percentile("share", F.lit(q / 100)).alias(f"p{q}") for q in (10, 50, 90)])
    return shares, spread


def token_year(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """year and keys: mean, median and number of the tokens' means of that year."""
    means = df.groupBy("year", *keys, "token").agg(F.avg(value).alias("_m"))
    return means.groupBy("year", *keys).agg(F.avg("_m").alias("mean"), F.median("_m").alias("median"), F.count("*").alias("n_tokens"))


def dust_effect(full: DataFrame, clean: DataFrame, snapshot: str) -> DataFrame:
    """snapshot, share of multi-asset accounts that are lost once small positions are ignored."""
    a = full.groupBy(snapshot).agg(F.count_if(F.col("num_tokens") >= 2).alias("multi"))
    b = clean.groupBy(snapshot).agg(F.count_if(F.col("num_tokens") >= 2).alias("multi_clean"))
    return a.join(b, snapshot, "left").select(snapshot, "multi", F.coalesce("multi_clean", F.lit(0)).alias("multi_clean"), F.try_divide(F.col("multi") - F.coalesce("multi_clean", F.lit(0)), F.col("multi")).alias("lost_share"))


def panel(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Any list of aggregates by keys, and over all rows where the keys are null; of no rows the latter alone, with counts of 0."""
    whole = df.agg(*aggs)
    kinds = dict(df.dtypes)
    return df.groupBy(*keys).agg(*aggs).unionByName(whole.select(*[F.lit(None).cast(kinds[k]).alias(k) for k in keys], "*"))


#: Accuracy of sketches: a quantile's rank is off by about 2.3 / K^0.9 of the rows at most, a distinct count by about 1.04 / 2^(LG_K / 2).
KLL_K, HLL_LG_K = 800, 14


def sketch_partials(df: DataFrame, dims: list[str], values: list[str], distinct: list[str], k: int = KLL_K, lg_k: int = HLL_LG_K) -> DataFrame:
    """dims, n, and a quantile sketch of each value and a distinct-count sketch of each of distinct, at the finest grain: what any coarser cell is merged from.

    A cell's sketches are of bounded size, however many rows it has, so the table can be stored and new rows' partials appended.
    A dimension's null is a group of its own; null values are in no sketch.
    """
    kll = [F.kll_sketch_agg_double(F.col(v).cast("double"), k).alias(f"kll_{v}") for v in values]
    hll = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"hll_{c}") for c in distinct]
    return df.groupBy(*dims).agg(F.count("*").alias("n"), *kll, *hll)


def sketch_cube(partials: DataFrame, dims: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """The partials' counts and sketches merged over every subset of dims, 'ALL' where a dimension is rolled up; no row of the data is read."""
    kll = [F.kll_merge_agg_double(c).alias(c) for c in partials.columns if c.startswith("kll_")]
    hll = [F.hll_union_agg(c).alias(c) for c in partials.columns if c.startswith("hll_")]
    return cube_panel(partials, dims, [F.sum("n").alias("n"), *kll, *hll], always)


def sketch_values(cells: DataFrame, qs: list[float]) -> DataFrame:
    """Cells with each sketch read off: q_<value>, an array of quantiles in the order of qs (null without values), and d_<column>, a distinct count."""
    drop = [c for c in cells.columns if c.startswith(("kll_", "hll_"))]
    read = []
    for c in drop:
        if c.startswith("kll_"):
            some = F.kll_sketch_get_n_double(c) > 0
            read.append(F.when(some, F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(q)) for q in qs])).alias(f"q_{c[4:]}"))
        else:
            read.append(F.hll_sketch_estimate(c).alias(f"d_{c[4:]}"))
    return cells.select("*", *read).drop(*drop)


def cube_rows(df: DataFrame, dims: list[str], always: tuple[str, ...] = ()) -> DataFrame:
    """df once for each subset of dims, 'ALL' standing for those that are rolled up."""
    for d in (d for d in dims if d not in always):
        df = df.withColumn(d, F.explode(F.array(F.col(d).cast("string"), F.lit("ALL"))))
    return df


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Sources by column name with the source's name: ordering numbers of two ledgers may collide."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coverage(sources: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: duplicates, missing and unexpected keys, and PASS or NOT_PASS."""
    there = sources.groupBy(key).agg(F.count("*").alias("_n"))
    rows = there.join(expected.select(key).distinct().withColumn("_want", F.lit(1)), key, "full_outer")
    counts = rows.agg(F.count_if(F.col("_n") > 1).alias("duplicates"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("unexpected"))
    return counts.withColumn("status", F.when(F.col("duplicates") + F.col("missing") + F.col("unexpected") == 0, "PASS").otherwise("NOT_PASS"))


def parties(transfers: DataFrame) -> DataFrame:
    """Distinct addresses that send or receive, in one shuffle."""
    return transfers.select(F.explode(F.array("sender", "recipient")).alias("address")).filter("address IS NOT NULL").distinct()


def compare_runs(a: DataFrame, b: DataFrame, key: list[str], cols: list[str], deal: str | None = None) -> DataFrame:
    """One row: rows in both runs, and the greatest absolute difference of each column.

    deal names a part of the key by which both runs are dealt, with few rows for each of its values: those meet as arrays by it
    alone, and no run is dealt again, as a join by the whole key would. Rows with a null in the key have no counterpart.
    """
    sides = a.select(*key, *[F.col(c).alias(f"{c}_a") for c in cols]), b.select(*key, *[F.col(c).alias(f"{c}_b") for c in cols])
    if deal is None:
        both = sides[0].join(sides[1], key)
    else:
        rest = [k for k in key if k != deal]
        lists = [df.groupBy(deal).agg(F.collect_list(F.struct(*[c for c in df.columns if c != deal])).alias(s)) for df, s in zip(sides, ("_x", "_y"), strict=True)]
        one = lists[0].join(lists[1], deal).select(F.explode("_x").alias("_x"), "_y")
        same = lambda y: reduce(lambda s, k: s & (y[k] == F.col("_x")[k]), rest, F.lit(True))
        both = one.select("_x", F.explode(F.filter("_y", same)).alias("_y")).select(*[f"_x.{c}_a" for c in cols], *[f"_y.{c}_b" for c in cols])
    return both.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))).alias(f"max_{c}") for c in cols])
