"""Returns, betas, weights, forward values, market regime, and portfolio comparisons."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.asof import asof_join
from tessera.sources.tables import saved


def price_panel(prices: DataFrame, snapshots: dict[int, date], days: int = 60) -> DataFrame:
    """snapshot, token, day, close: daily closes, carried forward inside the window, of the days + 1 days that end before each snapshot."""
    spans = F.explode(F.array(*[F.struct(F.lit(b).alias("snapshot"), F.lit(d).alias("at")) for b, d in snapshots.items()])).alias("s")
    windows = prices.sparkSession.range(1).select(spans).select("s.snapshot", F.explode(F.sequence(F.date_sub("s.at", days + 1), F.date_sub("s.at", 1))).alias("day"))
    inside = prices.join(F.broadcast(windows), "day").select("snapshot", "token", "day", "close")
    grid = inside.select("snapshot", "token").distinct().join(F.broadcast(windows), "snapshot").join(inside, ["snapshot", "token", "day"], "left")
    carried = F.last("close", ignorenulls=True).over(W.partitionBy("snapshot", "token").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return grid.withColumn("close", carried).filter("close IS NOT NULL")


def panel_returns(panel: DataFrame, kind: str = "log") -> DataFrame:
    """panel with ret; rows without a day before go."""
    before = F.lag("close").over(W.partitionBy("snapshot", "token").orderBy("day"))
    ret = F.log(F.col("close") / before) if kind == "log" else F.col("close") / before - 1
    return panel.withColumn("ret", ret).filter("ret IS NOT NULL")


def aligned_sets(sets: DataFrame, panel: DataFrame, min_days: int = 45) -> DataFrame:
    """snapshot, set_key, first_day, n_days, n_assets of asset sets (snapshot, set_key, token) with enough common days and two assets."""
    spans = panel.groupBy("snapshot", "token").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    rows = sets.join(spans, ["snapshot", "token"]).groupBy("snapshot", "set_key").agg(F.max("d0").alias("first_day"), F.max("d1").alias("last_day"), F.count("*").alias("n_assets"))
    rows = rows.withColumn("n_days", F.datediff("last_day", "first_day") + 1)
    return rows.filter((F.col("n_days") >= min_days) & (F.col("n_assets") >= 2)).drop("last_day")


def clipped(df: DataFrame, keys: list[str], col: str, q: float) -> DataFrame:
    """col clipped at its quantiles q and 1 - q within keys."""
    cuts = df.groupBy(*keys).agg(F.percentile(col, F.array(F.lit(q), F.lit(1 - q))).alias("_q"))
    joined = df.join(cuts, keys) if keys else df.crossJoin(cuts)
    return joined.withColumn(col, F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(col)))).drop("_q")


def covariance(returns: DataFrame, pairs: DataFrame | None = None, shrink: float = 0.0) -> DataFrame:
    """snapshot, a, b, cov (sample) of token pairs on their common days; shrink moves off-diagonals toward 0. pairs limits (snapshot, a, b)."""
    left, right = returns.select("snapshot", "day", F.col("token").alias("a"), F.col("ret").alias("x")), returns.select("snapshot", "day", F.col("token").alias("b"), F.col("ret").alias("y"))
    if pairs is not None:
        left = left.join(pairs, ["snapshot", "a"])
        rows = left.join(right, ["snapshot", "day", "b"])
    else:
        rows = left.join(right, ["snapshot", "day"])
    out = rows.groupBy("snapshot", "a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))
    return out.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise((1 - shrink) * F.col("cov")))


def held_pairs(positions: DataFrame, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """snapshot, a, b: the distinct pairs of tokens that some account holds together, each with itself; of positions dealt by account only pairs are shuffled, each once a task."""
    sets = positions.groupBy(*keys).agg(F.collect_set("token").alias("tokens"))
    return sets.select("snapshot", "tokens", F.explode("tokens").alias("a")).select("snapshot", "a", F.explode("tokens").alias("b")).distinct()


def trimmed_mean(df: DataFrame, keys: list[str], col: str, frac: float = 0.05) -> DataFrame:
    """keys, mean of col without the floor(frac * n) least and greatest values."""
    by = W.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(by.orderBy(col))).withColumn("_n", F.count("*").over(by)).withColumn("_k", F.floor(F.col("_n") * frac))
    return rows.filter((F.col("_r") > F.col("_k")) & (F.col("_r") <= F.col("_n") - F.col("_k"))).groupBy(*keys).agg(F.avg(col).alias("mu"))


def shrink_mean(df: DataFrame, set_key: list[str], lam: float = 0.5) -> DataFrame:
    """mu moved toward its mean over the set."""
    return df.withColumn("mu", lam * F.avg("mu").over(W.partitionBy(*set_key)) + (1 - lam) * F.col("mu"))


def capped_weights(df: DataFrame, key: list[str], cap: float = 0.9) -> DataFrame:
    """df with weight: the share of value, capped, the excess shared pro rata by those below the cap until none is above it.

    Shares are sorted once, largest first. With the first k at the cap, the rest scale by (1 - k cap) / (1 - their sum);
    a share is capped if, with all larger ones capped, it would still be above. Where caps do not sum to 1, or all that is
    not capped sums to nothing, all weigh the same.
    """
    by = W.partitionBy(*key)
    first = by.orderBy(F.desc("_w")).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_w", F.col("value") / F.sum("value").over(by)).withColumn("_before", F.coalesce(F.sum("_w").over(first), F.lit(0.0))).withColumn("_k", F.row_number().over(by.orderBy(F.desc("_w"))) - 1).withColumn("_n", F.count("*").over(by))
    scale = F.try_divide(1 - F.col("_k") * cap, 1 - F.col("_before"))
    rows = rows.withColumn("_over", (F.col("_w") * scale > cap * (1 + 1e-12)) & (F.col("_before") < 1 - 1e-18))
    rows = rows.withColumn("_over", F.coalesce("_over", F.lit(False)))
    rows = rows.withColumn("_c", F.count_if("_over").over(by)).withColumn("_s", F.sum(F.when(F.col("_over"), F.col("_w")).otherwise(0.0)).over(by))
    same = (F.col("_n") * cap <= 1 + 1e-12) | (F.col("_c") > 0) & (1 - F.col("_s") <= 1e-18)
    weight = F.when(same, 1 / F.col("_n")).when(F.col("_over"), cap).when(F.col("_c") > 0, F.col("_w") * F.try_divide(1 - F.col("_c") * cap, 1 - F.col("_s"))).otherwise(F.col("_w"))
    return rows.withColumn("weight", weight).drop("_w", "_before", "_k", "_n", "_over", "_c", "_s")


def naive_weights(df: DataFrame, key: list[str], kind: str) -> DataFrame:
    """df with weight: equal, or by cap, null for the set if any cap is missing."""
    by = W.partitionBy(*key)
    if kind == "equal":
        return df.withColumn("weight", 1 / F.count("*").over(by))
    whole = F.count("cap").over(by) == F.count("*").over(by)
    return df.withColumn("weight", F.when(whole, F.col("cap") / F.sum("cap").over(by)))


def horizon_prices(grid: DataFrame, prices: DataFrame, snapshots: dict[int, date], days: int = 20, max_age: int = 3) -> DataFrame:
    """snapshot, token, p0, p1: closes the day before each snapshot and so many days later, at most max_age days old.

    grid has the distinct (snapshot, token) in question: prices are found once for each, not for each position.
    """
    days_of = F.create_map(*[F.lit(x) for b, d in snapshots.items() for x in (b, d)])
    ends = grid.select("snapshot", "token").withColumn("d0", F.date_sub(F.element_at(days_of, F.col("snapshot")), 1)).withColumn("d1", F.date_add("d0", days))
    renamed = prices.select("token", F.col("day").alias("price_day"), "close")
    a = asof_join(ends, renamed, ["token"], "d0", "price_day", max_age).select("token", "snapshot", "d1", F.col("close").alias("p0"))
    return asof_join(a, renamed, ["token"], "d1", "price_day", max_age).select("snapshot", "token", "p0", F.col("close").alias("p1"))


def forward_return(weights: DataFrame, horizon: DataFrame, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, ret: the value change of a portfolio bought at weight; null if a price is missing."""
    rows = weights.join(horizon, ["token", "snapshot"])
    return rows.groupBy(*keys).agg(held_return(F.col("weight")).alias("ret"))


def held_return(weight: Column) -> Column:
    """Aggregate: sum of weight * p1 / p0, less one; null if a price is missing."""
    whole = F.count_if(F.col("p0").isNull() | F.col("p1").isNull() | weight.isNull()) == 0
    return F.when(whole, F.sum(weight * (F.col("p1") / F.col("p0"))) - 1)


def units(weight: Column, value: Column, price: Column) -> Column:
    return weight * value / price


def market_daily(panel_rets: DataFrame, benchmarks: tuple[str, ...]) -> DataFrame:
    """snapshot, day, mkt: mean return of the benchmarks on days that all have."""
    rows = panel_rets.filter(F.col("token").isin(*benchmarks)).groupBy("snapshot", "day").agg(F.avg("ret").alias("mkt"), F.count("*").alias("n"))
    return rows.filter(F.col("n") == len(benchmarks)).drop("n")


def token_betas(returns: DataFrame, market: DataFrame, min_obs: int = 20) -> DataFrame:
    """snapshot, token, beta, alpha, r2, n of an ordinary least squares fit on the market."""
    rows = returns.join(market, ["snapshot", "day"]).groupBy("snapshot", "token").agg(F.regr_slope("ret", "mkt").alias("beta"), F.regr_intercept("ret", "mkt").alias("alpha"), F.regr_r2("ret", "mkt").alias("r2"), F.count("*").alias("n"))
    return rows.filter(F.col("n") >= min_obs)


def portfolio_beta(weights: DataFrame, betas: DataFrame, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, beta: weighted betas, a missing one counting as 1."""
    rows = weights.join(betas.select("snapshot", "token", "beta"), ["snapshot", "token"], "left")
    return rows.groupBy(*keys).agg(weighted_beta(F.col("weight")).alias("beta"))


def weighted_beta(weight: Column) -> Column:
    """Aggregate: sum of weight * beta, a missing beta counting as 1."""
    return F.sum(weight * F.coalesce("beta", F.lit(1.0)))


def l1(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, l1: the sum of absolute differences of two sets of weights over all tokens: one aggregation of their union."""
    both = a.select(*keys, "token", F.col("weight").alias("w")).unionByName(b.select(*keys, "token", (-F.col("weight")).alias("w")))
    return both.groupBy(*keys, "token").agg(F.abs(F.sum("w")).alias("d")).groupBy(*keys).agg(F.sum("d").alias("l1"))


def portfolio_metrics(weights: DataFrame, mu: DataFrame, cov: DataFrame, keys: tuple[str, ...] = ("snapshot", "address"), rf: float = 0.0, days: int = 365) -> DataFrame:
    """keys, expected return, variance, volatility and Sharpe ratio, a year of days: a quadratic form over an account's own pairs, exploded within its row."""
    held = weights.groupBy(*keys).agg(F.collect_list(F.struct("token", "weight")).alias("p"))
    pairs = held.select(*keys, "p", F.posexplode("p").alias("i", "x")).select(*keys, "i", "x", F.posexplode("p").alias("j", "y"))
    pairs = pairs.select(*keys, F.col("x.token").alias("a"), F.col("y.token").alias("b"), (F.col("x.weight") * F.col("y.weight")).alias("w"), F.when(F.col("i") == F.col("j"), F.col("x.weight")).alias("own"))
    known = pairs.join(mu.select("snapshot", F.col("token").alias("a"), "mu", F.lit(1).alias("_m")), ["snapshot", "a"], "left").join(cov.select("snapshot", "a", "b", "cov", F.lit(1).alias("_c")), ["snapshot", "a", "b"], "left")
    # Both sums in one aggregation: a join of the two would deal the accounts again. Accounts without any mean or covariance go.
    rows = known.groupBy(*keys).agg((F.sum(F.col("own") * F.col("mu")) * days).alias("expected"), (F.sum(F.col("w") * F.col("cov")) * days).alias("variance"), F.count("_m").alias("_m"), F.count("_c").alias("_c"))
    rows = rows.filter("_m > 0 AND _c > 0").drop("_m", "_c").withColumn("volatility", F.sqrt(F.greatest("variance", F.lit(0.0))))
    return rows.withColumn("sharpe", F.try_divide(F.col("expected") - rf, F.col("volatility")))


def path_metrics(weights: DataFrame, prices: DataFrame, snapshots: dict[int, date], days: int = 20, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, n_days, total, volatility (a year), max_drawdown of a portfolio bought at weight and held: its value by day, prices carried forward; days before all assets have a price go."""
    spans = F.explode(F.array(*[F.struct(F.lit(b).alias("snapshot"), F.lit(d).alias("at")) for b, d in snapshots.items()])).alias("s")
    windows = prices.sparkSession.range(1).select(spans).select("s.snapshot", F.explode(F.sequence(F.date_sub("s.at", 4), F.date_add("s.at", days - 1))).alias("day"), "s.at")
    inside = prices.join(windows, "day").select("snapshot", "token", "day", "close")
    grid = inside.select("snapshot", "token").distinct().join(windows, "snapshot").join(inside, ["snapshot", "token", "day"], "left")
    carried = F.last("close", ignorenulls=True).over(W.partitionBy("snapshot", "token").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    closes = grid.withColumn("close", carried).filter(F.col("day") >= F.date_sub("at", 1))
    first = F.first("close").over(W.partitionBy("snapshot", "token").orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    growth = closes.withColumn("g", F.col("close") / first).select("snapshot", "token", "day", "g")
    growth = saved(growth, "growth")  # tokens times days, so that Spark sees how few they are
    counted = weights.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    value = counted.join(growth, ["snapshot", "token"]).groupBy(*keys, "day").agg(F.sum(F.col("weight") * F.col("g")).alias("v"), F.count("g").alias("c"), F.max("_n").alias("n")).filter("c = n")
    by = W.partitionBy(*keys).orderBy("day")
    rows = value.withColumn("r", F.log(F.col("v") / F.lag("v").over(by))).withColumn("dd", F.col("v") / F.max("v").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_days"), (F.max_by("v", "day") / F.min_by("v", "day") - 1).alias("total"), (F.stddev("r") * F.sqrt(F.lit(365.0))).alias("volatility"), F.min("dd").alias("max_drawdown"))


def index_tokens(positions: DataFrame, k: int) -> DataFrame:
    """snapshot, token: the k tokens that most accounts hold; ties by name."""
    held = positions.groupBy("snapshot", "token").agg(F.count("*").alias("n"))
    return held.withColumn("_r", F.row_number().over(W.partitionBy("snapshot").orderBy(F.desc("n"), "token"))).filter(F.col("_r") <= k).drop("_r")


def regime(positions: DataFrame, returns: DataFrame, market: DataFrame, k: int = 30, t_least: float = 1.0) -> DataFrame:
    """snapshot, n, mean, t_stat, regime of an index: the k most held tokens' mean return, blended half with the market's."""
    index = returns.join(index_tokens(positions, k).select("snapshot", "token"), ["snapshot", "token"]).groupBy("snapshot", "day").agg(F.avg("ret").alias("idx"))
    daily = index.join(market, ["snapshot", "day"]).withColumn("r", 0.5 * F.col("idx") + 0.5 * F.col("mkt"))
    rows = daily.groupBy("snapshot").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev("r").alias("_s"))
    t = F.try_divide(F.col("mean"), F.col("_s") / F.sqrt("n"))
    label = F.when(t.isNull(), "UNKNOWN").when((t >= t_least) & (F.col("mean") > 0), "BULLISH").when((t <= -t_least) & (F.col("mean") < 0), "BEARISH").otherwise("SIDEWAYS")
    return rows.withColumn("t_stat", t).withColumn("regime", label).drop("_s")


def alpha(ret: Column, beta: Column, market: Column) -> Column:
    return ret - beta * market


def status_and_score(mean_pp: Column, median_pp: Column, hit_rate: Column) -> tuple[Column, Column]:
    """BETTER or WORSE where both differences agree in sign, else MIXED; and a score that weighs them and the hit rate."""
    better, worse = (mean_pp > 0) & (median_pp > 0), (mean_pp < 0) & (median_pp < 0)
    return F.when(better, "BETTER").when(worse, "WORSE").otherwise("MIXED"), 0.5 * mean_pp + 0.3 * median_pp + 0.2 * (hit_rate - 0.5) * 100


def summary(wallets: DataFrame, strategies: list[str], baseline: str, dims: list[str]) -> DataFrame:
    """snapshot, dims ('ALL' too), strategy: mean, median, hit rate against the baseline, and the difference in percentage points with its status; means of the market return and, where wallets has them, of l1_<strategy> and beta_<strategy>, and the share of fallback_<strategy>.

    wallets has ret_<strategy> columns; one pass turns them to rows, each once for every grouping that it is in.
    """
    from tessera.operators.panels import cube_rows
    from tessera.operators.ranks import with_quantiles

    more = {k: [s for s in strategies if f"{k}_{s}" in wallets.columns] for k in ("l1", "beta", "fallback")}

    def fields(s: str) -> list[Column]:
        extra = [(F.col(f"{k}_{s}").cast("double") if s in names else F.lit(None).cast("double")).alias(k) for k, names in more.items()]
        return [F.lit(s).alias("strategy"), F.col(f"ret_{s}").alias("ret"), *extra]

    market = F.col("market") if "market" in wallets.columns else F.lit(None).cast("double")
    rows = wallets.select("snapshot", *dims, market.alias("market"), F.col(f"ret_{baseline}").alias("_base"), F.explode(F.array(*[F.struct(*fields(s)) for s in strategies])).alias("x")).select("snapshot", *dims, "_base", "market", "x.*").filter("ret IS NOT NULL AND _base IS NOT NULL")
    keys = ["snapshot", "strategy", *dims]
    every = cube_rows(rows, keys, always=("snapshot", "strategy"))
    means = [F.max("market").alias("market"), F.avg("l1").alias("mean_l1"), F.avg("beta").alias("mean_beta"), F.avg("fallback").alias("fallback_rate")]
    out = every.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > F.col("_base")).cast("int")).alias("hit_rate"), ((F.avg("ret") - F.avg("_base")) * 100).alias("diff_mean_pp"), *means)
    out = with_quantiles(out, every, keys, {"median": ("ret", 0.5), "_mb": ("_base", 0.5)}).withColumn("diff_median_pp", (F.col("median") - F.col("_mb")) * 100).drop("_mb")
    status, score = status_and_score(F.col("diff_mean_pp"), F.col("diff_median_pp"), F.col("hit_rate"))
    return out.withColumn("status", status).withColumn("score", score)


def strategy_outcomes(weights: DataFrame, horizon: DataFrame, betas: DataFrame, strategies: list[str], keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, total, and of each strategy ret_, l1_ (distance from the current weights), beta_ and, where weights has the column, fallback_: one aggregation of positions.

    weights has a row per position with value, weight and w_<strategy>; a strategy with a missing weight or price has no
    return, and one with a missing weight no distance or beta. A token without beta counts as 1.
    """
    rows = weights.join(horizon, ["token", "snapshot"]).join(betas.select("snapshot", "token", F.col("beta").alias("_b")), ["snapshot", "token"], "left")
    aggs = [F.sum("value").alias("total")]
    for s in strategies:
        w = F.col(f"w_{s}")
        whole = F.count_if(w.isNull()) == 0
        aggs += [held_return(w).alias(f"ret_{s}"), F.when(whole, F.sum(F.abs(F.col("weight") - w))).alias(f"l1_{s}"), F.when(whole, F.sum(w * F.coalesce("_b", F.lit(1.0)))).alias(f"beta_{s}")]
        if f"fallback_{s}" in weights.columns:
            aggs.append(F.coalesce(F.bool_or(f"fallback_{s}"), F.lit(False)).alias(f"fallback_{s}"))
    return rows.groupBy(*keys).agg(*aggs)


def block_summary(wallets: DataFrame, strategies: list[str], baseline: str, dims: list[str], digits: int | None = 9) -> DataFrame:
    """snapshot, dims, strategy: rows with a return, means and medians of return, distance, beta, baseline and market, the hit rate against the baseline, and the share of fallbacks.

    wallets has ret_, and may have l1_, beta_ and fallback_, of each strategy, the baseline's own among them. Baseline and
    market figures are of all rows of the group, as is the share of fallbacks. The baseline has no hit rate and no distance.
    Ratios are rounded far below their meaning first, so that the order of sums decides no comparison; digits None leaves
    those as they are that were rounded when they were stored, as each figure here reads them several times.
    """
    from tessera.operators.ranks import with_quantiles

    there = set(wallets.columns)
    rounded = lambda c: F.col(c) if digits is None else F.round(c, digits)
    of = lambda k, s: (rounded(f"{k}_{s}") if f"{k}_{s}" in there else F.lit(None).cast("double")).alias(k)

    def fields(s: str) -> Column:
        flag = F.col(f"fallback_{s}").cast("double") if f"fallback_{s}" in there else F.lit(None).cast("double")
        far = F.lit(None).cast("double").alias("l1") if s == baseline else of("l1", s)
        return F.struct(F.lit(s).alias("strategy"), of("ret", s), far, of("beta", s), flag.alias("fallback"))

    own = wallets.select("snapshot", *dims, rounded("market").alias("market"), rounded(f"ret_{baseline}").alias("base"))
    rows = wallets.select("snapshot", *dims, rounded(f"ret_{baseline}").alias("base"), F.explode(F.array(*map(fields, strategies))).alias("x")).select("snapshot", *dims, "base", "x.*")
    block, keys = ["snapshot", *dims], ["snapshot", *dims, "strategy"]
    hit = F.when((F.col("strategy") != baseline) & F.col("ret").isNotNull() & F.col("base").isNotNull(), (F.col("ret") > F.col("base")).cast("int"))
    means = {"strategy_mean": "ret", "l1_mean": "l1", "beta_mean": "beta", "fallback_rate": "fallback"}
    out = rows.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg(hit).alias("hit_rate"), *[F.avg(c).alias(name) for name, c in means.items()])
    out = with_quantiles(out, rows, keys, {"strategy_median": ("ret", 0.5), "l1_median": ("l1", 0.5), "beta_median": ("beta", 0.5)})
    # Baseline and market are the same for all strategies: once for each wallet.
    whole = with_quantiles(own.groupBy(*block).agg(F.avg("base").alias("baseline_mean"), F.avg("market").alias("market_mean")), own, block, {"baseline_median": ("base", 0.5), "market_median": ("market", 0.5)})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), block, F.lit(True))
    out = out.join(whole.withColumnsRenamed({k: f"_{k}" for k in block}), same).drop(*[f"_{k}" for k in block])
    figures = ("strategy", "l1", "beta", "baseline", "market")
    return out.select(*keys, "n", "hit_rate", *[f"{x}_mean" for x in figures], "fallback_rate", *[f"{x}_median" for x in figures])


def zero_counts(df: DataFrame, cols: list[str], near: float = 1e-6) -> DataFrame:
    """One row: for each distance, how many are exactly and nearly zero, and how many rows have all zero."""
    every = F.lit(True)
    for c in cols:
        every = every & (F.col(c) == 0)
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in cols], *[F.count_if(F.col(c) <= near).alias(f"near_{c}") for c in cols], F.count_if(every).alias("all_zero"))


def benchmark_check(wallets: DataFrame, benchmark: DataFrame, strategies: list[str]) -> DataFrame:
    """One row: snapshots, the greatest spread of the stored market return within one, snapshots without a benchmark return, the share of the others in which the benchmark beats the market, and, for each strategy, the median over snapshots of the share of its wallets that beat the benchmark.

    benchmark has snapshot and bench. Comparisons are on values rounded to 12 digits.
    """
    rows = wallets.join(benchmark, "snapshot", "left")
    beat = lambda s: F.avg((F.round(f"ret_{s}", 12) > F.round("bench", 12)).cast("int")).alias(f"_{s}")
    per = rows.groupBy("snapshot").agg((F.max("market") - F.min("market")).alias("_spread"), F.first("bench").alias("_bench"), F.max("market").alias("_market"), *map(beat, strategies))
    wins = F.avg((F.round("_bench", 12) > F.round("_market", 12)).cast("int"))
    return per.agg(F.count("*").alias("n"), F.max("_spread").alias("max_spread"), F.count_if(F.col("_bench").isNull()).alias("missing"), wins.alias("share_beats_market"), *[F.median(f"_{s}").alias(f"median_beat_{s}") for s in strategies])


def check_market(market: DataFrame, recomputed: DataFrame, tol: float = 1e-6) -> DataFrame:
    """One row: snapshots with both, greatest difference of stored and recomputed market return, shares where the stored is higher and within tol, and snapshots that only one side has; of no common snapshot the measures are null."""
    both = market.select("snapshot", "mkt").join(recomputed.select("snapshot", F.col("mkt").alias("again")), "snapshot", "full_outer")
    gap = F.col("mkt") - F.col("again")
    return both.agg(F.count(gap).alias("n"), F.max(F.abs(gap)).alias("max_diff"), F.avg((gap > 0).cast("int")).alias("share_higher"), F.avg((F.abs(gap) <= tol).cast("int")).alias("share_equal"), F.count_if(F.col("again").isNull() & F.col("mkt").isNotNull()).alias("only_stored"), F.count_if(F.col("mkt").isNull() & F.col("again").isNotNull()).alias("only_recomputed"))
