"""Queries over prices and forward returns: panels, betas, covariances, weights, regimes, portfolio outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import finance as f
from tessera.operators import balances as b, panels, positions as n, ranks
from tessera.functions import buckets as h
from tessera.plans.ctes import names, sql
from tessera.plans.ledger import DAYS, SNAPS
from tessera.plans.portfolio import folded, positions, r
from tessera.plans.registry import query
from tessera.sources import domain as d
from tessera.sources import tables as s

MARKS = ", ".join(f"({b}, DATE '{day}')" for b, day in DAYS.items())

ENDS = {
    "marks": f"SELECT * FROM (VALUES {MARKS}) v(snapshot, mark_day)",
    "ends": """SELECT m.snapshot, t.token, (SELECT arg_max(close, day) FROM prices p WHERE p.token = t.token AND p.day BETWEEN m.mark_day - 4 AND m.mark_day - 1) AS p0, (SELECT arg_max(close, day) FROM prices p WHERE p.token = t.token AND p.day BETWEEN m.mark_day + 16 AND m.mark_day + 19) AS p1
      FROM marks m, (SELECT DISTINCT token FROM prices) t""",
}
WALLETS = ENDS | {
    "base": "SELECT snapshot, address, token, value, value / sum(value) OVER (PARTITION BY snapshot, address) AS w, 1.0::DOUBLE / count(*) OVER (PARTITION BY snapshot, address) AS e FROM folded WHERE value > 0",
    "wal": f"""SELECT snapshot, address, count(*) AS n, round(sum(value), 6) AS total, round(max(w), 9) AS max_weight, round(sum(w * w), 9) AS hhi, round(sum(abs(w - e)), 9) AS l1, round(sum(CASE WHEN token IN ({names(d.CASH)}) THEN w ELSE 0 END), 9) AS cash,
      CASE WHEN count(*) FILTER (p0 IS NULL OR p1 IS NULL) = 0 THEN round(sum(w * (p1 / p0)) - 1, 9) END AS ret_base, CASE WHEN count(*) FILTER (p0 IS NULL OR p1 IS NULL) = 0 THEN round(sum(e * (p1 / p0)) - 1, 9) END AS ret_equal
      FROM base JOIN ends USING (snapshot, token) GROUP BY snapshot, address HAVING count(*) >= 2""",
    "mkt": f"SELECT snapshot, round(avg(p1 / p0 - 1), 9) AS market FROM ends WHERE token IN ({names(d.BENCHMARKS)}) GROUP BY snapshot HAVING count(p1 / p0) = {len(d.BENCHMARKS)}",
    "outcomes": "SELECT w.*, market, CASE WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' ELSE '10+' END AS size FROM wal w LEFT JOIN mkt USING (snapshot)",
}


def horizon(spark, sf):
    """Closes at both ends of each token's holding period; a stored table of tokens times snapshots, so that Spark sees how small it is."""
    p = d.prices(spark, sf)
    grid = p.select("token").distinct().select("token", F.explode(F.array(*map(F.lit, SNAPS))).alias("snapshot"))
    return s.stored(spark, sf, "horizon", lambda: f.horizon_prices(grid, p, DAYS))


def forward_market(spark, sf):
    rows = horizon(spark, sf).filter(F.col("token").isin(*d.BENCHMARKS)).withColumn("x", F.col("p1") / F.col("p0") - 1)
    return rows.groupBy("snapshot").agg(F.round(F.avg("x"), 9).alias("market"), F.count("x").alias("n")).filter(F.col("n") == len(d.BENCHMARKS)).drop("n")


def wallets(spark, sf):
    """The wallet-level table, worked out once for each session and read from the shared folder, where it is bucketed by address."""
    return s.stored(spark, sf, "wallets", lambda: outcomes(spark, sf), by="address")


def outcomes(spark, sf):
    """One aggregation of positions gives the baseline and the equal-weight portfolio's outcome and beta."""
    keys = ["address", "snapshot"]  # in this order rows sort by the first letters of an address, which tell most of them apart
    w = n.weights(folded(spark, sf), keys)
    w = f.naive_weights(w.withColumnRenamed("weight", "w"), keys, "equal").withColumnRenamed("weight", "e")
    ends = s.stored(spark, sf, "outlook", lambda: horizon(spark, sf).join(betas(spark, sf).select("snapshot", "token", "beta"), ["snapshot", "token"], "left"))
    rows = w.join(ends, ["snapshot", "token"])
    cash = F.when(F.col("token").isin(*d.CASH), F.col("w")).otherwise(0.0)
    out = rows.groupBy("snapshot", "address").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("w"), 9).alias("max_weight"), F.round(F.sum(F.col("w") * F.col("w")), 9).alias("hhi"), F.round(F.sum(F.abs(F.col("w") - F.col("e"))), 9).alias("l1"), F.round(F.sum(cash), 9).alias("cash"), F.round(f.held_return(F.col("w")), 9).alias("ret_base"), F.round(f.held_return(F.col("e")), 9).alias("ret_equal"), *[F.round(f.weighted_beta(F.col(c)), 6).alias(f"beta_{x}") for c, x in (("w", "base"), ("e", "equal"))]).filter("n >= 2")
    size = F.when(F.col("n") <= 4, "2-4").when(F.col("n") <= 9, "5-9").otherwise("10+")
    return out.join(forward_market(spark, sf), "snapshot", "left").withColumn("size", size)


def over_wallets(body: str, more: dict | None = None) -> str:
    return sql("folded prices", body, WALLETS | (more or {}))


@query("p13_forward_returns", over_wallets("SELECT snapshot, address, n, l1, ret_base, ret_equal, market FROM outcomes"))
def p13(spark, sf):
    return wallets(spark, sf).select("snapshot", "address", "n", "l1", "ret_base", "ret_equal", "market")


@query("p14_market_return", sql("prices", "SELECT * FROM mkt", {k: WALLETS[k] for k in ("marks", "ends", "mkt")}))
def p14(spark, sf):
    return forward_market(spark, sf)


@query("w11_returns", sql("daily", "SELECT token, day, close, round(CASE WHEN p > 0 AND close > 0 THEN ln(close / p) END, 9) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY token ORDER BY day) AS p FROM daily)"))
def w11(spark, sf):
    return ranks.returns(d.daily(spark, sf)).withColumn("ret", F.round("ret", 9))


FILLED = {"filled": "SELECT token, unnest(range(day::TIMESTAMP, coalesce(nd, day + 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day, close FROM (SELECT *, lead(day) OVER (PARTITION BY token ORDER BY day) AS nd FROM prices)"}


@query("w12_fill_forward", sql("prices", "SELECT token, count(*) AS n, round(sum(close), 4) AS total FROM filled GROUP BY token", FILLED))
def w12(spark, sf):
    return ranks.fill_forward(d.prices(spark, sf)).groupBy("token").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("w13_rolling_mean", sql("daily", "SELECT token, day, close, CASE WHEN count(*) OVER w = 7 THEN round(avg(close) OVER w, 9) END AS mean_7 FROM daily WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"))
def w13(spark, sf):
    return ranks.rolling_mean(d.daily(spark, sf), ["token"], "day", "close", 7).withColumn("mean_7", F.round("mean_7", 9))


@query("w14_market_state", sql("prices", """SELECT token, day, round(close / lag(close, 30) OVER o - 1, 6) AS mom_30, round(close / lag(close, 90) OVER o - 1, 6) AS mom_90, CASE WHEN count(ret) OVER m = 30 THEN round(stddev(ret) OVER m * sqrt(365.0), 4) END AS vol_30, round(close / max(close) OVER y - 1, 6) AS dd_365
  FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY token ORDER BY day)) AS ret FROM filled) WINDOW o AS (PARTITION BY token ORDER BY day), m AS (PARTITION BY token ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), y AS (PARTITION BY token ORDER BY day ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)""", FILLED))
def w14(spark, sf):
    return r(r(ranks.market_state(ranks.fill_forward(d.prices(spark, sf))).drop("close"), 6, "mom_30", "mom_90", "dd_365"), 4, "vol_30")


@query("w10_running", sql("daily", "SELECT token, day, round(sum(close) OVER w, 6) AS cum_close, round(sum(close) OVER w * 100.0 / sum(close) OVER (PARTITION BY token), 6) AS cum_pct FROM daily WINDOW w AS (PARTITION BY token ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def w10(spark, sf):
    return r(ranks.running(d.daily(spark, sf), ["token"], ["day"], "close").drop("close"))


PANEL = {
    "marks": ENDS["marks"],
    "grid": "SELECT snapshot, unnest(range((mark_day - 61)::TIMESTAMP, mark_day::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM marks",
    "seen": "SELECT DISTINCT snapshot, token FROM grid JOIN prices USING (day)",
    "panel": """SELECT * FROM (SELECT g.snapshot, s.token, g.day, last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.snapshot, s.token ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
      FROM grid g JOIN seen s USING (snapshot) LEFT JOIN prices p ON p.token = s.token AND p.day = g.day) WHERE close IS NOT NULL""",
    "rets": "SELECT * FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY snapshot, token ORDER BY day)) AS ret FROM panel) WHERE ret IS NOT NULL",
    "market": f"SELECT snapshot, day, avg(ret) AS mkt FROM rets WHERE token IN ({names(d.BENCHMARKS)}) GROUP BY snapshot, day HAVING count(*) = {len(d.BENCHMARKS)}",
    "betas": "SELECT snapshot, token, CASE WHEN max(mkt) > min(mkt) THEN regr_slope(ret, mkt) END AS beta, CASE WHEN max(mkt) > min(mkt) THEN regr_intercept(ret, mkt) END AS alpha, CASE WHEN max(mkt) > min(mkt) THEN regr_r2(ret, mkt) END AS r2, count(*) AS n FROM rets JOIN market USING (snapshot, day) GROUP BY snapshot, token HAVING count(*) >= 20",
}


def panel(spark, sf):
    return f.price_panel(d.prices(spark, sf), DAYS)


def panel_rets(spark, sf):
    return s.stored(spark, sf, "rets", lambda: f.panel_returns(panel(spark, sf)))


def betas(spark, sf):
    rets = panel_rets(spark, sf)
    return s.stored(spark, sf, "betas", lambda: f.token_betas(rets, f.market_daily(rets, d.BENCHMARKS)))


@query("p1_price_panel", sql("prices", "SELECT snapshot, token, count(*) AS n, round(sum(close), 4) AS total, min(day) AS first_day FROM panel GROUP BY snapshot, token", PANEL))
def p1(spark, sf):
    return panel(spark, sf).groupBy("snapshot", "token").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"), F.min("day").alias("first_day"))


@query("p2_aligned_sets", sql("folded prices", """SELECT snapshot, set_key, max(d0) AS first_day, count(*) AS n_assets, date_diff('day', max(d0), max(d1)) + 1 AS n_days FROM (SELECT DISTINCT snapshot, set_key, unnest(string_split(set_key, ',')) AS token FROM sets)
  JOIN (SELECT snapshot, token, min(day) AS d0, max(day) AS d1 FROM panel GROUP BY ALL) USING (snapshot, token) GROUP BY snapshot, set_key HAVING count(*) >= 2 AND date_diff('day', max(d0), max(d1)) + 1 >= 45""",
    PANEL | {"sets": "SELECT DISTINCT snapshot, string_agg(token, ',' ORDER BY token) AS set_key FROM folded WHERE value > 0 GROUP BY snapshot, address"}))
def p2(spark, sf):
    keys = folded(spark, sf).filter("value > 0").groupBy("snapshot", "address").agg(F.array_join(F.sort_array(F.collect_list("token")), ",").alias("set_key")).select("snapshot", "set_key").distinct()
    sets = keys.select("snapshot", "set_key", F.explode(F.split("set_key", ",")).alias("token"))
    return f.aligned_sets(sets, panel(spark, sf)).withColumn("n_days", F.col("n_days").cast("long"))


@query("p3_clipped_returns", sql("prices", "SELECT snapshot, token, round(avg(greatest(lo, least(hi, ret))), 9) AS mean FROM rets JOIN (SELECT snapshot, token, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM rets GROUP BY ALL) USING (snapshot, token) GROUP BY snapshot, token", PANEL))
def p3(spark, sf):
    return r(f.clipped(panel_rets(spark, sf), ["snapshot", "token"], "ret", 0.05).groupBy("snapshot", "token").agg(F.avg("ret").alias("mean")), 9)


HELD = {"held": "SELECT DISTINCT x.snapshot, x.token AS a, y.token AS b FROM folded x JOIN folded y ON x.snapshot = y.snapshot AND x.address = y.address WHERE x.value > 0 AND y.value > 0"}


@query("p4_covariance", sql("folded prices", "SELECT x.snapshot, x.token AS a, y.token AS b, round(CASE WHEN x.token = y.token THEN 1 ELSE 0.9 END * covar_samp(x.ret, y.ret), 9) AS cov, count(*) AS n FROM rets x JOIN rets y ON x.snapshot = y.snapshot AND x.day = y.day JOIN held h ON h.snapshot = x.snapshot AND h.a = x.token AND h.b = y.token GROUP BY x.snapshot, x.token, y.token", PANEL | HELD))
def p4(spark, sf):
    rets = panel_rets(spark, sf)
    return r(f.covariance(rets, f.held_pairs(folded(spark, sf).filter("value > 0")), shrink=0.1), 9)


MU = {"mu": "SELECT snapshot, token, avg(ret) AS mu FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, token ORDER BY ret) AS i, count(*) OVER (PARTITION BY snapshot, token) AS c FROM rets) WHERE i > floor(c * 0.05) AND i <= c - floor(c * 0.05) GROUP BY snapshot, token"}


@query("p5_trimmed_mean", sql("prices", "SELECT snapshot, token, round(mu, 10) AS mu FROM mu", PANEL | MU))
def p5(spark, sf):
    return r(f.trimmed_mean(panel_rets(spark, sf), ["snapshot", "token"], "ret"), 10)


@query("p6_shrunk_mean", sql("prices", "SELECT snapshot, token, round(0.5 * avg(mu) OVER (PARTITION BY snapshot) + 0.5 * mu, 10) AS mu FROM mu", PANEL | MU))
def p6(spark, sf):
    return r(f.shrink_mean(f.trimmed_mean(panel_rets(spark, sf), ["snapshot", "token"], "ret"), ["snapshot"]), 10)


CAPPED = {
    "base": WALLETS["base"],
    "m": "SELECT *, max(w) OVER (PARTITION BY snapshot, address) AS mx, count(*) OVER (PARTITION BY snapshot, address) AS k FROM base",
    "capped": "SELECT snapshot, address, token, CASE WHEN mx <= 0.9 THEN w WHEN 1 - mx <= 1e-18 THEN 1.0 / k WHEN w = mx THEN 0.9 ELSE w * (1 - 0.9::DOUBLE) / (1 - mx) END AS weight FROM m",
}


def capped(spark, sf):
    return f.capped_weights(folded(spark, sf).filter("value > 0"), ["snapshot", "address"]).select("snapshot", "address", "token", "weight")


@query("p7_capped_weights", sql("folded", "SELECT snapshot, address, round(max(weight), 8) AS max_weight, round(sum(weight), 8) AS total, count(*) AS n FROM capped GROUP BY snapshot, address", CAPPED))
def p7(spark, sf):
    return r(capped(spark, sf).groupBy("snapshot", "address").agg(F.max("weight").alias("max_weight"), F.sum("weight").alias("total"), F.count("*").alias("n")), 8)


@query("p11_naive_weights", sql("folded", "SELECT snapshot, address, round(max(e), 9) AS equal, round(max(w), 9) AS by_cap FROM base GROUP BY snapshot, address", {"base": CAPPED["base"]}))
def p11(spark, sf):
    rows = folded(spark, sf).filter("value > 0").withColumn("cap", F.col("value"))
    equal = f.naive_weights(rows, ["snapshot", "address"], "equal").withColumnRenamed("weight", "e")
    both = f.naive_weights(equal, ["snapshot", "address"], "cap")
    return r(both.groupBy("snapshot", "address").agg(F.max("e").alias("equal"), F.max("weight").alias("by_cap")), 9)


@query("p12_units", sql("folded prices", "SELECT snapshot, address, token, round(w * v0 / p0, 6) AS units FROM (SELECT *, sum(value) OVER (PARTITION BY snapshot, address) AS v0 FROM base) JOIN ends USING (snapshot, token) WHERE p0 IS NOT NULL", WALLETS))
def p12(spark, sf):
    from pyspark.sql import Window as W

    rows = n.weights(folded(spark, sf)).withColumn("v0", F.sum("value").over(W.partitionBy("snapshot", "address")))
    return rows.join(horizon(spark, sf), ["snapshot", "token"]).filter("p0 IS NOT NULL").select("snapshot", "address", "token", F.round(f.units(F.col("weight"), F.col("v0"), F.col("p0")), 6).alias("units"))


@query("p15_token_betas", sql("prices", "SELECT snapshot, token, round(beta, 7) AS beta, round(alpha, 9) AS alpha, round(r2, 7) AS r2, n FROM betas", PANEL))
def p15(spark, sf):
    return betas(spark, sf).select("snapshot", "token", F.round("beta", 7).alias("beta"), F.round("alpha", 9).alias("alpha"), F.round("r2", 7).alias("r2"), "n")


@query("p16_portfolio_beta", sql("folded prices", "SELECT snapshot, address, round(sum(w * coalesce(beta, 1)), 6) AS beta FROM base LEFT JOIN betas USING (snapshot, token) GROUP BY snapshot, address", PANEL | {"base": CAPPED["base"]}))
def p16(spark, sf):
    return r(f.portfolio_beta(n.weights(folded(spark, sf)), betas(spark, sf)))


@query("p17_l1", sql("folded", "SELECT snapshot, address, round(sum(abs(w - e)), 7) AS l1 FROM base GROUP BY snapshot, address", {"base": CAPPED["base"]}))
def p17(spark, sf):
    w = n.weights(folded(spark, sf))
    return r(f.l1(w, f.naive_weights(w.drop("weight"), ["snapshot", "address"], "equal")), 7)


@query("p18_metrics", sql("folded prices", """SELECT snapshot, address, round(expected, 6) AS expected, round(variance, 6) AS variance FROM (SELECT snapshot, address, sum(w * mu) * 365 AS expected FROM base JOIN mu USING (snapshot, token) GROUP BY ALL) JOIN
  (SELECT x.snapshot, x.address, sum(x.w * y.w * cov) * 365 AS variance FROM base x JOIN base y ON x.snapshot = y.snapshot AND x.address = y.address JOIN cov c ON c.snapshot = x.snapshot AND c.a = x.token AND c.b = y.token GROUP BY ALL) USING (snapshot, address)""",
    PANEL | MU | {"base": CAPPED["base"], "cov": "SELECT x.snapshot, x.token AS a, y.token AS b, covar_samp(x.ret, y.ret) AS cov FROM rets x JOIN rets y ON x.snapshot = y.snapshot AND x.day = y.day GROUP BY ALL"}))
def p18(spark, sf):
    rets = panel_rets(spark, sf)
    w = n.weights(folded(spark, sf))
    # Tables of tokens and of pairs of tokens are written first, so that Spark sees how small they are.
    mu, cov = s.saved(f.trimmed_mean(rets, ["snapshot", "token"], "ret"), "means"), s.saved(f.covariance(rets, f.held_pairs(w)), "covariances")
    rows = f.portfolio_metrics(w, mu, cov)
    return r(rows.select("snapshot", "address", "expected", "variance"))


@query("p18_path", sql("folded prices", """SELECT snapshot, address, count(*) AS n_days, round(arg_max(v, day) / arg_min(v, day) - 1, 7) AS total, round(stddev(x) * sqrt(365.0), 6) AS volatility, round(min(v / top - 1), 7) AS max_drawdown
  FROM (SELECT *, ln(v / lag(v) OVER (PARTITION BY snapshot, address ORDER BY day)) AS x, max(v) OVER (PARTITION BY snapshot, address ORDER BY day) AS top FROM worth) GROUP BY snapshot, address""", {"marks": ENDS["marks"], "base": WALLETS["base"],
    "win": "SELECT snapshot, mark_day, unnest(range((mark_day - 4)::TIMESTAMP, (mark_day + 20)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM marks",
    "tok": "SELECT DISTINCT snapshot, token FROM win JOIN prices USING (day)",
    "filled": "SELECT g.snapshot, t.token, g.day, g.mark_day, last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.snapshot, t.token ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM win g JOIN tok t USING (snapshot) LEFT JOIN prices p ON p.token = t.token AND p.day = g.day",
    "grown": "SELECT snapshot, token, day, close / first_value(close) OVER (PARTITION BY snapshot, token ORDER BY day) AS g FROM filled WHERE day >= mark_day - 1",
    "worth": "SELECT b.snapshot, b.address, day, sum(w * g) AS v FROM base b JOIN grown USING (snapshot, token) GROUP BY b.snapshot, b.address, day HAVING count(g) = (SELECT count(*) FROM base x WHERE x.snapshot = b.snapshot AND x.address = b.address)"}))
def p18_path(spark, sf):
    rows = f.path_metrics(n.weights(folded(spark, sf)), d.prices(spark, sf), DAYS)
    return r(r(rows, 7, "total", "max_drawdown"), 6, "volatility")


@query("p19_regime", sql("positions prices", """SELECT snapshot, count(*) AS n, round(avg(x), 9) AS mean, round(avg(x) / nullif(stddev(x) / sqrt(count(*)), 0), 6) AS t_stat, CASE WHEN coalesce(stddev(x), 0) = 0 THEN 'UNKNOWN' WHEN avg(x) / (stddev(x) / sqrt(count(*))) >= 1 AND avg(x) > 0 THEN 'BULLISH' WHEN avg(x) / (stddev(x) / sqrt(count(*))) <= -1 AND avg(x) < 0 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS regime
  FROM (SELECT snapshot, day, 0.5 * avg(ret) + 0.5 * max(mkt) AS x FROM rets JOIN top USING (snapshot, token) JOIN market USING (snapshot, day) GROUP BY snapshot, day) GROUP BY snapshot""",
    PANEL | {"top": "SELECT snapshot, token FROM positions GROUP BY snapshot, token QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY count(*) DESC, token) <= 10"}))
def p19(spark, sf):
    rets = panel_rets(spark, sf)
    rows = f.regime(positions(spark, sf), rets, f.market_daily(rets, d.BENCHMARKS), k=10)
    return rows.select("snapshot", "n", F.round("mean", 9).alias("mean"), F.round("t_stat", 6).alias("t_stat"), "regime")


@query("p20_alpha", over_wallets("SELECT snapshot, round(avg(ret_base - market), 8) AS alpha_base, round(avg(ret_equal - market), 8) AS alpha_equal, round(avg(ret_equal - ret_base), 8) AS diff FROM outcomes GROUP BY snapshot"))
def p20(spark, sf):
    one = F.lit(1.0)
    return r(wallets(spark, sf).groupBy("snapshot").agg(F.avg(f.alpha(F.col("ret_base"), one, F.col("market"))).alias("alpha_base"), F.avg(f.alpha(F.col("ret_equal"), one, F.col("market"))).alias("alpha_equal"), F.avg(F.col("ret_equal") - F.col("ret_base")).alias("diff")), 8)


@query("p21_summary", over_wallets("""SELECT snapshot, strategy, size, n, round(mean, 7) AS mean, round(median, 9) AS median, round(hit_rate, 8) AS hit_rate, round(dm, 6) AS diff_mean_pp, round(dd, 6) AS diff_median_pp, round(market, 8) AS market, round(l1, 8) AS mean_l1, round(beta, 5) AS mean_beta, NULL::DOUBLE AS fallback_rate, CASE WHEN dm > 0 AND dd > 0 THEN 'BETTER' WHEN dm < 0 AND dd < 0 THEN 'WORSE' ELSE 'MIXED' END AS status,
  round(0.5 * dm + 0.3 * dd + 0.2 * (hit_rate - 0.5) * 100, 6) AS score FROM (SELECT snapshot, strategy, coalesce(size, 'ALL') AS size, count(*) AS n, avg(ret) AS mean, median(ret) AS median, avg(CASE WHEN ret > b THEN 1 ELSE 0 END) AS hit_rate, (avg(ret) - avg(b)) * 100 AS dm, (median(ret) - median(b)) * 100 AS dd, max(market) AS market, avg(l1) AS l1, avg(beta) AS beta
  FROM (SELECT snapshot, size, 'base' AS strategy, ret_base AS ret, ret_base AS b, market, 0.0 AS l1, round(pb, 6) AS beta FROM outcomes LEFT JOIN pbeta USING (snapshot, address) UNION ALL SELECT snapshot, size, 'equal', ret_equal, ret_base, market, l1, round(eb, 6) FROM outcomes LEFT JOIN pbeta USING (snapshot, address)) WHERE ret IS NOT NULL AND b IS NOT NULL GROUP BY GROUPING SETS ((snapshot, strategy, size), (snapshot, strategy)))""",
  {k: v for k, v in PANEL.items() if k != "marks"} | {"pbeta": "SELECT snapshot, address, sum(w * coalesce(beta, 1)) AS pb, sum(e * coalesce(beta, 1)) AS eb FROM base LEFT JOIN betas USING (snapshot, token) GROUP BY ALL"}))
def p21(spark, sf):
    rows = wallets(spark, sf).withColumn("l1_base", F.lit(0.0)).withColumnRenamed("l1", "l1_equal")
    out = f.summary(rows, ["base", "equal"], "base", ["size"])
    return r(out.withColumns({c: F.round(c, k) for c, k in (("mean", 7), ("median", 9), ("hit_rate", 8), ("market", 8), ("mean_l1", 8), ("mean_beta", 5))}), 6, "diff_mean_pp", "diff_median_pp", "score")


BY_WEALTH = {k: v for k, v in PANEL.items() if k != "marks"} | {
    "mx": CAPPED["m"], "capped": CAPPED["capped"].replace("FROM m", "FROM mx"),
    "supplies": "SELECT token, snapshot, sum(CASE WHEN sender IS NULL THEN value ELSE -value END)::DOUBLE AS supply FROM transfers JOIN snaps ON block <= snapshot WHERE sender IS NULL OR recipient IS NULL GROUP BY ALL HAVING sum(CASE WHEN sender IS NULL THEN value ELSE -value END) <> 0",
    "caps": "SELECT snapshot, token, CASE WHEN supply > 0 AND p0 > 0 THEN supply * p0 END AS cap FROM supplies JOIN ends USING (snapshot, token)",
    "strat": """SELECT b.snapshot, b.address, b.token, b.value, weight AS w, e, p1 / p0 AS g, coalesce(beta, 1) AS beta, CASE WHEN count(cap) OVER x = count(*) OVER x THEN cap / sum(cap) OVER x END AS mc FROM base b JOIN capped USING (snapshot, address, token) LEFT JOIN ends USING (snapshot, token) LEFT JOIN betas USING (snapshot, token) LEFT JOIN caps USING (snapshot, token) WINDOW x AS (PARTITION BY b.snapshot, b.address)""",
    "acc": """SELECT snapshot, address, sum(value) AS total, sum(w * beta) AS b0, sum(e * beta) AS b1, CASE WHEN count(mc) = count(*) THEN sum(mc * beta) END AS b2, sum(abs(w - e)) AS l1, CASE WHEN count(mc) = count(*) THEN sum(abs(w - mc)) END AS l2,
      CASE WHEN count(g) = count(*) THEN sum(w * g) - 1 END AS r0, CASE WHEN count(g) = count(*) THEN sum(e * g) - 1 END AS r1, CASE WHEN count(g) = count(*) AND count(mc) = count(*) THEN sum(mc * g) - 1 END AS r2 FROM strat GROUP BY ALL HAVING count(*) >= 2""",
    "long": f"""SELECT snapshot, {h.bin_sql('total', h.BACKTEST_WEALTH, 'UNKNOWN')} AS wealth, round(r0, 9) AS base, market, unnest(['base', 'equal', 'mcap']) AS strategy, unnest([round(r0, 9), round(r1, 9), round(r2, 9)]) AS ret, unnest([NULL, round(l1, 9), round(l2, 9)]) AS l1, unnest([round(b0, 9), round(b1, 9), round(b2, 9)]) AS beta FROM acc LEFT JOIN mkt USING (snapshot)""",
}


def strategies(spark, sf, optimised):
    """(wallet outcomes, worked out once for each session; names) of the current, equal and market-cap weights and, if optimised, of the three goals."""
    names_ = ["base", "return", "variance", "sharpe", "equal", "mcap"] if optimised else ["base", "equal", "mcap"]
    return s.stored(spark, sf, "optimised" if optimised else "naive", lambda: strategy_rows(spark, sf, names_)), names_


def market_caps(spark, sf):
    """snapshot, token, cap; a stored table of tokens times snapshots, so that Spark sees how small it is and deals no positions to join it."""
    prices0 = horizon(spark, sf)
    return s.stored(spark, sf, "caps", lambda: b.supply_at(d.transfers(spark, sf), SNAPS).join(prices0, ["snapshot", "token"]).select("snapshot", "token", b.market_cap(F.col("supply").cast("double"), F.col("p0")).alias("cap")))


def strategy_rows(spark, sf, names_):
    """Outcomes of the strategies, with wealth bin and market return, of each wallet of two assets or more."""
    prices0, caps, slopes = horizon(spark, sf), market_caps(spark, sf), betas(spark, sf)
    if "sharpe" in names_:
        growth = prices0.select("snapshot", "token", F.try_divide("p1", "p0").alias("growth"))
        of_tokens = growth.join(slopes.select("snapshot", "token", "beta"), ["snapshot", "token"], "left").join(caps.withColumnRenamed("cap", "capital"), ["snapshot", "token"], "left")
        out = optimal(spark, sf, ("return", "variance", "sharpe"), kind="outcomes", of_tokens=of_tokens).drop("fallback_sharpe")
    else:
        from pyspark.sql import Window as W

        keys = ["address", "snapshot"]
        rows = folded(spark, sf).filter("value > 0").withColumn("value", F.col("value").cast("double")).withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter("_n >= 2").drop("_n")
        capped_rows = f.naive_weights(f.capped_weights(rows, keys).withColumnRenamed("weight", "w_base"), keys, "equal").withColumnRenamed("weight", "w_equal")
        every = f.naive_weights(capped_rows.join(caps, ["snapshot", "token"], "left"), keys, "cap").withColumnRenamed("weight", "w_mcap").withColumn("weight", F.col("w_base"))
        out = f.strategy_outcomes(every.select(*keys, "token", "value", "weight", *[f"w_{x}" for x in names_]), prices0, slopes, names_)
    out = out.join(forward_market(spark, sf), "snapshot", "left").withColumn("wealth", h.bin(F.col("total"), h.BACKTEST_WEALTH, "UNKNOWN"))
    out = out.drop("address", "total", "l1_base")  # what no summary of blocks reads
    return out.withColumns({c: F.round(c, 9) for c, t in out.dtypes if t == "double"})


@query("p21_wealth", sql("folded prices transfers snaps", """SELECT snapshot, wealth, strategy, count(ret) AS n, round(avg(CASE WHEN strategy <> 'base' AND ret IS NOT NULL AND base IS NOT NULL THEN (ret > base)::INTEGER END), 8) AS hit_rate, round(avg(ret), 7) AS strategy_mean, round(avg(l1), 7) AS l1_mean, round(avg(beta), 5) AS beta_mean, round(avg(base), 7) AS baseline_mean, round(max(market), 7) AS market_mean, NULL::DOUBLE AS fallback_rate,
  round(median(ret), 7) AS strategy_median, round(median(l1), 7) AS l1_median, round(median(beta), 5) AS beta_median, round(median(base), 7) AS baseline_median, round(max(market), 7) AS market_median FROM long GROUP BY snapshot, wealth, strategy""", WALLETS | BY_WEALTH))
def p21_wealth(spark, sf):
    rows, names_ = strategies(spark, sf, False)
    return r(r(f.block_summary(rows, names_, "base", ["wealth"], digits=None), 5, "beta_mean", "beta_median"), 7, *[f"{x}_{y}" for x in ("strategy", "l1", "baseline", "market") for y in ("mean", "median")])


@query("p21_strategies")
def p21_strategies(spark, sf):
    """All six strategies by wealth, the optimised ones with their share of fallbacks."""
    rows, names_ = strategies(spark, sf, True)
    return r(f.block_summary(rows, names_, "base", ["wealth"], digits=None))


@query("p23_zero_distance", over_wallets("SELECT count(*) AS n, count(*) FILTER (l1 = 0) AS zero_l1, count(*) FILTER (hhi = 0) AS zero_hhi, count(*) FILTER (l1 <= 1e-6) AS near_l1, count(*) FILTER (hhi <= 1e-6) AS near_hhi, count(*) FILTER (l1 = 0 AND hhi = 0) AS all_zero FROM outcomes"))
def p23(spark, sf):
    return f.zero_counts(wallets(spark, sf), ["l1", "hhi"])


@query("p29_check_market", sql("prices", """SELECT count(mkt - again) AS n, round(max(abs(mkt - again)), 7) AS max_diff, round(avg((abs(mkt - again) <= 1e-6)::INTEGER), 8) AS share_equal, count(*) FILTER (again IS NULL) AS only_stored, count(*) FILTER (mkt IS NULL) AS only_recomputed
  FROM (SELECT snapshot, market AS mkt FROM mkt) FULL JOIN (SELECT snapshot, sum(p1 / p0 / k) - 1 AS again FROM ends, (SELECT count(DISTINCT token) AS k FROM prices WHERE token IN ({0})) WHERE token IN ({0}) GROUP BY snapshot HAVING count(p1 / p0) = 2) USING (snapshot)""".format(names(d.BENCHMARKS)), {k: WALLETS[k] for k in ("marks", "ends", "mkt")}))
def p29(spark, sf):
    m = forward_market(spark, sf).withColumnRenamed("market", "mkt")
    # The other way: units of the benchmarks bought for an equal share each, sold at the end.
    w = horizon(spark, sf).filter(F.col("token").isin(*d.BENCHMARKS)).withColumn("weight", F.lit(1 / len(d.BENCHMARKS)))
    again = w.groupBy("snapshot").agg((F.sum(f.units(F.col("weight"), F.lit(1.0), F.col("p0")) * F.col("p1")) - 1).alias("mkt"), F.count(F.col("p1") / F.col("p0")).alias("k")).filter(F.col("k") == len(d.BENCHMARKS)).drop("k")
    return f.check_market(m, again).select("n", F.round("max_diff", 7).alias("max_diff"), F.round("share_equal", 8).alias("share_equal"), "only_stored", "only_recomputed")


@query("p29_benchmark", over_wallets(f"""SELECT count(*) AS n, max(spread) AS max_spread, count(*) FILTER (bench IS NULL) AS missing, round(avg((round(bench, 12) > round(market, 12))::INTEGER), 8) AS share_beats_market, round(median(b), 8) AS median_beat_base, round(median(e), 8) AS median_beat_equal
  FROM (SELECT snapshot, max(market) - min(market) AS spread, max(market) AS market, max(bench) AS bench, avg((round(ret_base, 12) > round(bench, 12))::INTEGER) AS b, avg((round(ret_equal, 12) > round(bench, 12))::INTEGER) AS e FROM outcomes LEFT JOIN (SELECT snapshot, p1 / p0 - 1 AS bench FROM ends WHERE token = '{d.NATIVE}') USING (snapshot) GROUP BY snapshot)"""))
def p29_benchmark(spark, sf):
    native = horizon(spark, sf).filter(F.col("token") == d.NATIVE).select("snapshot", (F.col("p1") / F.col("p0") - 1).alias("bench"))
    return r(f.benchmark_check(wallets(spark, sf), native, ["base", "equal"]), 8)


@query("h9_distance", over_wallets(f"SELECT {h.bin_sql('round(l1 * 50, 7)', h.DISTANCE)} AS bin, count(*) AS n FROM outcomes GROUP BY 1"))
def h9(spark, sf):
    return h.histogram(wallets(spark, sf), [], h.bin(F.round(F.col("l1") * 50, 7), h.DISTANCE))


@query("h10_return_bins", over_wallets(f"SELECT snapshot, {h.bin_sql('ret_base', h.RETURNS)} AS bin, count(*) AS n FROM outcomes GROUP BY ALL"))
def h10(spark, sf):
    return h.histogram(wallets(spark, sf), ["snapshot"], h.bin(F.col("ret_base"), h.RETURNS))


@query("h11_fixed_width", over_wallets("SELECT floor(greatest(-1, least(1, ret_base)) * 20) / 20 AS bin, count(*) AS n FROM outcomes GROUP BY 1"))
def h11(spark, sf):
    return h.histogram(wallets(spark, sf), [], h.fixed_width(F.col("ret_base"), 20, -1.0, 1.0))


@query("h12_ventiles", over_wallets("""SELECT ventile, count(*) AS n, round(avg(hhi), 8) AS mean_x, round(median(hhi), 8) AS median_x, round(avg(ret_base), 8) AS mean_y, round(median(ret_base), 8) AS median_y FROM (SELECT *, len(list_filter(e, lambda q: hhi > q)) + 1 AS ventile FROM outcomes, (SELECT quantile_disc(hhi, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS e FROM outcomes)) GROUP BY ventile"""))
def h12(spark, sf):
    return r(h.ventiles(wallets(spark, sf), "hhi", "ret_base"), 8).withColumn("ventile", F.col("ventile").cast("long"))


@query("h15_error_decades", over_wallets("SELECT CASE WHEN abs(ret_base - ret_equal) > 0 THEN floor(log10(round(abs(ret_base - ret_equal), 9)))::BIGINT END AS bin, count(*) AS n FROM outcomes WHERE abs(ret_base - ret_equal) > 1e-9 GROUP BY 1"))
def h15(spark, sf):
    gap = F.round(F.abs(F.col("ret_base") - F.col("ret_equal")), 9)
    return h.histogram(wallets(spark, sf).filter(F.abs(F.col("ret_base") - F.col("ret_equal")) > 1e-9), [], h.error_decade(gap))


@query("a12_correlations", over_wallets("SELECT unnest(['hhi', 'hhi', 'l1', 'l1']) AS x, unnest(['ret_base', 'ret_equal', 'ret_base', 'ret_equal']) AS y, round(unnest([corr(hhi, ret_base), corr(hhi, ret_equal), corr(l1, ret_base), corr(l1, ret_equal)]), 7) AS r FROM outcomes"))
def a12(spark, sf):
    return r(panels.corr_table(wallets(spark, sf), ["hhi", "l1"], ["ret_base", "ret_equal"]), 7)


@query("a13_present_share", over_wallets("SELECT snapshot, round(avg(CASE WHEN ret_base IS NOT NULL AND market IS NOT NULL THEN (ret_base > market)::INTEGER END), 8) AS beats FROM outcomes GROUP BY snapshot"))
def a13(spark, sf):
    return r(wallets(spark, sf).groupBy("snapshot").agg(panels.share(F.col("ret_base") > F.col("market"), F.col("ret_base"), F.col("market")).alias("beats")), 8)


@query("a20_growth", sql("daily", "SELECT arg_min(close, day) AS first_value, arg_max(close, day) AS last_value, min(day) AS first_day, max(day) AS last_day, round(pow(arg_max(close, day) / arg_min(close, day), 1 / (date_diff('day', min(day), max(day)) / 365.25)) - 1, 4) AS cagr, round((arg_max(close, day) - arg_min(close, day)) / (date_diff('day', min(day), max(day)) / 365.25), 6) AS per_year FROM daily WHERE token = 'view'"))
def a20(spark, sf):
    rows = panels.growth(d.daily(spark, sf).filter("token = 'view'"), "day", "close")
    return rows.withColumn("cagr", F.round("cagr", 4)).withColumn("per_year", F.round("per_year", 6))


@query("a21_monthly", sql("prices", "SELECT token, strftime(day, '%Y-%m') AS month, round(sum(close::DECIMAL(18,6))::DOUBLE / count(*), 3) AS mean, median(close) AS median, count(*) AS n FROM prices GROUP BY token, month"))
def a21(spark, sf):
    exact = d.prices(spark, sf).withColumn("close", F.col("close").cast("decimal(18,6)"))
    return panels.monthly(exact, ["token"], "day", "close").withColumn("mean", F.round("mean", 3))


@query("a22_daily_close", sql("daily", "SELECT * FROM daily"))
def a22(spark, sf):
    return panels.daily_close(d.ticks(spark, sf), ["ts", "event_id"])


@query("a23_daily_supply", "SELECT day, round(cap / price, 6) AS supply FROM (SELECT ts::DATE AS day, arg_max(value, ts) AS cap FROM events WHERE event_type = 'view' GROUP BY 1) JOIN (SELECT ts::DATE AS day, arg_max(value, ts) AS price FROM events WHERE event_type = 'click' GROUP BY 1) USING (day) WHERE price > 0")
def a23(spark, sf):
    t = d.ticks(spark, sf)
    caps, prices = t.filter("token = 'view'").withColumnRenamed("value", "cap"), t.filter("token = 'click'").withColumnRenamed("value", "price")
    return r(panels.daily_supply(caps, prices))


@query("a24_volume_status", sql("transfers", "SELECT token, round(sum(CASE WHEN date_diff('day', day, DATE '2001-11-05') < 1 THEN value ELSE 0 END)::DOUBLE, 4) AS recent, sum(value)::DOUBLE AS total, CASE WHEN sum(CASE WHEN date_diff('day', day, DATE '2001-11-05') < 1 THEN value ELSE 0 END) > 0 THEN 'good' WHEN sum(value) > 0 THEN 'good_all_time' ELSE 'bad' END AS status FROM transfers GROUP BY token"))
def a24(spark, sf):
    from datetime import date

    return panels.volume_status(d.transfers(spark, sf).select("token", "day", F.col("value").cast("double").alias("volume")), F.lit(date(2001, 11, 5)), 1)


@query("a25_peg", sql("prices", "SELECT token, count(*) AS days, round(median(close), 6) AS median_close, min(close) AS min_close, round(avg((abs(close / 1500 - 1) > 0.02)::INTEGER), 8) AS share_2pct, round(avg((abs(close / 1500 - 1) > 0.05)::INTEGER), 8) AS share_5pct, bool_or(abs(close / 1500 - 1) > 0.1) AS broke FROM prices GROUP BY token"))
def a25(spark, sf):
    rows = panels.peg_check(d.prices(spark, sf), 1500.0)
    return rows.withColumns({"median_close": F.round("median_close", 6), "share_2pct": F.round("share_2pct", 8), "share_5pct": F.round("share_5pct", 8)})


@query("a29_peaks", sql("daily", "SELECT max(a) AS peak, arg_max(day, (a, day)) AS peak_day, arg_max(a, day) AS last_value, round(min(a / nullif(b, 0)), 6) AS min_ratio, round(median(a / nullif(b, 0)), 6) AS median_ratio, round(max(a / nullif(b, 0)), 6) AS max_ratio FROM (SELECT day, max(close) FILTER (token = 'view') AS a, max(close) FILTER (token = 'click') AS b FROM daily GROUP BY day)"))
def a29(spark, sf):
    series = d.daily(spark, sf).groupBy("day").agg(F.max(F.when(F.col("token") == "view", F.col("close"))).alias("a"), F.max(F.when(F.col("token") == "click", F.col("close"))).alias("b"))
    rows = panels.peaks(series, "day", "a", "b")
    return rows.withColumns({c: F.round(c, 6) for c in ("min_ratio", "median_ratio", "max_ratio")})


@query("a31_token_year", sql("prices", "SELECT year, round(avg(m), 6) AS mean, round(median(m), 6) AS median, count(*) AS n_tokens FROM (SELECT year(day)::INTEGER AS year, token, avg(close) AS m FROM prices GROUP BY ALL) GROUP BY year"))
def a31(spark, sf):
    return r(panels.token_year(d.prices(spark, sf).withColumn("year", F.year("day")), [], "close"))


def optimal(spark, sf, goals=("sharpe", "return", "variance"), of_tokens=None, **how):
    """Portfolios of the goals named, of all wallets, made in the tasks that the wallets' values are dealt to: none is stored. of_tokens has more columns by snapshot and token."""
    from tessera.operators.optimise import optimise, set_inputs

    inputs = set_inputs(panel_rets(spark, sf))
    inputs = inputs if of_tokens is None else s.saved(inputs.join(of_tokens, ["snapshot", "token"], "left"), "inputs")
    return optimise(folded(spark, sf).filter("value > 0"), inputs, goals=goals, **how)


@query("p8_optimal_portfolios")
def p8(spark, sf):
    """Weights of the best ratio, by wallet and token; flagged where least variance stands for it."""
    return optimal(spark, sf, ("sharpe",)).select("snapshot", "address", "token", "weight", "w_sharpe", "fallback_sharpe")


@query("p9_same_variance")
def p9(spark, sf):
    """Weights of most return at the same variance; flagged where the best ratio stands for it."""
    return optimal(spark, sf, ("return",)).select("snapshot", "address", "token", "weight", "w_return", "fallback_return")


@query("p10_same_return")
def p10(spark, sf):
    """Weights of least variance at the same return."""
    return optimal(spark, sf, ("variance",)).select("snapshot", "address", "token", "weight", "w_variance", "fallback_variance")


@query("p21_fallback_rates")
def p21_fallbacks(spark, sf):
    """Wallets, mean distance of each goal's weights from the wallet's own, and the share of fallbacks, by snapshot."""
    goals = ("sharpe", "return", "variance")
    one = optimal(spark, sf, goals, kind="distances")
    return one.groupBy("snapshot").agg(F.count("*").alias("n"), *[F.round(F.avg(f"l1_{g}"), 6).alias(f"mean_l1_{g}") for g in goals], *[F.round(F.avg(F.col(f"fallback_{g}").cast("int")), 8).alias(f"fallback_rate_{g}") for g in goals])


@query("p28_rf_sensitivity")
def p28(spark, sf):
    """How far the best-ratio weights move when the risk-free rate goes from 0 to one basis point a day."""
    return optimal(spark, sf, ("sharpe",), other_rf=1e-4, kind="moves")
