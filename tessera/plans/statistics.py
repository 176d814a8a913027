"""Statistics over the wallet-level table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import finance as f
from tessera.operators import panels, ranks, stats as m
from tessera.operators.filters import with_outcome
from tessera.plans.portfolio import r
from tessera.plans.registry import query
from tessera.plans.returns import PANEL, over_wallets, wallets
from tessera.sources import domain as d

VALID = {"ok": "SELECT * FROM outcomes WHERE ret_base IS NOT NULL AND ret_equal IS NOT NULL AND market IS NOT NULL"}


def valid(spark, sf):
    return with_outcome(wallets(spark, sf), ["ret_base", "ret_equal", "market"])


def over_valid(body, more=None):
    return over_wallets(body, VALID | (more or {}))


@query("f17_with_outcome", over_valid("SELECT snapshot, count(*) AS n FROM ok GROUP BY snapshot"))
def f17(spark, sf):
    return valid(spark, sf).groupBy("snapshot").agg(F.count("*").alias("n"))


LONG = "(SELECT 'ret_base' AS col, ret_base AS v FROM ok UNION ALL SELECT 'hhi', hhi FROM ok)"


@query("m1_describe", over_valid(f"SELECT col, count(*) AS n, round(avg(v), 7) AS mean, round(stddev(v), 7) AS std, min(v) AS min, {', '.join(f'round(quantile_cont(v, {q}), 7) AS p{int(q * 100):02d}' for q in m.QS)}, max(v) AS max, round(avg((v > 0)::INTEGER), 7) AS share_pos, round(avg((v < 0)::INTEGER), 7) AS share_neg FROM {LONG} GROUP BY col"))
def m1(spark, sf):
    rows = m.describe(valid(spark, sf), ["ret_base", "hhi"])
    return r(rows, 7, "mean", "std", "share_pos", "share_neg", *[f"p{int(q * 100):02d}" for q in m.QS])


@query("m2_versus", over_valid("SELECT 'ret_equal' AS strategy, count(*) AS n, round(avg((NOT t AND d > 0)::INTEGER), 8) AS win, round(avg(t::INTEGER), 8) AS tie, round(avg((NOT t AND d < 0)::INTEGER), 8) AS loss, round(avg(d), 8) AS mean_diff, round(median(d), 8) AS median_diff FROM (SELECT ret_equal - ret_base AS d, coalesce(l1 <= 0.02, false) OR ret_equal = ret_base AS t FROM ok)"))
def m2(spark, sf):
    return r(m.versus(valid(spark, sf), "ret_base", ["ret_equal"], {"ret_equal": "l1"}), 8)


@query("m4_beat_margin", over_valid("SELECT snapshot, strategy, n, round(beat, 8) AS beat, round(unnest(q3), 7) AS margin, unnest([0.1, 0.5, 0.9])::DOUBLE AS q FROM (SELECT snapshot, strategy, count(*) AS n, avg((x > 0)::INTEGER) AS beat, quantile_cont(x, [0.1, 0.5, 0.9]) AS q3 FROM (SELECT snapshot, 'ret_base' AS strategy, ret_base - market AS x FROM ok UNION ALL SELECT snapshot, 'ret_equal', ret_equal - market FROM ok) GROUP BY snapshot, strategy)"))
def m4(spark, sf):
    rows = m.beat_margin(valid(spark, sf), ["snapshot"], ["ret_base", "ret_equal"], "market", [0.1, 0.5, 0.9])
    return r(r(rows, 8, "beat"), 7, "margin")


@query("m5_medians_by_size", over_valid("SELECT size, count(*) AS n, round(median(ret_base), 8) AS med_base, round(median(l1), 8) AS med_l1, round(avg(total), 3) AS mean_total FROM ok GROUP BY size"))
def m5(spark, sf):
    rows = valid(spark, sf).groupBy("size").agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"))
    rows = ranks.with_quantiles(rows, valid(spark, sf), ["size"], {"med_base": ("ret_base", 0.5), "med_l1": ("l1", 0.5)})
    return r(r(rows, 8, "med_base", "med_l1"), 3, "mean_total")


@query("m6_low_distance", over_valid("SELECT snapshot, count(*) AS n, round(avg(n), 7) AS mean_n, round(median(ret_base), 8) AS med FROM ok WHERE l1 <= 0.3 GROUP BY snapshot"))
def m6(spark, sf):
    low = valid(spark, sf).filter("l1 <= 0.3")
    rows = low.groupBy("snapshot").agg(F.count("*").alias("c"), F.avg("n").alias("mean_n")).withColumnRenamed("c", "n")
    rows = ranks.with_quantiles(rows, low, ["snapshot"], {"med": ("ret_base", 0.5)})
    return r(r(rows, 7, "mean_n"), 8, "med")


@query("m7_bucket_profile", over_valid("SELECT size, round(avg(n), 7) AS mean_n, round(quantile_cont(hhi, 0.25), 8) AS p25, round(quantile_cont(hhi, 0.75), 8) AS p75 FROM ok GROUP BY size"))
def m7(spark, sf):
    rows = ranks.with_quantiles(valid(spark, sf).groupBy("size").agg(F.avg("n").alias("mean_n")), valid(spark, sf), ["size"], {"p25": ("hhi", 0.25), "p75": ("hhi", 0.75)})
    return r(r(rows, 7, "mean_n"), 8, "p25", "p75")


@query("m8_distance_panel", over_valid("SELECT snapshot, coalesce(size, 'ALL') AS size, count(*) AS n, round(avg(l1), 8) AS mean_l1, round(median(l1), 8) AS median_l1 FROM ok GROUP BY GROUPING SETS ((snapshot, size), (snapshot))"))
def m8(spark, sf):
    every = panels.cube_rows(valid(spark, sf).select("snapshot", "size", "l1"), ["snapshot", "size"], always=("snapshot",))
    rows = every.groupBy("snapshot", "size").agg(F.count("*").alias("n"), F.avg("l1").alias("mean_l1"))
    return r(ranks.with_quantiles(rows, every, ["snapshot", "size"], {"median_l1": ("l1", 0.5)}), 8)


PAIRS = {"pairs": "SELECT snapshot, round(avg(l1) FILTER (n < 5), 9) AS a, round(avg(l1) FILTER (n >= 5), 9) AS b FROM ok GROUP BY snapshot", "dd": "SELECT a - b AS d FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL"}


@query("m9_paired_tests", over_valid("""SELECT (SELECT count(*) FROM dd) AS n, round((SELECT avg(d) FROM dd), 8) AS mean_diff, round((SELECT avg(d) / (stddev(d) / sqrt(count(*))) FROM dd), 6) AS t, round((SELECT avg(d) / stddev(d) FROM dd), 6) AS cohen_d,
  (SELECT coalesce(sum(r) FILTER (d > 0), 0) FROM rk)::DOUBLE AS w_plus, round((SELECT (coalesce(sum(r) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0) FROM rk), 6) AS z""", PAIRS | {"rk": "SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM dd WHERE d <> 0"}))
def m9(spark, sf):
    rows = valid(spark, sf).groupBy("snapshot").agg(F.round(F.avg(F.when(F.col("n") < 5, F.col("l1"))), 9).alias("a"), F.round(F.avg(F.when(F.col("n") >= 5, F.col("l1"))), 9).alias("b"))
    return r(r(m.paired_tests(rows, "a", "b").drop("p_t", "p_wilcoxon"), 8, "mean_diff"), 6, "t", "cohen_d", "z")


@query("m9_thresholds")
def m9_thresholds(spark, sf):
    """Paired tests with their p-values for sizes below and from 3, 4, 5, 6 and 7 assets."""
    return m.distance_thresholds(valid(spark, sf), "snapshot", "n", "l1")


@query("m10_spearman", over_valid("SELECT snapshot, round(corr(rx, ry), 7) AS rho, count(*) AS n FROM (SELECT snapshot, rank() OVER (PARTITION BY snapshot ORDER BY hhi) + (count(*) OVER (PARTITION BY snapshot, hhi) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY snapshot ORDER BY ret_base) + (count(*) OVER (PARTITION BY snapshot, ret_base) - 1) / 2.0 AS ry FROM ok) GROUP BY snapshot"))
def m10(spark, sf):
    return r(m.spearman(valid(spark, sf), "hhi", "ret_base", ["snapshot"]), 7)


CUTS = {"cuts": "SELECT snapshot, quantile_cont(ret_base, 0.05) AS lo, quantile_cont(ret_base, 0.95) AS hi FROM ok GROUP BY snapshot"}


@query("m11_winsorised", over_valid("SELECT snapshot, round(avg(greatest(lo, least(hi, ret_base))), 8) AS mean FROM ok JOIN cuts USING (snapshot) GROUP BY snapshot", CUTS))
def m11(spark, sf):
    return r(m.winsorise(valid(spark, sf), ["snapshot"], ["ret_base"]).groupBy("snapshot").agg(F.avg("ret_base").alias("mean")), 8)


@query("m30_month_outcomes", over_valid("SELECT snapshot, count(*) AS n, round(median(ret_base), 8) AS median, round(avg(greatest(lo, least(hi, ret_base))), 8) AS wmean, round(var_pop(greatest(lo, least(hi, ret_base))), 8) AS wvar FROM ok JOIN cuts USING (snapshot) GROUP BY snapshot", CUTS))
def m30(spark, sf):
    return r(m.month_outcomes(valid(spark, sf), "snapshot", "ret_base"), 8)


@query("m12_ols", over_valid("""SELECT unnest(['const', 'hhi']) AS term, round(unnest([b0, b1]), 6) AS coef, round(unnest([sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), sqrt(rss / (n - 2) / sxx)]), 6) AS std_error, round(unnest([b0 / sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx)), b1 / sqrt(rss / (n - 2) / sxx)]), 3) AS t, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, n::BIGINT AS n
  FROM (SELECT regr_intercept(ret_base, hhi) AS b0, regr_slope(ret_base, hhi) AS b1, regr_r2(ret_base, hhi) AS r2, regr_syy(ret_base, hhi) * (1 - regr_r2(ret_base, hhi)) AS rss, regr_sxx(ret_base, hhi) AS sxx, avg(hhi) AS mx, count(*)::DOUBLE AS n FROM ok)"""))
def m12(spark, sf):
    rows = m.ols(valid(spark, sf), "ret_base", ["hhi"]).drop("p")
    return r(r(rows, 3, "t"), 6, "coef", "std_error", "r2", "adj_r2")


@query("m12_ols_extended")
def m12x(spark, sf):
    rows = valid(spark, sf).withColumn("hhi2", F.pow("hhi", F.lit(2))).withColumn("cross", F.col("hhi") * F.col("l1"))
    return m.ols(rows, "ret_equal", ["hhi", "hhi2", "l1", "cross"])


@query("m13_quantile_reg")
def m13(spark, sf):
    return m.quantile_reg(valid(spark, sf), "ret_base", ["hhi"], 0.5)


XS = ["hhi", "l1", "n", "cash"]


@query("m14_forest")
def m14(spark, sf):
    return m.forest(valid(spark, sf).withColumn("n", F.col("n").cast("double")), "ret_base", XS)[1]


@query("m15_permutation")
def m15(spark, sf):
    rows = valid(spark, sf).withColumn("n", F.col("n").cast("double"))
    model, _ = m.forest(rows, "ret_base", XS)
    return m.permutation_importance(model, rows, "ret_base", XS)


@query("m16_grouped_cv")
def m16(spark, sf):
    return m.grouped_cv(valid(spark, sf).withColumn("n", F.col("n").cast("double")), "ret_base", XS, "snapshot")


@query("m17_forward_chain")
def m17(spark, sf):
    rows = valid(spark, sf).withColumn("year", (F.lit(1995) + F.floor(F.col("snapshot") / 365.25)).cast("int"))
    return m.forward_chain(rows.withColumn("n", F.col("n").cast("double")), "ret_base", XS, "year", "snapshot")


@query("m18_variance_shares", over_valid("""SELECT round(b / (b + w), 8) AS between_rows, round(w / (b + w), 8) AS within_rows, round(bg / (bg + wg), 8) AS between_groups, round(wg / (bg + wg), 8) AS within_groups FROM (
  SELECT sum(n * pow(mu - (SELECT avg(ret_base) FROM ok), 2)) / sum(n) AS b, sum(n * v) / sum(n) AS w, var_pop(mu) AS bg, avg(v) AS wg FROM (SELECT snapshot, count(*) AS n, avg(ret_base) AS mu, var_pop(ret_base) AS v FROM ok GROUP BY snapshot))"""))
def m18(spark, sf):
    return r(m.variance_shares(valid(spark, sf), "snapshot", "ret_base"), 8)


@query("m19_demean", over_valid("SELECT snapshot, round(max(ret_base) - avg(ret_base), 8) AS most, round(min(ret_base) - avg(ret_base), 8) AS least FROM ok GROUP BY snapshot"))
def m19(spark, sf):
    return r(m.demean(valid(spark, sf), ["snapshot"], ["ret_base"]).groupBy("snapshot").agg(F.max("ret_base_dm").alias("most"), F.min("ret_base_dm").alias("least")), 8)


@query("m20_power_fit")
def m20(spark, sf):
    curve = valid(spark, sf).groupBy("snapshot", "n").agg(F.avg(F.col("l1") * 50).alias("d"), F.count("*").alias("w"))
    return m.power_fit(curve, ["snapshot"], "n", "d", "w")


@query("m21_best_strategy", over_valid("SELECT unnest(['ret_base', 'ret_equal', 'market']) AS strategy, round(unnest([avg((ret_base >= g)::INTEGER), avg((ret_equal >= g)::INTEGER), avg((market >= g)::INTEGER)]), 8) AS share, count(*) AS n FROM (SELECT *, greatest(ret_base, ret_equal, market) AS g FROM ok)"))
def m21(spark, sf):
    return r(m.best_strategy(valid(spark, sf), ["ret_base", "ret_equal", "market"]), 8)


@query("m22_direction", over_valid("SELECT 'hhi>l1' AS pair, count(*) AS n, round(avg((l1 - hhi < -0.001)::INTEGER), 8) AS closer, round(avg((l1 - hhi > 0.001)::INTEGER), 8) AS farther, round(avg((abs(l1 - hhi) <= 0.001)::INTEGER), 8) AS unchanged FROM ok"))
def m22(spark, sf):
    return r(m.direction(valid(spark, sf), [("hhi", "l1")]), 8)


EXACT_N = {k: v for k, v in PANEL.items() if k != "marks"} | {"pb": "SELECT snapshot, address, round(sum(w * coalesce(beta, 1)), 6) AS x, round(sum(e * coalesce(beta, 1)), 6) AS y FROM base LEFT JOIN betas USING (snapshot, token) GROUP BY ALL"}


@query("m23_beta_by_exact_n", over_valid("SELECT n, count(*) AS rows, round(avg(y - x), 5) AS mean_change, round(median(y - x), 6) AS median_change, round(avg((abs(y - 1) < abs(x - 1))::INTEGER), 8) AS share_closer FROM ok JOIN pb USING (snapshot, address) WHERE n <= 30 GROUP BY n HAVING count(*) >= 200", EXACT_N))
def m23(spark, sf):
    rows = m.change_by_n(valid(spark, sf), "n", "beta_base", "beta_equal")
    return r(r(r(rows, 5, "mean_change"), 6, "median_change"), 8, "share_closer")


@query("m24_panel", over_valid("SELECT snapshot, count(*) AS n, round(avg(ret_base), 8) AS mean, round(median(ret_base), 8) AS median, round(stddev(ret_base), 8) AS sd FROM ok GROUP BY GROUPING SETS ((snapshot), ())"))
def m24(spark, sf):
    aggs = [F.count("*").alias("n"), F.avg("ret_base").alias("mean"), F.stddev("ret_base").alias("sd")]
    rows = panels.panel(valid(spark, sf), ["snapshot"], aggs)
    both = valid(spark, sf).select(F.explode(F.array("snapshot", F.lit(None).cast("int"))).alias("snapshot"), "ret_base")
    return r(ranks.with_quantiles(rows, both, ["snapshot"], {"median": ("ret_base", 0.5)}), 8)


@query("m25_accuracy", over_valid("SELECT size, count(*) AS n, count(*) FILTER (ret_base = ret_equal) AS exact, count(*) FILTER (e <= 0.1) AS within, round(quantile_cont(e, 0.5), 7) AS median_error, round(quantile_cont(e, 0.95), 6) AS p95_error, count(*) FILTER (ret_base > ret_equal) AS n_over, count(*) FILTER (ret_base < ret_equal) AS n_under FROM (SELECT *, CASE WHEN ret_equal = 0 THEN CASE WHEN ret_base = 0 THEN 0 ELSE 1 END ELSE abs(ret_base - ret_equal) / abs(ret_equal) END AS e FROM ok) GROUP BY size"))
def m25(spark, sf):
    rows = m.accuracy(valid(spark, sf), "ret_base", "ret_equal", 0.1, ["size"]).drop("max_error")
    return r(r(rows, 7, "median_error"), 6, "p95_error")


@query("m26_coverage", over_wallets("SELECT count(*) AS n_rows, count(DISTINCT snapshot) AS n_snapshots, round(avg((ret_base IS NOT NULL)::INTEGER), 8) AS share_ret_base, round(avg(ret_base), 8) AS mean_ret_base, round(median(ret_base), 8) AS median_ret_base FROM outcomes"))
def m26(spark, sf):
    return r(m.coverage_stats(wallets(spark, sf), "snapshot", ["ret_base"]), 8)


@query("m27_over_snapshots", over_valid("SELECT size, round(median(x), 8) AS median, round(quantile_cont(x, 0.99) + quantile_cont(x, 0.01), 8) AS skew, count(*) AS n FROM (SELECT snapshot, size, avg(ret_base) AS x FROM ok GROUP BY snapshot, size) GROUP BY size"))
def m27(spark, sf):
    per = valid(spark, sf).groupBy("snapshot", "size").agg(F.avg("ret_base").alias("x"))
    return r(m.over_snapshots(per, ["size"], "x"), 8)


@query("m27_least_correlation", over_valid("SELECT snapshot, count(*) AS n, round(least(" + ", ".join(f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN corr({a}, {b}) END" for a, b in (("hhi", "l1"), ("hhi", "ret_base"), ("hhi", "ret_equal"), ("l1", "ret_base"), ("l1", "ret_equal"), ("ret_base", "ret_equal"))) + "), 7) AS least FROM ok GROUP BY snapshot"))
def m27_correlation(spark, sf):
    return r(m.least_correlation(valid(spark, sf), ["hhi", "l1", "ret_base", "ret_equal"], ["snapshot"]), 7)


@query("m28_minmax", over_valid("SELECT snapshot, round(avg((greatest(lo, least(hi, hhi)) - lo) / (hi - lo)), 8) AS mean FROM ok JOIN (SELECT snapshot, quantile_cont(hhi, 0.05) AS lo, quantile_cont(hhi, 0.95) AS hi FROM ok GROUP BY snapshot) USING (snapshot) GROUP BY snapshot"))
def m28(spark, sf):
    return r(m.minmax(valid(spark, sf), ["snapshot"], "hhi").groupBy("snapshot").agg(F.avg("hhi_scaled").alias("mean")), 8)


@query("m29_smallest", over_valid("SELECT min(n) AS min_n, arg_max(n, (c, -n)) AS mode_n, round(arg_min(z, n), 8) AS share_zero FROM (SELECT n, count(*) AS c, avg((l1 = 0)::INTEGER) AS z FROM ok GROUP BY n)"))
def m29(spark, sf):
    return r(m.smallest_portfolios(valid(spark, sf), "n", "l1"), 8)


@query("j13_compare_runs", over_valid("SELECT count(*) AS n, round(max(abs(ret_base - ret_equal)), 8) AS max_ret FROM ok"))
def j13(spark, sf):
    w = valid(spark, sf)
    a, b = w.select("snapshot", "address", F.col("ret_base").alias("ret")), w.select("snapshot", "address", F.col("ret_equal").alias("ret"))
    return r(panels.compare_runs(a, b, ["snapshot", "address"], ["ret"], deal="address"), 8)


@query("p22_status_score", over_valid("""SELECT size, round(dm, 6) AS diff_mean_pp, round(dd, 6) AS diff_median_pp, round(h, 8) AS hit_rate, CASE WHEN dm > 0 AND dd > 0 THEN 'BETTER' WHEN dm < 0 AND dd < 0 THEN 'WORSE' ELSE 'MIXED' END AS status, round(0.5 * dm + 0.3 * dd + 0.2 * (h - 0.5) * 100, 6) AS score
  FROM (SELECT size, (avg(ret_equal) - avg(ret_base)) * 100 AS dm, (median(ret_equal) - median(ret_base)) * 100 AS dd, avg((ret_equal > ret_base)::INTEGER) AS h FROM ok GROUP BY size)"""))
def p22_status(spark, sf):
    rows = valid(spark, sf).groupBy("size").agg(((F.avg("ret_equal") - F.avg("ret_base")) * 100).alias("diff_mean_pp"), F.avg((F.col("ret_equal") > F.col("ret_base")).cast("int")).alias("hit_rate"))
    rows = ranks.with_quantiles(rows, valid(spark, sf), ["size"], {"_e": ("ret_equal", 0.5), "_b": ("ret_base", 0.5)}).withColumn("diff_median_pp", (F.col("_e") - F.col("_b")) * 100).drop("_e", "_b")
    status, score = f.status_and_score(F.col("diff_mean_pp"), F.col("diff_median_pp"), F.col("hit_rate"))
    return r(r(rows.withColumn("status", status).withColumn("score", score), 8, "hit_rate"), 6, "diff_mean_pp", "diff_median_pp", "score")


@query("p22_alpha_margin", over_valid("SELECT size, round(avg(ret_base - x * market) * 100, 5) AS alpha_pp FROM ok JOIN pb USING (snapshot, address) GROUP BY size", EXACT_N))
def p22(spark, sf):
    return r(valid(spark, sf).groupBy("size").agg((F.avg(f.alpha(F.col("ret_base"), F.col("beta_base"), F.col("market"))) * 100).alias("alpha_pp")), 5)
