"""Queries over holdings: concentration, size, cash, turnover."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import buckets as h
from tessera.functions import values as v
from tessera.operators import balances as b
from tessera.operators import panels, positions as n, ranks
from tessera.plans.ctes import names, sql
from tessera.plans.ledger import DAYS, SNAPS, balance, flows
from tessera.plans.registry import query
from tessera.sources import domain as d
from tessera.sources import tables as s

ALIAS = {d.WRAPPED: d.NATIVE}


def positions(spark, sf, price=b.priced):
    """Positions at all snapshots, valued at their prices, dealt by address.

    What is worked out once for each session and read from the shared folder is stretches of equal balances, bucketed by
    address, and the closes: positions, many times as many, are made of them in the tasks that read them.
    """
    stretches = s.stored(spark, sf, "stretches", lambda: b.runs(flows(spark, sf), SNAPS, deal=(s.buckets(spark, sf), "address")), by="address")
    spots = s.stored(spark, sf, "spots", lambda: b.spots(d.prices(spark, sf), DAYS))
    return price(b.at_snapshots(stretches, SNAPS), spots)


def folded(spark, sf):
    return n.fold_assets(positions(spark, sf, b.priced_in_parts), ALIAS)


def holdings(spark, sf):
    return b.holdings(positions(spark, sf))


def accounts(spark, sf):
    """snapshot, address, total_value, num_tokens, type."""
    rows = positions(spark, sf).groupBy("snapshot", "address").agg(F.round(F.sum("value"), 2).cast("double").alias("total_value"), F.count("*").alias("num_tokens"))
    return n.with_type(rows, d.contracts(spark, sf), every=False)


def r(df, digits=6, *cols):
    """Doubles rounded, for comparison with another engine."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" and (not cols or c in cols) else F.col(f"`{c}`") for c, t in df.dtypes])


@query("b13_holdings", sql("positions", "SELECT snapshot, address, round(sum(value), 2)::DOUBLE AS total_value, count(*) AS num_tokens, string_agg(token || ':' || balance::BIGINT, ',' ORDER BY token) AS tokens FROM positions GROUP BY ALL"))
def b13(spark, sf):
    text = F.array_join(F.transform("holdings", lambda x: F.concat_ws(":", x["token"], x["balance"].cast("long"))), ",")
    return holdings(spark, sf).select("snapshot", "address", "total_value", "num_tokens", text.alias("tokens"))


@query("s12_written_counts", sql("accounts", "SELECT snapshot AS block_number, count(*) AS n FROM accounts GROUP BY 1"))
def s12(spark, sf):
    return s.write_by_snapshot(holdings(spark, sf).withColumnRenamed("snapshot", "block_number"), s.shared_path(spark, "holdings"), "block_number")


@query("n3_folded_positions", sql("folded", "SELECT * FROM folded WHERE units > 0"))
def n3(spark, sf):
    return folded(spark, sf)


@query("n2_folded_count", sql("positions", f"SELECT snapshot, n_folded, count(*) AS n FROM (SELECT snapshot, address, count(*) - CASE WHEN count(*) FILTER (token = '{d.WRAPPED}') > 0 AND count(*) FILTER (token = '{d.NATIVE}') > 0 THEN 1 ELSE 0 END AS n_folded FROM positions GROUP BY ALL) GROUP BY ALL"))
def n2(spark, sf):
    rows = holdings(spark, sf).withColumn("n_folded", n.folded_count(F.col("holdings"), (d.WRAPPED, d.NATIVE)).cast("long"))
    return rows.groupBy("snapshot", "n_folded").agg(F.count("*").alias("n"))


@query("n4_violations", sql("accounts", "SELECT count(*) AS n_accounts, 0::BIGINT AS bad_count, 0::BIGINT AS repeated_token, 0::BIGINT AS bad_balance, 0::BIGINT AS bad_total FROM accounts"))
def n4(spark, sf):
    return n.holdings_violations(holdings(spark, sf))


@query("n5_one_position", sql("positions", f"SELECT snapshot, address, balance, value::DOUBLE AS value FROM positions WHERE token = '{d.NATIVE}'"))
def n5(spark, sf):
    return n.position_of(holdings(spark, sf), d.NATIVE)


CATS = {"cash": d.CASH, "native": [d.NATIVE], "derivative": d.DERIVATIVE, "wrapper": d.WRAPPER}
CATSQL = ", ".join(f"round(sum(CASE WHEN token IN ({names(t)}) THEN coalesce(value, 0) ELSE 0 END), 6) AS {k}" for k, t in CATS.items())
CATVIEW = {"cats": f"SELECT snapshot, address, round(sum(coalesce(value, 0)), 6) AS total, {CATSQL} FROM folded GROUP BY ALL"}


def cats(spark, sf):
    return r(n.category_values(folded(spark, sf), CATS), 6)


@query("n6_category_values", sql("folded", "SELECT * FROM cats", CATVIEW))
def n6(spark, sf):
    return cats(spark, sf)


CONC = {"conc": "SELECT snapshot, address, count(*) AS n_tokens, sum(value) AS total, max(value) / sum(value) AS max_weight, sum(value * value) / (sum(value) * sum(value)) AS hhi FROM folded WHERE value > 0 GROUP BY ALL"}


@query("n7_concentration", sql("folded", "SELECT snapshot, address, n_tokens, round(total, 6) AS total, round(max_weight, 9) AS max_weight, round(hhi, 9) AS hhi, round(1 / hhi, 6) AS effective_n FROM conc", CONC))
def n7(spark, sf):
    rows = n.concentration(folded(spark, sf))
    return rows.select("snapshot", "address", "n_tokens", F.round("total", 6).alias("total"), F.round("max_weight", 9).alias("max_weight"), F.round("hhi", 9).alias("hhi"), F.round("effective_n", 6).alias("effective_n"))


@query("n8_token_totals", sql("positions", "SELECT snapshot, token, sum(value)::DOUBLE AS value, sum(balance) AS units, count(*) AS n_positions, round(sum(value)::DOUBLE / sum(balance), 6) AS implied_price FROM positions GROUP BY ALL"))
def n8(spark, sf):
    rows = n.token_totals(positions(spark, sf))
    return rows.withColumn("implied_price", F.round("implied_price", 6))


@query("n9_token_profile", sql("positions transfers snaps", """SELECT p.snapshot, p.token, holders, valued_holders, value, largest, largest_balance, s.supply, round(largest_balance / s.supply, 9) AS largest_share, largest_balance > s.supply AS exceeds_supply
  FROM (SELECT snapshot, token, count(*) AS holders, count(*) FILTER (value > 0) AS valued_holders, sum(value)::DOUBLE AS value, arg_max(address, (balance, address)) AS largest, max(balance) AS largest_balance FROM positions GROUP BY ALL) p
  LEFT JOIN (SELECT token, snapshot, nullif(sum(CASE WHEN sender IS NULL THEN value ELSE -value END), 0)::DOUBLE AS supply FROM transfers JOIN snaps ON block <= snapshot WHERE sender IS NULL OR recipient IS NULL GROUP BY ALL) s USING (token, snapshot)"""))
def n9(spark, sf):
    rows = n.token_profile(positions(spark, sf), b.supply_at(d.transfers(spark, sf), SNAPS))
    return rows.withColumn("largest_share", F.round("largest_share", 9))


@query("n10_account_profile", sql("positions", "SELECT snapshot, address, first(token ORDER BY coalesce(value, 0) DESC, token) AS dominant, round(max(coalesce(value, 0))::DOUBLE / sum(value)::DOUBLE, 9) AS share, array_to_string(list(token ORDER BY coalesce(value, 0) DESC, token)[1:3], '|') AS top_tokens FROM positions GROUP BY ALL"))
def n10(spark, sf):
    return n.account_profile(positions(spark, sf)).withColumn("share", F.round("share", 9))


@query("n11_types", sql("typed", "SELECT snapshot, type, count(*) AS n, round(sum(total_value), 2) AS value FROM (SELECT * FROM typed UNION ALL SELECT * REPLACE ('ALL' AS type) FROM typed) GROUP BY ALL"))
def n11(spark, sf):
    rows = n.with_type(accounts(spark, sf).drop("type"), d.contracts(spark, sf))
    return rows.groupBy("snapshot", "type").agg(F.count("*").alias("n"), F.round(F.sum("total_value"), 2).alias("value"))


@query("n12_holds_any", sql("positions cash", "SELECT snapshot, holds, count(*) AS n FROM (SELECT snapshot, address, bool_or(token IN (SELECT token FROM cash)) AS holds FROM positions GROUP BY ALL) GROUP BY ALL"))
def n12(spark, sf):
    tokens = F.transform("holdings", lambda x: x["token"])
    return holdings(spark, sf).withColumn("holds", v.holds_any(tokens, d.CASH)).groupBy("snapshot", "holds").agg(F.count("*").alias("n"))


@query("n13_json_assets", sql("accounts", "SELECT snapshot, num_tokens AS n_optimised, count(*) AS n FROM accounts GROUP BY ALL"))
def n13(spark, sf):
    json = holdings(spark, sf).select("snapshot", F.to_json(F.transform("holdings", lambda x: x["token"])).alias("j"))
    return json.groupBy("snapshot", v.n_assets(F.col("j")).cast("long").alias("n_optimised")).agg(F.count("*").alias("n"))


N14 = SNAPS[10], SNAPS[14]


@query("n14_weight_l1", sql("positions", f"""SELECT address, round(sum(abs(coalesce(x, 0) - coalesce(y, 0))), 6) AS l1 FROM (SELECT address, token, max(w) FILTER (snapshot = {N14[0]}) AS x, max(w) FILTER (snapshot = {N14[1]}) AS y
  FROM (SELECT *, value::DOUBLE / sum(value::DOUBLE) OVER (PARTITION BY snapshot, address) AS w FROM positions WHERE value > 0) WHERE address IN (SELECT address FROM positions WHERE snapshot = {N14[0]} AND value > 0) AND address IN (SELECT address FROM positions WHERE snapshot = {N14[1]} AND value > 0) GROUP BY ALL) GROUP BY address"""))
def n14(spark, sf):
    w = n.weights(positions(spark, sf)).filter(F.col("snapshot").isin(*N14))
    maps = w.groupBy("address", "snapshot").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("m"))
    pairs = maps.groupBy("address").agg(F.max_by("m", -F.col("snapshot")).alias("x"), F.max_by("m", "snapshot").alias("y"), F.count("*").alias("n")).filter("n = 2")
    return pairs.select("address", F.round(v.weight_l1(F.col("x"), F.col("y")), 6).alias("l1"))


# ------------------------------------------------------------------ panels over accounts

WEALTH_SQL, SIZE_SQL = h.bin_sql("total_value", h.WEALTH), h.bin_sql("num_tokens", h.SIZE)
BUCKETED = {"acc": f"SELECT *, {WEALTH_SQL} AS wealth, {SIZE_SQL} AS size FROM typed WHERE total_value > 0"}


def bucketed(spark, sf):
    rows = accounts(spark, sf).filter("total_value > 0")
    return rows.withColumn("wealth", h.bin(F.col("total_value"), h.WEALTH)).withColumn("size", h.bin(F.col("num_tokens"), h.SIZE))


@query("a1_filtered_sums", sql("typed", "SELECT snapshot, count(*) FILTER (num_tokens >= 5) AS n_wide, round(sum(total_value) FILTER (type = 'CA'), 2) AS ca_value, round(sum(total_value), 2) AS value FROM acc GROUP BY snapshot", BUCKETED))
def a1(spark, sf):
    return bucketed(spark, sf).groupBy("snapshot").agg(F.count_if(F.col("num_tokens") >= 5).alias("n_wide"), F.round(F.sum(F.when(F.col("type") == "CA", F.col("total_value"))), 2).alias("ca_value"), F.round(F.sum("total_value"), 2).alias("value"))


ALL = lambda c: f"CASE WHEN grouping({c}) = 1 THEN 'ALL' ELSE {c} END AS {c}"


@query("a2_cube", sql("typed", f"SELECT snapshot, {ALL('type')}, {ALL('wealth')}, {ALL('size')}, count(*) AS n, round(sum(total_value), 2) AS value, round(avg(num_tokens), 6) AS mean_tokens FROM acc GROUP BY snapshot, CUBE (type, wealth, size)", BUCKETED))
def a2(spark, sf):
    aggs = [F.count("*").alias("n"), F.round(F.sum("total_value"), 2).alias("value"), F.round(F.avg("num_tokens"), 6).alias("mean_tokens")]
    return panels.cube_panel(bucketed(spark, sf), ["snapshot", "type", "wealth", "size"], aggs, always=("snapshot",))


@query("a3_fixed_bin_sets", sql("typed", f"SELECT snapshot, {ALL('type')}, size, count(*) AS n FROM acc GROUP BY GROUPING SETS ((snapshot, type, size), (snapshot, size))", BUCKETED))
def a3(spark, sf):
    return panels.cube_panel(bucketed(spark, sf), ["snapshot", "type", "size"], [F.count("*").alias("n")], always=("snapshot", "size"))


@query("a4_cube_of_partials", sql("typed", f"SELECT {ALL('type')}, {ALL('wealth')}, sum(n)::BIGINT AS n, round(sum(value), 2) AS value FROM (SELECT type, wealth, count(*) AS n, sum(total_value) AS value FROM acc GROUP BY ALL) GROUP BY CUBE (type, wealth)", BUCKETED))
def a4(spark, sf):
    partial = bucketed(spark, sf).groupBy("type", "wealth").agg(F.count("*").alias("n"), F.sum("total_value").alias("value"))
    return panels.cube_panel(partial, ["type", "wealth"], [F.sum("n").alias("n"), F.round(F.sum("value"), 2).alias("value")])


@query("a5_types_and_all", sql("typed", "SELECT snapshot, coalesce(type, 'ALL') AS type, wealth, count(*) AS n FROM acc GROUP BY GROUPING SETS ((snapshot, wealth, type), (snapshot, wealth))", BUCKETED))
def a5(spark, sf):
    return bucketed(spark, sf).withColumn("type", F.explode(F.array("type", F.lit("ALL")))).groupBy("snapshot", "type", "wealth").agg(F.count("*").alias("n"))


QS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("a6_exact_quantiles", sql("typed", f"SELECT snapshot, unnest({QS}) AS q, round(unnest(quantile_cont(total_value, {QS})), 4) AS value FROM acc GROUP BY snapshot", BUCKETED))
def a6(spark, sf):
    return r(panels.quantiles(bucketed(spark, sf), ["snapshot"], "total_value", QS), 4, "value")


@query("a7_discrete_quantiles", sql("typed", f"SELECT snapshot, unnest({QS}) AS q, unnest(quantile_disc(total_value, {QS})) AS value FROM acc GROUP BY snapshot", BUCKETED))
def a7(spark, sf):
    return panels.quantiles(bucketed(spark, sf), ["snapshot"], "total_value", QS, "discrete")


@query("a8_sketch_cube")
def a8_cube(spark, sf):
    """Quartiles of value and number of addresses of every cell of the cube, from stored partial sketches alone."""
    dims = ["snapshot", "type", "wealth", "size"]
    partials = s.saved(panels.sketch_partials(bucketed(spark, sf), dims, ["total_value"], ["address"]), "sketches")
    out = panels.sketch_values(panels.sketch_cube(partials, dims, always=("snapshot",)), [0.25, 0.5, 0.75])
    return out.select(*dims, "n", *[F.col("q_total_value")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))], F.col("d_address").alias("addresses"))


@query("a8_approx_quantiles")
def a8(spark, sf):
    return panels.quantiles(bucketed(spark, sf), ["snapshot"], "total_value", [i / 10 for i in range(1, 10)], "approx")


@query("a14_yearly", sql("prices", "SELECT year(day)::INTEGER AS year, round(avg(close), 4) AS mean_close, min(close) AS min_close, max(close) AS max_close FROM prices GROUP BY 1"))
def a14(spark, sf):
    return panels.yearly(d.prices(spark, sf), "day", ["close"]).withColumn("mean_close", F.round("mean_close", 4))


@query("a15_mean_of_shares", sql("typed", "SELECT type, wealth, round(sum(s) / max(k), 9) AS mean_share FROM (SELECT snapshot, type, wealth, count(*) / sum(count(*)) OVER (PARTITION BY snapshot, type) AS s FROM acc GROUP BY snapshot, type, wealth) JOIN (SELECT type, count(DISTINCT snapshot) AS k FROM acc GROUP BY type) USING (type) GROUP BY type, wealth", BUCKETED))
def a15(spark, sf):
    return panels.mean_of_shares(bucketed(spark, sf).withColumn("one", F.lit(1)), "snapshot", ["type"], "wealth", "one").withColumn("mean_share", F.round("mean_share", 9))


SIZES = [label for _, label in h.SIZE[0]] + [h.SIZE[1]]


@query("a16_widen", sql("typed", "SELECT snapshot, " + ", ".join(f"count(*) FILTER (size = '{s}') AS \"n_{s}\", round(count(*) FILTER (size = '{s}') * 100.0 / count(*), 6) AS \"pct_{s}\"" for s in SIZES) + " FROM acc GROUP BY snapshot", BUCKETED))
def a16(spark, sf):
    counts = bucketed(spark, sf).groupBy("snapshot", "size").agg(F.count("*").alias("n"))
    return r(panels.widen(counts, ["snapshot"], "size", SIZES))


@query("a17_lengthen", sql("typed", f"SELECT snapshot, 'total_value' AS metric, unnest(range({len(QS)}))::INTEGER AS place, round(unnest(quantile_cont(total_value, {QS})), 4) AS value FROM acc GROUP BY snapshot", BUCKETED))
def a17(spark, sf):
    lists = ranks.exact_quantiles(bucketed(spark, sf), ["snapshot"], "total_value", QS)
    return r(panels.lengthen(lists, ["snapshot"], {"q": "total_value"}), 4, "value")


@query("a18_crosstab", sql("typed", "SELECT type, size, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM acc GROUP BY type, size", BUCKETED))
def a18(spark, sf):
    return r(panels.crosstab(bucketed(spark, sf), "type", "size"))


@query("a19_two_runs", sql("typed", "SELECT snapshot, wealth, n AS n_old, m AS n_new, coalesce(m, 0) - coalesce(n, 0) AS n_delta FROM (SELECT snapshot, wealth, count(*) AS n FROM acc GROUP BY ALL) FULL JOIN (SELECT snapshot, wealth, count(*) AS m FROM acc WHERE type = 'EOA' GROUP BY ALL) USING (snapshot, wealth)", BUCKETED))
def a19(spark, sf):
    rows = bucketed(spark, sf)
    old = rows.groupBy("snapshot", "wealth").agg(F.count("*").alias("n"))
    new = rows.filter("type = 'EOA'").groupBy("snapshot", "wealth").agg(F.count("*").alias("n"))
    return panels.diff_runs(old, new, ["snapshot", "wealth"], ["n"], "snapshot")


@query("a27_share_floor", sql("typed", "SELECT snapshot, round(sum(n * lower) / sum(n), 6) AS floor FROM (SELECT snapshot, size AS bin, count(*) AS n FROM acc GROUP BY ALL) JOIN (VALUES ('1', 1), ('2', 2), ('3-4', 3), ('5-9', 5), ('10+', 10)) e(bin, lower) USING (bin) GROUP BY snapshot", BUCKETED))
def a27(spark, sf):
    edges = spark.createDataFrame([("1", 1), ("2", 2), ("3-4", 3), ("5-9", 5), ("10+", 10)], "bin string, lower int")
    return r(panels.share_floor(h.histogram(bucketed(spark, sf), ["snapshot"], F.col("size")), ["snapshot"], edges))


@query("a28_rebuilt_sums", sql("folded", "SELECT snapshot, round(sum(cash), 3) AS sum_cash, round(sum(native), 3) AS sum_native, round(sum(cash) / (sum(cash) + sum(native)), 6) AS share_cash, round(sum(native) / (sum(cash) + sum(native)), 6) AS share_native FROM cats GROUP BY snapshot", CATVIEW))
def a28(spark, sf):
    means = cats(spark, sf).groupBy("snapshot", (F.hash("address") % 5).alias("g")).agg(F.avg("cash").alias("mean_cash"), F.avg("native").alias("mean_native"), F.count("*").alias("n"))
    rows = panels.rebuild_sums(means, ["snapshot"], ["cash", "native"])
    return rows.select("snapshot", F.round("sum_cash", 3).alias("sum_cash"), F.round("sum_native", 3).alias("sum_native"), F.round("share_cash", 6).alias("share_cash"), F.round("share_native", 6).alias("share_native"))


@query("a30_type_spread", sql("typed", "SELECT type, round(avg(share), 9) AS mean, round(quantile_cont(share, 0.1), 9) AS p10, round(quantile_cont(share, 0.5), 9) AS p50, round(quantile_cont(share, 0.9), 9) AS p90 FROM (SELECT snapshot, type, sum(total_value) / sum(sum(total_value)) OVER (PARTITION BY snapshot) AS share FROM acc GROUP BY snapshot, type) GROUP BY type", BUCKETED))
def a30(spark, sf):
    return r(panels.type_share(bucketed(spark, sf), "snapshot", "type", "total_value")[1], 9)


@query("a32_dust", sql("positions", "SELECT snapshot, multi, coalesce(multi_clean, 0) AS multi_clean, round((multi - coalesce(multi_clean, 0)) / multi, 9) AS lost_share FROM (SELECT snapshot, count(*) FILTER (k >= 2) AS multi FROM (SELECT snapshot, address, count(*) AS k FROM positions GROUP BY ALL) GROUP BY snapshot) LEFT JOIN (SELECT snapshot, count(*) FILTER (k >= 2) AS multi_clean FROM (SELECT snapshot, address, count(*) AS k FROM positions WHERE value > 50000 GROUP BY ALL) GROUP BY snapshot) USING (snapshot)"))
def a32(spark, sf):
    p = positions(spark, sf)
    count = lambda x: x.groupBy("snapshot", "address").agg(F.count("*").alias("num_tokens"))
    return r(panels.dust_effect(count(p), count(p.filter("value > 50000")), "snapshot"), 9)


@query("u2_coverage", sql("snaps typed", "SELECT *, CASE WHEN duplicates + missing + unexpected = 0 THEN 'PASS' ELSE 'NOT_PASS' END AS status FROM (SELECT (SELECT count(*) FROM (SELECT snapshot FROM there GROUP BY 1 HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM snaps WHERE snapshot NOT IN (SELECT snapshot FROM there)) AS missing, (SELECT count(DISTINCT snapshot) FROM there WHERE snapshot NOT IN (SELECT snapshot FROM snaps)) AS unexpected)", {"there": "SELECT DISTINCT snapshot, 1 AS run FROM typed WHERE type = 'EOA' UNION ALL SELECT DISTINCT snapshot, 2 FROM typed WHERE type = 'CA' AND total_value > 3000000 UNION ALL SELECT max(snapshot) + 1, 3 FROM accounts"}))
def u2(spark, sf):
    # Two runs: one has every snapshot of EOA accounts, the other those of large CA accounts and one that none asked for.
    rows = accounts(spark, sf)
    runs = rows.filter("type = 'EOA'").select("snapshot").distinct().unionByName(rows.filter("type = 'CA' AND total_value > 3000000").select("snapshot").distinct()).unionByName(rows.agg((F.max("snapshot") + 1).alias("snapshot")))
    return panels.coverage(runs, spark.createDataFrame([(x,) for x in SNAPS], "snapshot int"), "snapshot")


# ------------------------------------------------------------------ ranks and bins


@query("w2_top_shares", sql("typed", """SELECT snapshot, type, max(n) AS n, round(max(total), 2) AS total, round(sum(v) FILTER (r <= greatest(1, ceil(0.01 * n))) / max(total), 9) AS top_0_01, round(sum(v) FILTER (r <= greatest(1, ceil(0.1 * n))) / max(total), 9) AS top_0_1
  FROM (SELECT snapshot, type, total_value AS v, row_number() OVER (PARTITION BY snapshot, type ORDER BY total_value DESC, address) AS r, count(*) OVER (PARTITION BY snapshot, type) AS n, sum(total_value) OVER (PARTITION BY snapshot, type) AS total FROM acc) GROUP BY ALL""", BUCKETED))
def w2(spark, sf):
    rows = ranks.top_shares(bucketed(spark, sf), [0.01, 0.1], "total_value", ["snapshot", "type"])
    return rows.select("snapshot", "type", "n", F.round("total", 2).alias("total"), F.round("top_0_01", 9).alias("top_0_01"), F.round("top_0_1", 9).alias("top_0_1"))


@query("w3_top_shares_floor", sql("typed", """SELECT snapshot, max(n) AS n, round(max(total), 2) AS total, round(sum(v) FILTER (r <= greatest(1, ceil(0.05 * n))) / max(total), 9) AS top_0_05
  FROM (SELECT snapshot, total_value AS v, row_number() OVER (PARTITION BY snapshot ORDER BY total_value DESC, address) AS r, count(*) OVER (PARTITION BY snapshot) AS n, sum(total_value) OVER (PARTITION BY snapshot) AS total FROM acc WHERE total_value > 100000) GROUP BY ALL""", BUCKETED))
def w3(spark, sf):
    rows = ranks.top_shares(bucketed(spark, sf), [0.05], "total_value", ["snapshot"], floor=100_000)
    return rows.select("snapshot", "n", F.round("total", 2).alias("total"), F.round("top_0_05", 9).alias("top_0_05"))


CUT = {"acc": BUCKETED["acc"], "cuts": "SELECT snapshot, quantile_cont(total_value, 0.9) AS cut FROM acc GROUP BY snapshot"}


@query("w4_top_quantile", sql("typed", "SELECT snapshot, type, count(*) AS n, round(sum(total_value), 2) AS value FROM acc JOIN cuts USING (snapshot) WHERE total_value >= cut GROUP BY ALL", CUT))
def w4(spark, sf):
    return ranks.top_quantile(bucketed(spark, sf), 0.1, "total_value", ["snapshot"], "type")[0].withColumn("value", F.round("value", 2))


@query("w5_share_of_total", sql("typed", "SELECT snapshot, wealth, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY snapshot), 6) AS n_pct FROM acc GROUP BY snapshot, wealth", BUCKETED))
def w5(spark, sf):
    counts = bucketed(spark, sf).groupBy("snapshot", "wealth").agg(F.count("*").alias("n"))
    return r(ranks.share_of_total(counts, ["snapshot"], "n"))


@query("w7_top_with_share", sql("typed", """SELECT snapshot, address, total_value, r AS rank, round(total_value / total, 9) AS share, round(run / total, 9) AS cum_share FROM (
  SELECT snapshot, address, total_value, row_number() OVER w AS r, sum(total_value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(total_value) OVER (PARTITION BY snapshot) AS total FROM acc WINDOW w AS (PARTITION BY snapshot ORDER BY total_value DESC, address)) WHERE r <= 20""", BUCKETED))
def w7(spark, sf):
    rows = ranks.top_with_share(bucketed(spark, sf).select("snapshot", "address", "total_value"), ["snapshot"], "total_value", "address", 20)
    return rows.withColumn("share", F.round("share", 9)).withColumn("cum_share", F.round("cum_share", 9))


def binned(name, col, spec, source, view, more, unknown=None, value=None):
    """Register a histogram query of a column's bins by snapshot."""

    @query(name, sql(view, f"SELECT snapshot, {h.bin_sql(col, spec, unknown)} AS bin, count(*) AS n FROM {list(more)[-1] if more else view} GROUP BY ALL", more))
    def run(spark, sf):
        return h.histogram(source(spark, sf), ["snapshot"], h.bin(F.col(col) if value is None else value, spec, unknown))

    return run


binned("h1_wealth", "total_value", h.WEALTH, accounts, "typed", {"acc": "SELECT * FROM typed"})
binned("h2_wealth_below", "total_value", h.WEALTH_BELOW, accounts, "typed", {"acc": "SELECT * FROM typed"})
binned("h3_backtest_wealth", "total_value", h.BACKTEST_WEALTH, accounts, "typed", {"acc": "SELECT * FROM typed"}, "UNKNOWN")
binned("h4_size", "num_tokens", h.SIZE, accounts, "typed", {"acc": "SELECT * FROM typed"})
binned("h5_size_fine", "num_tokens", h.SIZE_FINE, accounts, "typed", {"acc": "SELECT * FROM typed"})
binned("h5_assets", "num_tokens", h.ASSETS, accounts, "typed", {"acc": "SELECT * FROM typed"})
binned("h5_tokens", "num_tokens", h.TOKENS, accounts, "typed", {"acc": "SELECT * FROM typed"})
ROUNDED = {"conc": CONC["conc"], "c": "SELECT snapshot, round(max_weight, 9) AS max_weight, round(1 / hhi, 6) AS effective_n FROM conc"}
binned("h6_max_weight", "max_weight", h.MAX_WEIGHT, n7, "folded", ROUNDED)
binned("h6_effective_n", "effective_n", h.EFFECTIVE_N, n7, "folded", ROUNDED)
SHARES = {"cats": CATVIEW["cats"], "s": "SELECT snapshot, round(cash / total, 9) AS cash_share, CASE WHEN total - cash > 1e-9 THEN round(native / (total - cash), 9) END AS native_of_risky FROM cats WHERE total > 0"}


def shares(spark, sf):
    return r(n.cash_mix(cats(spark, sf)), 9)


binned("h7_cash_share", "cash_share", h.CASH_SHARE, shares, "folded", SHARES)
binned("h7_mix", "native_of_risky", h.MIX, shares, "folded", SHARES)


@query("h13_holder_counts", sql("positions", f"SELECT snapshot, {h.bin_sql('k', h.HOLDERS)} AS bin, count(*) AS n FROM (SELECT snapshot, token, count(*) AS k FROM positions GROUP BY ALL) GROUP BY ALL"))
def h13(spark, sf):
    counts = positions(spark, sf).groupBy("snapshot", "token").agg(F.count("*").alias("k"))
    return h.histogram(counts, ["snapshot"], h.bin(F.col("k"), h.HOLDERS))


@query("h14_balance_bins", sql("positions", f"SELECT snapshot, {h.bin_sql('balance', h.SIZE_FINE)} AS bin, count(*) AS n, sum(balance) AS held FROM positions WHERE token = '{d.NATIVE}' GROUP BY ALL"))
def h14(spark, sf):
    rows = positions(spark, sf).filter(F.col("token") == d.NATIVE).withColumn("bin", h.bin(F.col("balance"), h.SIZE_FINE))
    return rows.groupBy("snapshot", "bin").agg(F.count("*").alias("n"), F.sum("balance").alias("held"))


#: Positions of the native token beside the account's value: the given units and prices are large, so parts of them fill the bins.
NATIVE_SQL = {"nat": f"SELECT snapshot, round(value::DOUBLE / 100000, 6) AS usd, round(balance / 100, 6) AS units, round(value::DOUBLE / nullif(total_value, 0), 9) AS share, round(balance * balance, 0) * 1e16 AS wei FROM positions JOIN accounts USING (snapshot, address) WHERE token = '{d.NATIVE}'"}


def native_positions(spark, sf):
    rows = positions(spark, sf).filter(F.col("token") == d.NATIVE).join(accounts(spark, sf).select("snapshot", "address", "total_value"), ["snapshot", "address"])
    return rows.select("snapshot", F.round(F.col("value").cast("double") / 100_000, 6).alias("usd"), F.round(F.col("balance") / 100, 6).alias("units"), F.round(F.try_divide(F.col("value").cast("double"), F.col("total_value")), 9).alias("share"), (F.round(F.col("balance") * F.col("balance"), 0) * 1e16).alias("wei"))


binned("h14_position_usd", "usd", h.POSITION_USD, native_positions, "positions accounts", NATIVE_SQL)
binned("h14_position_units", "units", h.POSITION_UNITS, native_positions, "positions accounts", NATIVE_SQL)
binned("h14_position_share", "share", h.POSITION_SHARE, native_positions, "positions accounts", NATIVE_SQL)


@query("h14_wei_held", sql("positions accounts", f"SELECT snapshot, {h.bin_sql('wei', h.WEI)} AS bin, count(*) AS n, sum(wei) AS held FROM nat GROUP BY ALL", NATIVE_SQL))
def h14_wei(spark, sf):
    rows = native_positions(spark, sf).withColumn("bin", h.bin(F.col("wei"), h.WEI))
    return rows.groupBy("snapshot", "bin").agg(F.count("*").alias("n"), F.sum("wei").alias("held"))


@query("h14_gas_thresholds", sql("positions accounts", "SELECT snapshot, count(*) AS n, " + ", ".join(f"count(*) FILTER (usd < {t}) AS n_below_{t}" for t in h.GAS_USD) + " FROM nat GROUP BY snapshot", NATIVE_SQL))
def h14_gas(spark, sf):
    return h.below_thresholds(native_positions(spark, sf), ["snapshot"], F.col("usd"))


@query("h16_first_match", sql("typed", "SELECT CASE WHEN type = 'CA' THEN 'contract' WHEN num_tokens >= 10 THEN 'wide' WHEN total_value > 1e6 THEN 'rich' ELSE 'other' END AS bin, count(*) AS n FROM typed GROUP BY 1"))
def h16(spark, sf):
    label = h.first_match([("contract", F.col("type") == "CA"), ("wide", F.col("num_tokens") >= 10), ("rich", F.col("total_value") > 1e6)], "other")
    return h.histogram(accounts(spark, sf), [], label)


# ------------------------------------------------------------------ cash, caps, turnover


@query("p26_cash_mix", sql("folded", "SELECT snapshot, count(*) AS n, round(avg(cash_share), 9) AS mean_share, round(quantile_cont(cash_share, 0.5), 9) AS median_share, round(avg(native_of_risky), 9) AS mean_native FROM s GROUP BY snapshot", SHARES))
def p26(spark, sf):
    rows = shares(spark, sf).groupBy("snapshot").agg(F.count("*").alias("n"), F.avg("cash_share").alias("mean_share"), F.avg("native_of_risky").alias("mean_native"))
    return r(ranks.with_quantiles(rows, shares(spark, sf), ["snapshot"], {"median_share": ("cash_share", 0.5)}), 9)


@query("p27_cap_binding", sql("folded", "SELECT snapshot, count(*) AS n, round(avg(CASE WHEN max_weight > 0.9 THEN 1 ELSE 0 END), 9) AS share_accounts, round(sum(CASE WHEN max_weight > 0.9 THEN total ELSE 0 END) / sum(total), 9) AS share_value, round(avg(max_weight - 0.9) FILTER (max_weight > 0.9), 9) AS mean_shift FROM conc GROUP BY snapshot", CONC))
def p27(spark, sf):
    return r(n.cap_binding(n.concentration(folded(spark, sf)), 0.9, ["snapshot"]), 9)


SAME = "abs(u1 - u0) <= 1e-9 * greatest(abs(u0), abs(u1))"
TURN = {
    "f": "SELECT snapshot, address, token, units, greatest(coalesce(value, 0), 0) AS value FROM folded WHERE units > 0",
    "pairs": "SELECT snapshot AS t, lead(snapshot) OVER (ORDER BY snapshot) AS t1 FROM snaps",
    "price": "SELECT snapshot, token, sum(value) / sum(units) AS price FROM f WHERE value > 0 GROUP BY ALL",
    "a": "SELECT t, t1, address, f.token, units AS u0, value AS v0, CASE WHEN value > 0 THEN units * coalesce(price, 0) ELSE 0 END AS p1 FROM f JOIN pairs ON f.snapshot = t LEFT JOIN price ON price.snapshot = t1 AND price.token = f.token WHERE t1 IS NOT NULL",
    "b": "SELECT t, t1, address, token, units AS u1, value AS v1 FROM f JOIN pairs ON f.snapshot = t1",
    "j": "SELECT coalesce(a.t, b.t) AS t, coalesce(a.t1, b.t1) AS t1, coalesce(a.address, b.address) AS address, coalesce(a.token, b.token) AS token, coalesce(u0, 0) AS u0, coalesce(v0, 0) AS v0, coalesce(p1, 0) AS p1, coalesce(u1, 0) AS u1, coalesce(v1, 0) AS v1 FROM a FULL JOIN b ON a.t = b.t AND a.address = b.address AND a.token = b.token",
    "w": "SELECT *, sum(v0) OVER x AS V0s, sum(p1) OVER x AS P1s, sum(v1) OVER x AS A1s FROM j WINDOW x AS (PARTITION BY t, address)",
    "every": f"""SELECT address, t, t1, max(V0s) AS V0, max(P1s) AS P1, max(A1s) AS A1, count(*) FILTER (v0 > 0) AS n0, bool_and({SAME}) AS unchanged, bool_and(token = '{d.NATIVE}' OR {SAME}) AS unchanged_ex_native, count(*) FILTER (u0 <= 0 AND u1 > 0) AS n_added, count(*) FILTER (u0 > 0 AND u1 <= 0) AS n_removed,
      sum(CASE WHEN v0 > 0 AND p1 <= 0 THEN v0 ELSE 0 END) AS v0_unpriced, CASE WHEN max(A1s) > 0 AND max(P1s) > 0 THEN sum(abs(v1 / nullif(A1s, 0) - p1 / nullif(P1s, 0))) / 2 END AS turnover,
      CASE WHEN max(P1s) > 0 THEN sum(abs(v0 / nullif(V0s, 0) - p1 / nullif(P1s, 0))) / 2 END AS drift, CASE WHEN max(V0s) <= 0 THEN 'entry' WHEN max(A1s) <= 0 THEN 'exit' ELSE 'stay' END AS status FROM w GROUP BY ALL HAVING max(V0s) > 0 OR max(A1s) > 0""",
    "turn": "SELECT * FROM every WHERE V0 > 0",
}


def turned(spark, sf):
    return n.turnover(folded(spark, sf), SNAPS, d.NATIVE)


@query("p24_turnover", sql("folded snaps", "SELECT address, t, t1, round(V0, 3) AS V0, round(P1, 3) AS P1, round(A1, 3) AS A1, n0, unchanged, unchanged_ex_native, n_added, n_removed, round(v0_unpriced, 3) AS v0_unpriced, round(turnover, 6) AS turnover, round(drift, 6) AS drift, status FROM every", TURN))
def p24(spark, sf):
    return r(r(turned(spark, sf), 3, "V0", "P1", "A1", "v0_unpriced"), 6, "turnover", "drift")


MEASURED = "A1 > 0 AND P1 > 0"


@query("p24_entries", sql("folded snaps contracts", f"""SELECT t, type, wealth, count(*) AS n_entries, round(sum(A1), 2) AS value_entries FROM
  (SELECT t, A1, unnest([CASE WHEN c.address IS NULL THEN 'EOA' ELSE 'CA' END, 'ALL']) AS type, {h.bin_sql('A1', h.WEALTH)} AS wealth FROM every LEFT JOIN contracts c USING (address) WHERE V0 <= 0 AND A1 > 0) GROUP BY ALL""", TURN))
def p24_entries(spark, sf):
    return r(n.entries(n.with_type(turned(spark, sf), d.contracts(spark, sf)).withColumn("wealth", h.bin(F.col("A1"), h.WEALTH)), ["t", "type", "wealth"]), 2)


@query("p24_turnover_summary", sql("folded snaps", f"""SELECT t, count(*) FILTER (V0 > 0) AS n, count(*) FILTER (V0 <= 0) AS n_entry, round(coalesce(sum(A1) FILTER (V0 <= 0), 0), 2) AS value_entry, count(*) FILTER (V0 > 0 AND A1 <= 0) AS n_exit, count(*) FILTER (V0 > 0 AND A1 > 0) AS n_stay, count(*) FILTER ({MEASURED}) AS n_measured, count(*) FILTER (V0 > 0 AND A1 > 0 AND unchanged) AS n_unchanged, count(*) FILTER (V0 > 0 AND A1 > 0 AND unchanged_ex_native) AS n_unchanged_ex_native,
  count(*) FILTER (V0 > 0 AND A1 > 0 AND n_added > 0) AS n_added_any, count(*) FILTER (V0 > 0 AND A1 > 0 AND n_removed > 0) AS n_removed_any, count(*) FILTER ({MEASURED} AND round(A1 / P1, 9) > 1.1) AS n_inflow, count(*) FILTER ({MEASURED} AND round(A1 / P1, 9) < 0.9) AS n_outflow, count(*) FILTER ({MEASURED} AND turnover <= 1e-12) AS n_le_0, """ + ", ".join(f"count(*) FILTER ({MEASURED} AND round(turnover, 12) <= {x}) AS n_le_{k}" for x, k in n.THRESHOLDS) + f""",
  round(avg(turnover) FILTER ({MEASURED}), 6) AS mean_turnover, round(avg(drift) FILTER ({MEASURED}), 6) AS mean_drift, round(sum(V0 * turnover) FILTER ({MEASURED}) / nullif(sum(V0) FILTER ({MEASURED}), 0), 6) AS weighted_turnover, round(sum(v0_unpriced) / nullif(sum(V0), 0), 6) AS share_unpriced FROM every GROUP BY t""", TURN))
def p24s(spark, sf):
    rows = r(n.turnover_summary(turned(spark, sf), ["t"]), 2, "value_entry")
    return r(rows, 6, *[c for c in rows.columns if c != "value_entry"])


@query("h8_turnover_bins", sql("folded snaps", f"SELECT t, {h.bin_sql('round(turnover, 9)', h.TURNOVER)} AS bin, count(*) AS n FROM turn WHERE {MEASURED} GROUP BY ALL", TURN))
def h8(spark, sf):
    rows = turned(spark, sf).filter("A1 > 0 AND P1 > 0")
    return h.histogram(rows.withColumn("turnover", F.round("turnover", 9)), ["t"], h.bin(F.col("turnover"), h.TURNOVER))


@query("f15_eligible", sql("positions", f"SELECT snapshot, count(*) AS n FROM (SELECT snapshot, address FROM positions GROUP BY ALL HAVING count(DISTINCT CASE WHEN token = '{d.WRAPPED}' THEN '{d.NATIVE}' ELSE token END) >= 2) GROUP BY snapshot"))
def f15(spark, sf):
    return n.eligible(holdings(spark, sf), (d.WRAPPED, d.NATIVE)).groupBy("snapshot").agg(F.count("*").alias("n"))


@query("p30_index_tokens", sql("positions", "SELECT snapshot, token, count(*) AS n FROM positions GROUP BY snapshot, token QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY count(*) DESC, token) <= 5"))
def p30(spark, sf):
    from tessera.operators.finance import index_tokens

    return index_tokens(positions(spark, sf), 5)
