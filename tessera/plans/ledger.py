"""Ledger and balance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import asof, balances as b, ledger as l, panels, ranks
from tessera.plans.ctes import sql
from tessera.plans.registry import query
from tessera.sources import domain as d

SNAPS = [d.block_of(q) for q in d.QUARTERS]
DAYS = {d.block_of(q): q for q in d.QUARTERS}


def flows(spark, sf):
    return l.to_flows(d.transfers(spark, sf)).select("token", "block", "address", "value")


def balance(spark, sf, snapshots=None):
    return b.balances(flows(spark, sf), snapshots or SNAPS)


@query("l3_flows_by_token", sql("flows", "SELECT token, count(*) AS n, sum(value)::DOUBLE AS net, count(DISTINCT address) AS n_addresses FROM flows GROUP BY token"))
def l3(spark, sf):
    return flows(spark, sf).groupBy("token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"), F.countDistinct("address").alias("n_addresses"))


@query("l5_flow_gap", sql("flows", "SELECT *, net - minted + burned AS gap FROM (SELECT (SELECT sum(value) FROM flows)::DOUBLE AS net, sum(CASE WHEN sender IS NULL THEN value ELSE 0 END)::DOUBLE AS minted, sum(CASE WHEN recipient IS NULL THEN value ELSE 0 END)::DOUBLE AS burned FROM transfers)"))
def l5(spark, sf):
    t = d.transfers(spark, sf)
    return l.flow_balance_gap(l.to_flows(t), t).select(*[F.col(c).cast("double").alias(c) for c in ("net", "minted", "burned", "gap")])


@query("l2_value_type", sql("transfers", """SELECT token, max(length(amount))::INTEGER AS digits, CASE WHEN max(length(amount)) < 19 OR max(length(amount)) = 19 AND max(amount) FILTER (length(amount) = 19) <= '9223372036854775807' THEN 'int64' WHEN max(length(amount)) <= 38 THEN 'decimal128' WHEN max(length(amount)) <= 76 THEN 'decimal256' ELSE 'text' END AS storage
  FROM (SELECT token, CASE token WHEN 'Brand#11' THEN '9223372036854775' || lpad((800 + value % 10)::INTEGER::VARCHAR, 3, '0') WHEN 'Brand#12' THEN '9223372036854775' || lpad((807 + value % 10)::INTEGER::VARCHAR, 3, '0') WHEN 'Brand#13' THEN value::INTEGER::VARCHAR || repeat('0', 25) WHEN 'Brand#14' THEN value::INTEGER::VARCHAR || repeat('0', 50) WHEN 'Brand#15' THEN value::INTEGER::VARCHAR || repeat('0', 90) ELSE value::INTEGER::VARCHAR END AS amount FROM transfers) GROUP BY token"""))
def l2(spark, sf):
    # Five tokens have their amounts written longer, so that every storage type occurs.
    v = F.col("value").cast("long")
    near = lambda least: F.concat(F.lit("9223372036854775"), F.lpad((F.lit(least) + v % 10).cast("string"), 3, "0"))
    longer = {"Brand#11": near(800), "Brand#12": near(807)} | {f"Brand#{13 + i}": F.concat(v.cast("string"), F.repeat(F.lit("0"), zeros)) for i, zeros in enumerate((25, 50, 90))}
    amount = F.coalesce(*[F.when(F.col("token") == t, x) for t, x in longer.items()], v.cast("string"))
    return l.value_type(d.transfers(spark, sf).withColumn("value", amount))


@query("l11_log_index", sql("transfers", """SELECT block, count(*) AS n, max(log_index)::BIGINT AS last_index, sum(log_index * value)::DOUBLE AS mixed FROM (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY token NULLS LAST, sender NULLS LAST, recipient NULLS LAST, value NULLS LAST, kind NULLS LAST, l_orderkey NULLS LAST, l_linenumber NULLS LAST) - 1 AS log_index FROM transfers) GROUP BY block"""))
def l11(spark, sf):
    rows = l.add_log_index(d.transfers(spark, sf), ["token", "sender", "recipient", "value", "kind", "l_orderkey", "l_linenumber"])
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.max("log_index").cast("long").alias("last_index"), F.sum(F.col("log_index") * F.col("value")).cast("double").alias("mixed"))


@query("l13_invalid_rows", sql("transfers", "SELECT count(*) AS n FROM transfers WHERE value IS NULL OR value < 0 OR (sender IS NULL AND recipient IS NULL)"))
def l13(spark, sf):
    return l.invalid_rows(d.transfers(spark, sf)).agg(F.count("*").alias("n"))


STATS = """count(*) AS n_rows, sum(CASE WHEN sender IS NULL THEN value ELSE 0 END)::DOUBLE AS minted, sum(CASE WHEN recipient IS NULL THEN value ELSE 0 END)::DOUBLE AS burned,
  sum(CASE WHEN sender IS NULL THEN value ELSE 0 END)::DOUBLE - sum(CASE WHEN recipient IS NULL THEN value ELSE 0 END)::DOUBLE AS net,
  count(*) FILTER (kind = 'transfer') AS n_transfer, count(*) FILTER (kind = 'mint') AS n_mint, count(*) FILTER (kind = 'burn') AS n_burn, sum(value)::DOUBLE AS total"""


def doubled(df):
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query("l14_chunk_stats", sql("transfers", f"SELECT (block // 100 * 100)::BIGINT AS chunk, {STATS} FROM transfers GROUP BY 1"))
def l14(spark, sf):
    return doubled(l.ledger_stats(d.transfers(spark, sf).withColumn("chunk", l.chunk_of(F.col("block"), 100)), ["chunk"]))


@query("l17_supply_accounts", sql("transfers", "SELECT *, mint - burn AS net_supply FROM (SELECT sum(value) FILTER (kind = 'mint')::DOUBLE AS mint, sum(value) FILTER (kind = 'burn')::DOUBLE AS burn, sum(value) FILTER (kind = 'transfer')::DOUBLE AS transfer FROM transfers)"))
def l17(spark, sf):
    return doubled(l.supply_accounts(d.transfers(spark, sf)))


@query("u1_union_ledger", sql("transfers", "SELECT kind, token, count(*) AS n, sum(value)::DOUBLE AS total FROM transfers GROUP BY ALL"))
def u1(spark, sf):
    t = d.transfers(spark, sf)
    branches = [t.filter(F.col("kind") == k) for k in ("transfer", "mint", "burn")]
    return l.union_ledger(*branches).groupBy("kind", "token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("f2_allow_list", sql("transfers cash", "SELECT token, count(*) AS n FROM transfers WHERE token IN (SELECT token FROM cash) AND value > 0 GROUP BY token"))
def f2(spark, sf):
    from tessera.operators.filters import allow

    wanted = spark.createDataFrame([(t,) for t in d.CASH], "token string")
    return l.positive(allow(d.transfers(spark, sf), wanted)).groupBy("token").agg(F.count("*").alias("n"))


@query("b1_balances", sql("balances", "SELECT token, address, snapshot, balance::DOUBLE AS balance FROM balances"))
def b1(spark, sf):
    return balance(spark, sf).select("token", "address", "snapshot", F.col("balance").cast("double").alias("balance"))


@query("b2_exact_balances", sql("transfers flows", "SELECT token, address, sum(value)::VARCHAR AS balance FROM flows GROUP BY ALL"))
def b2(spark, sf):
    return b.exact_sums(flows(spark, sf).withColumn("value", F.col("value").cast("string")), ["token", "address"], "value")


@query("b3_balances_at", sql("flows", "SELECT p.address, p.block, coalesce(sum(f.value), 0)::DOUBLE AS balance FROM (SELECT 'C' || o_custkey AS address, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS block FROM orders GROUP BY ALL) p LEFT JOIN flows f ON f.address = p.address AND f.block <= p.block GROUP BY ALL"))
def b3(spark, sf):
    pairs = d.table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("address"), d.block(F.to_date("o_orderdate")).alias("block")).distinct()
    return doubled(b.balances_at(flows(spark, sf), pairs))


@query("b4_supply_at", sql("transfers snaps", "SELECT token, snapshot, sum(CASE WHEN sender IS NULL THEN value ELSE -value END)::DOUBLE AS supply FROM transfers JOIN snaps ON block <= snapshot WHERE sender IS NULL OR recipient IS NULL GROUP BY ALL HAVING sum(CASE WHEN sender IS NULL THEN value ELSE -value END) <> 0"))
def b4(spark, sf):
    return doubled(b.supply_at(d.transfers(spark, sf), SNAPS))


@query("b5_human_balance", sql("balances", "SELECT token, address, snapshot, balance::DOUBLE / 100 AS balance FROM balances WHERE balance > 0 AND snapshot = (SELECT max(snapshot) FROM snaps)"))
def b5(spark, sf):
    decimals = d.table(spark, sf, "part").select(F.col("p_brand").alias("token"), F.lit(2).alias("decimals")).distinct()
    return b.human(balance(spark, sf, SNAPS[-1:]), decimals)


@query("b6_resolve_blocks", sql("quarters transfers", "SELECT q.day, (SELECT max(block) FROM transfers t WHERE t.day <= q.day)::INTEGER AS block FROM quarters q"))
def b6(spark, sf):
    dates = spark.createDataFrame([(q,) for q in d.QUARTERS], "day date")
    return b.resolve_blocks(dates, d.transfers(spark, sf).select("day", "block"))


@query("b7_month_starts", "SELECT unnest(range((SELECT date_trunc('month', min(l_shipdate)) FROM lineitem)::TIMESTAMP, TIMESTAMP '2001-12-02', INTERVAL 1 MONTH))::DATE AS day")
def b7(spark, sf):
    first = d.table(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate"))).first()[0]
    from datetime import date

    return b.month_starts(spark, first.replace(day=1), date(2001, 12, 1))


@query("b8_spot_prices", sql("spot", "SELECT snapshot, token, price AS close FROM spot"))
def b8(spark, sf):
    p = d.prices(spark, sf)
    grid = p.select("token").distinct().select("token", F.explode(F.array(*[F.struct(F.lit(k).alias("snapshot"), F.lit(v).alias("day")) for k, v in DAYS.items()])).alias("s")).select("token", "s.*")
    return b.spot(p, grid).select("snapshot", "token", "close")


@query("b9_spot_bounded", sql("snaps prices", "SELECT s.snapshot, t.token, (SELECT arg_max(close, day) FROM prices p WHERE p.token = t.token AND p.day <= DATE '1995-01-01' + s.snapshot::INTEGER AND p.day >= DATE '1995-01-01' + s.snapshot::INTEGER - 3) AS close FROM snaps s, (SELECT DISTINCT token FROM prices) t"))
def b9(spark, sf):
    p = d.prices(spark, sf)
    grid = p.select("token").distinct().select("token", F.explode(F.array(*[F.struct(F.lit(k).alias("snapshot"), F.lit(v).alias("day")) for k, v in DAYS.items()])).alias("s")).select("token", "s.*")
    return b.spot(p, grid, 3).select("snapshot", "token", "close")


@query("b12_market_cap", sql("transfers snaps spot", """SELECT s.token, s.snapshot, CASE WHEN supply > 0 AND price > 0 THEN round(supply * price, 4) END AS cap FROM (
  SELECT token, snapshot, sum(CASE WHEN sender IS NULL THEN value ELSE -value END)::DOUBLE AS supply FROM transfers JOIN snaps ON block <= snapshot WHERE sender IS NULL OR recipient IS NULL GROUP BY ALL) s JOIN spot p ON s.token = p.token AND s.snapshot = p.snapshot WHERE supply <> 0"""))
def b12(spark, sf):
    supply = b.supply_at(d.transfers(spark, sf), SNAPS)
    at = b8(spark, sf)
    return supply.join(at, ["token", "snapshot"]).select("token", "snapshot", F.round(b.market_cap(F.col("supply").cast("double"), F.col("close")), 4).alias("cap"))


@query("b14_universe", sql("flows", "SELECT address, bool_or(token <> 'Brand#11') AS in_tokens, bool_or(token = 'Brand#11') AND NOT bool_or(token <> 'Brand#11') AS only_native, count(*) / 2 AS n_transfers FROM flows GROUP BY address"))
def b14(spark, sf):
    return b.universe(flows(spark, sf), d.NATIVE)


@query("b15_asof_series", sql("snaps daily", "SELECT c.day, c.token, (SELECT arg_max(close, day) FROM daily e WHERE e.token = 'view' AND e.day <= c.day) AS tvl FROM daily c WHERE c.token = 'click'"))
def b15(spark, sf):
    x = d.daily(spark, sf)
    one = lambda t: x.filter(F.col("token") == t).withColumn("one", F.lit(1))
    right = one("view").select("one", F.col("day").alias("d2"), F.col("close").alias("tvl"))
    return asof.asof_join(one("click").select("one", "day", "token"), right, ["one"], "day", "d2").select("day", "token", "tvl")


@query("b16_nearest", sql("prices", """SELECT q.day, q.token, (SELECT arg_min(close, (abs(date_diff('day', p.day, q.day)), p.day)) FROM prices p WHERE p.token = q.token AND abs(date_diff('day', p.day, q.day)) <= 15) AS close
  FROM (SELECT o_orderdate::DATE AS day, 'Brand#11' AS token FROM orders GROUP BY 1) q"""))
def b16(spark, sf):
    days = d.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.lit("Brand#11").alias("token")).distinct()
    return asof.nearest_join(days, d.prices(spark, sf).withColumnRenamed("day", "pday"), ["token"], "day", "pday", 15).select("day", "token", "close")


@query("b17_census", sql("flows", """SELECT (SELECT count(*) FROM x) AS active, (SELECT count(*) FROM x WHERE balance > 0) AS positive, (SELECT count(*) FROM x WHERE balance < 0) AS negative, (SELECT sum(balance) FROM x)::DOUBLE AS total,
  (SELECT sum(value) FROM flows WHERE value > 0)::DOUBLE AS credits, (SELECT count(*) FROM flows WHERE value > 0) AS credit_rows""", {"x": "SELECT address, sum(value) AS balance FROM flows GROUP BY address"}))
def b17(spark, sf):
    f = flows(spark, sf)
    return doubled(b.balance_census(f.groupBy("address").agg(F.sum("value").alias("balance")), f))


@query("u4_parties", sql("transfers", "SELECT address FROM (SELECT sender AS address FROM transfers UNION SELECT recipient FROM transfers) WHERE address IS NOT NULL"))
def u4(spark, sf):
    return panels.parties(d.transfers(spark, sf))


@query("a9_distinct_counts", sql("transfers", "SELECT count(DISTINCT token) AS token, count(DISTINCT sender) AS sender, count(DISTINCT recipient) AS recipient, count(DISTINCT block) AS block FROM transfers"))
def a9(spark, sf):
    return panels.distinct_counts(d.transfers(spark, sf), ["token", "sender", "recipient", "block"])


@query("a26_eras", sql("flows", "SELECT CASE WHEN block >= 1800 THEN 'late' WHEN block >= 900 THEN 'middle' WHEN block >= 0 THEN 'early' ELSE 'before' END AS era, count(*) AS n_rows, count(DISTINCT address) AS n_addresses FROM flows GROUP BY 1"))
def a26(spark, sf):
    return panels.era_rows(flows(spark, sf), [("early", 0), ("middle", 900), ("late", 1800)])


@query("w8_top_active", sql("flows", "SELECT address, count(*) AS n FROM flows GROUP BY address ORDER BY n DESC, address LIMIT 25"))
def w8(spark, sf):
    return ranks.top_n(flows(spark, sf).groupBy("address").agg(F.count("*").alias("n")), [F.desc("n"), F.col("address")], 25)


@query("w9_last_rows", sql("transfers", "SELECT token, block, value::DOUBLE AS value, l_orderkey FROM transfers QUALIFY row_number() OVER (PARTITION BY token ORDER BY block DESC, l_orderkey DESC, l_linenumber DESC, value DESC) <= 5"))
def w9(spark, sf):
    return ranks.last_n(d.transfers(spark, sf), ["token"], ["block", "l_orderkey", "l_linenumber", "value"], 5).select("token", "block", F.col("value").cast("double").alias("value"), "l_orderkey")


FIRST = {"first": "SELECT address, min(block) AS block FROM flows GROUP BY address"}


@query("w15_cumulative", sql("flows snaps", "SELECT snapshot, count(*) AS n FROM first JOIN snaps ON block <= snapshot GROUP BY snapshot", FIRST))
def w15(spark, sf):
    return ranks.cumulative_entities(flows(spark, sf).groupBy("address").agg(F.min("block").alias("block")), SNAPS)


@query("w16_account_kinds", sql("flows snaps contracts", """SELECT snapshot, count(*) AS n_all, count(made) FILTER (greatest(f.block, made) <= snapshot) AS n_ca, count(*) - count(made) FILTER (greatest(f.block, made) <= snapshot) AS n_eoa
  FROM first f LEFT JOIN (SELECT address, 400 AS made FROM contracts) c USING (address) JOIN snaps ON f.block <= snapshot GROUP BY snapshot""", FIRST))
def w16(spark, sf):
    first = flows(spark, sf).groupBy("address").agg(F.min("block").alias("block"))
    return ranks.account_kinds(first, d.contracts(spark, sf).withColumn("block", F.lit(400)), SNAPS)


MD5 = "md5({0})"


@query("w17_hash_sample", sql("transfers", "SELECT token, sender, recipient, block, l_orderkey FROM transfers QUALIFY row_number() OVER (PARTITION BY token ORDER BY md5('s' || concat_ws('|', l_orderkey, l_linenumber, block, value, coalesce(sender, ''), coalesce(recipient, '')))) <= 7"))
def w17(spark, sf):
    ident = F.concat_ws("|", "l_orderkey", "l_linenumber", "block", F.col("value").cast("string"), F.coalesce("sender", F.lit("")), F.coalesce("recipient", F.lit("")))
    return ranks.hash_sample(d.transfers(spark, sf), ["token"], ident, 7, "s").select("token", "sender", "recipient", "block", "l_orderkey")


@query("w18_weighted_sample", """SELECT o_orderkey FROM (SELECT o_orderkey, ln((('0x' || substr(md5('w' || o_orderkey), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0) / sqrt(date_diff('day', DATE '1994-01-01', o_orderdate::DATE)) AS k FROM orders) ORDER BY k DESC, o_orderkey LIMIT 50""")
def w18(spark, sf):
    orders = d.table(spark, sf, "orders")
    from datetime import date

    weight = F.sqrt(F.datediff(F.to_date("o_orderdate"), F.lit(date(1994, 1, 1))).cast("double"))
    return ranks.weighted_sample(orders, F.col("o_orderkey"), weight, 50, "w").select("o_orderkey")


@query("w20_previous", sql("summed snaps", "SELECT snapshot, n, lag(n) OVER (ORDER BY snapshot) AS prev_n FROM (SELECT snapshot, count(*) AS n FROM first JOIN snaps ON block <= snapshot GROUP BY snapshot)", FIRST))
def w20(spark, sf):
    return ranks.with_previous(w15(spark, sf), [], "snapshot", ["n"])


@query("w21_keep_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w21(spark, sf):
    return ranks.dedupe(d.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w22_next_snapshot", sql("snaps transfers", "SELECT snapshot, lead(snapshot) OVER (ORDER BY snapshot) AS next_snapshot FROM (SELECT DISTINCT snapshot FROM snaps JOIN transfers ON block = snapshot)"))
def w22(spark, sf):
    there = d.transfers(spark, sf).filter(F.col("block").isin(SNAPS)).select(F.col("block").alias("snapshot")).distinct()
    return ranks.with_previous(there, [], "snapshot", ["snapshot"], ahead=True)


INEQUALITY = """SELECT token, snapshot, max(n) AS holders, max(total)::DOUBLE AS supply, round(sum(pow(v / total, 2)), 9) AS hhi, round(2 * sum((n + 1 - r) * v) / (max(n) * max(total)) - (max(n) + 1) / max(n)::DOUBLE, 9) AS gini,
  round(sum(v) FILTER (r <= 1) / max(total), 9) AS top1, round(sum(v) FILTER (r <= 10) / max(total), 9) AS top10, round(sum(v) FILTER (r <= 100) / max(total), 9) AS top100,
  round(sum(v) FILTER (r <= greatest(1, ceil(n * 1 / 100.0))) / max(total), 9) AS top1pct, round(sum(v) FILTER (r <= greatest(1, ceil(n * 5 / 100.0))) / max(total), 9) AS top5pct, round(sum(v) FILTER (r <= greatest(1, ceil(n * 10 / 100.0))) / max(total), 9) AS top10pct,
  min(r) FILTER (run >= 0.5 * total) AS nakamoto
FROM (SELECT token, snapshot, balance::DOUBLE AS v, row_number() OVER w AS r, sum(balance::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, count(*) OVER (PARTITION BY token, snapshot) AS n, sum(balance::DOUBLE) OVER (PARTITION BY token, snapshot) AS total
  FROM balances WHERE balance > 0 WINDOW w AS (PARTITION BY token, snapshot ORDER BY balance DESC, address)) GROUP BY token, snapshot HAVING max(n) > 1"""


@query("w1_inequality", sql("balances", INEQUALITY))
def w1(spark, sf):
    rows = ranks.inequality(balance(spark, sf))
    return rows.select("token", "snapshot", "holders", F.col("supply").cast("double").alias("supply"), "nakamoto", *[F.round(c, 9).alias(c) for c in ("hhi", "gini", "top1", "top10", "top100", "top1pct", "top5pct", "top10pct")])
