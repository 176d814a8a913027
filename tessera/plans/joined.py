"""Queries of the joins by name, and of small aggregates that others ride on."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import asof, attribution as g, balances as b, filters as fl, joins, panels, positions as n, ranks, stats as m
from tessera.plans.ctes import sql
from tessera.plans.ledger import DAYS, SNAPS, flows
from tessera.plans.portfolio import accounts, folded, positions, r
from tessera.plans.registry import query
from tessera.plans.statistics import over_valid, valid
from tessera.sources import domain as d


@query("j1_inner", sql("flows contracts", "SELECT address, count(*) AS n, sum(value)::DOUBLE AS net FROM flows JOIN contracts USING (address) GROUP BY address"))
def j1(spark, sf):
    rows = flows(spark, sf).join(d.contracts(spark, sf), "address")
    return rows.groupBy("address").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"))


@query("j2_left", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def j2(spark, sf):
    counts = d.table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return d.table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j3_left_last", "SELECT c_custkey, k AS last_key FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j3(spark, sf):
    last = joins.last_of_key(d.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return d.table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("last_key"))


@query("j4_flip_flag", "SELECT p_partkey AS token, CASE WHEN p_size % 2 = 0 THEN 'true' WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'true' ELSE 'FALSE' END AS is_erc_20 FROM part")
def j4(spark, sf):
    part = d.table(spark, sf, "part")
    status = part.select(F.col("p_partkey").alias("token"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("FALSE").alias("is_erc_20"))
    verdicts = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("token"), F.when(F.col("p_size") % 3 == 0, " y").otherwise("n").alias("first_check"), F.lit("Y").alias("second_check"))
    return g.flip_flag(status, verdicts)


@query("j5_left_and_unmatched", """SELECT coalesce(a.k, c.k) AS k, a.name, c.n FROM (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 = 0) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) c ON a.k = c.k""")
def j5(spark, sf):
    left = d.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    right = d.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.left_and_unmatched(left, right, ["k"])


J6 = min(x for x in SNAPS if x > 1800), SNAPS[-1]


@query("j6_full_outer", sql("positions", f"""SELECT coalesce(a.address, c.address) AS address, coalesce(a.token, c.token) AS token, coalesce(a.balance, 0) AS u0, coalesce(c.balance, 0) AS u1 FROM (SELECT * FROM positions WHERE snapshot = {J6[0]}) a
  FULL JOIN (SELECT * FROM positions WHERE snapshot = {J6[1]}) c ON a.address = c.address AND a.token = c.token"""))
def j6(spark, sf):
    a, c = (positions(spark, sf).filter(F.col("snapshot") == x).select("address", "token", F.col("balance").alias(u)) for x, u in zip(J6, ("u0", "u1"), strict=True))
    return a.join(c, ["address", "token"], "full_outer").select("address", "token", F.coalesce("u0", F.lit(0.0)).alias("u0"), F.coalesce("u1", F.lit(0.0)).alias("u1"))


@query("j7_semi", sql("accounts contracts", "SELECT snapshot, count(*) AS n, round(sum(total_value), 2) AS value FROM accounts WHERE address IN (SELECT address FROM contracts) GROUP BY snapshot"))
def j7(spark, sf):
    rows = accounts(spark, sf).join(d.contracts(spark, sf), "address", "left_semi")
    return rows.groupBy("snapshot").agg(F.count("*").alias("n"), F.round(F.sum("total_value"), 2).alias("value"))


@query("j8_anti", sql("transfers", "SELECT token, count(*) AS n FROM transfers t WHERE NOT EXISTS (SELECT 1 FROM transfers x WHERE x.token = t.token AND x.sender = t.recipient) GROUP BY token"))
def j8(spark, sf):
    t = d.transfers(spark, sf)
    senders = t.filter("sender IS NOT NULL").select("token", F.col("sender").alias("recipient")).distinct()
    return t.join(senders, ["token", "recipient"], "left_anti").groupBy("token").agg(F.count("*").alias("n"))


@query("j9_range", sql("flows", "SELECT q.block, count(f.value) AS n, coalesce(sum(f.value), 0)::DOUBLE AS balance FROM (SELECT DISTINCT o_custkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS block FROM orders) q LEFT JOIN flows f ON f.address = 'C' || q.o_custkey AND f.block <= q.block GROUP BY q.block"))
def j9(spark, sf):
    # The range condition as running sums in one stream by address: no pair of a query and a flow is made.
    pairs = d.table(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("address"), d.block(F.to_date("o_orderdate")).alias("block")).distinct()
    sums = b.balances_at(flows(spark, sf).withColumn("one", F.lit(1).cast("long")), pairs, values={"balance": "value", "n": "one"})
    return sums.groupBy("block").agg(F.sum("n").alias("n"), F.sum("balance").cast("double").alias("balance"))


@query("j10_asof", sql("prices", "SELECT o_orderkey, (SELECT arg_max(close, day) FROM prices p WHERE p.token = 'Brand#' || (o_custkey % 25 + 1) AND p.day <= o_orderdate::DATE) AS close FROM orders"))
def j10(spark, sf):
    asked = d.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("token"), F.to_date("o_orderdate").alias("day"))
    return b.spot(d.prices(spark, sf), asked).select("o_orderkey", "close")


@query("j11_using", "SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS gas FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def j11(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), "l_quantity").join(d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("block"), "o_orderstatus"), "block")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("gas"))


@query("j12_rank_of_one", sql("flows", "SELECT own::DOUBLE AS value, (SELECT count(*) FROM held WHERE v > own) + 1 AS rank FROM (SELECT max(v) AS own FROM held WHERE address = 'C1') WHERE own IS NOT NULL", {"held": "SELECT address, sum(value) AS v FROM flows GROUP BY address"}))
def j12(spark, sf):
    held = flows(spark, sf).groupBy("address").agg(F.sum("value").cast("double").alias("v"))
    return joins.rank_of(held, "v", "address", "C1")


@query("j14_date_check", sql("transfers", "SELECT count(*) AS n, count(*) FILTER (known IS NULL) AS missing, count(*) FILTER (known <> day) AS mismatched FROM (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS block, (o_orderdate::DATE + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END)::DATE AS day FROM orders) LEFT JOIN (SELECT DISTINCT block, day AS known FROM transfers) USING (block)"))
def j14(spark, sf):
    day = F.to_date("o_orderdate")
    manifest = d.table(spark, sf, "orders").select(d.block(day).alias("block"), F.date_add(day, F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("day"))
    return joins.date_mismatches(manifest, d.transfers(spark, sf).select("block", "day").distinct())


@query("j15_categories", "SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY p_type")
def j15(spark, sf):
    meta = d.table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return d.table(spark, sf, "lineitem").select("l_partkey").join(meta, "l_partkey", "left").na.drop(subset=["p_type"]).groupBy("p_type").agg(F.count("*").alias("n"))


@query("a10_largest_holder", sql("positions", "SELECT snapshot, token, arg_max(address, (balance, address)) AS largest, max(balance) AS balance FROM positions GROUP BY ALL"))
def a10(spark, sf):
    return positions(spark, sf).groupBy("snapshot", "token").agg(F.max_by("address", F.struct("balance", "address")).alias("largest"), F.max("balance").alias("balance"))


@query("a11_all_small", sql("positions", "SELECT snapshot, count(*) FILTER (e) AS n_every, count(*) FILTER (s) AS n_some FROM (SELECT snapshot, address, bool_and(balance <= 50) AS e, bool_or(balance <= 50) AS s FROM positions GROUP BY ALL) GROUP BY snapshot"))
def a11(spark, sf):
    one = positions(spark, sf).groupBy("snapshot", "address").agg(F.bool_and(F.col("balance") <= 50).alias("every"), F.bool_or(F.col("balance") <= 50).alias("some"))
    return one.groupBy("snapshot").agg(F.count_if("every").alias("n_every"), F.count_if("some").alias("n_some"))


@query("w6_totals_beside", sql("folded", "SELECT snapshot, address, token, round(value / sum(value) OVER (PARTITION BY snapshot, address), 9) AS share, count(*) OVER (PARTITION BY snapshot, address) AS n FROM folded WHERE value > 0"))
def w6(spark, sf):
    by = W.partitionBy("snapshot", "address")
    return folded(spark, sf).filter("value > 0").select("snapshot", "address", "token", F.round(F.col("value") / F.sum("value").over(by), 9).alias("share"), F.count("*").over(by).alias("n"))


@query("w19_row_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('r' || o_orderkey) LIMIT 100")
def w19(spark, sf):
    return ranks.hash_sample(d.table(spark, sf, "orders"), [], F.col("o_orderkey"), 100, "r").select("o_orderkey", "o_custkey")


@query("n1_folded_map", sql("positions", f"SELECT snapshot, address, count(*) AS n, round(sum(units), 6) AS units FROM (SELECT snapshot, address, CASE WHEN token = '{d.WRAPPED}' THEN '{d.NATIVE}' ELSE token END AS token, sum(balance) AS units FROM positions GROUP BY ALL) WHERE units > 0 GROUP BY ALL"))
def n1(spark, sf):
    maps = positions(spark, sf).groupBy("snapshot", "address").agg(F.map_from_entries(F.collect_list(F.struct("token", "balance"))).alias("m"))
    one = n.fold_map(F.col("m"), {d.WRAPPED: d.NATIVE})
    return r(maps.select("snapshot", "address", one.alias("m")).select("snapshot", "address", F.size("m").cast("long").alias("n"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).alias("units")))


@query("u3_common_snapshots", sql("positions", "SELECT snapshot FROM positions WHERE token = 'Brand#11' INTERSECT SELECT snapshot FROM positions WHERE token = 'Brand#25'"))
def u3(spark, sf):
    one = lambda t: positions(spark, sf).filter(F.col("token") == t).select("snapshot")
    return one("Brand#11").intersect(one("Brand#25"))


@query("u6_unreviewed", sql("transfers", "SELECT DISTINCT recipient AS address FROM transfers WHERE recipient IS NOT NULL AND recipient LIKE 'C%' EXCEPT SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"))
def u6(spark, sf):
    reviewed = d.table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.concat(F.lit("C"), "o_custkey").alias("address"))
    found = d.transfers(spark, sf).filter("recipient LIKE 'C%'").select(F.col("recipient").alias("address")).distinct()
    return fl.drop_listed(found, reviewed, "address")


@query("p25_implied_price", sql("folded", "SELECT snapshot, token, round(sum(value) / sum(units), 6) AS price FROM folded WHERE value > 0 AND units > 0 GROUP BY ALL"))
def p25(spark, sf):
    rows = n.token_totals(folded(spark, sf).filter("value > 0 AND units > 0"))
    return rows.select("snapshot", "token", F.round("implied_price", 6).alias("price"))


@query("m3_hit_rate", over_valid("SELECT size, count(*) AS n, round(avg(CASE WHEN l1 <= 0.02 OR ret_equal = ret_base THEN 0.5 WHEN ret_equal > ret_base THEN 1 ELSE 0 END), 8) AS hit_rate, round(avg((l1 <= 0.02 OR ret_equal = ret_base)::INTEGER), 8) AS tie FROM ok GROUP BY size"))
def m3(spark, sf):
    return r(m.hit_rate(valid(spark, sf), ["size"], "ret_base", "ret_equal", "l1"), 8)


@query("g14_absent_positions", sql("positions flows", """SELECT address, token, truth, truth = 0 AS ok FROM (SELECT a.address, a.token, coalesce(x.truth, 0) AS truth FROM (SELECT address, (SELECT list(t ORDER BY t) FROM (SELECT DISTINCT token AS t FROM prices))[(h % (SELECT count(DISTINCT token) FROM prices) + 1)] AS token, h
  FROM (SELECT address, ('0x' || substr(md5('probe' || address), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT address FROM flows))) a LEFT JOIN (SELECT token, address, sum(value)::DOUBLE AS truth FROM flows GROUP BY ALL) x ON a.address = x.address AND a.token = x.token
  WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.address = a.address AND p.token = a.token AND p.snapshot = (SELECT max(snapshot) FROM snaps)) ORDER BY h, a.address LIMIT 40)"""))
def g14(spark, sf):
    x = flows(spark, sf)
    truth = x.groupBy("token", "address").agg(F.sum("value").cast("double").alias("balance"))
    return g.absent_positions(positions(spark, sf).filter(F.col("snapshot") == SNAPS[-1]), x, d.prices(spark, sf), truth, 40, "probe")


@query("g15_curated", "SELECT p_brand AS token, p_partkey, p_size % 2 = 0 AS cash_core, p_size % 3 = 0 AS cash_extended, p_brand IN (SELECT p_brand FROM part WHERE p_size > 49) AS whitelisted, p_size % 2 = 0 AND p_size % 3 <> 0 AS breaks_rule, count(*) OVER (PARTITION BY p_brand) > 1 AS repeated FROM part")
def g15(spark, sf):
    part = d.table(spark, sf, "part")
    listed = part.select(F.col("p_brand").alias("token"), "p_partkey", (F.col("p_size") % 2 == 0).alias("cash_core"), (F.col("p_size") % 3 == 0).alias("cash_extended"))
    return g.curated(listed, part.filter("p_size > 49").select(F.col("p_brand").alias("token")))


@query("j10_nearest_after", sql("prices", "SELECT o_orderkey, (SELECT arg_min(close, day) FROM prices p WHERE p.token = 'Brand#11' AND p.day >= o_orderdate::DATE AND p.day <= o_orderdate::DATE + 10) AS close FROM orders"))
def j10_after(spark, sf):
    asked = d.table(spark, sf, "orders").select("o_orderkey", F.lit("Brand#11").alias("token"), F.to_date("o_orderdate").alias("day"))
    return asof.asof_join(asked, d.prices(spark, sf).withColumnRenamed("day", "price_day"), ["token"], "day", "price_day", 10, forward=True).select("o_orderkey", "close")


@query("u2_snapshot_gaps", sql("snaps transfers", "SELECT *, CASE WHEN duplicates + missing + unexpected = 0 THEN 'PASS' ELSE 'NOT_PASS' END AS status FROM (SELECT (SELECT count(*) FROM (SELECT block FROM (SELECT DISTINCT block, kind FROM transfers WHERE block IN (SELECT snapshot FROM snaps) OR block % 100 = 0) GROUP BY block HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM snaps WHERE snapshot NOT IN (SELECT block FROM transfers)) AS missing, (SELECT count(DISTINCT block) FROM transfers WHERE block NOT IN (SELECT snapshot FROM snaps) AND block % 100 = 0) AS unexpected)"))
def u2_gaps(spark, sf):
    there = d.transfers(spark, sf).filter(F.col("block").isin(list(DAYS)) | (F.col("block") % 100 == 0)).select(F.col("block").alias("snapshot"), "kind").distinct()
    return panels.coverage(there, spark.createDataFrame([(x,) for x in SNAPS], "snapshot int"), "snapshot")
