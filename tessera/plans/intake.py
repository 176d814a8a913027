"""Queries of what turns raw rows into a ledger: loads, filters, decoding, fees, withdrawals, chunks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import values as v
from tessera.operators import balances as b
from tessera.operators import filters as fl
from tessera.operators import ledger as l
from tessera.operators import panels
from tessera.plans.ctes import sql
from tessera.plans.ledger import SNAPS, doubled, flows
from tessera.plans.registry import query
from tessera.sources import domain as d
from tessera.sources import states
from tessera.sources import tables as s


def items(spark, sf):
    return d.table(spark, sf, "lineitem")


def orders(spark, sf):
    return d.table(spark, sf, "orders")


def hexed(col, digits: int):
    return F.lpad(F.lower(F.hex(col)), digits, "0")


def hexed_sql(col: str, digits: int) -> str:
    return f"lpad(lower(to_hex({col})), {digits}, '0')"


# ------------------------------------------------------------------ loads and writes


@query("s2_read_drifting", "SELECT o_orderstatus = 'F' AS first, count(*) AS n, count(o_custkey) FILTER (o_orderstatus <> 'F') AS n_customer, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS price FROM orders GROUP BY 1")
def s2(spark, sf):
    o, root = orders(spark, sf), s.shared_path(spark, "drifting")
    o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").withColumn("first", F.lit(True)).write.parquet(f"{root}/a")
    o.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey").withColumn("first", F.lit(False)).write.parquet(f"{root}/b")
    rows = s.read_drifting(spark, [f"{root}/a", f"{root}/b"])
    return rows.groupBy("first").agg(F.count("*").alias("n"), F.count("o_custkey").alias("n_customer"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("s6_file_ranges", "SELECT l_returnflag AS part, min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS n FROM lineitem GROUP BY 1")
def s6(spark, sf):
    root = s.shared_path(spark, "parts")
    items(spark, sf).select("l_returnflag", "l_orderkey").write.partitionBy("l_returnflag").parquet(root)
    files = s.file_ranges(spark.read.parquet(root), "l_orderkey")
    part = F.regexp_extract("file", r"l_returnflag=([^/]+)/", 1)
    return files.groupBy(part.alias("part")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


@query("s8_price_files", sql("prices", "SELECT token, day AS date, close FROM prices"))
def s8(spark, sf):
    root = s.shared_path(spark, "prices")
    d.prices(spark, sf).select("token", F.date_format("day", "yyyy-MM-dd 00:00:00").alias("date"), F.col("close").alias("daily_close_usd")).write.partitionBy("token").option("header", "true").csv(root)
    return s.read_prices(spark, root, r"token=([^/]+)/")


@query("s9_address_lines", f"SELECT '0x' || {hexed_sql('c_custkey', 40)} AS address, 'x;0X' || upper({hexed_sql('c_custkey', 40)}) || ', ' || c_name AS line FROM customer")
def s9(spark, sf):
    root = s.shared_path(spark, "lines")
    row = F.concat(F.lit("x;0X"), F.upper(hexed("c_custkey", 40)), F.lit(", "), "c_name")
    lines = d.table(spark, sf, "customer").select(row.alias("value"))
    lines.unionByName(d.table(spark, sf, "nation").select(F.concat(F.lit("address\t"), "n_name").alias("value"))).write.text(root)
    return s.read_addresses(spark, root)


@query("s11_genesis", f"SELECT '0x' || {hexed_sql('c_custkey', 40)} AS recipient, (c_custkey * 1000003)::DOUBLE AS value, 0 AS block FROM customer")
def s11(spark, sf):
    amount = F.col("c_custkey") * 1000003
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(amount)))).otherwise(amount.cast("string"))
    entry = F.struct(hexed("c_custkey", 40), F.struct(text.alias("balance")))
    alloc = d.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("alloc"))
    return l.genesis_rows(alloc).select("recipient", F.col("value").cast("double").alias("value"), "block")


@query("s6_range_scan", sql("flows", "SELECT token, count(*) AS n, sum(value)::DOUBLE AS net, min(block) AS first_block, max(block) AS last_block FROM flows WHERE block BETWEEN 900 AND 1300 GROUP BY token"))
def s6_scan(spark, sf):
    root = s.shared_path(spark, "ranged")
    index = states.write_ranged(flows(spark, sf), root, "block", 16)
    rows = states.scan_range(spark, root, index, "block", 900, 1300)
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"), F.min("block").alias("first_block"), F.max("block").alias("last_block"))


@query("s13_bucketed_write", sql("flows", "SELECT address, count(*) AS n, sum(value)::DOUBLE AS net, bool_and(block >= first_block) AS in_order, count(DISTINCT address) AS n_buckets FROM (SELECT *, min(block) OVER (PARTITION BY address) AS first_block FROM flows) GROUP BY address"))
def s13_write(spark, sf):
    root = s.shared_path(spark, "buckets")
    s.write_bucketed(flows(spark, sf).withColumn("log_index", F.lit(0)), root, 16)
    rows = spark.read.parquet(root).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    # A row's place in its file against the row of its address before it there.
    before = F.lag("block").over(W.partitionBy("address", "file").orderBy("place"))
    rows = rows.withColumn("ok", F.coalesce(F.col("block") >= before, F.lit(True)))
    return rows.groupBy("address").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"), F.bool_and("ok").alias("in_order"), F.countDistinct("bucket").alias("n_buckets"))


@query("s13_bucketed_join", sql("flows", "SELECT f.address, c_mktsegment AS segment, count(*) AS n, sum(value)::DOUBLE AS net, min(block) AS first_block FROM flows f JOIN customer ON f.address = 'C' || c_custkey GROUP BY ALL"))
def s13(spark, sf):
    table = states.write_clustered(flows(spark, sf), "address", ("block",), 16)
    wallets = d.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("address"), F.col("c_mktsegment").alias("segment"))
    return spark.table(table).join(wallets, "address").groupBy("address", "segment").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"), F.min("block").alias("first_block"))


@query("b1_incremental", sql("balances", "SELECT token, address, snapshot, balance::DOUBLE AS balance FROM balances"))
def b1_incremental(spark, sf):
    """Balances built in three steps, each from the last stored snapshot and the files with later blocks."""
    root = s.shared_path(spark, "states")
    index = states.write_ranged(flows(spark, sf), f"{root}/ledger", "block", 16)
    store = states.States(spark, root, "ledger")
    for k in (10, 20, len(SNAPS)):
        store.advance(f"{root}/ledger", index, SNAPS[:k])
    return store.state(SNAPS).withColumn("balance", F.col("balance").cast("double"))


@query("s15_manifest_upsert", "SELECT o_orderkey AS block_number, o_orderstatus AS source_tag, o_custkey AS rows FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'F', -o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def s15(spark, sf):
    old = orders(spark, sf).select(F.col("o_orderkey").alias("block_number"), F.col("o_orderstatus").alias("source_tag"), F.col("o_custkey").alias("rows"))
    new = old.filter("source_tag = 'F' AND block_number % 2 = 0").select("block_number", (-F.col("rows")).alias("rows"))
    return s.upsert_manifest(old, new, "F").select("block_number", "source_tag", "rows")


# ------------------------------------------------------------------ logs


def logs(spark, sf):
    """Line items as logs: open ones are transfers, returned ones withdrawals, others deposits; parts are tokens, suppliers and orders the parties."""
    kind = F.when(F.col("l_returnflag") == "N", "transfer").when(F.col("l_returnflag") == "R", "withdrawal").otherwise("deposit")
    topic = F.when(F.col("l_linenumber") == 7, F.lit("0x00")).when(kind == "transfer", l.TOPICS["transfer"]).when(kind == "withdrawal", l.TOPICS["withdrawal"]).otherwise(F.upper(F.lit(l.TOPICS["deposit"])))
    word = lambda c: F.unhex(F.lpad(F.hex(c), 64, "0"))
    topics = F.array(F.unhex(F.lpad(F.lit("0"), 64, "0")), word("l_suppkey"), word("l_orderkey"))
    return items(spark, sf).select(topic.alias("topic0"), topics.alias("topics"), F.unhex(hexed("l_partkey", 40)).alias("address"), word((F.col("l_quantity") - 1).cast("long")).alias("data"), F.col("l_orderkey").alias("block_id"), F.col("l_linenumber").alias("log_index"), F.col("l_orderkey").cast("string").alias("tx_hash"))


@query("f1_events", "SELECT CASE l_returnflag WHEN 'N' THEN 'transfer' WHEN 'R' THEN 'withdrawal' ELSE 'deposit' END AS event, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def f1(spark, sf):
    return l.classify_events(logs(spark, sf)).groupBy("event").agg(F.count("*").alias("n"))


ZERO = f"'{l.ZERO}'"


@query("l1_decoded_logs", f"""SELECT '0x' || {hexed_sql('l_partkey', 40)} AS token, CASE l_returnflag WHEN 'A' THEN {ZERO} ELSE '0x' || {hexed_sql('l_suppkey', 40)} END AS sender, CASE l_returnflag WHEN 'N' THEN '0x' || {hexed_sql('l_orderkey', 40)} WHEN 'A' THEN '0x' || {hexed_sql('l_suppkey', 40)} ELSE {ZERO} END AS recipient,
  l_orderkey AS block, l_linenumber AS log_index, l_quantity - 1 AS value, l_orderkey::VARCHAR AS tx_hash FROM lineitem WHERE l_linenumber <> 7 AND l_quantity > 1""")
def l1(spark, sf):
    return doubled(l.decode_transfers(l.classify_events(logs(spark, sf))))


@query("f5_positive", sql("flows", "SELECT token, count(*) AS n, sum(value)::DOUBLE AS total FROM flows WHERE value > 0 GROUP BY token"))
def f5(spark, sf):
    return l.positive(flows(spark, sf)).groupBy("token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


# ------------------------------------------------------------------ filters


@query("f4_whitelist", f"SELECT DISTINCT '0x' || {hexed_sql('p_partkey', 40)} AS token FROM part WHERE p_size > 10 AND p_retailprice > 910 AND p_type <> 'PROMO' UNION ALL SELECT 'ETH'")
def f4(spark, sf):
    status = d.table(spark, sf, "part").select(F.concat(F.lit("0X"), F.upper(hexed("p_partkey", 40))).alias("contract_address"), F.when(F.col("p_size") > 10, "True").otherwise("false").alias("is_erc_20"), F.when(F.col("p_retailprice") > 910, "SUCCESS").otherwise("failure").alias("price_data_status"), F.when(F.col("p_type") == "PROMO", "NOT_PASS").otherwise(" PASS ").alias("local_status"))
    return fl.whitelist(status)


@query("f6_not_reverted", "SELECT event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY event_type")
def f6(spark, sf):
    traces = d.table(spark, sf, "events").withColumn("status", F.when(F.col("value") > 5, 1).when(F.col("value") > 2, 0))
    return l.not_reverted(traces).groupBy("event_type").agg(F.count("*").alias("n"))


def traces(spark, sf):
    """Line items as traces of their order: the kind by flag, call type by status, a place in the call tree by line number."""
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "create").otherwise("suicide")
    kind = F.when(F.col("l_linenumber") == 6, "reward").when(F.col("l_linenumber") == 7, "genesis").otherwise(kind)
    path = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") <= 3, (F.col("l_linenumber") - 2).cast("string")).otherwise(F.concat(F.lit("0,"), F.col("l_linenumber") - 4))
    error = F.when((F.col("l_returnflag") == "R") & F.col("l_linenumber").isin(2, 3), "Reverted")
    call = F.when(F.col("l_linestatus") == "F", "call").otherwise("delegatecall")
    return items(spark, sf).select(F.col("l_orderkey").alias("tx_hash"), F.col("l_orderkey").alias("block"), kind.alias("trace_type"), F.when(kind == "call", call).alias("call_type"), path.alias("trace_address"), error.alias("error"), (F.col("l_quantity") - 25).alias("value"), "l_linenumber", "l_partkey", "l_returnflag")


KIND = "CASE WHEN l_linenumber = 6 THEN 'reward' WHEN l_linenumber = 7 THEN 'genesis' WHEN l_returnflag = 'A' THEN 'call' WHEN l_returnflag = 'N' THEN 'create' ELSE 'suicide' END"
PATH = "CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber <= 3 THEN (l_linenumber - 2)::VARCHAR ELSE '0,' || (l_linenumber - 4) END"


@query("f7_value_moves", f"SELECT kind, count(*) AS n, sum(value) AS total FROM (SELECT {KIND} AS kind, l_linestatus, l_quantity - 25 AS value FROM lineitem) WHERE value > 0 AND (kind IN ('create', 'suicide') OR (kind = 'call' AND l_linestatus = 'F')) GROUP BY kind")
def f7(spark, sf):
    return l.value_moves(traces(spark, sf)).groupBy(F.col("trace_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("f8_mints", f"SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind, l_orderkey FROM lineitem) WHERE (kind = 'reward' AND l_orderkey < 1000) OR kind = 'genesis' GROUP BY kind")
def f8(spark, sf):
    return l.mints(traces(spark, sf), 1000).groupBy(F.col("trace_type").alias("kind")).agg(F.count("*").alias("n"))


@query("f11_proxy_target", f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0x' || {hexed_sql('c_custkey', 40)} END AS target FROM customer")
def f11(spark, sf):
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, "0x363D3D373d3d3d363d73").otherwise("363d3d373d3d3d363d74"), hexed("c_custkey", 40), F.lit("5af43d82803e903d91602b57fd5bf3"))
    return d.table(spark, sf, "customer").select("c_custkey", v.proxy_target(code).alias("target"))


@query("f12_impossible", "SELECT length(repeat('9', (o_orderkey % 90 + 1)::INTEGER)) AS digits, o_orderkey % 90 + 1 >= 77 AS impossible, count(*) AS n FROM orders GROUP BY ALL")
def f12(spark, sf):
    text = F.repeat(F.lit("9"), (F.col("o_orderkey") % 90 + 1).cast("int"))
    return orders(spark, sf).select(F.length(text).cast("long").alias("digits"), v.impossible_balance(text).alias("impossible")).groupBy("digits", "impossible").agg(F.count("*").alias("n"))


@query("f14_no_custody", sql("flows", "SELECT token, count(*) AS n, sum(value)::DOUBLE AS net FROM flows WHERE address <> 'S1' GROUP BY token"))
def f14(spark, sf):
    return fl.exclude_custody(flows(spark, sf), "S1").groupBy("token").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"))


@query("f18_sane_supply", "SELECT p_partkey, least(1.0, p_retailprice / 950) AS gini FROM part WHERE p_size < 45")
def f18(spark, sf):
    # Sizes from 45 up stand for supplies that overflowed.
    supply = F.when(F.col("p_size") < 45, F.col("p_retailprice")).otherwise(F.lit(1e60))
    return fl.sane_supply(d.table(spark, sf, "part").select("p_partkey", supply.alias("supply"), (F.col("p_retailprice") / 950).alias("gini"))).select("p_partkey", "gini")


# ------------------------------------------------------------------ traces, fees, withdrawals


@query("l4_native_flows", sql("transfers", "SELECT kind, count(*) AS n, sum(value)::DOUBLE AS net FROM (SELECT kind, -value AS value FROM transfers WHERE token = 'Brand#11' AND sender IS NOT NULL UNION ALL SELECT kind, value FROM transfers WHERE token = 'Brand#11' AND recipient IS NOT NULL) GROUP BY kind"))
def l4(spark, sf):
    rows = l.to_flows(d.transfers(spark, sf).filter(F.col("token") == d.NATIVE))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("net"))


@query("l6_not_reverted_subtrees", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, {PATH} AS path FROM lineitem), bad AS (SELECT DISTINCT l_orderkey AS tx, path AS failed FROM t WHERE l_returnflag = 'R' AND l_linenumber IN (2, 3))
  SELECT l_linenumber, l_returnflag, count(*) AS n FROM t WHERE NOT EXISTS (SELECT 1 FROM bad WHERE tx = l_orderkey AND (path = failed OR starts_with(path, failed || ','))) GROUP BY ALL""")
def l6(spark, sf):
    return l.drop_reverted_subtrees(traces(spark, sf)).groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))


@query("l7_trace_key", f"SELECT l_linenumber, array_to_string(list_transform(list_filter(string_split({PATH}, ','), lambda x: x <> ''), lambda x: lpad(x, 9, '0')), '.') AS key, count(*) AS n FROM lineitem GROUP BY ALL")
def l7(spark, sf):
    return traces(spark, sf).select("l_linenumber", l.trace_key(F.col("trace_address")).alias("key")).groupBy("l_linenumber", "key").agg(F.count("*").alias("n"))


def fees(spark, sf):
    """Line items as transactions of their order's block: quantity is gas, supplier the price."""
    tx = items(spark, sf).select(F.col("l_orderkey").alias("block"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_hash"), F.concat(F.lit("S"), "l_suppkey").alias("sender"), F.col("l_quantity").cast("long").alias("gas_used"), (F.col("l_suppkey") + 10).alias("gas_price"), F.when(F.col("l_linenumber") == 1, F.lit(2)).alias("blob_gas_used"), F.when(F.col("l_linenumber") == 1, F.lit(3)).alias("blob_gas_price"))
    blocks = orders(spark, sf).select(F.col("o_orderkey").alias("block"), F.concat(F.lit("C"), "o_custkey").alias("producer"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5).alias("base_fee"))
    return l.fee_rows(tx, blocks)


FEES = """fees AS (SELECT l_orderkey, o_custkey, l_quantity::BIGINT * (l_suppkey + 10) AS fee, l_quantity::BIGINT * CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 5 ELSE 0 END AS base, CASE WHEN l_linenumber = 1 THEN 6 ELSE 0 END AS blob FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("l8_fee_split", f"WITH {FEES} SELECT 'fee_burn' AS kind, NULL::VARCHAR AS recipient, count(*) AS n, sum(base + blob)::DOUBLE AS value FROM fees WHERE base + blob > 0 UNION ALL SELECT 'fee_tip', 'C' || o_custkey, count(*), sum(fee - base)::DOUBLE FROM fees WHERE fee - base > 0 GROUP BY o_custkey")
def l8(spark, sf):
    return fees(spark, sf).groupBy("kind", "recipient").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


def withdrawn(spark, sf):
    """Orders as blocks that list their line items as withdrawals; only even lines carry an index."""
    one = F.struct(F.col("l_suppkey").alias("order"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("index"), F.concat(F.lit("0X"), hexed("l_suppkey", 40)).alias("address"), F.col("l_quantity").cast("long").alias("amount"))
    return l.withdrawal_rows(items(spark, sf).groupBy(F.col("l_orderkey").alias("block")).agg(F.sort_array(F.collect_list(one)).alias("withdrawals")))


@query("l9_withdrawals", f"""SELECT l_orderkey AS block, '0x' || {hexed_sql('l_suppkey', 40)} AS recipient, l_quantity * 1e9 AS value, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_quantity) - 1 END AS sub_index FROM lineitem""")
def l9(spark, sf):
    return doubled(withdrawn(spark, sf).select("block", "recipient", "value", "sub_index"))


@query("l10_ledger_branches", sql("transfers", """SELECT kind, count(*) AS n, sum(value)::DOUBLE AS total, count(recipient) AS n_recipient FROM (SELECT kind, recipient, value::DOUBLE AS value FROM transfers
  UNION ALL SELECT 'fee_burn', NULL, base + blob FROM fees WHERE base + blob > 0 UNION ALL SELECT 'fee_tip', 'C', fee - base FROM fees WHERE fee - base > 0 UNION ALL SELECT 'withdrawal', 'x', l_quantity * 1e9 FROM lineitem) GROUP BY kind""", {"fees": FEES[len("fees AS ("):-1]}))
def l10(spark, sf):
    rows = l.union_ledger(d.transfers(spark, sf).select("block", "sender", "recipient", "value", "kind"), fees(spark, sf), withdrawn(spark, sf))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"), F.count("recipient").alias("n_recipient"))


@query("l12_borrowed_index", "SELECT l_orderkey AS tx_hash, CASE WHEN l_returnflag = 'R' THEN o_custkey ELSE l_linenumber END AS tx_index, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def l12(spark, sf):
    own = traces(spark, sf).withColumn("tx_index", F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("long")))
    tx = orders(spark, sf).select(F.col("o_orderkey").alias("tx_hash"), F.col("o_custkey").alias("tx_index"))
    return l.borrow_tx_index(own, tx).groupBy("tx_hash", "tx_index").agg(F.count("*").alias("n"))


@query("l15_quality_counts", "SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS unparsed_values, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS no_gas, count(*) FILTER (o_custkey % 3 = 0 AND o_orderkey >= 100) AS no_base_fee, count(*) FILTER (o_custkey % 4 = 0 AND o_orderkey >= 200) AS no_withdrawals FROM orders")
def l15(spark, sf):
    x = items(spark, sf)
    rows = x.select(F.when(F.col("l_returnflag") == "R", "0xzz").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("value"))
    tx = x.select(F.when(F.col("l_linestatus") != "F", F.col("l_quantity")).alias("gas_used"))
    blocks = orders(spark, sf).select(F.col("o_orderkey").alias("block"), F.when(F.col("o_custkey") % 3 != 0, F.lit(1)).alias("base_fee"), F.when(F.col("o_custkey") % 4 != 0, F.array(F.lit(1))).alias("withdrawals"))
    return l.quality_counts(rows, tx, blocks, 100, 200)


@query("l16_chunk_grid", sql("transfers", "SELECT lo, least(lo + 299, last) AS hi, (SELECT count(*) FROM transfers WHERE block BETWEEN lo AND lo + 299) AS n FROM (SELECT unnest(range(first, last + 1, 300)) AS lo, last FROM (SELECT min(block)::BIGINT AS first, max(block)::BIGINT AS last FROM transfers))"))
def l16(spark, sf):
    rows = d.transfers(spark, sf)
    first, last = rows.agg(F.min("block"), F.max("block")).first()
    if first is None:
        first, last = 0, -1
    counts = l.in_chunks(rows, first, 300).groupBy("lo").agg(F.count("*").alias("n"))
    return l.chunk_grid(spark, first, last, 300).join(counts, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ supply


@query("b10_supply_asof", sql("transfers snaps", """SELECT t.token, s.snapshot AS block, (SELECT arg_max(supply, block) FROM run r WHERE r.token = t.token AND r.block <= s.snapshot) AS supply FROM (SELECT DISTINCT token FROM transfers) t, snaps s""",
    {"steps": "SELECT token, block, sum(CASE WHEN sender IS NULL THEN value ELSE -value END)::DOUBLE AS value FROM transfers WHERE sender IS NULL OR recipient IS NULL GROUP BY ALL", "run": "SELECT token, block, sum(value) OVER (PARTITION BY token ORDER BY block) AS supply FROM steps"}))
def b10(spark, sf):
    t = d.transfers(spark, sf)
    points = t.select("token").distinct().select("token", F.explode(F.array(*map(F.lit, SNAPS))).alias("block"))
    return doubled(b.supply_asof(b.supply_changes(t), points).select("token", "block", "supply"))


OVER = {"given": "SELECT day, close AS supply FROM prices WHERE token = 'Brand#11' AND day_of_month(day) <= 12", "asked": "SELECT DISTINCT o_orderdate::DATE AS day, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS block FROM orders"}


@query("b11_supply_override", sql("prices", "SELECT count(*) AS n, count(supply) AS found, round(sum(supply), 4) AS total, count(*) - count(supply) AS unresolved FROM (SELECT block, (SELECT arg_max(supply, day) FROM given g WHERE g.day <= a.day AND g.day >= a.day - 7) AS supply FROM asked a)", {k: v.replace("day_of_month", "day") for k, v in OVER.items()}))
def b11(spark, sf):
    given = d.prices(spark, sf).filter((F.col("token") == d.NATIVE) & (F.dayofmonth("day") <= 12)).select("day", F.col("close").alias("supply"))
    day = F.to_date("o_orderdate")
    found, missing = b.supply_override(given, orders(spark, sf).select(day.alias("day"), d.block(day).alias("block")).distinct())
    a = found.agg(F.count("*").alias("found"), F.round(F.sum("supply"), 4).alias("total"))
    return a.crossJoin(missing.agg(F.count("*").alias("unresolved"))).select((F.col("found") + F.col("unresolved")).alias("n"), "found", "total", "unresolved")


@query("b6_date_gaps", sql("quarters transfers", "SELECT count(*) AS n, count(*) FILTER (block IS NULL) AS unresolved, count(*) FILTER (block <> date_diff('day', DATE '1995-01-01', day)) AS mismatched FROM (SELECT q.day, (SELECT max(block) FROM transfers t WHERE t.day <= q.day) AS block FROM quarters q)"))
def b6_gaps(spark, sf):
    dates = spark.createDataFrame([(q, d.block_of(q)) for q in d.QUARTERS], "day date, block int")
    found = b.resolve_blocks(dates.select("day"), d.transfers(spark, sf).select("day", "block"))
    return b.date_gaps(found, dates)


@query("u5_sources", sql("transfers", "SELECT source, block, count(*) AS n, count(DISTINCT log_index) AS n_index FROM (SELECT 'token' AS source, block, l_linenumber AS log_index FROM transfers UNION ALL SELECT 'native', date_diff('day', DATE '1995-01-01', o_orderdate::DATE), o_orderkey % 5 FROM orders) GROUP BY source, block"))
def u5(spark, sf):
    a = d.transfers(spark, sf).select("block", F.col("l_linenumber").cast("long").alias("log_index"))
    c = orders(spark, sf).select(d.block(F.to_date("o_orderdate")).alias("block"), (F.col("o_orderkey") % 5).alias("log_index"), "o_custkey")
    return panels.union_sources({"token": a, "native": c}).groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("log_index").alias("n_index"))
