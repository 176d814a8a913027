"""Queries of sources, sinks, tags and status tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as v
from tessera.operators import attribution as g
from tessera.operators import filters as fl
from tessera.operators import ledger as l
from tessera.plans.ctes import sql
from tessera.plans.ledger import flows
from tessera.plans.registry import query
from tessera.sources import domain as d
from tessera.sources import tables as s


@query("s1_read_dataset", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem")
def s1(spark, sf):
    return s.read_dataset(spark, f"{sf}/lineitem.parquet").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("s3_resolve_columns", "SELECT o_orderkey AS key, o_orderdate AS day, NULL::VARCHAR AS note FROM orders")
def s3(spark, sf):
    rows = s.resolve_columns(d.table(spark, sf, "orders"), {"key": ["id", "o_orderkey"], "day": ["o_orderdate", "date"], "note": ["comment"]})
    return rows.withColumn("note", F.col("note").cast("string"))


@query("s4_decimal_formats", "SELECT o_orderkey, o_orderkey::BIGINT AS from_text, o_orderkey::BIGINT AS from_hex, o_orderkey::BIGINT AS from_bytes FROM orders")
def s4(spark, sf):
    key = F.col("o_orderkey")
    rows = d.table(spark, sf, "orders").select("o_orderkey", key.cast("string").alias("t"), F.concat(F.lit("0x"), F.lower(F.hex(key))).alias("h"), F.unhex(F.lpad(F.hex(key), 64, "0")).alias("b"))
    return rows.select("o_orderkey", v.to_decimal(F.col("t"), "text").cast("long").alias("from_text"), v.to_decimal(F.col("h"), "hex").cast("long").alias("from_hex"), v.to_decimal(F.col("b"), "binary").cast("long").alias("from_bytes"))


@query("s5_addresses", "SELECT c_custkey, '0x' || lpad(lower(to_hex(c_custkey)), 40, '0') AS address FROM customer")
def s5(spark, sf):
    topic = F.unhex(F.lpad(F.hex("c_custkey"), 64, "0"))
    return d.table(spark, sf, "customer").select("c_custkey", v.to_address(topic, True).alias("address"))


@query("s7_duplicate_rows", "SELECT l_returnflag, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n) > count(*) AS repeated FROM (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def s7(spark, sf):
    return s.duplicate_rows(d.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("s10_expand_map", "SELECT event_id, props::JSON->>'k' AS k FROM events")
def s10(spark, sf):
    return s.expand_map(d.table(spark, sf, "events").select("event_id", "props"), "props", ["k"])


@query("s16_upsert", "SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus <> 'P') AS old_key, max(o_orderkey) FILTER (o_orderstatus = 'P') AS new_key, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), max(o_orderkey) FILTER (o_orderstatus <> 'P')) AS kept FROM orders GROUP BY o_custkey")
def s16(spark, sf):
    o = d.table(spark, sf, "orders")
    old = o.filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("kept"))
    new = o.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("kept"))
    both = s.upsert(old, new, ["o_custkey"])
    return both.join(old.withColumnRenamed("kept", "old_key"), "o_custkey", "left").join(new.withColumnRenamed("kept", "new_key"), "o_custkey", "left").select("o_custkey", "old_key", "new_key", "kept")


@query("s17_pending_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def s17(spark, sf):
    o = d.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return s.pending_keys(d.table(spark, sf, "customer"), [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")], ["c_custkey"])


@query("s14_overlapping", "SELECT DISTINCT o_custkey AS block_number FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def s14(spark, sf):
    o = d.table(spark, sf, "orders").select(F.col("o_custkey").alias("block_number"), F.col("o_orderstatus").alias("source_tag"))
    return s.overlapping_blocks(o.filter("source_tag = 'F'"), o.filter("source_tag = 'O'"), "F")


@query("f10_signatures", "SELECT page_id FROM pages WHERE contains(html, '<nav>') AND contains(html, '<script>')")
def f10(spark, sf):
    return d.table(spark, sf, "pages").filter(v.has_signatures(F.col("html"), ["<nav>", "<script>"])).select("page_id")


@query("f13_drop_listed", sql("flows contracts", "SELECT address, count(*) AS n FROM flows WHERE address NOT IN (SELECT address FROM contracts) AND address <> 'C1' GROUP BY address"))
def f13(spark, sf):
    rows = fl.exclude_custody(fl.drop_listed(flows(spark, sf), d.contracts(spark, sf), "address"), "C1")
    return rows.groupBy("address").agg(F.count("*").alias("n"))


@query("f16_name_candidates", "SELECT p_partkey AS token FROM part WHERE (regexp_matches(p_type, '(?i)^eco|ring$') OR regexp_matches(p_name, '(?i)^eco|ring$')) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 45)")
def f16(spark, sf):
    parts = d.table(spark, sf, "part").select(F.col("p_partkey").alias("token"), F.col("p_type").alias("symbol"), F.col("p_name").alias("name"))
    reviewed = d.table(spark, sf, "lineitem").filter("l_returnflag = 'A' AND l_quantity >= 45").select(F.col("l_partkey").alias("token"))
    return fl.name_candidates(parts, reviewed, ["^eco", "ring$"]).select("token")


@query("f3_included_tokens", "SELECT DISTINCT '0x' || lpad(lower(to_hex(p_partkey)), 40, '0') AS token FROM part WHERE p_size > 10 AND p_retailprice > 950 AND p_type <> 'PROMO'")
def f3(spark, sf):
    address = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("p_partkey")), 40, "0"))
    status = d.table(spark, sf, "part").select(address.alias("contract_address"), F.when(F.col("p_size") > 10, " TRUE").otherwise("false").alias("is_erc_20"), F.when(F.col("p_retailprice") > 950, "success").otherwise("failure").alias("price_data_status"), F.lit("good").alias("trading_volume_status"), F.when(F.col("p_type") == "PROMO", "FALSE").alias("fdv_mcap_lt_eth"))
    return fl.included_tokens(status)


def tags(spark, sf):
    """Documents as tagged addresses: language is the category, source the concept, labels the number of tags."""
    docs = d.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = d.table(spark, sf, "labels")
    n = F.when(F.col("quality").isNotNull(), F.col("quality") + F.col("toxic") + 1)
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("address"), (F.col("doc_id") % 7).alias("block"), F.when(F.col("quality") == 1, F.col("lang")).alias("category"), F.when(F.col("doc_id") % 3 == 0, F.concat_ws("|", "source", "lang")).alias("concepts"), n.alias("n_tags"))


TAGS = {"tags": "SELECT d.doc_id AS address, d.doc_id % 7 AS block, CASE WHEN quality = 1 THEN lang END AS category, CASE WHEN d.doc_id % 3 = 0 THEN source || '|' || lang END AS concepts, CASE WHEN quality IS NOT NULL THEN quality + toxic + 1 END AS n_tags FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"}


def flagged(spark, sf):
    return g.tag_flags(tags(spark, sf).withColumn("categories", F.col("category")))


@query("g1_tag_flags", "WITH tags AS (" + TAGS["tags"] + ") SELECT address, n_tags IS NOT NULL AS in_tags, category IS NOT NULL AS has_category, concepts IS NOT NULL AS has_concept, category IS NOT NULL OR concepts IS NOT NULL AS has_any FROM tags")
def g1(spark, sf):
    return flagged(spark, sf).select("address", "in_tags", "has_category", "has_concept", "has_any")


LABEL = "coalesce(category, CASE WHEN concepts IS NOT NULL THEN CASE WHEN split_part(concepts, '|', 2) IN ('en', 'de') THEN split_part(concepts, '|', 2) ELSE least(split_part(concepts, '|', 1), split_part(concepts, '|', 2)) END END, 'UNLABELED')"


def labelled(spark, sf):
    return g.effective_label(tags(spark, sf), ["en", "de"])


@query("g2_effective_label", "WITH tags AS (" + TAGS["tags"] + f") SELECT address, {LABEL} AS label FROM tags")
def g2(spark, sf):
    return labelled(spark, sf).select("address", "label")


@query("g3_label_counts", "WITH tags AS (" + TAGS["tags"] + f"), x AS (SELECT {LABEL} AS label FROM tags) SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM x WHERE label <> 'UNLABELED'), 7) AS pct_labelled, round(count(*) * 100.0 / (SELECT count(*) FROM x), 7) AS pct_all FROM x WHERE label <> 'UNLABELED' GROUP BY label")
def g3(spark, sf):
    rows = g.label_counts(labelled(spark, sf), "label", False)
    return rows.withColumn("pct_labelled", F.round("pct_labelled", 7)).withColumn("pct_all", F.round("pct_all", 7))


@query("g4_multi_label_counts", "WITH tags AS (" + TAGS["tags"] + "), x AS (SELECT unnest(list_distinct(string_split(concepts, '|'))) AS label FROM tags) SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(concepts) FROM tags), 7) AS pct_labelled, round(count(*) * 100.0 / (SELECT count(*) FROM tags), 7) AS pct_all FROM x GROUP BY label")
def g4(spark, sf):
    rows = g.label_counts(tags(spark, sf), "concepts", True)
    return rows.withColumn("pct_labelled", F.round("pct_labelled", 7)).withColumn("pct_all", F.round("pct_all", 7))


@query("g5_tag_coverage", "WITH tags AS (" + TAGS["tags"] + ") SELECT coalesce(block::VARCHAR, 'ALL') AS block, count(*) AS n, round(avg((n_tags IS NOT NULL)::INTEGER), 8) AS share_in_tags, round(avg((category IS NOT NULL)::INTEGER), 8) AS share_has_category, round(avg((concepts IS NOT NULL)::INTEGER), 8) AS share_has_concept, round(avg((category IS NOT NULL OR concepts IS NOT NULL)::INTEGER), 8) AS share_has_any FROM tags GROUP BY GROUPING SETS ((block), ())")
def g5(spark, sf):
    rows = g.tag_coverage(flagged(spark, sf).withColumn("block", F.col("block").cast("string")), ["block"])
    return rows.select("block", "n", *[F.round(c, 8).alias(c) for c in rows.columns if c.startswith("share")])


@query("g6_pair_tags", "WITH tags AS (" + TAGS["tags"] + "), p AS (SELECT DISTINCT o_orderkey % 10 AS block, o_custkey AS address FROM orders) SELECT p.block, count(*) AS n, count(*) FILTER (category IS NOT NULL) AS n_category FROM p LEFT JOIN tags USING (address) GROUP BY p.block")
def g6(spark, sf):
    pairs = d.table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("block"), F.col("o_custkey").alias("address"))
    return g.pair_tags(pairs, flagged(spark, sf)).groupBy("block").agg(F.count("*").alias("n"), F.count_if("has_category").alias("n_category"))


@query("g7_tag_quality", "WITH tags AS (" + TAGS["tags"] + ") SELECT 'category' AS aspect, category AS value, count(*) AS n, median(n_tags) AS median_tags FROM tags GROUP BY category UNION ALL SELECT 'block', block::VARCHAR, count(*), median(n_tags) FROM tags GROUP BY block")
def g7(spark, sf):
    return g.tag_quality(tags(spark, sf), ["category", "block"])


@query("g8_price_status", sql("prices", "SELECT token, CASE WHEN max(close) < 5000 THEN 'failure' WHEN count(*) >= 1550 THEN 'success' ELSE 'not_enough_data' END AS status FROM prices GROUP BY token"))
def g8(spark, sf):
    rows = d.prices(spark, sf).groupBy("token").agg(F.count("*").alias("points"), (F.max("close") >= 5000).alias("ok"))
    return rows.select("token", g.price_status(F.col("ok"), F.col("points"), 1550).alias("status"))


@query("g9_order_status", "SELECT o_orderkey, o_orderstatus FROM orders")
def g9(spark, sf):
    return g.order_status(d.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "o_orderkey")


@query("g10_below_reference", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN' WHEN p_retailprice < 1000 AND p_size < 40 THEN 'TRUE' ELSE 'FALSE' END AS below FROM part")
def g10(spark, sf):
    metrics = d.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("market_cap"), F.col("p_size").cast("double").alias("fdv"))
    ref = spark.createDataFrame([(1000.0, 40.0)], "market_cap double, fdv double")
    return g.below_reference(metrics, ref).select("p_partkey", "below")


@query("g11_local_status", sql("flows", "SELECT local_status, count(*) AS n FROM (SELECT t.token, CASE WHEN s.net IS NULL THEN 'NO_DATA' WHEN s.net > 0 THEN 'PASS' ELSE 'NOT_PASS' END AS local_status FROM (SELECT DISTINCT token FROM flows) t LEFT JOIN (SELECT token, sum(value) AS net FROM flows WHERE token <> 'Brand#3' GROUP BY token) s USING (token)) GROUP BY 1"))
def g11(spark, sf):
    x = flows(spark, sf)
    results = x.filter("token <> 'Brand#3'").groupBy("token").agg((F.sum("value") > 0).alias("ok"))
    return g.local_status(x.select("token").distinct(), results).groupBy("local_status").agg(F.count("*").alias("n"))


@query("g12_candidates", sql("transfers", "SELECT address, coalesce(min(block) FILTER (block > 100), 0)::INTEGER AS block FROM (SELECT sender AS address, block FROM transfers UNION ALL SELECT recipient, block FROM transfers) WHERE address IS NOT NULL GROUP BY address"))
def g12(spark, sf):
    t = d.transfers(spark, sf).withColumn("block", F.when(F.col("block") > 100, F.col("block")).otherwise(0))
    a, b = (t.filter(F.col(c).isNotNull()).select(F.col(c).alias("address"), "block") for c in ("sender", "recipient"))
    return g.candidates(a, b)


@query("g13_check_balances", sql("flows", "SELECT token, count(*) AS n, count(*) FILTER (address NOT LIKE '%7') AS exact, count(*) FILTER (address NOT LIKE '%7') AS within, CASE WHEN count(*) FILTER (address LIKE '%7') = 0 THEN 'PASS' ELSE 'NOT_PASS' END AS status FROM (SELECT DISTINCT token, address FROM flows) GROUP BY token"))
def g13(spark, sf):
    x = flows(spark, sf)
    truth = x.filter("block <= 1500").groupBy("token", "address").agg(F.sum("value").alias("balance"))
    truth = x.select("token", "address").distinct().join(truth, ["token", "address"], "left").select("token", "address", F.lit(1500).alias("block"), (F.coalesce("balance", F.lit(0)) + F.when(F.col("address").endswith("7"), 5).otherwise(0)).alias("balance"))
    return g.check_balances(x, truth, 1)


@query("f9_created_contracts", "SELECT lower(user_id::VARCHAR || 'x') AS address, min(event_id) AS block FROM events WHERE event_type IN ('view', 'click') AND value > 5 GROUP BY 1")
def f9(spark, sf):
    kind = F.when(F.col("event_type") == "view", "create").when(F.col("event_type") == "click", "create2").otherwise("call")
    traces = d.table(spark, sf, "events").select(kind.alias("trace_type"), F.when(F.col("value") > 5, "").otherwise("reverted").alias("error"), F.concat("user_id", F.lit("X")).alias("address"), F.col("event_id").alias("block"))
    return l.created_contracts(traces)


@query("m31_month_index", "SELECT DISTINCT ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS idx, strftime(o_orderdate, '%Y-%m') AS label FROM orders")
def m31(spark, sf):
    return d.table(spark, sf, "orders").select(v.month_index(F.col("o_orderdate"), 1995).alias("idx"), F.date_format("o_orderdate", "yyyy-MM").alias("label")).distinct()
