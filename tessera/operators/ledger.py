"""Ledgers: transfers to signed flows, validity and statistics, fees, withdrawals, ordering, supply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZERO = "0x" + "0" * 40
#: Event topics of token logs: fixed values of the token standards.
TOPICS = {
    "transfer": "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "deposit": "0xe1fffcc4923d04b559f4d29a8bfc6cda04eb5b0d3c460751c2402c5c5cc9109c",
    "withdrawal": "0x7fcf532c15f0a6db0bd6d0e038bea71d30d808c7d98cb3bf7268a95bf5081b65",
}
GWEI = 10**9


def to_flows(transfers: DataFrame, null_sides: bool = True) -> DataFrame:
    """Each transfer as a debit of its sender and a credit of its recipient; with null_sides a missing side emits no row."""
    sides = F.array(F.struct(F.col("sender").alias("address"), (-F.col("value")).alias("value")), F.struct(F.col("recipient").alias("address"), F.col("value").alias("value")))
    kept = [c for c in transfers.columns if c not in ("sender", "recipient", "value")]
    rows = transfers.select(*kept, F.explode(sides).alias("side")).select(*kept, "side.address", "side.value")
    return rows.filter("address IS NOT NULL") if null_sides else rows


def flow_balance_gap(flows: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: the sum of all flows, what was minted and burned, and the gap between them, which must be zero."""
    total = flows.agg(F.sum("value").alias("net"))
    made = transfers.agg(F.sum(F.when(F.col("sender").isNull(), F.col("value")).otherwise(0)).alias("minted"), F.sum(F.when(F.col("recipient").isNull(), F.col("value")).otherwise(0)).alias("burned"))
    return total.crossJoin(made).withColumn("gap", F.col("net") - F.col("minted") + F.col("burned"))


def invalid_rows(ledger: DataFrame) -> DataFrame:
    """Rows without a value, with a negative one, or without both ends."""
    return ledger.filter(F.col("value").isNull() | (F.col("value") < 0) | (F.col("sender").isNull() & F.col("recipient").isNull()))


def ledger_stats(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Rows, minted, burned, net and per-kind counts, by the given columns."""
    value = F.col("value")
    minted, burned = F.sum(F.when(F.col("sender").isNull(), value).otherwise(0)), F.sum(F.when(F.col("recipient").isNull(), value).otherwise(0))
    return ledger.groupBy(*by).agg(F.count("*").alias("n_rows"), minted.alias("minted"), burned.alias("burned"), (minted - burned).alias("net"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("transfer", "mint", "burn")], F.sum("value").alias("total"))


def chunk_of(block: Column, size: int) -> Column:
    """First block of the chunk that holds a block."""
    return (F.floor(block / size) * size).cast("long")


def chunk_grid(spark: SparkSession, first: int, last: int, size: int) -> DataFrame:
    """lo, hi: the chunks of so many blocks that cover a range of blocks; the last one ends with it."""
    starts = spark.range(first, last + 1, size).select(F.col("id").alias("lo"))
    return starts.select("lo", F.least(F.col("lo") + size - 1, F.lit(last)).alias("hi"))


def in_chunks(ledger: DataFrame, first: int, size: int, block: str = "block") -> DataFrame:
    """ledger with lo, the first block of the chunk of a grid that begins at first."""
    return ledger.withColumn("lo", (F.floor((F.col(block) - first) / size) * size + first).cast("long"))


def supply_accounts(ledger: DataFrame) -> DataFrame:
    """One row: sums by kind and the net supply."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0)).alias(k) for k in ("mint", "burn", "transfer")]
    return ledger.agg(*sums).withColumn("net_supply", F.col("mint") - F.col("burn"))


def value_type(transfers: DataFrame, key: str = "token", value: str = "value") -> DataFrame:
    """Storage type by token, from the greatest number of digits; of 19 digits the greatest value decides."""
    digits = F.regexp_replace(F.regexp_replace(F.col(value).cast("string"), "^-", ""), "^0+(?=.)", "")
    rows = transfers.groupBy(key).agg(F.max(F.length(digits)).alias("digits"), F.max(F.when(F.length(digits) == 19, digits)).alias("_most"))
    small = (F.col("digits") < 19) | ((F.col("digits") == 19) & (F.col("_most") <= "9223372036854775807"))
    return rows.select(key, "digits", F.when(small, "int64").when(F.col("digits") <= 38, "decimal128").when(F.col("digits") <= 76, "decimal256").otherwise("text").alias("storage"))


def union_ledger(*branches: DataFrame) -> DataFrame:
    """Branches of a ledger by column name; columns that a branch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def add_log_index(ledger: DataFrame, order: list[str], block: str = "block") -> DataFrame:
    """ledger with a running number from 0 in each block, by the given columns, nulls last."""
    by = W.partitionBy(block).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return ledger.withColumn("log_index", F.row_number().over(by) - 1)


def trace_key(path: Column) -> Column:
    """'0,12' as '000000000.000000012', so that text order is tree order; the root is empty."""
    parts = F.transform(F.filter(F.split(F.coalesce(path.cast("string"), F.lit("")), ","), lambda p: p != ""), lambda p: F.lpad(F.trim(p), 9, "0"))
    return F.array_join(parts, ".")


def drop_reverted_subtrees(traces: DataFrame, tx: str = "tx_hash", path: str = "trace_address", error: str = "error") -> DataFrame:
    """Traces without an errored ancestor or own error: an equi anti-join on each trace's prefixes, not a theta join."""
    failed = traces.filter(F.coalesce(F.col(error), F.lit("")) != "").select(F.col(tx).alias("_tx"), trace_key(F.col(path)).alias("_key")).distinct()
    own = trace_key(F.col(path))
    parts = F.filter(F.split("_own", r"\."), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    # A trace is known by its transaction and place, which no retry changes.
    places = traces.select(F.col(tx).alias("_tx"), own.alias("_own")).distinct().select("_tx", "_own", F.explode(prefixes).alias("_key"))
    bad = places.join(failed, ["_tx", "_key"], "left_semi").select("_tx", "_own").distinct()
    return traces.join(bad, (F.col(tx) == F.col("_tx")) & (own == F.col("_own")), "left_anti")


def fee_rows(tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, sender, recipient, value, kind: a fee's base and blob parts are burned, the rest goes to the producer."""
    fee = F.col("gas_used").cast("decimal(38,0)") * F.col("gas_price").cast("decimal(38,0)")
    base = F.coalesce(F.col("gas_used").cast("decimal(38,0)") * F.col("base_fee").cast("decimal(38,0)"), F.lit(0))
    blob = F.coalesce(F.col("blob_gas_used").cast("decimal(38,0)") * F.col("blob_gas_price").cast("decimal(38,0)"), F.lit(0))
    rows = tx.join(blocks.select("block", "producer", "base_fee"), "block")
    rows = rows.select("block", "tx_hash", "sender", "producer", F.explode(F.array(F.struct(F.lit("fee_burn").alias("kind"), F.lit(None).cast("string").alias("to"), (base + blob).cast("decimal(38,0)").alias("value")), F.struct(F.lit("fee_tip").alias("kind"), F.col("producer").alias("to"), (fee - base).cast("decimal(38,0)").alias("value")))).alias("x"))
    return rows.select("block", "tx_hash", "sender", F.col("x.to").alias("recipient"), "x.value", "x.kind").filter("value > 0")


def withdrawal_rows(blocks: DataFrame) -> DataFrame:
    """block, recipient, value, sub_index of each withdrawal, in the smallest unit; its index or else its position."""
    rows = blocks.select("block", F.posexplode("withdrawals").alias("position", "w"))
    return rows.select("block", F.lower("w.address").alias("recipient"), (F.col("w.amount").cast("decimal(20,0)") * F.lit(GWEI)).cast("decimal(38,0)").alias("value"), F.coalesce(F.col("w.index"), F.col("position").cast("long")).alias("sub_index"), F.lit("withdrawal").alias("kind"))


def borrow_tx_index(traces: DataFrame, tx: DataFrame) -> DataFrame:
    """Traces without a transaction index take it from their transaction."""
    known = tx.select("tx_hash", F.col("tx_index").alias("_index")).dropDuplicates(["tx_hash"])
    return traces.join(known, "tx_hash", "left").withColumn("tx_index", F.coalesce("tx_index", "_index")).drop("_index")


def quality_counts(traces: DataFrame, tx: DataFrame, blocks: DataFrame, fee_fork: int, withdrawal_fork: int) -> DataFrame:
    """One row: unparsed values, transactions without gas, blocks that lack what a fork brought."""
    a = traces.agg(F.count_if(F.expr("try_cast(value AS decimal(38,0)) IS NULL AND value IS NOT NULL")).alias("unparsed_values"))
    b = tx.agg(F.count_if(F.col("gas_used").isNull()).alias("no_gas"))
    c = blocks.agg(F.count_if(F.col("base_fee").isNull() & (F.col("block") >= fee_fork)).alias("no_base_fee"), F.count_if(F.col("withdrawals").isNull() & (F.col("block") >= withdrawal_fork)).alias("no_withdrawals"))
    return a.crossJoin(b).crossJoin(c)


def classify_events(logs: DataFrame) -> DataFrame:
    """Logs of the three kinds of event, with the event's name."""
    name = reduce(lambda c, k: c.when(F.lower("topic0") == TOPICS[k], k), TOPICS, F.when(F.lit(False), None))
    return logs.withColumn("event", name).filter("event IS NOT NULL")


def decode_transfers(logs: DataFrame) -> DataFrame:
    """Classified logs as transfers: a deposit is a mint from the zero address, a withdrawal a burn to it."""
    from tessera.functions.values import to_address, to_decimal

    one, two = to_address(F.try_element_at("topics", F.lit(2)), True), to_address(F.try_element_at("topics", F.lit(3)), True)
    e = F.col("event")
    sender = F.when(e == "deposit", F.lit(ZERO)).otherwise(one)
    recipient = F.when(e == "transfer", two).when(e == "deposit", one).otherwise(F.lit(ZERO))
    rows = logs.select(to_address(F.col("address"), True).alias("token"), sender.alias("sender"), recipient.alias("recipient"), F.col("block_id").alias("block"), "log_index", to_decimal(F.col("data"), "binary").alias("value"), "tx_hash")
    return positive(rows)


def positive(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.col(value) > 0)


def not_reverted(traces: DataFrame) -> DataFrame:
    return traces.filter("status = 1")


def value_moves(traces: DataFrame) -> DataFrame:
    """Traces that move value: plain calls, creations and self-destructions of more than nothing."""
    call = (F.col("trace_type") == "call") & (F.coalesce(F.col("call_type"), F.lit("call")) == "call")
    return traces.filter((call | F.col("trace_type").isin("create", "create2", "suicide", "selfdestruct")) & (F.col("value") > 0))


def mints(traces: DataFrame, merge_block: int) -> DataFrame:
    """Rewards before the merge block, and genesis and fork credits."""
    return traces.filter(((F.col("trace_type") == "reward") & (F.col("block") < merge_block)) | F.col("trace_type").isin("genesis", "daofork"))


def created_contracts(traces: DataFrame) -> DataFrame:
    """address, block: the first successful creation of each address."""
    made = traces.filter(F.col("trace_type").isin("create", "create2") & (F.coalesce(F.col("error"), F.lit("")) == "") & F.col("address").isNotNull())
    return made.groupBy(F.lower("address").alias("address")).agg(F.min("block").alias("block"))


def genesis_rows(alloc: DataFrame) -> DataFrame:
    """Credits at block 0 from one JSON column ``alloc``: address to balance, in hexadecimal or decimal text."""
    from tessera.functions.values import to_decimal

    entries = alloc.select(F.explode(F.from_json("alloc", "map<string, struct<balance: string>>")).alias("address", "x"))
    value = F.when(F.col("x.balance").startswith("0x"), to_decimal(F.col("x.balance"), "hex")).otherwise(to_decimal(F.col("x.balance"), "text"))
    address = F.concat(F.lit("0x"), F.lower(F.regexp_replace("address", "^0x", "")))
    return entries.select(F.lit(0).alias("block"), F.lit(None).cast("string").alias("sender"), address.alias("recipient"), value.alias("value"), F.lit("genesis").alias("kind"))
