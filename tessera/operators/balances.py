"""Balances as of many snapshots, exact sums of big integers, prices and holdings."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.asof import asof_join
from tessera.operators.segments import running_sums

LIMB = 18


def first_snapshot(block: Column, snapshots: list[int]) -> Column:
    """Place, from 0, of the first snapshot at or after a block; null after the last. One comparison chain, no join."""
    return reduce(lambda c, i: c.when(block <= snapshots[i], i), range(1, len(snapshots)), F.when(block <= snapshots[0], 0))


def balances(flows: DataFrame, snapshots: list[int], keys: tuple[str, ...] = ("token", "address"), fill: bool = True) -> DataFrame:
    """keys, snapshot, balance: the sum of all flows up to each snapshot, where it is not zero.

    Flows are summed into the first snapshot that sees them (one map-side combined shuffle), run up over the few
    snapshots of each key, and carried to the next change: cost does not grow with rows times snapshots.
    """
    return at_snapshots(runs(flows, snapshots, keys, fill), snapshots)


def at_snapshots(stretches: DataFrame, snapshots: list[int]) -> DataFrame:
    """runs() with a row for each snapshot in place of lo and hi; rows stay where they are dealt."""
    blocks = F.array(*map(F.lit, snapshots))
    rest = [c for c in stretches.columns if c not in ("lo", "hi", "balance")]
    return stretches.select(*rest, F.explode(F.slice(blocks, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("snapshot"), "balance")


def runs(flows: DataFrame, snapshots: list[int], keys: tuple[str, ...] = ("token", "address"), fill: bool = True, deal: tuple[int, str] | None = None) -> DataFrame:
    """keys, lo, hi, balance: stretches of snapshots, by their places from 0, over which the sum of all flows is the same and not zero.

    deal, a number of partitions and one of the keys, leaves the rows dealt by that key.
    """
    placed = flows.withColumn("_s", first_snapshot(F.col("block"), snapshots)).filter("_s IS NOT NULL")
    steps = placed.groupBy(*keys, "_s").agg(F.sum("value").alias("_v"))
    steps = steps.repartition(*deal) if deal else steps
    order = W.partitionBy(*keys).orderBy("_s")
    found = steps.select(*keys, "_s", F.sum("_v").over(order).alias("balance"), F.lead("_s").over(order).alias("_next")).filter("balance <> 0")
    last = F.coalesce(F.col("_next") - 1, F.lit(len(snapshots) - 1)) if fill else F.col("_s")
    return found.select(*keys, F.col("_s").alias("lo"), last.alias("hi"), "balance")


def exact_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, balance: exact sums, as text, of integers of up to 90 digits given as text.

    A value is cut into limbs of 18 digits, whose sums fit in decimal(38,0) for 10^20 rows; carries go up after the sum.
    """
    text = F.trim(F.col(value))
    negative = text.startswith("-")
    digits = F.lpad(F.regexp_replace(text, "^[+-]", ""), 5 * LIMB, "0")
    limbs = [F.substring(digits, 1 + (4 - i) * LIMB, LIMB).cast("decimal(38,0)") * F.when(negative, -1).otherwise(1) for i in range(5)]
    sums = df.groupBy(*keys).agg(*[F.sum(x.cast("decimal(38,0)")).alias(f"_l{i}") for i, x in enumerate(limbs)])
    # The sign of a sum is that of its highest limb after carries; a negative total is negated first.
    base = F.lit(10**LIMB).cast("decimal(38,0)")

    def carried(df: DataFrame) -> DataFrame:
        for i in range(4):
            exact = F.expr(f"CASE WHEN _l{i} >= 0 THEN _l{i} div 1000000000000000000 ELSE -((-_l{i} + 999999999999999999) div 1000000000000000000) END").cast("decimal(38,0)")
            df = df.withColumn("_c", exact).withColumn(f"_l{i + 1}", (F.col(f"_l{i + 1}") + F.col("_c")).cast("decimal(38,0)")).withColumn(f"_l{i}", (F.col(f"_l{i}") - F.col("_c") * base).cast("decimal(38,0)")).drop("_c")
        return df

    once = carried(sums).withColumn("_neg", F.col("_l4") < 0)
    for i in range(5):
        once = once.withColumn(f"_l{i}", F.when(F.col("_neg"), -F.col(f"_l{i}")).otherwise(F.col(f"_l{i}")))
    twice = carried(once)
    text = F.concat(*[F.lpad(F.col(f"_l{i}").cast("string"), LIMB + 2 if i == 4 else LIMB, "0") for i in range(4, -1, -1)])
    bare = F.regexp_replace(text, "^0+(?=.)", "")
    return twice.select(*keys, F.concat(F.when(F.col("_neg"), "-").otherwise(""), bare).alias("balance"))


def balances_at(flows: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("address",), values: dict[str, str] | None = None, width: int | None = None) -> DataFrame:
    """pairs' keys and block, balance: the sum of the key's flows up to each block; zero if none.

    Flows and pairs are one stream by key and block, summed in time ranges, so that no pair meets a flow and an address with a
    third of all flows is many tasks. values names several sums of flow columns; a repeated pair is answered once and comes
    back as often as it stands.
    """
    values = {"balance": "value"} if values is None else values
    steps = flows.groupBy(*keys, "block").agg(*[F.sum(c).alias(name) for name, c in values.items()])
    asked = pairs.groupBy(*keys, "block").agg(F.count("*").alias("_times"))
    none = {name: F.lit(None).cast(steps.schema[name].dataType) for name in values}
    points = asked.select(*keys, "block", *[c.alias(name) for name, c in none.items()], F.lit(1).alias("_side"), "_times")
    rows = steps.withColumns({"_side": F.lit(0), "_times": F.lit(None).cast("long")}).join(pairs.select(*keys).distinct(), list(keys), "left_semi").unionByName(points)
    found = running_sums(rows, list(keys), "block", list(values), "_side", width).filter("_side = 1")
    out = found.select(*keys, "block", *[F.coalesce(name, F.lit(0)).alias(name) for name in values], "_times")
    return out.withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).drop("_times")


def supply_at(transfers: DataFrame, snapshots: list[int]) -> DataFrame:
    """token, snapshot, supply: minted less burned up to each snapshot."""
    signed = F.when(F.col("sender").isNull(), F.col("value")).when(F.col("recipient").isNull(), -F.col("value"))
    return balances(transfers.select("token", "block", signed.alias("value")).filter("value IS NOT NULL"), snapshots, ("token",)).withColumnRenamed("balance", "supply")


def supply_changes(transfers: DataFrame) -> DataFrame:
    """token, block, supply: minted less burned up to each block in which it changes."""
    signed = F.when(F.col("sender").isNull(), F.col("value")).when(F.col("recipient").isNull(), -F.col("value"))
    steps = transfers.select("token", "block", signed.alias("value")).filter("value IS NOT NULL").groupBy("token", "block").agg(F.sum("value").alias("value"))
    return running_sums(steps.withColumnRenamed("value", "supply"), ["token"], "block", ["supply"])


def supply_asof(changes: DataFrame, points: DataFrame) -> DataFrame:
    """points (token, block, ...) with the last supply at or before their block."""
    return asof_join(points, changes.withColumnRenamed("block", "supply_block"), ["token"], "block", "supply_block")


def human(balances: DataFrame, decimals: DataFrame, default: int = 18) -> DataFrame:
    """Balances over ten to the token's decimals; what is not positive goes."""
    rows = balances.join(decimals.select("token", "decimals"), "token", "left")
    return rows.withColumn("balance", F.col("balance").cast("double") / F.pow(F.lit(10.0), F.coalesce("decimals", F.lit(default)))).filter("balance > 0").drop("decimals")


def month_starts(spark, lo: date, hi: date, months: int = 1) -> DataFrame:
    """day: the first of each month from lo to hi."""
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(lo), "month"), F.lit(hi), F.expr(f"INTERVAL {months} MONTH"))).alias("day"))


def resolve_blocks(dates: DataFrame, days: DataFrame) -> DataFrame:
    """day, block: the last known block at or before each day; days has day and block, the greatest block of a day counting."""
    known = days.groupBy("day").agg(F.max("block").alias("block")).withColumn("one", F.lit(1))
    return asof_join(dates.select("day").withColumn("one", F.lit(1)), known.withColumnRenamed("day", "known_day"), ["one"], "day", "known_day").select("day", "block")


def date_gaps(resolved: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: days, those without a block, and those whose block differs from the manifest's."""
    rows = resolved.join(manifest.select("day", F.col("block").alias("_m")), "day", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("block").isNull()).alias("unresolved"), F.count_if(F.col("_m") != F.col("block")).alias("mismatched"))


def supply_override(supply: DataFrame, blocks: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(block, supply at its day or up to so many days before; blocks without any)."""
    found = asof_join(blocks.withColumn("one", F.lit(1)), supply.withColumn("one", F.lit(1)).withColumnRenamed("day", "supply_day"), ["one"], "day", "supply_day", max_age=days).drop("one")
    return found.filter("supply IS NOT NULL"), found.filter("supply IS NULL").select("block", "day")


def market_cap(supply: Column, price: Column) -> Column:
    return F.when((supply > 0) & (price > 0), supply * price)


def spot(prices: DataFrame, points: DataFrame, max_age: int | None = None) -> DataFrame:
    """points (token, day, ...) with the close at or before their day."""
    return asof_join(points, prices.withColumnRenamed("day", "price_day"), ["token"], "day", "price_day", max_age=max_age)


def valued(balances: DataFrame, prices: DataFrame, snapshots: dict[int, date]) -> DataFrame:
    """snapshot, address, token, balance, value (in millionths) of positive balances; a token without a price has a null value.

    Balances of up to 20 digits before and 9 after the point are multiplied exactly; others, such as raw amounts of a
    token with 18 decimals, as doubles.
    Prices are found once for each token and snapshot, a table of tokens times snapshots, then joined.
    """
    return priced(balances, spots(prices, snapshots))


def spots(prices: DataFrame, snapshots: dict[int, date]) -> DataFrame:
    """token, snapshot, close: the last close of each token at each snapshot."""
    grid = prices.select("token").distinct().select("token", F.explode(F.array(*[F.struct(F.lit(b).alias("snapshot"), F.lit(d).alias("day")) for b, d in snapshots.items()])).alias("s")).select("token", "s.snapshot", "s.day")
    return spot(prices, grid).select("token", "snapshot", "close")


def priced(balances: DataFrame, at: DataFrame) -> DataFrame:
    """valued() with the closes of spots()."""
    rows = spotted(balances, at)
    return rows.select("snapshot", "address", "token", F.col("balance").cast("double").alias("balance"), money(F.col("balance"), F.col("close"), F.col("_exact")).alias("value"))


def priced_in_parts(balances: DataFrame, at: DataFrame) -> DataFrame:
    """priced() for sums: a value that is a whole number of millionths below 2^52 is in millionths (long), any other in value.

    A row in millionths makes no decimal; fold_assets() sums both exactly.
    """
    amount = F.col("balance").cast("double")
    product = amount * F.col("_millionths")
    small = F.coalesce((amount == F.floor(amount)) & (F.abs(amount) < 2.0**52) & (F.abs("_millionths") < 2.0**52) & (F.abs(product) < 2.0**52), F.lit(False))
    value = F.when(~small, money(F.col("balance"), F.col("close"), F.col("_exact")))
    return spotted(balances, at).select("snapshot", "address", "token", amount.alias("balance"), F.when(small, product.cast("long")).alias("millionths"), value.alias("value"))


def spotted(balances: DataFrame, at: DataFrame) -> DataFrame:
    """Positive balances with close, the same as a decimal (_exact) and in millionths, both made once for each token and snapshot, before the join."""
    exact = F.col("close").try_cast("decimal(18,6)")
    prices = at.select("token", "snapshot", "close", exact.alias("_exact"), (exact * 1000000).cast("double").alias("_millionths"))
    return balances.filter("balance > 0").join(prices, ["token", "snapshot"], "left")


def money(amount: Column, price: Column, exact_price: Column | None = None) -> Column:
    """amount * price as decimal(38,6); null where either is, or where the product has more than 32 digits before the point. exact_price is price.try_cast("decimal(18,6)"), if at hand."""
    exact_price = price.try_cast("decimal(18,6)") if exact_price is None else exact_price
    exact = F.try_multiply(amount.try_cast("decimal(29,9)"), exact_price).cast("decimal(38,6)")
    fits = F.abs(amount.cast("double")) * 1e9 == F.floor(F.abs(amount.cast("double")) * 1e9)
    return F.coalesce(F.when(fits, exact), (amount.cast("double") * price).try_cast("decimal(38,6)"))


def holdings(positions: DataFrame) -> DataFrame:
    """snapshot, address, total_value, num_tokens, holdings: one row per account with its positions as an ordered array."""
    item = F.struct("token", "balance", F.col("value").cast("double").alias("value"))
    return positions.groupBy("snapshot", "address").agg(F.round(F.sum("value"), 2).cast("double").alias("total_value"), F.count("*").alias("num_tokens"), F.sort_array(F.collect_list(item)).alias("holdings"))


def universe(flows: DataFrame, native: str, zero: str = "") -> DataFrame:
    """address, in_tokens, only_native, n_transfers for each address of the flows but the zero address."""
    other = F.col("token") != native
    rows = flows.filter(F.col("address") != zero).groupBy("address").agg(F.bool_or(other).alias("in_tokens"), F.bool_or(~other).alias("_native"), F.count("*").alias("n_flows"))
    return rows.select("address", "in_tokens", (F.col("_native") & ~F.col("in_tokens")).alias("only_native"), (F.col("n_flows") / 2).alias("n_transfers"))


def balance_census(balances: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: addresses, how many are positive, negative and zero, the sum of balances, of credits, and their rows."""
    a = balances.agg(F.count("*").alias("active"), F.count_if(F.col("balance") > 0).alias("positive"), F.count_if(F.col("balance") < 0).alias("negative"), F.sum("balance").alias("total"))
    b = flows.agg(F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("credits"), F.count_if(F.col("value") > 0).alias("credit_rows"))
    return a.crossJoin(b)
