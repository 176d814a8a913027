"""Positions and nested holdings: folding, invariants, categories, concentration, turnover, cash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_assets(positions: DataFrame, alias: dict[str, str], keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """Positions with alias tokens counted as the token they stand for; what is not positive goes. units and value are summed.

    Of positions with millionths (priced_in_parts) the sums are those of priced(): exact, then made a double.
    """
    name = reduce(lambda c, a: F.when(F.col("token") == a[0], a[1]).otherwise(c), alias.items(), F.col("token"))
    value = F.sum("value").cast("double")
    if "millionths" in positions.columns:
        small, rest = F.sum("millionths"), F.sum("value")
        exact = F.coalesce((small.cast("decimal(28,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,6)"), F.lit(0)) + rest
        # Below 2^53 a division of whole numbers rounds as the decimal would.
        value = F.when(rest.isNotNull(), exact.cast("double")).when(F.abs(small) < 2**53, small / F.lit(1e6)).otherwise((small.cast("decimal(28,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("double"))
    rows = positions.withColumn("token", name).groupBy(*keys, "token").agg(F.sum("balance").alias("units"), value.alias("value"))
    return rows.filter("units > 0")


def fold_map(holdings: Column, alias: dict[str, str]) -> Column:
    """A map of token to balance with alias tokens counted as the token they stand for; what is not positive goes."""
    other = lambda a, b: lambda k, _: ~k.isin(a, b)
    out = holdings
    for a, b in alias.items():
        both = F.coalesce(F.try_element_at(holdings, F.lit(a)), F.lit(0.0)) + F.coalesce(F.try_element_at(holdings, F.lit(b)), F.lit(0.0))
        others = F.map_filter(out, other(a, b))
        out = F.map_concat(others, F.create_map(F.lit(b), both))
    return F.map_filter(out, lambda _, v: v > 0)


def folded_count(holdings: Column, alias: tuple[str, str]) -> Column:
    """Number of assets, the two alias tokens counting once where both are held."""
    has = lambda t: F.exists(holdings, lambda h: (h["token"] == t) & (h["balance"] > 0))
    return F.size(holdings) - F.when(has(alias[0]) & has(alias[1]), 1).otherwise(0)


def holdings_violations(holdings: DataFrame) -> DataFrame:
    """One row: accounts whose count, tokens, balances or total break an invariant."""
    h = F.col("holdings")
    tokens = F.transform(h, lambda x: x["token"])
    total = F.aggregate(h, F.lit(0.0), lambda s, x: s + F.coalesce(x["value"], F.lit(0.0)))
    off = F.abs(total - F.coalesce(F.col("total_value"), F.lit(0.0))) > 1e-6 * F.greatest(F.abs(total), F.lit(1.0)) + 0.01
    return holdings.agg(F.count("*").alias("n_accounts"), F.count_if(F.col("num_tokens") != F.size(h)).alias("bad_count"), F.count_if(F.size(F.array_distinct(tokens)) != F.size(h)).alias("repeated_token"), F.count_if(F.exists(h, lambda x: x["balance"] <= 0)).alias("bad_balance"), F.count_if(off).alias("bad_total"))


def position_of(holdings: DataFrame, token: str) -> DataFrame:
    """snapshot, address, balance, value of one token; accounts without it go."""
    one = F.try_element_at(F.filter("holdings", lambda h: h["token"] == token), F.lit(1))
    return holdings.select("snapshot", "address", one.alias("p")).filter("p IS NOT NULL").select("snapshot", "address", F.col("p.balance").alias("balance"), F.col("p.value").alias("value"))


def category_values(positions: DataFrame, categories: dict[str, list[str]], keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, total, and the value in each category."""
    value = F.coalesce(F.col("value"), F.lit(0.0))
    return positions.groupBy(*keys).agg(F.sum(value).alias("total"), *[F.sum(F.when(F.col("token").isin(tokens), value).otherwise(0.0)).alias(name) for name, tokens in categories.items()])


def concentration(positions: DataFrame, min_usd: float = 0.0, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """keys, n_tokens, total, max_weight, hhi, effective_n of positions worth more than min_usd."""
    rows = positions.filter(F.col("value") > min_usd).groupBy(*keys).agg(F.count("*").alias("n_tokens"), F.sum("value").alias("total"), F.max("value").alias("_most"), F.sum(F.col("value") * F.col("value")).alias("_sq"))
    hhi = F.col("_sq") / (F.col("total") * F.col("total"))
    return rows.select(*keys, "n_tokens", "total", (F.col("_most") / F.col("total")).alias("max_weight"), hhi.alias("hhi"), (1 / hhi).alias("effective_n"))


def token_totals(positions: DataFrame) -> DataFrame:
    """snapshot, token, value, units, n_positions, and the implied price: value over units."""
    unit = "units" if "units" in positions.columns else "balance"
    rows = positions.groupBy("snapshot", "token").agg(F.sum("value").cast("double").alias("value"), F.sum(unit).alias("units"), F.count("*").alias("n_positions"))
    return rows.withColumn("implied_price", F.try_divide("value", "units"))


def token_profile(positions: DataFrame, supply: DataFrame) -> DataFrame:
    """snapshot, token: holders, holders with value, value, supply, and the largest holder with its share of the supply."""
    rows = positions.groupBy("snapshot", "token").agg(F.count("*").alias("holders"), F.count_if(F.col("value") > 0).alias("valued_holders"), F.sum("value").cast("double").alias("value"), F.max_by("address", F.struct("balance", "address")).alias("largest"), F.max("balance").alias("largest_balance"))
    joined = rows.join(supply.select("snapshot", "token", F.col("supply").cast("double").alias("supply")), ["snapshot", "token"], "left")
    return joined.withColumn("largest_share", F.try_divide("largest_balance", "supply")).withColumn("exceeds_supply", F.col("largest_balance") > F.col("supply"))


def account_profile(positions: DataFrame, k: int = 3) -> DataFrame:
    """snapshot, address: the dominant token, its share, and the k largest as text."""
    item = F.struct((-F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("v"), "token")
    rows = positions.groupBy("snapshot", "address").agg(F.sort_array(F.collect_list(item)).alias("h"), F.sum("value").cast("double").alias("total"))
    first = F.col("h")[0]
    return rows.select("snapshot", "address", first["token"].alias("dominant"), F.try_divide(-first["v"], F.col("total")).alias("share"), F.array_join(F.transform(F.slice("h", 1, k), lambda x: x["token"]), "|").alias("top_tokens"))


def with_type(df: DataFrame, contracts: DataFrame, every: bool = True) -> DataFrame:
    """df with type CA or EOA, and with every a copy of each row as ALL. A list larger than Spark's broadcast limit is shuffled."""
    known = contracts.select("address").distinct().withColumn("_ca", F.lit(True))
    rows = df.join(known, "address", "left").withColumn("type", F.when(F.col("_ca"), "CA").otherwise("EOA")).drop("_ca")
    return rows.withColumn("type", F.explode(F.array("type", F.lit("ALL")))) if every else rows


def turnover(positions: DataFrame, order: list[int], native: str | None = None, tol: float = 1e-9) -> DataFrame:
    """address, t, t1 and the change from each snapshot to the next, for accounts with value in either: status is entry, stay or exit.

    The passive value of a position with value at t is its units times the token's implied price at t1, over positions
    with value. turnover is half the sum of absolute differences of actual and passive weights, drift that of passive and
    first weights; both are null where a side has no value. Units count as unchanged within a relative tolerance.
    Prices, a row per snapshot and token, are written first, so that Spark sees how few they are. A position becomes two
    rows, of the pair that it begins and the pair that it ends; positions dealt by address are not dealt again.
    """
    from tessera.sources.tables import saved

    nxt = F.create_map(*[F.lit(x) for a, b in zip(order, order[1:], strict=False) for x in (a, b)])
    back = F.create_map(*[F.lit(x) for a, b in zip(order[1:], order, strict=False) for x in (a, b)])
    priced = positions.select("snapshot", "address", "token", "units", F.greatest(F.coalesce("value", F.lit(0.0)).cast("double"), F.lit(0.0)).alias("value"))
    price = priced.filter("value > 0 AND units > 0").groupBy("snapshot", "token").agg((F.sum("value") / F.sum("units")).alias("price"))
    price = saved(price, "implied").select(F.try_element_at(back, F.col("snapshot")).alias("snapshot"), "token", "price")
    ahead = F.when(F.col("value") > 0, F.col("units") * F.coalesce("price", F.lit(0.0))).otherwise(0.0)
    zero = F.lit(0.0)
    begun = F.struct(F.col("snapshot").alias("t"), F.try_element_at(nxt, F.col("snapshot")).alias("t1"), F.col("units").alias("u0"), F.col("value").alias("v0"), ahead.alias("p1"), zero.alias("u1"), zero.alias("v1"))
    ended = F.struct(F.try_element_at(back, F.col("snapshot")).alias("t"), F.col("snapshot").alias("t1"), zero.alias("u0"), zero.alias("v0"), zero.alias("p1"), F.col("units").alias("u1"), F.col("value").alias("v1"))
    sides = priced.join(price, ["snapshot", "token"], "left").select("address", "token", F.explode(F.array(begun, ended)).alias("x"))
    rows = sides.select("x.t", "x.t1", "address", "token", *[f"x.{c}" for c in ("u0", "v0", "p1", "u1", "v1")]).filter("t IS NOT NULL AND t1 IS NOT NULL").groupBy("t", "t1", "address", "token").agg(*[F.sum(c).alias(c) for c in ("u0", "v0", "p1", "u1", "v1")])
    beside = W.partitionBy("t", "t1", "address")
    rows = rows.select("*", *[F.sum(c).over(beside).alias(f"_{c}") for c in ("v0", "p1", "v1")])
    same = F.abs(F.col("u1") - F.col("u0")) <= tol * F.greatest(F.abs("u0"), F.abs("u1"))
    part = lambda c: F.try_divide(F.col(c), F.col(f"_{c}"))
    aggs = [F.max("_v0").alias("V0"), F.max("_p1").alias("P1"), F.max("_v1").alias("A1"), F.count_if(F.col("v0") > 0).alias("n0"), F.bool_and(same).alias("unchanged"), F.bool_and(same | (F.col("token") == F.lit(native))).alias("unchanged_ex_native")]
    aggs += [F.count_if((F.col("u0") <= 0) & (F.col("u1") > 0)).alias("n_added"), F.count_if((F.col("u0") > 0) & (F.col("u1") <= 0)).alias("n_removed"), F.sum(F.when((F.col("v0") > 0) & (F.col("p1") <= 0), F.col("v0")).otherwise(0.0)).alias("v0_unpriced")]
    aggs += [(F.sum(F.abs(part("v1") - part("p1"))) / 2).alias("_turnover"), (F.sum(F.abs(part("v0") - part("p1"))) / 2).alias("_drift")]
    out = rows.groupBy("t", "t1", "address").agg(*aggs).filter("V0 > 0 OR A1 > 0")
    out = out.withColumn("turnover", F.when((F.col("A1") > 0) & (F.col("P1") > 0), F.col("_turnover"))).withColumn("drift", F.when(F.col("P1") > 0, F.col("_drift"))).drop("_turnover", "_drift")
    return out.withColumn("unchanged_ex_native", F.coalesce("unchanged_ex_native", "unchanged")).withColumn("status", F.when(F.col("V0") <= 0, "entry").when(F.col("A1") <= 0, "exit").otherwise("stay"))


#: Turnover up to which accounts are counted.
THRESHOLDS = [(0.001, "0_1pct"), (0.01, "1pct"), (0.05, "5pct"), (0.10, "10pct"), (0.25, "25pct"), (0.50, "50pct")]


def turnover_summary(rows: DataFrame, dims: list[str]) -> DataFrame:
    """dims: accounts with value in the first snapshot, exits, measured ones (value at both ends), unchanged, with positions added or removed, in- and outflows beyond a tenth, sums, and counts under cumulative thresholds of turnover; beside them, accounts that enter and their value."""
    # Ratios are rounded far below any threshold's meaning, so that the order of sums decides nothing.
    ratio = F.round(F.try_divide("A1", "P1"), 9)
    first = F.col("V0") > 0
    measured, stays, enters = first & (F.col("A1") > 0) & (F.col("P1") > 0), first & (F.col("A1") > 0), ~first & (F.col("A1") > 0)
    counts = {"n": first, "n_entry": enters, "n_exit": first & ~stays, "n_stay": stays, "n_measured": measured, "n_unchanged": stays & F.col("unchanged"), "n_unchanged_ex_native": stays & F.col("unchanged_ex_native"), "n_added_any": stays & (F.col("n_added") > 0), "n_removed_any": stays & (F.col("n_removed") > 0)}
    counts |= {"n_inflow": measured & (ratio > 1.1), "n_outflow": measured & (ratio < 0.9), "n_le_0": measured & (F.col("turnover") <= 1e-12)}
    counts |= {f"n_le_{name}": measured & (F.round("turnover", 12) <= x) for x, name in THRESHOLDS}
    sums = {"mean_turnover": F.avg(F.when(measured, F.col("turnover"))), "mean_drift": F.avg(F.when(measured, F.col("drift"))), "weighted_turnover": F.try_divide(F.sum(F.when(measured, F.col("V0") * F.col("turnover"))), F.sum(F.when(measured, F.col("V0")))), "share_unpriced": F.try_divide(F.sum("v0_unpriced"), F.sum("V0"))}
    sums["value_entry"] = F.sum(F.when(enters, F.col("A1")).otherwise(0.0))
    return rows.groupBy(*dims).agg(*[F.count_if(c).alias(k) for k, c in counts.items()], *[c.alias(k) for k, c in sums.items()])


def entries(rows: DataFrame, dims: list[str]) -> DataFrame:
    """dims: accounts of a turnover table that had no value in the first snapshot and have some in the next, and that value; wealth bins of it go by the next snapshot."""
    return rows.filter("V0 <= 0 AND A1 > 0").groupBy(*dims).agg(F.count("*").alias("n_entries"), F.sum("A1").alias("value_entries"))


def cash_mix(values: DataFrame) -> DataFrame:
    """Accounts with cash share and the mix of the rest; values has total, cash, native, derivative, wrapper."""
    rest = F.col("total") - F.col("cash")
    return values.filter("total > 0").select("*", (F.col("cash") / F.col("total")).alias("cash_share"), *[F.when(rest > 1e-9, F.col(c) / rest).alias(f"{c}_of_risky") for c in ("native", "derivative", "wrapper")])


def cap_binding(conc: DataFrame, cap: float, dims: list[str]) -> DataFrame:
    """dims: accounts, share of accounts and of value with the largest weight above the cap, and the mean excess."""
    over = F.col("max_weight") > cap
    return conc.groupBy(*dims).agg(F.count("*").alias("n"), F.avg(over.cast("int")).alias("share_accounts"), (F.sum(F.when(over, F.col("total")).otherwise(0.0)) / F.sum("total")).alias("share_value"), F.avg(F.when(over, F.col("max_weight") - cap)).alias("mean_shift"))


def eligible(holdings: DataFrame, alias: tuple[str, str]) -> DataFrame:
    """Accounts with at least two assets, before and after folding: the first test reaches the scan."""
    return holdings.filter("num_tokens >= 2").filter(folded_count(F.col("holdings"), alias) >= 2)


def weights(positions: DataFrame, keys: tuple[str, ...] = ("snapshot", "address")) -> DataFrame:
    """Positions with weight, their share of the account's value."""
    rows = positions.filter("value > 0").withColumn("value", F.col("value").cast("double"))
    return rows.withColumn("weight", F.col("value") / F.sum("value").over(W.partitionBy(*keys)))
