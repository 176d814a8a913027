"""Tags, labels and token status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.balances import balances_at


def tag_flags(summary: DataFrame) -> DataFrame:
    """Addresses with in_tags, has_category, has_concept and has_any from their tag columns."""
    has = lambda c: F.coalesce(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[|,]"), lambda x: F.trim(x) != "")), F.lit(0)) > 0
    rows = summary.withColumn("has_category", has(F.col("categories"))).withColumn("has_concept", has(F.col("concepts")))
    return rows.withColumn("in_tags", F.coalesce("n_tags", F.lit(0)) > 0).withColumn("has_any", F.col("has_category") | F.col("has_concept"))


def effective_label(df: DataFrame, priority: list[str]) -> DataFrame:
    """df with label: the best category, else the concept of highest priority (unknown ones last, by name), else UNLABELED."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(priority) for x in (p, i)])
    concepts = F.filter(F.transform(F.split(F.coalesce("concepts", F.lit("")), r"[|,]"), lambda c: F.trim(c)), lambda c: c != "")
    ranked = F.array_sort(F.transform(concepts, lambda c: F.struct(F.coalesce(F.try_element_at(order, c), F.lit(10**6)).alias("r"), c.alias("c"))))
    best = F.try_element_at(ranked, F.lit(1))["c"]
    return df.withColumn("label", F.coalesce(F.when(F.trim("category") != "", F.trim("category")), best, F.lit("UNLABELED")))


def label_counts(df: DataFrame, col: str, multi: bool) -> DataFrame:
    """label, n, percent of labelled rows and of all; multi explodes sets, so that percentages can exceed 100 in sum."""
    rows = df.withColumn("_l", F.split(F.coalesce(F.col(col), F.lit("")), r"[|,]") if multi else F.array(F.coalesce(F.col(col), F.lit(""))))
    totals = rows.agg(F.count("*").alias("_all"), F.count_if(F.exists("_l", lambda x: ~F.trim(x).isin("", "UNLABELED"))).alias("_labelled"))
    exploded = rows.select(F.explode(F.array_distinct(F.transform("_l", lambda x: F.trim(x)))).alias("label")).filter("label NOT IN ('', 'UNLABELED')")
    counts = exploded.groupBy("label").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(totals)).select("label", "n", (F.col("n") * 100.0 / F.col("_labelled")).alias("pct_labelled"), (F.col("n") * 100.0 / F.col("_all")).alias("pct_all"))


def tag_coverage(df: DataFrame, dims: list[str]) -> DataFrame:
    """dims with 'ALL': rows, and the shares in tags, with a category, a concept, any of both."""
    from tessera.operators.panels import cube_panel

    flags = ("in_tags", "has_category", "has_concept", "has_any")
    return cube_panel(df, dims, [F.count("*").alias("n"), *[F.avg(F.col(f).cast("int")).alias(f"share_{f}") for f in flags]])


def pair_tags(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Distinct (block, address) pairs with their address's flags; an unknown address has none."""
    flags = ["in_tags", "has_category", "has_concept", "has_any"]
    rows = pairs.select("block", "address").dropDuplicates().join(summary.select("address", *flags), "address", "left")
    return rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def tag_quality(tags: DataFrame, by: list[str]) -> DataFrame:
    """aspect, value, n and median number of tags, for each of the given columns."""
    from functools import reduce

    parts = [tags.groupBy(F.lit(c).alias("aspect"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.median("n_tags").alias("median_tags")) for c in by]
    return reduce(DataFrame.unionByName, parts)


def price_status(ok: Column, points: Column, enough: int = 15) -> Column:
    """success with enough points, not_enough_data with 2 or more, not_available with fewer, failure without an answer."""
    return F.when(~F.coalesce(ok, F.lit(False)), "failure").when(points >= enough, "success").when(points >= 2, "not_enough_data").otherwise("not_available")


def order_status(df: DataFrame, col: str, order: list[str], then: str) -> DataFrame:
    """df sorted by the place of a status in a list, then by a column."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return df.withColumn("_r", F.coalesce(F.try_element_at(rank, F.col(col)), F.lit(len(order)))).orderBy("_r", then).drop("_r")


def below_reference(metrics: DataFrame, reference: DataFrame) -> DataFrame:
    """metrics with below: TRUE when market value and diluted value are both less than the reference's one row, UNKNOWN if missing."""
    ref = reference.select(F.col("market_cap").alias("_m"), F.col("fdv").alias("_f"))
    rows = metrics.crossJoin(F.broadcast(ref))
    known = F.col("market_cap").isNotNull() & F.col("fdv").isNotNull()
    flag = F.when(~known, "UNKNOWN").when((F.col("market_cap") < F.col("_m")) & (F.col("fdv") < F.col("_f")), "TRUE").otherwise("FALSE")
    return rows.withColumn("below", flag).drop("_m", "_f")


def local_status(status: DataFrame, results: DataFrame) -> DataFrame:
    """status with local_status from the results' verdict: PASS, NOT_PASS, or NO_DATA."""
    rows = status.join(results.select("token", "ok"), "token", "left")
    return rows.withColumn("local_status", F.when(F.col("ok").isNull(), "NO_DATA").when(F.col("ok"), "PASS").otherwise("NOT_PASS")).drop("ok")


def candidates(*sources: DataFrame) -> DataFrame:
    """address, block: the least creation block over several sources, 0 counting as unknown."""
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b), [s.select("address", "block") for s in sources])
    return rows.groupBy("address").agg(F.coalesce(F.min(F.when(F.col("block") > 0, F.col("block"))), F.lit(0)).alias("block"))


def flip_flag(status: DataFrame, verdicts: DataFrame, flag: str = "is_erc_20") -> DataFrame:
    """status with a false flag turned true where both checks say Y."""
    rows = status.join(verdicts.select("token", "first_check", "second_check"), "token", "left")
    both = (F.upper(F.trim("first_check")) == "Y") & (F.upper(F.trim("second_check")) == "Y")
    return rows.withColumn(flag, F.when((F.lower(flag) == "false") & F.coalesce(both, F.lit(False)), "true").otherwise(F.col(flag))).drop("first_check", "second_check")


def check_balances(flows: DataFrame, truth: DataFrame, tol: float) -> DataFrame:
    """token: rows, exact and within tolerance, and PASS if all are, of ledger balances against a truth table (token, address, block, balance)."""
    keys = ["token", "address", "block"]
    asked = truth.select(*keys, F.col("balance").alias("truth")).distinct()
    ours = balances_at(flows.select("token", "address", "block", "value"), asked.select(*keys).distinct(), ("token", "address"))
    both = asked.join(ours.withColumnRenamed("balance", "ours"), keys)
    near = F.abs(F.col("ours") - F.col("truth")) <= tol
    out = both.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("ours") == F.col("truth")).alias("exact"), F.count_if(near).alias("within"))
    return out.withColumn("status", F.when(F.col("within") == F.col("n"), "PASS").otherwise("NOT_PASS"))


def absent_positions(positions: DataFrame, accounts: DataFrame, tokens: DataFrame, truth: DataFrame, n: int, seed: str) -> DataFrame:
    """address, token of n sampled pairs without a position, with their truth (0 where unknown) and whether it is 0.

    Each account meets one token that its hash picks, so no cross join of accounts and tokens is made.
    """
    numbered = tokens.select("token").distinct().groupBy().agg(F.sort_array(F.collect_set("token")).alias("_t"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "address").cast("binary")), 1, 8), 16, 10).cast("long")
    pairs = accounts.select("address").distinct().crossJoin(F.broadcast(numbered)).select("address", F.element_at("_t", (h % F.size("_t") + 1).cast("int")).alias("token"), h.alias("_h"))
    free = pairs.join(positions.select("address", "token"), ["address", "token"], "left_anti").orderBy("_h", "address").limit(n)
    rows = free.join(truth.select("address", "token", F.col("balance").alias("truth")), ["address", "token"], "left")
    return rows.select("address", "token", F.coalesce("truth", F.lit(0)).alias("truth")).withColumn("ok", F.col("truth") == 0)


def curated(listed: DataFrame, whitelist: DataFrame) -> DataFrame:
    """A curated list with whether each token is on the whitelist, breaks the rule that core implies extended, and is there twice."""
    twice = listed.groupBy("token").agg(F.count("*").alias("_n"))
    rows = listed.join(twice, "token").join(whitelist.select("token").distinct().withColumn("_w", F.lit(True)), "token", "left")
    return rows.withColumn("whitelisted", F.coalesce("_w", F.lit(False))).withColumn("breaks_rule", F.col("cash_core") & ~F.col("cash_extended")).withColumn("repeated", F.col("_n") > 1).drop("_n", "_w")
