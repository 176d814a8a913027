"""Every query of the ledger engine against its SQL: on the smallest tables, or on larger ones where those leave it no row."""

import math
import os

import duckdb
import pytest

from tessera.plans import ORACLE, QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Families over wallet outcomes: the smallest tables have none that is whole.
OUTCOMES = ("m", "f17", "f3_", "p14", "p21", "p22", "p29", "h15")


def folder_of(name):
    return LARGER if name.startswith(OUTCOMES) else SF


@pytest.fixture(scope="module")
def duck():
    out = {}
    for folder in (SF, LARGER):
        con = out[folder] = duckdb.connect()
        for name in sorted(os.listdir(folder)):
            path = f"{folder}/{name}"
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return out


def plain(value):
    """A value as text, numbers to eight digits, so that engines can differ in the last bits."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value):.8g}"
    if hasattr(value, "date") and callable(value.date):
        return str(value.date())
    return str(value)


def near(a, b):
    """Whether two rows of texts agree, numbers but for a last rounded digit."""
    for x, y in zip(a, b, strict=True):
        if x != y:
            try:
                if abs(float(x) - float(y)) > 2e-5 * max(1.0, abs(float(x))):
                    return False
            except ValueError:
                return False
    return True


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, folder_of(name))
    want = duck[folder_of(name)].sql(ORACLE[name])
    # Columns that are exact come first, so that the last bits of a float don't decide which rows are compared.
    names = sorted(got.columns, key=lambda c: (dict(got.dtypes)[c] in ("double", "float"), c))
    assert sorted(names) == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    a = sorted([plain(r[c]) for c in names] for r in got.collect())
    b = sorted([plain(r[i]) for i in order] for r in want.fetchall())
    assert a and len(a) == len(b)
    assert all(near(x, y) for x, y in zip(a, b, strict=True))


def test_statistics_of_no_rows(spark):
    """What each operator answers for an empty table."""
    from pyspark.sql import functions as F

    from tessera.operators import finance, panels, ranks, stats

    empty = spark.createDataFrame([], "snapshot int, a double, b double, l1 double, n int")
    assert [(x.strategy, x.n, x.win) for x in stats.versus(empty, "a", ["b"], {"b": "l1"}).collect()] == [("b", 0, None)]
    assert [(x.pair, x.n, x.closer) for x in stats.direction(empty, [("a", "b")]).collect()] == [("a>b", 0, None)]
    assert [(x.snapshot, x.n) for x in panels.panel(empty, ["snapshot"], [F.count("*").alias("n")]).collect()] == [(None, 0)]
    assert [(x.term, x.coef, x.n) for x in stats.ols(empty, "a", ["b"]).collect()] == [("const", None, 0), ("b", None, 0)]
    row = stats.paired_tests(empty, "a", "b").first()
    assert (row.n, row.w_plus, row.t, row.p_t, row.z) == (0, 0.0, None, None, None)
    sides = spark.createDataFrame([], "snapshot int, mkt double")
    assert finance.check_market(sides, sides).first().asDict() == {"n": 0, "max_diff": None, "share_higher": None, "share_equal": None, "only_stored": 0, "only_recomputed": 0}
    assert ranks.exact_quantiles(empty, ["snapshot"], "a", [0.5]).count() == 0 and stats.forest(empty, "a", ["b"])[0] is None
    assert [x.coef for x in stats.quantile_reg(empty, "a", ["b"], 0.5).collect()] == [None, None] and stats.grouped_cv(empty, "a", ["b"], "snapshot").count() == 0


def test_exact_quantiles_and_ranks_against_numpy(spark):
    import numpy as np

    from tessera.operators import ranks, stats

    rng = np.random.default_rng(21)
    values = np.concatenate([rng.normal(0, 100, 400), np.zeros(50), np.full(60, 7.25), -np.exp(rng.normal(0, 8, 200)), [1e300, -1e300, 5e-310]])
    rows = [(i % 3 if i % 3 else None, float(v)) for i, v in enumerate(values)] + [(1, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double")
    qs = [0.0, 0.05, 0.5, 0.731, 1.0]
    for discrete in (False, True):
        for r in ranks.exact_quantiles(df, ["k"], "v", qs, discrete).collect():
            own = np.sort([v for k, v in rows if k == r.k and v is not None and v == v])
            want = own[np.maximum(np.ceil(len(own) * np.array(qs)).astype(int), 1) - 1] if discrete else np.quantile(own, qs)
            assert np.allclose(r.q, want, rtol=1e-9)
    own = df.filter("k = 2")
    got = {x.v: x.r for x in stats.average_ranks(own, "v", "r").collect()}
    held = np.sort([v for k, v in rows if k == 2])
    assert all(r == (np.searchsorted(held, v, "left") + 1 + np.searchsorted(held, v, "right")) / 2 for v, r in got.items())
    numbers = sorted(x._n for x in ranks.numbered(df, F_hash()).collect())
    assert numbers == list(range(1, len(rows) + 1))


def F_hash():
    from pyspark.sql import functions as F

    return F.xxhash64("k", "v")


def test_tails_against_known_values():
    from tessera.operators import stats

    for t, df, p in ((2.0, 10, 0.07338803477), (12.706204736, 1, 0.05), (1.959963985, 10**7, 0.05), (0.0, 5, 1.0), (-3.0, 4, 0.03994196807), (40.0, 30, 9.6e-28)):
        assert stats.t_tail(t, df) == pytest.approx(p, rel=2e-2 if p < 1e-20 else 1e-5)
    assert stats.normal_tail(1.959963984540054) == pytest.approx(0.05)


def test_values_of_fractional_and_large_balances(spark):
    from datetime import date
    from decimal import Decimal

    from tessera.operators import balances

    prices = spark.createDataFrame([("a", date(2020, 1, 1), 2.0)], "token string, day date, close double")
    doubles = spark.createDataFrame([("a", "x", 1, 0.4), ("a", "y", 1, 1.5), ("a", "z", 1, 5e18)], "token string, address string, snapshot int, balance double")
    raw = spark.createDataFrame([("a", "x", 1, Decimal(5 * 10**18)), ("a", "y", 1, Decimal(3 * 10**27))], "token string, address string, snapshot int, balance decimal(38,0)")
    assert {r.address: float(r.value) for r in balances.valued(doubles, prices, {1: date(2020, 1, 2)}).collect()} == {"x": 0.8, "y": 3.0, "z": 1e19}
    assert {r.address: float(r.value) for r in balances.valued(raw, prices, {1: date(2020, 1, 2)}).collect()} == {"x": 1e19, "y": 6e27}


def test_turnover_of_hand_made_accounts(spark):
    from tessera.operators import positions

    rows = [
        (1, "still", "N", 1.0, 10.0), (2, "still", "N", 1.0 + 5e-10, 12.0),  # unchanged within the relative tolerance
        (1, "gas", "N", 1.0, 10.0), (1, "gas", "A", 5.0, 5.0), (2, "gas", "N", 0.9, 10.8), (2, "gas", "A", 5.0, 10.0),  # only the native asset moved
        (1, "out", "A", 4.0, 4.0), (1, "none", "A", 3.0, 0.0), (2, "none", "A", 3.0, 6.0),
        (1, "swap", "A", 2.0, 2.0), (1, "swap", "Z", 7.0, 0.0), (2, "swap", "N", 1.0, 12.0),
    ]
    df = spark.createDataFrame(rows, "snapshot int, address string, token string, units double, value double")
    got = {r.address: r for r in positions.turnover(df, [1, 2], "N").collect()}
    assert set(got) == {"still", "gas", "out", "swap", "none"} and (got["none"].status, got["none"].turnover, got["none"].A1) == ("entry", None, 6.0)
    assert got["still"].unchanged and got["still"].turnover == 0 and got["still"].n_added == 0
    gas = got["gas"]
    assert not gas.unchanged and gas.unchanged_ex_native
    price = {"N": (12.0 + 10.8 + 12.0) / (1.0 + 5e-10 + 0.9 + 1.0), "A": 16.0 / 8.0}
    passive = np_array([1.0 * price["N"], 5.0 * price["A"]])
    actual = np_array([10.8, 10.0])
    assert gas.P1 == pytest.approx(passive.sum()) and gas.turnover == pytest.approx(abs(actual / actual.sum() - passive / passive.sum()).sum() / 2)
    assert got["out"].status == "exit" and got["out"].turnover is None and got["out"].n_removed == 1
    swap = got["swap"]  # the position without value at first has no passive value
    assert swap.P1 == pytest.approx(2.0 * price["A"]) and swap.turnover == 1.0 and (swap.n_added, swap.n_removed) == (1, 2)
    total = positions.turnover_summary(positions.turnover(df, [1, 2], "N"), ["t"]).first()
    assert (total.n, total.n_exit, total.n_measured, total.n_unchanged, total.n_unchanged_ex_native, total.n_added_any) == (4, 1, 3, 1, 2, 1)
    assert (total.n_entry, total.value_entry) == (1, 6.0) and [(x.n_entries, x.value_entries) for x in positions.entries(positions.turnover(df, [1, 2], "N"), ["t"]).collect()] == [(1, 6.0)]


def test_block_summary_of_hand_made_wallets(spark):
    from tessera.operators import finance

    rows = [(1, "lo", 0.1, 0.2, 0.3, True, 0.05, 1.0), (1, "lo", 0.3, 0.1, 0.5, False, 0.05, 2.0), (1, "lo", None, 0.4, None, True, 0.05, None), (1, "hi", 0.2, None, 0.1, True, 0.05, 1.5)]
    df = spark.createDataFrame(rows, "snapshot int, wealth string, ret_base double, ret_x double, l1_x double, fallback_x boolean, market double, beta_base double")
    got = {(r.wealth, r.strategy): r for r in finance.block_summary(df, ["base", "x"], "base", ["wealth"]).collect()}
    x, base = got["lo", "x"], got["lo", "base"]
    assert (x.n, base.n, x.hit_rate, base.hit_rate, base.l1_mean, x.beta_mean) == (3, 2, 0.5, None, None, None)
    assert x.strategy_mean == pytest.approx(0.7 / 3) and x.strategy_median == 0.2 and x.l1_mean == pytest.approx(0.4) and x.fallback_rate == pytest.approx(2 / 3)
    assert base.strategy_mean == pytest.approx(0.2) and base.beta_median == 1.5 and x.baseline_mean == pytest.approx(0.2) and x.market_median == 0.05
    assert (got["hi", "x"].n, got["hi", "x"].strategy_mean, got["hi", "x"].fallback_rate) == (0, None, 1.0)


def np_array(x):
    import numpy as np

    return np.array(x)


def test_joins_and_reverts_by_hand(spark):
    from datetime import date

    from tessera.operators import joins, ledger

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, n int")
    assert sorted(map(tuple, joins.left_and_unmatched(a, b, ["k"]).select("k", "name", "n").collect()), key=str) == [(1, "x", None), (2, "y", 5), (3, None, 6)]
    days = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 1, 2))], "block int, day date")
    manifest = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 1, 3)), (9, date(2020, 1, 9))], "block int, day date")
    assert tuple(joins.date_mismatches(manifest, days).first()) == (3, 1, 1)
    traces = [("t", "", None), ("t", "0", "out of gas"), ("t", "0,1", None), ("t", "0", "out of gas"), ("t", "1", None), ("t", "10", None), ("u", "0,1", None), ("v", "", "bad"), ("v", "3,4", None)]
    df = spark.createDataFrame(traces, "tx_hash string, trace_address string, error string").repartition(3)
    assert sorted((r.tx_hash, r.trace_address) for r in ledger.drop_reverted_subtrees(df).collect()) == [("t", ""), ("t", "1"), ("t", "10"), ("u", "0,1")]


def test_accounts_are_not_dealt_again(spark):
    """Positions come dealt by address, and tables of tokens are known to be small: what goes by account shuffles nothing."""
    from tessera.operators import finance, positions
    from tessera.plans import portfolio, returns

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    w = positions.weights(portfolio.folded(spark, SF))
    for df in (w, positions.turnover(portfolio.folded(spark, SF), portfolio.SNAPS), finance.path_metrics(w, portfolio.d.prices(spark, SF), portfolio.DAYS), returns.outcomes(spark, SF).drop("market"), QUERIES["p16_portfolio_beta"](spark, SF), QUERIES["p18_metrics"](spark, SF)):
        text = plan(df)
        assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "Exchange" not in plan(QUERIES["p13_forward_returns"](spark, SF))
    assert "hashpartitioning(address" not in plan(QUERIES["m23_beta_by_exact_n"](spark, LARGER)) and "SortMergeJoin" not in plan(QUERIES["m28_minmax"](spark, LARGER))


def test_quantiles_count_magnitudes_first(spark):
    """Only values of the magnitudes that hold a quantile are dealt; nulls, NaN, null keys, ties and negative values are as before."""
    import numpy as np

    from tessera.operators import ranks

    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.normal(size=3000), 2), "b": rng.exponential(size=7) - 1, None: np.zeros(40)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in ranks.exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    assert {k: np.round(q, 12).tolist() for k, q in got.items()} == {k: np.round(np.quantile(v, [0.0, 0.05, 0.5, 0.95, 1.0]), 12).tolist() for k, v in values.items()}
    dealt = ranks.places(df, ["k"], "v", lambda n: ranks.F.array(n)).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in dealt}["a"] < 200


def test_strategies_deal_wallets_at_most_once(spark):
    """Wallets' figures are made where their positions or portfolios are: no query of strategies shuffles positions, or wallets by address after they are solved."""
    import re

    from tessera.plans import returns

    dealt = lambda df: re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
    for rows in (returns.strategy_rows(spark, SF, ["base", "equal", "mcap"]), returns.strategy_rows(spark, SF, ["base", "return", "variance", "sharpe", "equal", "mcap"]), returns.p21_fallbacks(spark, SF), returns.p28(spark, SF), returns.p9(spark, SF)):
        keys = [re.sub(r"#\d+", "", k) for k in dealt(rows)]
        assert not [k for k in keys if "address" in k or "token" in k and "snapshot, token" not in k], keys
        assert keys.count("snapshot, part") in (0, 2)
    keys = [re.sub(r"#\d+", "", k) for k in dealt(returns.strategy_rows(spark, SF, ["base", "equal", "mcap"]))]
    assert not [k for k in keys if "token" in k], keys
