"""Hand-made fixtures for what SQL on the given tables cannot state."""

import itertools
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import values as v
from tessera.operators import asof, balances as b, filters, finance, frontier, ledger as l, optimise as o, panels, positions, ranks, stats
from tessera.operators import attribution as g
from tessera.sources import domain, tables as s


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_decimal_formats(spark):
    big = 2**120 + 12345
    data = [("12", "0x0c", bytes(31) + b"\x0c"), (str(big), hex(big), big.to_bytes(32, "big")), ("9" * 39, "0x" + "f" * 64, b"\xff" * 32), ("x", "0xzz", b""), (None, None, None)]
    df = spark.createDataFrame(data, "t string, h string, b binary")
    got = df.select(v.to_decimal(F.col("t"), "text"), v.to_decimal(F.col("h"), "hex"), v.to_decimal(F.col("b"), "binary")).collect()
    assert [int(x) for x in got[0]] == [12, 12, 12] and [int(x) for x in got[1]] == [big] * 3
    assert list(got[2]) == [None] * 3 and got[3][0] is None and got[3][1] is None and list(got[4]) == [None] * 3


def test_exact_sums_of_big_integers(spark):
    rng = np.random.default_rng(2)
    data = [(int(k), int("".join(map(str, rng.integers(0, 10, n)))) * int(rng.choice([-1, 1]))) for k in range(6) for n in (1, 18, 19, 38, 39, 78)]
    data += [(9, 10**77), (9, -(10**77)), (8, -5), (8, 3), (7, 10**36), (7, -1)]
    df = spark.createDataFrame([(k, str(x)) for k, x in data], "k int, x string")
    want = {}
    for k, x in data:
        want[k] = want.get(k, 0) + x
    assert {r.k: int(r.balance) for r in b.exact_sums(df, ["k"], "x").collect()} == want


def test_value_types_and_impossible_balances(spark):
    df = spark.createDataFrame([("a", "12"), ("b", "9223372036854775807"), ("c", "9223372036854775808"), ("d", "1" * 38), ("e", "1" * 39), ("f", "1" * 78)], "token string, value string")
    assert {r.token: r.storage for r in l.value_type(df).collect()} == {"a": "int64", "b": "int64", "c": "decimal128", "d": "decimal128", "e": "decimal256", "f": "text"}
    flags = spark.createDataFrame([(str(2**255 - 1),), (str(2**256),), ("1" * 76,), ("12.5",)], "x string").select(v.impossible_balance(F.col("x"))).collect()
    assert [r[0] for r in flags] == [True, True, False, False]


def topic(n):
    return bytes(12) + n.to_bytes(20, "big")


def test_log_decoding(spark):
    address = lambda n: "0x" + n.to_bytes(20, "big").hex()
    t = l.TOPICS
    logs = [(t["transfer"], [b"", topic(1), topic(2)], (7).to_bytes(32, "big"), 5, 0, (9).to_bytes(20, "big"), "0xa"), (t["deposit"].upper().replace("0X", "0x"), [b"", topic(3)], (8).to_bytes(32, "big"), 5, 1, (9).to_bytes(20, "big"), "0xb"), (t["withdrawal"], [b"", topic(4)], (6).to_bytes(32, "big"), 6, 0, (9).to_bytes(20, "big"), "0xc"), (t["transfer"], [b"", topic(1), topic(2)], bytes(32), 7, 0, (9).to_bytes(20, "big"), "0xd"), ("0xother", [b""], b"\x01", 7, 1, (9).to_bytes(20, "big"), "0xe")]
    df = spark.createDataFrame(logs, "topic0 string, topics array<binary>, data binary, block_id long, log_index int, address binary, tx_hash string")
    got = [(r.token, r.sender, r.recipient, r.block, int(r.value)) for r in l.decode_transfers(l.classify_events(df)).orderBy("block", "log_index").collect()]
    assert got == [(address(9), address(1), address(2), 5, 7), (address(9), l.ZERO, address(3), 5, 8), (address(9), address(4), l.ZERO, 6, 6)]


def test_reverted_subtrees_keys_and_moves(spark):
    data = [("t", "", None), ("t", "0", "out of gas"), ("t", "0,1", None), ("t", "0,1,2", None), ("t", "1", ""), ("t", "10", None), ("u", "0,1", None)]
    df = spark.createDataFrame(data, "tx_hash string, trace_address string, error string")
    assert rows(l.drop_reverted_subtrees(df).select("tx_hash", "trace_address")) == sorted([("t", ""), ("t", "1"), ("t", "10"), ("u", "0,1")], key=repr)
    assert df.select(l.trace_key(F.col("trace_address"))).collect()[3][0] == "000000000.000000001.000000002"
    traces = spark.createDataFrame([("call", "call", 1, 3), ("call", "delegatecall", 1, 3), ("call", None, 2, 3), ("create", None, 1, 3), ("call", "call", 0, 3), ("reward", None, 1, 3), ("reward", None, 1, 99), ("genesis", None, 1, 0)], "trace_type string, call_type string, value int, block int")
    assert l.value_moves(traces).count() == 3 and l.mints(traces, 50).count() == 2


def test_fees_withdrawals_genesis_and_indexes(spark):
    tx = spark.createDataFrame([(1, "a", "0xs", 10, 7, 0, None), (2, "b", "0xs", 10, 7, 2, 3)], "block int, tx_hash string, sender string, gas_used long, gas_price long, blob_gas_used long, blob_gas_price long")
    blocks = spark.createDataFrame([(1, "0xp", None, None), (2, "0xp", 5, [(4, "0xAB", 3), (None, "0xcd", 1)])], "block int, producer string, base_fee long, withdrawals array<struct<index: long, address: string, amount: long>>")
    fees = [(r.block, r.recipient, int(r.value), r.kind) for r in l.fee_rows(tx, blocks).collect()]
    assert sorted(fees, key=repr) == sorted([(1, "0xp", 70, "fee_tip"), (2, None, 56, "fee_burn"), (2, "0xp", 20, "fee_tip")], key=repr)
    assert [(r.recipient, int(r.value), r.sub_index) for r in l.withdrawal_rows(blocks).orderBy("sub_index").collect()] == [("0xcd", 10**9, 1), ("0xab", 3 * 10**9, 4)]
    alloc = spark.createDataFrame([('{"0xAa": {"balance": "0x10"}, "bb": {"balance": "12"}}',)], "alloc string")
    assert sorted((r.recipient, int(r.value)) for r in l.genesis_rows(alloc).collect()) == [("0xaa", 16), ("0xbb", 12)]
    traces = spark.createDataFrame([("a", None), ("a", 5), ("z", None)], "tx_hash string, tx_index int")
    assert rows(l.borrow_tx_index(traces, spark.createDataFrame([("a", 3), ("a", 3)], "tx_hash string, tx_index int"))) == rows(spark.createDataFrame([("a", 3), ("a", 5), ("z", None)], "tx_hash string, tx_index int"))
    counts = l.quality_counts(spark.createDataFrame([("1",), ("x",), (None,)], "value string"), tx, blocks, 1, 1).first()
    assert tuple(counts) == (1, 0, 1, 1)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("a", date(2020, 1, 5)), ("a", date(2020, 1, 1)), ("b", date(2020, 1, 5)), ("a", date(2020, 2, 9))], "k string, d date")
    right = spark.createDataFrame([("a", date(2020, 1, 2), 1), ("a", date(2020, 1, 5), 2), ("a", date(2020, 1, 9), 3)], "k string, t date, v int")
    got = {(r.k, r.d.day, r.d.month): r.v for r in asof.asof_join(left, right, ["k"], "d", "t").collect()}
    assert got == {("a", 5, 1): 2, ("a", 1, 1): None, ("b", 5, 1): None, ("a", 9, 2): 3}
    assert {r.d: r.v for r in asof.asof_join(left, right, ["k"], "d", "t", max_age=3).filter("k = 'a'").collect()}[date(2020, 2, 9)] is None
    near = {(r.k, r.d): r.v for r in asof.nearest_join(left, right, ["k"], "d", "t", 15).collect()}
    assert near[("a", date(2020, 1, 1))] == 1 and near[("a", date(2020, 2, 9))] is None


def test_runs_equal_a_sort(spark):
    rng = np.random.default_rng(4)
    data = [(int(i % 3) or None, f"a{i}", int(rng.choice([1, 1, 2, 5, 40, 1000, 10**6]) * rng.integers(1, 4))) for i in range(600)]
    df = spark.createDataFrame(data, "k int, address string, x long")
    for options in ({}, {"crowded": 2}, {"crowded": 1, "levels": 2}, {"levels": 0}):
        got = {(r.k, r.x): (r.c, r.above, r.running, r.n, r.total) for r in ranks.runs(df, ["k"], "x", **options).collect()}
        for k in (None, 1, 2):
            own = [x for q, _, x in data if q == k]
            assert {x: v for (q, x), v in got.items() if q == k} == {x: (own.count(x), sum(y > x for y in own), sum(y for y in own if y > x), len(own), sum(own)) for x in own}
        shares = {r.k: (r.n, r["top_0_1"]) for r in ranks.top_shares(df, [0.1], "x", ["k"], **options).collect()}
        for k in (None, 1, 2):
            own = sorted((x for q, _, x in data if q == k), reverse=True)
            assert shares[k] == (len(own), pytest.approx(sum(own[: -(-len(own) // 10)]) / sum(own)))


def plain_inequality(own):
    own = sorted(map(float, own))
    n, total = len(own), sum(own)
    down = own[::-1]
    gini = 2 * sum((i + 1) * x for i, x in enumerate(own)) / (n * total) - (n + 1) / n
    half = next(i + 1 for i in range(n) if sum(down[: i + 1]) >= 0.5 * total)
    return n, total, sum((x / total) ** 2 for x in own), gini, sum(down[:10]) / total, sum(down[: max(1, -(-n * 5 // 100))]) / total, half


def test_inequality_of_runs(spark):
    rng = np.random.default_rng(9)
    sets = {"same": [7] * 500, "two": [1, 3], "ties": [int(x) for x in rng.choice([1, 2, 2, 50, 10**9], 400)], "apart": [int(x) for x in rng.integers(1, 10**12, 300)], "half": [5, 5, 5, 5], "one": [9]}
    df = spark.createDataFrame([(t, 1, f"a{i}", x) for t, own in sets.items() for i, x in enumerate(own)], "token string, snapshot int, address string, balance long")
    for options in ({}, {"crowded": 3}):
        got = {r.token: r for r in ranks.inequality(df, **options).collect()}
        assert set(got) == set(sets) - {"one"}
        for t, r in got.items():
            assert (r.holders, r.supply, r.hhi, r.gini, r.top10, r.top5pct, r.nakamoto) == pytest.approx(plain_inequality(sets[t]))


def test_a_million_equal_holders_are_one_row(spark):
    df = spark.range(1_000_000).select(F.lit("t").alias("token"), F.lit(1).alias("snapshot"), F.col("id").alias("address"), F.lit(5).cast("long").alias("balance"))
    r = ranks.inequality(df).first()
    assert (r.holders, r.nakamoto, r.gini, r.top100) == (1_000_000, 500_000, pytest.approx(0, abs=1e-9), pytest.approx(1e-4))
    assert ranks.runs(df, ["token"], "balance").count() == 1


def test_crowded_columns_are_cut_again(spark):
    """Two million distinct values between 0.99 and 1, most of them near 1: quantiles and ranks by many tasks of bounded size."""
    n = 2_000_000
    df = spark.range(n).select((1 - 0.01 * F.pow(F.col("id") / n, F.lit(4))).alias("v"))
    q = ranks.exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 1.0]).first().q
    assert q == pytest.approx([1 - 0.01 * ((1 - p) * (n - 1) / n) ** 4 for p in (0.0, 0.25, 0.5, 1.0)], abs=1e-9)
    placed = ranks.places(df.sample(0.2, 3), [], "v", levels=2, crowded=10_000)
    assert len(set(placed.agg(F.sum("_c"), F.max("_end"), F.max("_all")).first())) == 1


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "AAA_price.csv").write_text("date,daily_close_usd\n2021-01-01 00:00:00,1.5\n2021-01-01,9\n2021-01-02,2\n")
    (tmp_path / "p" / "BBB_price.csv").write_text("date,daily_close_usd\n2021-01-01,3\n")
    assert rows(s.read_prices(spark, str(tmp_path / "p"))) == [("AAA", date(2021, 1, 1), 1.5), ("AAA", date(2021, 1, 2), 2.0), ("BBB", date(2021, 1, 1), 3.0)]
    (tmp_path / "a.txt").write_text("address;x\n0x" + "A" * 40 + ";1\n0x" + "a" * 40 + ",2\nnone\n")
    assert [r.line[-1] for r in s.read_addresses(spark, str(tmp_path / "a.txt")).collect()] == ["2"]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(one)
    spark.createDataFrame([(3, "x")], "a int, c string").write.parquet(two)
    assert set(s.read_drifting(spark, [one, two]).columns) == {"a", "b", "c"}
    ranges = s.file_ranges(spark.read.parquet(one), "a").collect()
    assert [(r.lo, r.hi, r.n) for r in ranges] == [(1, 1, 1)]
    df = spark.createDataFrame([(i % 3, f"x{i}", i, i % 5) for i in range(60)], "block_number int, address string, block int, log_index int")
    assert {r.block_number: r.n for r in s.write_by_snapshot(df, str(tmp_path / "w")).collect()} == {0: 20, 1: 20, 2: 20}
    s.write_bucketed(df, str(tmp_path / "b"), 4)
    assert s.read_dataset(spark, str(tmp_path / "b")).count() == 60
    old = spark.createDataFrame([(1, "a"), (2, "b")], "block_number int, source_tag string")
    new = spark.createDataFrame([(7,)], "block_number int")
    assert [tuple(r) for r in s.upsert_manifest(old, new, "b").collect()] == [(1, "a"), (7, "b")]


def test_status_rules(spark):
    verdicts = spark.createDataFrame([("a", "Y", " y"), ("b", "Y", "N")], "token string, first_check string, second_check string")
    status = spark.createDataFrame([("a", "false"), ("b", "false"), ("c", "true")], "token string, is_erc_20 string")
    assert {r.token: r.is_erc_20 for r in g.flip_flag(status, verdicts).collect()} == {"a": "true", "b": "false", "c": "true"}
    listed = spark.createDataFrame([("a", True, True), ("b", True, False), ("b", True, False)], "token string, cash_core boolean, cash_extended boolean")
    got = {r.token: (r.whitelisted, r.breaks_rule, r.repeated) for r in g.curated(listed, status.filter("token = 'a'")).collect()}
    assert got == {"a": (True, False, False), "b": (False, True, True)}
    absent = g.absent_positions(spark.createDataFrame([("w", "a")], "address string, token string"), spark.createDataFrame([("w",), ("x",)], "address string"), status, spark.createDataFrame([("x", "c", 5)], "address string, token string, balance int"), 10, "s").collect()
    assert all((r.address, r.token) != ("w", "a") and r.ok == (r.truth == 0) for r in absent)
    sheet = spark.createDataFrame([("0x1", "TRUE", "Pass", "success"), ("0x2", "true", "pass", "failure"), ("0x3", "false", "pass", "success")], "contract_address string, is_erc_20 string, local_status string, price_data_status string")
    assert rows(filters.whitelist(sheet)) == [("0x1",), ("ETH",)] and rows(filters.whitelist(sheet, eth=False, price=False)) == [("0x1",), ("0x2",)]
    assert filters.sane_supply(spark.createDataFrame([(1e60, 0.5), (5.0, 1.2)], "supply double, gini double")).first().gini == 1.0
    proxy = "0x363d3d373d3d3d363d73" + "ab" * 20 + "5af43d82803e903d91602b57fd5bf3"
    assert spark.createDataFrame([(proxy,), ("0x00",)], "c string").select(v.proxy_target(F.col("c"))).collect()[0][0] == "0x" + "ab" * 20
    days = spark.createDataFrame([(date(2020, 1, 1), 5.0)], "day date, supply double")
    found, missing = b.supply_override(days, spark.createDataFrame([(1, date(2020, 1, 6)), (2, date(2020, 3, 1))], "block int, day date"))
    assert [r.supply for r in found.collect()] == [5.0] and [r.block for r in missing.collect()] == [2]
    assert panels.union_sources({"a": old_rows(spark), "b": old_rows(spark)}).count() == 4


def old_rows(spark):
    return spark.createDataFrame([(1,), (2,)], "log_index int")


def feasible(rng, n, cap, k):
    """Random portfolios within the cap: capped shares of Dirichlet draws, what is cut off dealt to the room that others have."""
    w = np.minimum(rng.dirichlet(np.ones(n) * 0.7, k), cap)
    room = cap - w
    return w + room / np.maximum(room.sum(axis=1, keepdims=True), 1e-12) * (1 - w.sum(axis=1, keepdims=True))


def best_by_enumeration(q, m, cap, goal, at):
    """The best portfolio for a goal, over all ways to hold assets at 0, at the cap or free: each way has closed forms."""
    n, top, found = len(m), min(cap, 1.0), (-np.inf, None)

    def look(w, found):
        if w is None or (w < -1e-9).any() or (w > top + 1e-9).any() or abs(w.sum() - 1) > 1e-9:
            return found
        if goal == "variance" and abs(w @ m - at) > 1e-9 or goal == "return" and abs(w @ q @ w - at) > 1e-9:
            return found
        worth = {"variance": -w @ q @ w, "return": w @ m, "sharpe": w @ m / np.sqrt(w @ q @ w)}[goal]
        return max(found, (worth, w), key=lambda x: x[0])

    for state in itertools.product((0, 1, 2), repeat=n):
        free = [i for i in range(n) if state[i] == 2]
        w = np.array([top if s == 1 else 0.0 for s in state])
        k = len(free)
        if not k:
            found = look(w, found)
            continue
        # Stationary points are a + x b, for the multiplier x of the return.
        system = np.zeros((k + 1, k + 1))
        system[:k, :k], system[:k, k], system[k, :k] = q[np.ix_(free, free)], -1, 1
        a = np.linalg.solve(system, np.append(-q[free] @ w, 1 - w.sum()))[:k]
        b = np.linalg.solve(system, np.append(m[free], 0))[:k]
        base, move = w.copy(), np.zeros(n)
        base[free], move[free] = a, b
        xs = [0.0]
        if goal == "variance" and abs(move @ m) > 1e-15:
            xs = [(at - base @ m) / (move @ m)]
        elif goal == "return":
            xs = [float(x.real) for x in np.roots([move @ q @ move, 2 * base @ q @ move, base @ q @ base - at]) if abs(x.imag) < 1e-9]
        elif goal == "sharpe":
            r0, r1, v0, v1, v2 = base @ m, move @ m, base @ q @ base, base @ q @ move, move @ q @ move
            xs += [(r1 * v0 - r0 * v1) / (r0 * v2 - r1 * v1)] if abs(r0 * v2 - r1 * v1) > 1e-18 else []
        for x in xs:
            found = look(base + x * move, found)
        if k == 2 and goal == "return":  # an edge
            i, j = free
            first, step = w.copy(), np.zeros(n)
            first[i], step[i], step[j] = 1 - w.sum(), -1, 1
            for t in np.roots([step @ q @ step, 2 * first @ q @ step, first @ q @ first - at]):
                found = look(first + t.real * step, found) if abs(t.imag) < 1e-9 else found
    return found


@pytest.mark.parametrize("cap", [1.0, 0.9, 0.5, 0.4, 0.3])
@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_frontier_against_enumerated_active_sets(n, cap):
    if n * cap <= 1:
        assert np.allclose(frontier.trace(np.ones((1, n)), np.eye(n)[None], cap).weights, 1 / n)
        return
    rng = np.random.default_rng(n)
    x = rng.normal(0.001, 0.03, (60, n)) * rng.uniform(0.5, 2, n)
    mu, cov = x.mean(axis=0) * 100, o.ledoit_wolf(x) * 1000
    lines = frontier.trace(mu[None], cov[None], cap)
    held, of = feasible(rng, n, cap, 12), np.zeros(12, int)
    var = lambda w: np.einsum("ij,jk,ik->i", w, cov, w)
    top, met = frontier.most_return(lines, of, var(held), cov[None], mu[None], cap)
    low, same = frontier.least_variance(lines, of, held @ mu)
    assert met.all() and same.all() and np.allclose(var(top), var(held), atol=1e-9) and np.allclose(low @ mu, held @ mu, atol=1e-9)
    for w in (top, low):
        assert (w > -1e-9).all() and (w < cap + 1e-9).all() and np.allclose(w.sum(axis=1), 1)
    for i, w in enumerate(held):
        assert top[i] @ mu == pytest.approx(best_by_enumeration(cov, mu, cap, "return", w @ cov @ w)[0], abs=1e-7)
        assert -var(low[i][None])[0] == pytest.approx(best_by_enumeration(cov, mu, cap, "variance", w @ mu)[0], abs=1e-7)
    best, flagged = frontier.best_ratio(lines, 0.0)
    if not flagged[0]:
        assert best[0] @ mu / np.sqrt(var(best)[0]) == pytest.approx(best_by_enumeration(cov, mu, cap, "sharpe", 0)[0], abs=1e-7)


@pytest.mark.parametrize("n,cap", [(8, 0.9), (20, 0.9), (20, 0.3), (12, 1.0), (12, 0.25), (8, 0.5)])
def test_frontier_portfolios_are_stationary(n, cap):
    rng = np.random.default_rng(n)
    x = rng.normal(0.001, 0.03, (20, 60, n)) * rng.uniform(0.5, 2, (20, 1, n)) + rng.normal(0, 0.01, (20, 60, 1))
    mu, cov = x.mean(axis=1), np.stack([o.ledoit_wolf(y) for y in x])
    mu[0, 3] = mu[0, 2]  # equal means
    lines = frontier.trace(mu, cov, cap)
    for k in range(20):
        q, m = cov[k] / np.diag(cov[k]).max(), mu[k] / np.abs(mu[k]).max()
        assert lines.least[k] < lines.count[k] and lines.variances[k].min() == pytest.approx(lines.variances[k, lines.least[k]])
        for j in range(lines.count[k] - 1):
            w = lines.weights[k, j : j + 2].mean(axis=0)
            free, pull = (w > 1e-9) & (w < cap - 1e-9), q @ w
            if free.sum() < 2 or np.ptp(m[free]) < 1e-9:
                continue
            fit = np.stack([m, np.ones(n)], axis=1)
            x, nu = np.linalg.lstsq(fit[free], pull[free], rcond=None)[0]
            left = (pull - x * m - nu) / max(1, abs(x))
            assert np.abs(left[free]).max() < 1e-6 and left[w <= 1e-9].min(initial=0) > -1e-6 and left[w >= cap - 1e-9].max(initial=0) < 1e-6


def test_a_target_that_no_portfolio_has_is_not_met():
    pair, mu = np.array([[0.04, 0.006], [0.006, 0.01]]), np.array([0.02, 0.01])
    lines, of = frontier.trace(mu[None], pair[None], 0.9), np.zeros(3, int)
    assert frontier.most_return(lines, of, np.array([1.0, 1e-6, 0.02]), pair[None], mu[None], 0.9)[1].tolist() == [False, False, True]
    w, met = frontier.least_variance(lines, of, np.array([0.5, -0.5, 0.015]))
    assert met.tolist() == [False, False, True] and np.allclose(w[0], lines.weights[0, lines.least[0]]) and np.allclose(w[2], [0.5, 0.5])
    losing, flagged = frontier.best_ratio(frontier.trace(-mu[None], pair[None], 0.9), 0.0)
    assert flagged[0] and np.allclose(losing[0], lines.weights[0, lines.least[0]])


def capped_by_rounds(values, cap):
    """The rule as stated: whoever is above the cap gets it, the excess goes pro rata to the others, again and again."""
    w = np.array(values) / sum(values)
    for _ in range(5000):
        over = w > cap
        if not over.any():
            break
        excess = (w[over] - cap).sum()
        w[over] = cap
        if w[~over].sum() <= 1e-18:
            return np.full(len(w), 1 / len(w))
        w[~over] += w[~over] / w[~over].sum() * excess
    return np.minimum(w, cap) / np.minimum(w, cap).sum()


@pytest.mark.parametrize("cap", [1.0, 0.9, 0.5, 0.4, 0.3, 0.25, 0.2, 0.1])
def test_capped_weights_against_rounds(spark, cap):
    rng = np.random.default_rng(3)
    sets = [[45, 40, 15], [98, 1, 1], [5], [1, 1], [7, 7, 7, 7, 7], [100, 100, 1, 1, 1], *(rng.pareto(0.5, int(rng.integers(2, 12))).tolist() for _ in range(40))]
    df = spark.createDataFrame([(i, k, float(x)) for i, own in enumerate(sets) for k, x in enumerate(own)], "a int, k int, value double")
    got = {}
    for r in finance.capped_weights(df, ["a"], cap).collect():
        got[r.a, r.k] = r.weight
    for i, own in enumerate(sets):
        assert np.allclose([got[i, k] for k in range(len(own))], capped_by_rounds(own, cap), atol=1e-7), (cap, own)


def test_optimise_over_wallets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rets = [(1, date.fromordinal(730000 + k), t, float(rng.normal(0.001 * (i + 1), 0.02))) for k in range(60) for i, t in enumerate("abc")]
    inputs = o.set_inputs(spark.createDataFrame(rets, "snapshot int, day date, token string, ret double"))
    weights = spark.createDataFrame([(1, f"w{i}", t, w) for i in range(5) for t, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))] + [(1, "single", "a", 1.0)], "snapshot int, address string, token string, weight double")
    got = o.optimise(weights, inputs).collect()
    assert {r.address for r in got} == {f"w{i}" for i in range(5)}
    assert all(not r.fallback_variance for r in got)
    for goal in o.GOALS:
        sums = {}
        for r in got:
            sums[r.address] = sums.get(r.address, 0) + r[f"w_{goal}"]
        assert all(x == pytest.approx(1) for x in sums.values())
    monkeypatch.setattr(o, "GROUP", 2)  # a set that many hold is dealt to several groups
    again = {(r.address, r.token): r for r in o.optimise(weights, inputs).collect()}
    assert len(again) == len(got) and all(again[r.address, r.token][f"w_{goal}"] == pytest.approx(r[f"w_{goal}"]) for r in got for goal in o.GOALS)
    assert finance.l1(weights, weights).agg(F.max("l1")).first()[0] == 0


def test_models(spark):
    rng = np.random.default_rng(10)
    data = [(float(a), float(b_), float(2 + 3 * a - b_ + e), int(i % 4), 2000 + i % 3) for i, (a, b_, e) in enumerate(rng.normal(0, 1, (300, 3)) * [1, 1, 0.1])]
    df = spark.createDataFrame(data, "a double, b double, y double, g int, year int")
    x = np.array([[1, r[0], r[1]] for r in data])
    y = np.array([r[2] for r in data])
    coef, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    got = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    assert np.allclose([got[t].coef for t in ("const", "a", "b")], coef)
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / (len(y) - 3))
    assert np.allclose([got[t].std_error for t in ("const", "a", "b")], error)
    q = {r.term: r.coef for r in stats.quantile_reg(df, "y", ["a", "b"], 0.75).collect()}
    fit = x @ [q["const"], q["a"], q["b"]]
    loss = lambda f: np.where(y >= f, 0.75 * (y - f), 0.25 * (f - y)).sum()
    assert loss(fit) <= min(loss(x @ (np.array([q["const"], q["a"], q["b"]]) + d)) for d in rng.normal(0, 0.02, (200, 3))) + 1e-3
    assert all(r.r2 > 0.9 for r in stats.grouped_cv(df, "y", ["a", "b"], "g", 2).collect() if r.n)
    assert all(r.r2 > 0.9 for r in stats.forward_chain(df, "y", ["a", "b"], "year").collect())
    model, table = stats.forest(df, "y", ["a", "b"], trees=10, depth=5)
    assert {r.feature: r.importance for r in table.collect()}["a"] > 0.6
    drops = {r.feature: r.drop for r in stats.permutation_importance(model, df, "y", ["a", "b"]).collect()}
    assert drops["a"] > drops["b"] > 0
    curve = spark.createDataFrame([("k", n, 80 - 60 * n**-0.75, 1.0) for n in range(1, 40)], "k string, n int, d double, w double")
    p = stats.power_fit(curve, ["k"], "n", "d", "w").first()
    assert (p.b, round(p.a, 6), round(p.c, 6)) == (0.75, 60.0, 80.0) and p.r2 == pytest.approx(1)


def test_the_rest_stands_without_the_corpus_operators():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "tessera").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("tessera.llm", "corpus_pipeline")) for n in names)


def test_segments_equal_plain_windows(spark):
    rng = np.random.default_rng(17)
    hot = [("hot", int(x), int(v)) for x, v in zip(rng.integers(0, 5000, 4000), rng.integers(-50, 50, 4000), strict=True)]
    cold = [(f"k{i % 40}", int(x), int(v)) for i, (x, v) in enumerate(zip(rng.integers(0, 5000, 400), rng.integers(-50, 50, 400), strict=True))]
    flows = spark.createDataFrame(hot + cold, "address string, block int, value long")
    asked = sorted({(k, int(x)) for k in ("hot", "k1", "k2", "none") for x in rng.integers(-10, 5200, 60)})
    pairs = spark.createDataFrame([*asked, *asked[:5]], "address string, block int")
    for width in (7, 1000, 1 << 15):
        got = rows(b.balances_at(flows, pairs, width=width))
        assert got == sorted(((k, x, sum(v for a, t, v in hot + cold if a == k and t <= x)) for k, x in [*asked, *asked[:5]]), key=repr)
        both = b.balances_at(flows.withColumn("one", F.lit(1)), pairs, values={"balance": "value", "n": "one"}, width=width)
        assert {(r.address, r.block): r.n for r in both.collect()} == {(k, x): sum(a == k and t <= x for a, t, _ in hot + cold) for k, x in asked}
    known = {(a, t): i for i, (a, t, _) in enumerate(hot[:900] + cold)}
    right = spark.createDataFrame([(a, t, i) for (a, t), i in known.items()], "address string, t int, v int")
    left = spark.createDataFrame([(*x, i) for i, x in enumerate([*asked, *asked[:9], (None, 5), ("hot", None)])], "address string, block int, id int")
    for width in (3, 500, 1 << 15):
        for forward in (False, True):
            for age in (None, 4):
                got = {r.id: (r.t, r.v) for r in asof.asof_join(left, right, ["address"], "block", "t", age, forward, width).collect()}
                assert len(got) == len(asked) + 11 and got[len(asked) + 9] == got[len(asked) + 10] == (None, None)
                for i, (k, x) in enumerate([*asked, *asked[:9]]):
                    times = [t for a, t in known if a == k and (t >= x if forward else t <= x)]
                    t = (min(times) if forward else max(times)) if times else None
                    t = None if t is None or age is not None and abs(t - x) > age else t
                    assert got[i] == (t, None if t is None else known[k, t])


def test_a_hot_key_is_many_tasks(spark):
    """One address with 10 million flows: no task of the scan holds more than its ranges."""
    flows = spark.range(10_000_000).select(F.lit("hot").alias("address"), F.col("id").cast("int").alias("block"), F.lit(1).cast("long").alias("value"))
    pairs = spark.createDataFrame([("hot", 9_999_999), ("hot", 31), ("cold", 5)], "address string, block int")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = b.balances_at(flows, pairs)
        assert {(r.address, r.block): r.balance for r in found.collect()} == {("hot", 9_999_999): 10_000_000, ("hot", 31): 32, ("cold", 5): 0}
        from tessera.operators.segments import time_range

        ranges = flows.groupBy("address", time_range(F.col("block"), "int").alias("r")).count()
        assert ranges.agg(F.max("count")).first()[0] <= 1 << 15 and ranges.count() > 300
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(address" in plan and all("_range" in line for line in plan.splitlines() if "Window [" in line and "last(" not in line and "sum(value" in line)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sketch_cube_against_exact_cells(spark):
    rng = np.random.default_rng(23)
    data = [(int(i % 2), ["a", "b", "c", None][int(rng.integers(0, 4))], ["x", "y"][int(i % 7 == 0)], float(v), f"w{int(rng.integers(0, 9000))}") for i, v in enumerate(rng.lognormal(3, 2, 30_000))]
    df = spark.createDataFrame([*data, (0, "a", "z", None, None)], "snapshot int, kind string, side string, v double, address string").repartition(6)
    dims, qs = ["snapshot", "kind", "side"], [0.05, 0.25, 0.5, 0.75, 0.95]
    partials = panels.sketch_partials(df, dims, ["v"], ["address"])
    # Partials of parts of the data, put together, serve as well as those of the whole.
    halves = [panels.sketch_partials(df.filter(F.hash("address", "v") % 2 == i), dims, ["v"], ["address"]) for i in (0, 1, -1)]
    exact = panels.cube_panel(df, dims, [F.count("*").alias("n"), F.collect_list("v").alias("vs"), F.countDistinct("address").alias("d")], always=("snapshot",))
    want = {(r.snapshot, r.kind, r.side): r for r in exact.collect()}
    for source in (partials, halves[0].unionByName(halves[1]).unionByName(halves[2])):
        got = {(r.snapshot, r.kind, r.side): r for r in panels.sketch_values(panels.sketch_cube(source, dims, always=("snapshot",)), qs).collect()}
        assert set(got) == set(want) and len(got) > 20
        for cell, r in got.items():
            own = np.sort(want[cell].vs)
            assert r.n == want[cell].n and abs(r.d_address - want[cell].d) <= max(2, 0.04 * want[cell].d)
            if not len(own):
                assert r.q_v is None
                continue
            for q, v in zip(qs, r.q_v, strict=True):
                low, high = np.searchsorted(own, v, "left") / len(own), np.searchsorted(own, v, "right") / len(own)
                assert low - 0.012 - 1 / len(own) <= q <= high + 0.012 + 1 / len(own)


def test_quantile_regression_reaches_the_vertex(spark):
    rng = np.random.default_rng(29)
    for trial in range(120):  # against all fits through as many rows as there are terms
        p, n, q = int(rng.integers(1, 4)), int(rng.integers(4, 13)), float(rng.choice([0.1, 0.25, 0.5, 0.9]))
        x = np.column_stack([np.ones(n), *rng.normal(size=(p - 1, n))])
        y, w = rng.normal(size=n) if trial % 2 else np.round(rng.normal(size=n)), rng.choice([1.0, 2.0, 3.0], n)
        loss = lambda b: (w * np.where(y >= x @ b, q * (y - x @ b), (q - 1) * (y - x @ b))).sum()  # noqa: B023, E731
        assert loss(stats.vertex(x, y, w, q, np.zeros(p))) <= min(loss(np.linalg.solve(x[list(c)], y[list(c)])) for c in itertools.combinations(range(n), p)) + 1e-8
    n = 60_000
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.integers(0, 3, n)])
    y = x @ [1, 2, -1] + rng.standard_t(2, n) * (1 + x[:, 2])
    df = spark.createDataFrame(np.column_stack([x, y]).tolist(), "const double, a double, b double, y double").repartition(4).cache()
    for q in (0.5, 0.9):
        want = stats.vertex(x, y, np.ones(n), q, np.zeros(3))
        for band in (100_000, 6_000, 800):  # all rows, a band of them, and a band that is sampled first
            found, settled, passes = stats.quantile_coefficients(df, ["const", "a", "b"], "y", q, n, band)
            assert settled and found == pytest.approx(want, abs=1e-7) and passes <= {100_000: 1, 6_000: 8, 800: 40}[band]


def test_optimise_ships_no_covariance(spark):
    """What is shuffled and written on the way to optimal portfolios is wallets and returns: no frontier, and no series on a set's row; two rates come from one pass."""
    rng = np.random.default_rng(9)
    rets = [(1, date.fromordinal(730000 + k), t, float(rng.normal(0.001 * (i + 1), 0.02))) for k in range(60) for i, t in enumerate("abc")]
    inputs = o.set_inputs(spark.createDataFrame(rets, "snapshot int, day date, token string, ret double"))
    weights = spark.createDataFrame([(1, f"w{i}", t, w) for i in range(5) for t, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))], "snapshot int, address string, token string, weight double")
    both = o.optimise(weights, inputs, goals=("sharpe",), other_rf=1e-4)
    text = both._jdf.queryExecution().executedPlan().toString()
    assert "corners" not in text and "cov#" not in text and text.count("FlatMapCoGroupsInPandas") == 1
    again = {(r.address, r.token): r.w_sharpe for r in o.optimise(weights, inputs, rf=1e-4, goals=("sharpe",)).collect()}
    assert all(again[r.address, r.token] == pytest.approx(r.w_other) for r in both.collect()) and len(again) == 15


def test_runs_dealt_by_a_part_of_the_key_are_not_dealt_again(spark):
    """Both ways of comparing runs agree on repeated keys, nulls in key and value and rows of one run alone; j13 shuffles no wallet."""
    from tessera.operators import panels
    from tessera.plans import QUERIES

    kind = "s int, a string, v double"
    x = spark.createDataFrame([(1, "p", 1.0), (2, "p", 5.0), (2, "p", 9.0), (1, "q", None), (None, "q", 80.0), (3, None, 70.0), (7, "r", 60.0)], kind)
    y = spark.createDataFrame([(1, "p", 1.5), (2, "p", 4.0), (2, "p", 8.0), (1, "q", 3.0), (None, "q", 1.0), (3, None, 1.0), (8, "r", 1.0), (1, "t", 1.0)], kind)
    got = [panels.compare_runs(x, y, ["s", "a"], ["v"], deal).first().asDict() for deal in (None, "a")]
    assert got == [{"n": 6, "max_v": 5.0}] * 2
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["j13_compare_runs"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan


def test_values_in_millionths_fold_as_decimals_do(spark):
    amounts = ["5", "7", "9007199254740993", "0.5", "123456789012345678901", "3.123456789", "4503599627370495", "0.0000000004", "1000000"]
    rows = spark.createDataFrame([(t, f"C{i}", 1, a) for i, a in enumerate(amounts) for t in "abcd"], "token string, address string, snapshot int, balance string").withColumn("balance", F.col("balance").cast("decimal(38,10)"))
    at = spark.createDataFrame([("a", 1, 1234.567891), ("b", 1, 0.000001), ("c", 1, 9.9e14)], "token string, snapshot int, close double")
    parts = b.priced_in_parts(rows, at)
    assert parts.filter("millionths IS NOT NULL AND value IS NOT NULL").isEmpty()
    assert {"C0", "C1", "C8"} <= {r.address for r in parts.filter("token = 'a' AND millionths IS NOT NULL").collect()}  # these make no decimal
    want, got = (sorted(map(tuple, positions.fold_assets(p, {"b": "a", "d": "c"}).select("address", "token", "units", "value").collect()), key=str) for p in (b.priced(rows, at), parts))
    assert got == want and len(got) == 2 * len(amounts)


def test_closes_compare_by_all_columns_only_the_last_orders_lines(spark, tmp_path):
    fields = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    day = datetime(1995, 3, 1)
    lines = [(9, 1, 1, 1, 2.0, 10.0, 0.0, 0.0, "N", "O", day), (9, 1, 1, 2, 2.0, 12.0, 0.0, 0.0, "N", "O", day), (9, 1, 1, 2, 2.0, 14.0, 0.0, 0.0, "N", "O", day), (5, 1, 1, 7, 1.0, 99.0, 0.0, 0.0, "N", "O", day), (None, 2, 1, 1, 1.0, 3.0, 0.0, 0.0, "N", "O", day), (None, 2, 1, 2, 1.0, 4.0, 0.0, 0.0, "N", "O", day), (3, 3, 1, 1, 1.0, 8.0, 0.0, 0.0, "N", "O", None)]
    spark.createDataFrame(lines, fields).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = domain.closes(spark, str(tmp_path))
    assert rows(found) == sorted([("a", day.date(), 7.0), ("b", day.date(), 4.0), (None, None, 8.0)], key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan  # the sort sees the last orders' lines alone


def test_sets_of_one_size_share_their_sums(monkeypatch):
    """Sets' estimates are those of each set alone, with gaps, too few days and eigenvalues at their floor; and neither they nor a frontier's steps solve anything for each set."""
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.03, (60, 7)) + rng.normal(0, 0.01, (60, 1))
    x[3:8, 2], x[10:40, 4], x[:, 5] = np.nan, np.nan, x[:, 0] * 1e-5
    sets = np.array([[0, 1, 3], [0, 2, 3], [1, 4, 6], [0, 5, 6], [1, 2, 6], [0, 1, 5]])
    want = [o.estimates(x[:, s], 45, 0.5) for s in sets]
    for many in (1024, 4):  # all tokens' products at once, and those of a few sets
        monkeypatch.setattr(o, "TOKENS", many)
        known, mu, cov = o.set_estimates(x, sets, 45, 0.5)
        assert known.tolist() == [e is not None for e in want] == [True, True, False, True, True, True]
        assert np.allclose(mu, [e[0] for e in want if e], atol=1e-15) and np.allclose(cov, [e[1] for e in want if e], atol=1e-14)
    y = rng.normal(0.001, 0.03, (60, 12))
    monkeypatch.setattr(np.linalg, "solve", None)
    monkeypatch.setattr(np.linalg, "eigh", None)
    known, mu, cov = o.set_estimates(y, np.array([rng.choice(12, 6, replace=False) for _ in range(40)]), 45, 0.5)
    whole = frontier.trace(mu, cov, 0.9)
    half, part = frontier.trace(mu, cov, 0.9, np.full(40, np.inf)), frontier.trace(mu, cov, 0.9, mu.mean(axis=1))
    assert known.all() and (half.count == whole.least + 1).all() and (half.least == whole.least).all() and (part.count <= whole.count).all()
    for k in range(40):
        for lines in (half, part):
            assert np.allclose(lines.weights[k, : lines.count[k]], whole.weights[k, : lines.count[k]], atol=1e-12)
        assert part.returns[k, part.count[k] - 1] <= max(mu[k].mean(), part.returns[k, part.least[k]])
        assert frontier.best_ratio(half, 0.0)[0][k] == pytest.approx(frontier.best_ratio(whole, 0.0)[0][k])
    own = np.arange(40)
    assert np.allclose(frontier.least_variance(part, own, mu.mean(axis=1))[0], frontier.least_variance(whole, own, mu.mean(axis=1))[0], atol=1e-10)


def test_pivots_keep_to_the_covariances(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0.001, 0.03, (30, 60, 25)) * rng.uniform(0.2, 3, (30, 1, 25))
    mu, cov = x.mean(axis=1), np.stack([o.ledoit_wolf(y) for y in x])
    far = frontier.trace(mu, cov, 0.4)
    monkeypatch.setattr(frontier, "RENEW", 1)  # tableaus made anew at each step
    near = frontier.trace(mu, cov, 0.4)
    assert (far.count == near.count).all() and np.allclose(far.weights, near.weights, atol=1e-9)


def test_rows_of_wallets_are_made_where_their_portfolios_are(spark):
    """Capped shares, distances, moves and outcomes of wallets are those that follow from their positions."""
    rng = np.random.default_rng(12)
    tokens = "abcdef"
    rets = [(1, date.fromordinal(730000 + k), t, float(rng.normal(0.001 * (i + 1), 0.02))) for k in range(60) for i, t in enumerate(tokens)]
    inputs = o.set_inputs(spark.createDataFrame(rets, "snapshot int, day date, token string, ret double"))
    more = spark.createDataFrame([(t, 1.0 + 0.1 * i if t != "f" else None, 0.5 * i if t != "b" else None, 10.0 * (i + 1) if t != "c" else None) for i, t in enumerate(tokens)], "token string, growth double, beta double, capital double")
    values = [(1, f"w{i}", t, float(rng.pareto(0.4) + 0.01)) for i in range(40) for t in rng.choice(list(tokens), int(rng.integers(1, 7)), replace=False)]
    values = spark.createDataFrame(values + [(2, "unknown", t, 1.0) for t in "ab"] + [(1, "priceless", t, 1.0) for t in "az"], "snapshot int, address string, token string, value double")
    every = values.groupBy("snapshot", "address").agg(F.count("*").alias("n")).filter("n > 1 AND snapshot = 1 AND address <> 'priceless'").count()
    for cap in (0.9, 0.4):
        rows = {(r.address, r.token): r for r in o.optimise(values, inputs, cap).collect()}
        want = {(r.address, r.token): r.weight for r in finance.capped_weights(values, ["snapshot", "address"], cap).collect()}
        assert len({a for a, _ in rows}) == every and all(r.weight == pytest.approx(want[k], abs=1e-12) for k, r in rows.items())
    rows = o.optimise(values, inputs, other_rf=1e-3).persist()
    gap = lambda a, b: F.sum(F.abs(F.col(a) - F.col(b)))
    want = {r.address: r for r in rows.groupBy("address").agg(*[gap("weight", f"w_{g}").alias(f"l1_{g}") for g in o.GOALS], gap("w_sharpe", "w_other").alias("l1")).collect()}
    far, moved = o.optimise(values, inputs, kind="distances").collect(), o.optimise(values, inputs, goals=("sharpe",), other_rf=1e-3, kind="moves").collect()
    assert len(far) == len(moved) == every
    assert all(r[f"l1_{g}"] == pytest.approx(want[r.address][f"l1_{g}"], abs=1e-9) for r in far for g in o.GOALS) and all(r.l1 == pytest.approx(want[r.address].l1, abs=1e-9) for r in moved)
    got = {r.address: r for r in o.optimise(values, inputs.join(more, "token", "left"), kind="outcomes").collect()}
    joined = rows.join(values, ["snapshot", "address", "token"]).withColumnsRenamed({"weight": "w_base"}).withColumn("weight", F.col("w_base")).join(more, "token").withColumnRenamed("capital", "cap")
    joined = finance.naive_weights(finance.naive_weights(joined, ["address"], "equal").withColumnRenamed("weight", "w_equal"), ["address"], "cap").withColumnRenamed("weight", "w_mcap").withColumn("weight", F.col("w_base"))
    names = ["base", *o.GOALS, "equal", "mcap"]
    ends = more.select(F.lit(1).alias("snapshot"), "token", F.lit(1.0).alias("p0"), F.col("growth").alias("p1"))
    for r in finance.strategy_outcomes(joined, ends, more.withColumn("snapshot", F.lit(1)), names).collect():
        for c in ("total", *(f"{k}_{x}" for k in ("ret", "l1", "beta") for x in names)):
            assert got[r.address][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-9)), (r.address, c)
    rows.unpersist()
