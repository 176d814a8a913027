"""The domain views as DuckDB common table expressions."""

from __future__ import annotations

from tessera.sources.domain import BENCHMARKS, CASH, DERIVATIVE, NATIVE, QUARTERS, WRAPPED, WRAPPER, block_of


def names(tokens) -> str:
    return ", ".join(f"'{t}'" for t in tokens)


CTES = {
    "transfers": """SELECT p_brand AS token, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS block, l_shipdate::DATE AS day,
      CASE WHEN l_returnflag = 'N' THEN 'S' || l_suppkey WHEN l_returnflag = 'R' THEN 'C' || o_custkey WHEN l_linestatus <> 'F' THEN 'S' || l_suppkey END AS sender,
      CASE WHEN l_returnflag = 'N' THEN 'C' || o_custkey WHEN l_returnflag = 'R' AND l_linestatus <> 'F' THEN 'S' || l_suppkey WHEN l_returnflag = 'A' THEN 'C' || o_custkey END AS recipient,
      l_quantity::DECIMAL(18,0) AS value, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'mint' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'burn' ELSE 'transfer' END AS kind, l_orderkey, l_linenumber
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "flows": "SELECT token, block, sender AS address, -value AS value FROM transfers WHERE sender IS NOT NULL UNION ALL SELECT token, block, recipient, value FROM transfers WHERE recipient IS NOT NULL",
    "quarters": "SELECT unnest([" + ", ".join(f"DATE '{q}'" for q in QUARTERS) + "]) AS day",
    "snaps": "SELECT unnest([" + ", ".join(str(block_of(q)) for q in QUARTERS) + "]) AS snapshot",
    "summed": "SELECT token, address, block, sum(value) AS value FROM flows GROUP BY ALL",
    "balances": "SELECT token, address, snapshot, sum(value) AS balance FROM summed JOIN snaps ON block <= snapshot GROUP BY ALL HAVING sum(value) <> 0",
    "prices": """SELECT p_brand AS token, l_shipdate::DATE AS day, arg_max(round(l_extendedprice / l_quantity, 6), (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)) AS close
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "contracts": "SELECT 'C' || c_custkey AS address FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "spot": "SELECT s.snapshot, t.token, (SELECT arg_max(close, day) FROM prices p WHERE p.token = t.token AND p.day <= DATE '1995-01-01' + s.snapshot::INTEGER) AS price FROM snaps s, (SELECT DISTINCT token FROM prices) t",
    "positions": "SELECT b.snapshot, b.address, b.token, b.balance::DOUBLE AS balance, b.balance::DECIMAL(18,0) * s.price::DECIMAL(18,6) AS value FROM balances b LEFT JOIN spot s ON s.snapshot = b.snapshot AND s.token = b.token WHERE b.balance > 0",
    "accounts": "SELECT snapshot, address, round(sum(value), 2)::DOUBLE AS total_value, count(*) AS num_tokens FROM positions GROUP BY ALL",
    "folded": f"SELECT snapshot, address, CASE WHEN token = '{WRAPPED}' THEN '{NATIVE}' ELSE token END AS token, sum(balance) AS units, sum(value)::DOUBLE AS value FROM positions GROUP BY ALL",
    "typed": "SELECT a.*, CASE WHEN c.address IS NULL THEN 'EOA' ELSE 'CA' END AS type FROM accounts a LEFT JOIN contracts c USING (address)",
    "daily": "SELECT event_type AS token, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL",
    "cash": f"SELECT unnest([{names(CASH)}]) AS token",
}
NEEDS = {
    "flows": ["transfers"], "summed": ["flows"], "balances": ["summed", "snaps"], "spot": ["snaps", "prices"], "positions": ["balances", "spot"],
    "accounts": ["positions"], "folded": ["positions"], "typed": ["accounts", "contracts"],
}
LISTS = {"cash": CASH, "derivative": DERIVATIVE, "wrapper": WRAPPER, "benchmarks": BENCHMARKS}


def sql(needs: str, body: str, more: dict[str, str] | None = None) -> str:
    """A query over the named views and those that they need; more views may follow."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    views = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({x})" for n, x in (more or {}).items()]
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
