"""Range scans, states that grow, and bucketed joins: what is read, what is shuffled, and equality with plain work."""

import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import balances as b
from tessera.sources import states


@pytest.fixture(scope="module")
def flows(spark):
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.col("id") % 3).alias("token"), F.concat(F.lit("a"), F.col("id") * 7 % 41).alias("address"), (F.col("id") / 4).cast("int").alias("block"), (F.col("id") * 31 % 17 - 8).cast("decimal(38,0)").alias("value"))
    return rows.cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_a_range_scan_reads_the_files_that_overlap(spark, flows, tmp_path):
    root = str(tmp_path / "with space+plus")
    index = states.write_ranged(flows, root, "block", 10)
    every = {r.file: (r.lo, r.hi) for r in index.collect()}
    assert len(every) == 10 and sum(r.n for r in index.collect()) == 4000
    for low, high in ((100, 199), (0, 0), (None, 350), (990, None), (None, None)):
        found = states.scan_range(spark, root, index, "block", low, high)
        wanted = {f for f, (lo, hi) in every.items() if (low is None or hi >= low) and (high is None or lo <= high)}
        assert {pathlib.Path(f).name for f in found.inputFiles()} == {pathlib.Path(f).name for f in wanted} and (low is None or len(wanted) < 10)
        assert rows(found) == rows(flows.filter((F.col("block") >= (low if low is not None else -1)) & (F.col("block") <= (high if high is not None else 10**6))))
    assert states.scan_range(spark, root, index, "block", 5000, 6000).count() == 0
    more = states.write_ranged(flows.withColumn("block", F.col("block") + 5000), root, "block", 2)
    assert more.count() == 12 and states.scan_range(spark, root, more, "block", 5000, 6000).count() == 4000


def test_states_grow_by_snapshot(spark, flows, tmp_path):
    ledger, root = str(tmp_path / "ledger"), str(tmp_path / "store")
    index = states.write_ranged(flows, ledger, "block", 20)
    store = states.States(spark, root, "a")
    assert store.stored() == {} and store.state([1]).count() == 0
    snaps = [99, 299, 499, 699]
    full = rows(b.balances(flows, [*snaps, 899]))
    first = store.advance(ledger, index, snaps)
    assert [(m["base"], m["snapshots"]) for m in first] == [(None, snaps)] and store.advance(ledger, index, snaps) == []
    added = store.advance(ledger, index, [*snaps, 899])
    assert [(m["base"], m["snapshots"]) for m in added] == [(699, [899])]
    later = {r.file for r in index.filter("hi > 699 AND lo <= 899").collect()}
    assert {pathlib.Path(f).name for f in added[0]["files"]} == {pathlib.Path(f).name for f in later} and len(later) < 8
    assert rows(store.state([*snaps, 899])) == full
    # A lost folder is made again from the one before it, and nothing else is written.
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/state").rglob("*.parquet") if "=499" not in str(p)}
    shutil.rmtree(tmp_path / "store/state/block_number=499")
    spark.catalog.refreshByPath(f"{root}/state")
    assert set(store.stored()) == {99, 299, 699, 899}
    again = store.advance(ledger, index, [*snaps, 899])
    assert [(m["base"], m["snapshots"]) for m in again] == [(299, [499])] and {p: p.stat().st_mtime_ns for p in kept} == kept
    assert rows(store.state([*snaps, 899])) == full and store.manifest().count() == 5
    with pytest.raises(ValueError, match="another source"):
        states.States(spark, root, "b").advance(ledger, index, [899])


def exchanges_above(plan, scan):
    """Lines of a physical plan with an exchange on the way from a scan of a table to the root."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if scan in line and "FileScan" in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            if "Exchange" in line:
                found.append(line.strip())
    return found


def test_bucketed_flows_meet_wallets_without_a_shuffle(spark, flows, tmp_path):
    table = states.write_clustered(flows.withColumn("log_index", F.lit(0)), "address", ("block",), 4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = spark.table(table)
        assert rows(back.drop("log_index")) == rows(flows)
        # Within a file, rows are in order of address and block.
        placed = back.select("address", "block", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
        by_file = {}
        for r in sorted(placed, key=lambda r: (r.f, r.i)):
            by_file.setdefault(r.f, []).append((r.address, r.block))
        assert len(by_file) == 4 and all(x == sorted(x) for x in by_file.values())
        assert sum(len({a for a, _ in x}) for x in by_file.values()) == 41  # an address lies in one bucket
        wallets = flows.select("address").distinct().withColumn("kind", F.length("address"))
        met = back.join(wallets, "address").groupBy("address", "kind").agg(F.sum("value").alias("net"))
        met.collect()
        assert exchanges_above(met._jdf.queryExecution().executedPlan().toString(), table) == []
        assert rows(met) == rows(flows.join(wallets, "address").groupBy("address", "kind").agg(F.sum("value").alias("net")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql(f"DROP TABLE {table}")
