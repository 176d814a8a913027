"""Ledgers stored by block range, scans that skip files, states that grow by snapshot, and tables bucketed for joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import shared_path


def write_ranged(df: DataFrame, root: str, col: str, files: int) -> DataFrame:
    """Append rows as files of narrow, sorted ranges of a column, and return the index of all files under root."""
    df.repartitionByRange(files, col).sortWithinPartitions(col).write.mode("append").parquet(root)
    return range_index(df.sparkSession, root, col)


def range_index(spark: SparkSession, root: str, col: str) -> DataFrame:
    """file, lo, hi, n: least and greatest value of a column and rows of each file; only that column is read. The index is written and read again."""
    rows = spark.read.parquet(root).select(F.col(col), F.col("_metadata.file_path").alias("file"))
    index = rows.groupBy("file").agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n"))
    path = shared_path(spark, "index")
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def overlapping(index: DataFrame, low: int | None, high: int | None) -> list[str]:
    """Files that may hold a value from low to high. The list goes through the driver, as any scan's list of files does."""
    some = F.lit(True) if low is None else F.col("hi") >= low
    some = some if high is None else some & (F.col("lo") <= high)
    # A path of the file metadata is escaped; a reader wants it plain.
    plain = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    return [r[0] for r in index.filter(some).select(plain).sort("lo", plain).collect()]


def scan_range(spark: SparkSession, root: str, index: DataFrame, col: str, low: int | None, high: int | None) -> DataFrame:
    """Rows of a ranged table whose column is from low to high, read from the files that overlap; null bounds are open."""
    files, schema = overlapping(index, low, high), spark.read.parquet(root).schema
    rows = spark.read.schema(schema).option("basePath", root).parquet(*files) if files else spark.createDataFrame([], schema)
    rows = rows if low is None else rows.filter(F.col(col) >= low)
    return rows if high is None else rows.filter(F.col(col) <= high)


class States:
    """Balances of snapshots in folders block_number=N under root, and a manifest of what each was made from.

    A snapshot is made from the last one stored before it and the flows of the blocks between them, so adding one reads only
    files with later blocks. Folders are written one by one: a lost one is made again, alone, from the one before it.
    """

    def __init__(self, spark: SparkSession, root: str, tag: str, keys: tuple[str, ...] = ("token", "address")):
        self.spark, self.tag, self.keys = spark, tag, keys
        self.path, self.log = f"{root.rstrip('/')}/state", f"{root.rstrip('/')}/manifest"

    def _read(self, path: str, schema: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:  # nothing is written yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """block_number, source_tag, n_rows, base, version: the last entry of each snapshot."""
        rows = self._read(self.log, "block_number int, source_tag string, n_rows long, base int, version long")
        last = F.max_by(F.struct(*rows.columns[1:]), "version").alias("x")
        return rows.groupBy("block_number").agg(last).select("block_number", "x.*")

    def stored(self) -> dict[int, int]:
        """Snapshots that the manifest has and whose folders hold all their rows, with those rows."""
        there = self._read(self.path, "token string, block_number int").groupBy("block_number").agg(F.count("*").alias("m"))
        rows = self.manifest().join(there, "block_number", "left").filter(F.coalesce("m", F.lit(0)) == F.col("n_rows"))
        return {r.block_number: r.n_rows for r in rows.collect()}  # one row a snapshot

    def state(self, snapshots: list[int]) -> DataFrame:
        """keys, snapshot, balance of stored snapshots; only their folders are read."""
        kinds = ", ".join(f"{k} string" for k in self.keys)
        rows = self._read(self.path, f"{kinds}, balance decimal(38,0), block_number int").filter(F.col("block_number").isin(snapshots))
        return rows.select(*self.keys, F.col("block_number").alias("snapshot"), "balance")

    def advance(self, ledger: str, index: DataFrame, snapshots: list[int]) -> list[dict]:
        """Make the snapshots that are not stored; returns, for each run of them, its base, its snapshots and the files of flows read.

        ledger is a table written by write_ranged() with the keys, block and value. A snapshot that another tag owns raises.
        """
        from tessera.operators.balances import balances
        from tessera.sources.tables import overlapping_blocks

        wanted = self.spark.createDataFrame([(b,) for b in snapshots], "block_number int")
        if owned := [r[0] for r in overlapping_blocks(wanted, self.manifest(), self.tag).collect()]:
            raise ValueError(f"snapshots of another source: {sorted(owned)}")
        have, made = sorted(self.stored()), []
        todo = sorted(set(snapshots) - set(have))
        while todo:
            base = max((b for b in have if b < todo[0]), default=None)
            after = min((b for b in have if b > todo[0]), default=None)
            run = [b for b in todo if after is None or b < after]
            todo = todo[len(run) :]
            low = None if base is None else base + 1
            flows = scan_range(self.spark, ledger, index, "block", low, run[-1]).select(*self.keys, "block", "value")
            files = overlapping(index, low, run[-1])
            if base is not None:
                flows = flows.unionByName(self.state([base]).select(*self.keys, F.lit(base).alias("block"), F.col("balance").alias("value")))
            rows = balances(flows, run, self.keys).withColumnRenamed("snapshot", "block_number")
            # Folders of this run alone are replaced; AQE cuts a large one into several files.
            rows.hint("rebalance", "block_number").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_number").parquet(self.path)
            counts = self._read(self.path, "token string, block_number int").filter(F.col("block_number").isin(run)).groupBy("block_number").agg(F.count("*").alias("n"))
            entries = self.spark.createDataFrame([(b, base) for b in run], "block_number int, base int").join(counts, "block_number", "left")
            version = (self._read(self.log, "version long").agg(F.max("version")).first()[0] or 0) + 1
            entries.select("block_number", F.lit(self.tag).alias("source_tag"), F.coalesce("n", F.lit(0)).alias("n_rows"), "base", F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(self.log)
            have = sorted({*have, *run})
            made.append({"base": base, "snapshots": run, "files": files})
        return made


def write_clustered(df: DataFrame, key: str, order: tuple[str, ...], buckets: int, name: str = "clustered") -> str:
    """Write a table bucketed by key and sorted within its buckets, and return its name in the catalogue.

    Joins and aggregations by the key read it without a shuffle: only the other side is dealt. Its files lie in the shared folder.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # One task writes one bucket, so a bucket is one sorted file.
    dealt = df.repartition(buckets, key)
    dealt.write.option("path", shared_path(spark, name)).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return table
