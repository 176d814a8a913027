"""Reading and writing tables: partitioned and drifting datasets, side tables, manifests, keyed upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """df, written in buckets by key and read again."""
    from tessera.sources.states import write_clustered

    return df.sparkSession.table(write_clustered(df, key, (), count, name))


_STORED: dict[tuple[str, str, str], tuple[list[str], DataFrame]] = {}
_STORING = RLock()


#: Ledger rows of a bucket, about: what a task makes of them, over all snapshots, fits in its memory.
PER_BUCKET = 1 << 16


def buckets(spark: SparkSession, source: str, grows: str = "lineitem") -> int:
    """Buckets of a source's shared tables, by the rows of its ledger (which Parquet's footers give)."""
    return 8 + spark.read.parquet(f"{source}/{grows}.parquet").count() // PER_BUCKET


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], grows: str = "lineitem", by: str | None = None) -> DataFrame:
    """A table that many queries share, built once for each session and source and read from the shared folder.

    With by it is bucketed by that column, so that joins and aggregations by it, alone or among other keys, need no shuffle.
    It is built anew once the source's ledger has other files than it was built from. Files that are written over in place
    under their old names are not noticed: drop_stored() then forgets what was built.
    """
    key, files = (spark.sparkContext.applicationId, source, name), sorted(spark.read.parquet(f"{source}/{grows}.parquet").inputFiles())
    with _STORING:
        if key not in _STORED or _STORED[key][0] != files:
            _STORED[key] = files, clustered(build(), by, buckets(spark, source, grows), name) if by else saved(build(), name)
        return _STORED[key][1]


def drop_stored(source: str | None = None) -> None:
    """Forget the shared tables of a source, or of all; they are built again when next asked for."""
    with _STORING:
        for key in [k for k in _STORED if source is None or k[1] == source]:
            del _STORED[key]


def read_dataset(spark: SparkSession, root: str) -> DataFrame:
    """A Parquet file or a directory whose key=value folders become columns."""
    return spark.read.parquet(root)


def read_drifting(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with unlike schemas as one table; a column that a file lacks is null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Logical names from the first candidate column that is there; none gives null."""
    there = set(df.columns)
    picked = {name: next((c for c in options if c in there), None) for name, options in candidates.items()}
    return df.select(*[(F.col(c) if c else F.lit(None)).alias(name) for name, c in picked.items()])


def file_ranges(df: DataFrame, col: str) -> DataFrame:
    """file, least, greatest value of a column, and rows."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n"))


def duplicate_rows(df: DataFrame, part: list[str], key: list[str]) -> DataFrame:
    """part, rows, distinct keys, and whether some rows repeat."""
    rows = df.groupBy(*part, *[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.count("*").alias("_n"))
    out = rows.groupBy(*part).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"))
    return out.withColumn("repeated", F.col("n_rows") > F.col("n_keys"))


def read_prices(spark: SparkSession, folder: str, pattern: str = r"([^/]+)_price\.csv$") -> DataFrame:
    """token, date, close from CSV files whose path names the token; the first row of a date counts."""
    rows = spark.read.option("header", "true").option("recursiveFileLookup", "true").schema("date string, daily_close_usd double").csv(folder)
    name = F.url_decode(F.url_decode(F.regexp_extract(F.input_file_name(), pattern, 1)))  # Spark escapes the folder's name, and the path again
    rows = rows.select(name.alias("token"), F.to_date(F.substring("date", 1, 10)).alias("date"), F.col("daily_close_usd").alias("close"), F.monotonically_increasing_id().alias("_n"))
    return rows.groupBy("token", "date").agg(F.min_by("close", "_n").alias("close"))


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """address, line: one row per address found in text lines of any delimiter, header or none; the last line of an address counts."""
    rows = spark.read.text(path).select(F.lower(F.regexp_extract(F.lower("value"), "0x[0-9a-f]{40}", 0)).alias("address"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_n"))
    return rows.filter("address <> ''").groupBy("address").agg(F.max_by("line", "_n").alias("line"))


def expand_map(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """A JSON map column as one column per key."""
    parsed = F.from_json(F.col(col), "map<string,string>")
    return df.withColumn("_m", parsed).select("*", *[F.try_element_at("_m", F.lit(k)).alias(k.replace("-", "_")) for k in keys]).drop("_m", col)


def write_by_snapshot(df: DataFrame, root: str, key: str = "block_number") -> DataFrame:
    """Write one folder per snapshot, count the rows again, and return the counts; a count that differs raises."""
    wanted = df.groupBy(key).agg(F.count("*").alias("n"))
    df.repartition(F.col(key), F.pmod(F.xxhash64(*[c for c in df.columns if c != key][:1]), F.lit(16))).write.partitionBy(key).parquet(root)
    written = df.sparkSession.read.parquet(root).groupBy(key).agg(F.count("*").alias("n"))
    bad = wanted.join(written.withColumnRenamed("n", "m"), key, "full_outer").filter(~F.col("n").eqNullSafe(F.col("m"))).limit(1).count()
    if bad:
        raise ValueError(f"{root} does not hold the rows that were written")
    return written


def write_bucketed(df: DataFrame, root: str, n: int, key: str = "address", order: tuple[str, ...] = ("block", "log_index")) -> None:
    """n hash buckets by key, each sorted by key and order, so that a scan for one key reads few row groups."""
    bucket = F.pmod(F.xxhash64(key), F.lit(n))
    df.withColumn("bucket", bucket).repartition(n, "bucket").sortWithinPartitions("bucket", key, *order).write.partitionBy("bucket").parquet(root)


def overlapping_blocks(source: DataFrame, manifest: DataFrame, tag: str, key: str = "block_number") -> DataFrame:
    """Blocks of a source that another tag of the manifest owns."""
    owned = manifest.filter(F.col("source_tag") != tag).select(key)
    return source.select(key).distinct().join(owned, key, "left_semi")


def upsert_manifest(old: DataFrame, new: DataFrame, tag: str, key: str = "block_number") -> DataFrame:
    """The manifest with the rows of one tag replaced, by block."""
    return old.filter(F.col("source_tag") != tag).unionByName(new.withColumn("source_tag", F.lit(tag)), allowMissingColumns=True).orderBy(key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, a new one replacing the old one of its keys."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy(*keys).orderBy(F.desc("_v"))
    return both.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_v")


def pending_keys(todo: DataFrame, outputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that not every output holds."""
    done = outputs[0].select(*keys)
    for other in outputs[1:]:
        done = done.intersect(other.select(*keys))
    return todo.select(*keys).distinct().join(done.distinct(), keys, "left_anti")


def parsed_or_null(value: Column) -> tuple[Column, Column]:
    """(value as decimal(38,0), whether it could not be parsed)."""
    out = F.trim(value).try_cast("decimal(38,0)")
    return out, value.isNotNull() & out.isNull()
