"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule is the golden-ratio point k * 2654435769 mod 2^32. Mapped through the cumulative quotas
of the sources it gives the slot's source; a source's slots are ranked, and the r-th takes block r, modulo the
source's number of blocks, of that source's documents in shuffled order, cut into blocks of equal tokens.

A source's stream is laid out with sums over hash ranges of its documents, and slots are ranked within runs of
slots, so no step needs all rows of a source in one task. One row per source is the only single-task table.

Null text has no words and is never taken. A null source is a source of its own, last in order. Repeated rows
are placed apart and may be taken unlike often; the result as a whole is the same at each run. Ties of a document's hash are
broken by key and size. An empty table gives an empty one. ``mix`` reads key, text and source alone; ``copies`` keeps every
column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh, saved

#: Fixed values of the mix: weights by rank of source, share of all sizes, greatest repeat.
WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2
#: Tokens of a block at most; a source has at least so many blocks, or one for each token.
BLOCK, LEAST_BLOCKS = 256, 1024
#: Documents in a range of hashes, in expectation; slots of a run; cells of the unit interval.
RANGE, RUN, CELLS = 4096, 1 << 14, 1024
GOLDEN, WHOLE = 2654435769, 1 << 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """(s, source, source_size, n_ranges, target, width, n_blocks, quota, below, total): a row per source.

    A target is min(repeat * size, level * weight); the level is the greatest that any prefix of the sources, ordered
    by when they fill up, leaves for the rest. quota counts slots in millionths.
    """
    everything = W.partitionBy()
    by = W.orderBy(F.col("source").asc_nulls_last())
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / RANGE).alias("n_ranges"))
    rows = rows.withColumn("s", F.row_number().over(by) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("s") % len(weights) + 1))
    filling = W.orderBy(F.col("source_size") * repeat / F.col("weight"), "s").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(filling), F.lit(0)) * repeat
    rows = rows.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))))
    rows = rows.withColumn("target", F.least((F.col("source_size") * repeat).cast("double"), F.max("level").over(everything) * F.col("weight")))
    rows = rows.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    rows = rows.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long"))
    rows = rows.withColumn("quota", F.floor(F.col("target") / F.col("width") * 1_000_000).cast("long"))
    rows = rows.withColumn("below", F.sum("quota").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0)) - F.col("quota"))
    return rows.withColumn("total", F.sum("quota").over(everything)).drop("weight", "level")


def schedule(sources: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """(slot, s, rank, block): the mix in order; sources is the table of targets()."""
    spark = sources.sparkSession
    total = sources.agg(F.max("total")).first()[0] or 0
    slots = spark.range(-(-total // 1_000_000)).withColumnRenamed("id", "slot")
    low, high = F.col("slot") % 65536, F.floor(F.col("slot") / 65536) % 65536
    slots = slots.withColumn("point", (low * GOLDEN + high * GOLDEN % 65536 * 65536) % WHOLE)

    def bound(quota: Column) -> Column:
        return F.floor(quota.cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)") / F.col("total").cast("decimal(20,0)")).cast("long")

    ranges = sources.filter("quota > 0").select("s", "n_blocks", bound(F.col("below")).alias("lo"), bound(F.col("below") + F.col("quota")).alias("hi")).filter("hi > lo")
    size = WHOLE // CELLS
    celled = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))).alias("cell"))
    drawn = slots.withColumn("cell", F.floor(F.col("point") / size)).join(celled, "cell").filter("point >= lo AND point < hi")
    drawn = drawn.select("slot", "s", "n_blocks", F.floor(F.col("slot") / RUN).alias("run"))
    counted = drawn.groupBy("s", "run").agg(F.count("*").alias("n"))
    counted = counted.select("s", "run", (F.sum("n").over(W.partitionBy("s").orderBy("run").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = drawn.withColumn("own", F.row_number().over(W.partitionBy("s", "run").orderBy("slot")) - 1).join(counted, ["s", "run"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own")).filter(F.col("rank") < F.col("n_blocks") * repeat)
    return ranked.select("slot", "s", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with its source's s, source_size, target and width, and start, its first token's place in the shuffled source."""
    keyed = sized.join(sources.select(F.col("source").alias("_source"), "s", "source_size", "target", "width", "n_ranges"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("range", F.floor(F.col("h") / (1 << 60) * F.col("n_ranges")).cast("long"))
    sums = keyed.groupBy("s", "range").agg(F.sum("size").alias("n"))
    sums = sums.select("s", "range", (F.sum("n").over(W.partitionBy("s").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    order = W.partitionBy("s", "range").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    return keyed.withColumn("within", F.sum("size").over(order) - F.col("size")).join(sums, ["s", "range"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within", "range", "n_ranges", "h")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK) -> DataFrame:
    """(key, size, source_size, target, taken): one row per document; key is renamed to "key"."""
    h = F.conv(F.substring(F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    sized = saved(docs.select(docs[key].alias("key"), docs[source].alias("source"), words(docs[text]).alias("size"), h.alias("h")), "sizes")
    sources = saved(targets(sized, weights, share, repeat, block), "sources")
    uses = schedule(sources, repeat).groupBy("s", "block").agg(F.count("*").alias("times"))
    rows = placed(sized, sources)
    first, last = F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("size") - 1) / F.col("width"))
    cut = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    at = F.col("block") * F.col("width")
    overlap = F.least(F.col("start") + F.col("size"), at + F.col("width")) - F.greatest(F.col("start"), at)
    met = cut.join(uses, ["s", "block"], "left").withColumn("part", F.coalesce(F.col("times"), F.lit(0)) * overlap)
    # A document with words is known by its place; those without are all alike, so their number is kept.
    whole = met.groupBy("s", "start", "size", "key", "source_size", "target").agg(F.sum("part").alias("taken"), F.count("*").alias("n"))
    whole = whole.withColumn("copy", F.explode(F.when(F.col("size") > 0, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    return whole.select("key", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("taken")).otherwise(0).alias("taken"))


def copies(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as many times as the mix takes it: taken / size, rounded.

    Rows that share a key, or have none, share its copies: each takes an equal part of them, rounded up or down by the
    hash of the row, so that no task needs all rows of a key.
    """
    key = options.get("key", "doc_id")
    name, share, copy = fresh(docs, "key", "share", "copy")
    taken = F.coalesce(F.round(F.try_divide(F.col("taken"), F.col("size"))), F.lit(0.0))
    chosen = mix(docs, **options).groupBy("key").agg((F.sum(taken) / F.count("*")).alias("share")).filter("share > 0")
    chosen = saved(chosen.select(F.col("key").alias(name), F.col("share").alias(share)), "chosen")
    part = F.xxhash64(*docs.columns).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    times = (F.floor(share) + F.when(part < F.col(share) - F.floor(share), 1).otherwise(0)).cast("int")
    rows = docs.join(chosen, F.col(key).eqNullSafe(F.col(name))).withColumn(copy, times).filter(F.col(copy) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id AS key, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
grouped AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM sized GROUP BY source),
weighed AS (SELECT *, CASE s % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM grouped),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER f, 0) * 2) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM weighed WINDOW f AS (ORDER BY (source_size * 2)::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targeted AS (
  SELECT *, least((source_size * 2)::DOUBLE, max(level) OVER () * weight) AS target, greatest(1, least(256, source_size // 1024)) AS width FROM levels),
quotas AS (SELECT *, ceil(source_size / width)::BIGINT AS n_blocks, floor(target / width * 1000000)::BIGINT AS quota FROM targeted),
sources AS (
  SELECT *, (sum(quota) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - quota)::HUGEINT AS below, (sum(quota) OVER ())::HUGEINT AS total FROM quotas),
slots AS (SELECT k AS slot, (k * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range((SELECT max((total + 999999) // 1000000) FROM sources)::BIGINT)) AS k)),
drawn AS (
  SELECT slot, s, n_blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS rank
  FROM slots JOIN sources ON point >= below * 4294967296 // total AND point < (below + quota) * 4294967296 // total),
uses AS (SELECT s, rank % n_blocks AS block, count(*) AS times FROM drawn WHERE rank < 2 * n_blocks GROUP BY ALL),
placed AS (
  SELECT sized.*, s, source_size, target, width, (sum(size) OVER (PARTITION BY s ORDER BY h, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source),
cut AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // width, (start + size - 1) // width + 1) ELSE [-1::BIGINT] END) AS block FROM placed)
SELECT key AS doc_id, size, source_size, target,
       sum(CASE WHEN size > 0 THEN coalesce(times, 0) * (least(start + size, (block + 1) * width) - greatest(start, block * width)) ELSE 0 END)::BIGINT AS taken
FROM cut LEFT JOIN uses USING (s, block) GROUP BY key, size, source_size, target, s, start
"""
