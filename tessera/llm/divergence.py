"""Source divergence audit: how far each source of a language is from every other, and which terms set it apart.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII. A language keeps the terms of at least
``LEAST_DOCS`` of its documents; each gets an add-one share of a group's or of the language's kept terms, in parts of
``SCALE``. The price of p against q is floor((p - q)^2 / q). All arithmetic is on integers.

Kept terms are dealt to blocks of about ``BLOCK`` ids by hash, and a group's row of a block is two arrays: sorted ids and
their counts. Each unordered pair of sources meets once a block: the two rows are co-grouped, a galloping search finds
the shared ids, and shared, one-sided and absent terms are priced both ways. A pair's value is the sum over blocks. So a
task holds two rows of at most a block's terms, however many terms a language or documents a source has.

Null text, language and source count as ''. A group without kept terms takes part: all its terms are absent. A language
without kept terms gives pairs of value 0. Repeated rows count as often as they stand. Equal values rank by the item's
UTF-8 bytes. An empty table gives an empty result. Only text, language and source are read; other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import saved

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Ids of a block, about. Entries that a task counts before it hands them on.
BLOCK, ENTRIES = 1 << 14, 600_000

#: UTF-8 bytes of terms, A-Z lower-cased; all others become spaces.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group of a task's rows; a null term stands for the group itself."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].cast(pa.binary()), strict=True):
            group = found.setdefault((lang, source), (Counter(), Counter()))
            own, before = terms(text.as_py() or b""), len(group[0])
            group[0].update(own)
            group[1].update(set(own))
            held += len(group[0]) - before
            if held > ENTRIES:
                yield from _rows(found)
                found, held = {}, 0
    yield from _rows(found)


def _rows(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in found.items():
        own = [None, *counts]
        columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string())]
        numbers = [pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs[t] for t in counts)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns + numbers, names=["lang", "source", "term", "n", "docs"])


def gallop(few: np.ndarray, many: np.ndarray, stride: int = 64) -> np.ndarray:
    """For each of the sorted ids in few, the place of the first of the sorted ids in many that is not smaller.

    From the place of the id that heads its run of stride ids, the step doubles until it passes the id; then it halves.
    """
    heads = np.searchsorted(many, few[::stride])
    low = np.repeat(heads, stride)[: len(few)]  # all ids before low are smaller
    last, step = len(many) - 1, np.zeros(len(few), np.int64)
    if last < 0:
        return low
    on = np.flatnonzero((low <= last) & (many[np.minimum(low, last)] < few))
    step[on] = 1
    while len(on):
        at = low[on] + step[on]
        on = on[(at <= last) & (many[np.minimum(at, last)] < few[on])]
        step[on] *= 2
    low, high = low + step // 2, np.minimum(low + step, last + 1)
    while True:
        on = np.flatnonzero(low < high)
        if not len(on):
            return low
        mid = (low[on] + high[on]) // 2
        less = many[mid] < few[on]
        low[on], high[on] = np.where(less, mid + 1, low[on]), np.where(less, high[on], mid)


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for counts of any size."""
    if len(counts) and int(counts.max()) >= 2**63 // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 1) // total for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // total


def prices(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | int:
    return (p - q) ** 2 // q


def priced(ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], width: int) -> tuple[int, int]:
    """The prices of a block's terms, first group against second and second against first."""
    if not width:
        return 0, 0
    p, q = shares(counts[0], totals[0]), shares(counts[1], totals[1])
    absent = 1 + SCALE // totals[0], 1 + SCALE // totals[1]
    swap = len(ids[0]) > len(ids[1])
    few, many = (ids[1], ids[0]) if swap else ids
    at = gallop(few, many)
    hit = at < len(many)
    hit[hit] = many[at[hit]] == few[hit]
    both = np.flatnonzero(hit), at[hit]
    i, j = both[::-1] if swap else both
    alone = np.delete(p, i), np.delete(q, j)
    neither = width - len(p) - len(alone[1])
    forth = prices(p[i], q[j]).sum() + prices(alone[0], absent[1]).sum() + prices(absent[0], alone[1]).sum() + neither * prices(absent[0], absent[1])
    back = prices(q[j], p[i]).sum() + prices(alone[1], absent[0]).sum() + prices(absent[1], alone[0]).sum() + neither * prices(absent[1], absent[0])
    return int(forth), int(back)


def pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    """One unordered pair of sources over one block: both sums."""
    sides = [(t["ids"].combine_chunks().values.to_numpy().astype(np.int64), t["counts"].combine_chunks().values.to_numpy(), t["total"][0].as_py()) for t in (left, right)]
    ids, counts, totals = zip(*sides, strict=True)
    forth, back = priced(ids, counts, totals, left["width"][0].as_py())
    return pa.table({"lang": left["lang"], "a": left["a"], "b": left["b"], "forth": pa.array([forth], pa.int64()), "back": pa.array([back], pa.int64())})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against the other sources of its language, and its leading terms."""
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))), docs[text].alias("text"))
    counted = rows.mapInArrow(tallies, "lang string, source string, term string, n long, docs long")
    counts = saved(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")

    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = saved(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")).withColumn("blocks", F.ceil(F.col("v") / BLOCK))
    dealt = kept.join(sizes.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    dealt = dealt.repartition("lang", "block").withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")) - 1)
    entries = saved(counts.filter("term IS NOT NULL").drop("docs").join(dealt, ["lang", "term"]), "entries")

    groups = counts.filter("term IS NULL").select("lang", "source").join(sizes, "lang", "left").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("blocks", F.lit(1)).alias("blocks"), (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total"))
    groups = saved(groups, "groups")

    # One row for each group and block, those without entries included.
    arrays = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("e"))
    widths = dealt.groupBy("lang", "block").agg(F.count("*").alias("width"))
    frame = groups.select("lang", "source", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    frame = frame.join(arrays, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left")
    none = F.array().cast("array<struct<id: int, n: bigint>>")
    frame = frame.select("lang", "source", "block", "total", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("e", none).alias("e")).select("*", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")).drop("e")
    frame = saved(frame, "arrays")

    names = groups.select("lang", "source")
    pairs = names.withColumnRenamed("source", "a").join(names.withColumnRenamed("source", "b"), "lang").filter("a < b")
    key = ["lang", "a", "b", "block"]
    left, right = (pairs.join(frame.withColumnRenamed("source", side), ["lang", side]) for side in ("a", "b"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(pair_task, "lang string, a string, b string, forth long, back long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("forth").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value"))))
    pair = sums.select("lang", both.alias("r")).select("lang", "r.*").withColumn("part", F.lit("pair"))

    share = "1 + (({0} * (CAST({1} AS DECIMAL(20, 0)) + 1)) div CAST({2} AS DECIMAL(20, 0)))"
    term = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(share.format(SCALE, "n", "total")).alias("p"), F.expr(share.format(SCALE, "lang_n", "lang_total")).alias("q"))
    term = term.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"), F.lit("term").alias("part"))

    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


#: The same in DuckDB's SQL, over whole tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  w AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
  v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
  t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
  f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v))::BIGINT AS p, (1 + (1000000000 * (k.n + 1)) // (v.total + v.v))::BIGINT AS q
    FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM f WHERE n > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
