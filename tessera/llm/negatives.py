"""Hard-negative mining: for each anchor and each of its nearest rows of its label, the nearest rows of other labels
whose score lies in a window below.

Components become integers, and scores are integer inner products. Anchors and candidates are dealt to groups, so that
each pair of an anchor group and a candidate group is one task of bounded size: the blocks of one matrix product. In a
task, int64 tiles are multiplied by Strassen's recursion, odd sides padded with zeros. Its additions are exact, even where
an intermediate sum leaves 64 bits: wrapped sums agree modulo 2^64, and scores fit. Each task hands on the first rows of
each anchor, or of each anchor and window; such heaps merge into the first rows of all. Positives come first, as windows
are made from their scores; the second product is worked out anew, as all scores would be the square of the input.

A row with a null id, label or vector, or a null or non-finite component, takes no part. Short vectors count as padded
with zeros, and empty ones score 0. Components are held within +-sqrt(2^62 / length of the longest vector), so that scores
fit; no embedding in use comes near. Rows that share an id are candidates each, and anchors each, but equal anchor rows
count once; an anchor's others are the rows with another id. Ties go to the smaller id. An anchor without positives, and a
window without rows, gives no row: a window of a negative score is empty. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import merge
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import saved

POSITIVES, NEGATIVES = 5, 10
#: The window of negatives, in hundredths of the positive's score.
WINDOW = 30, 90
#: Numbers in the vectors of an anchor group and a candidate group, and rows of a tile.
ANCHOR_CELLS, CELLS, TILE = 1 << 19, 1 << 18, (512, 4096)
#: A side that is multiplied plainly.
LEAF = 16
NOTHING = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven products of half the size."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), a.dtype)
    out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to a width."""
    lists = vectors.combine_chunks()
    lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k of a row's scores as a sorted heap of (-score, id); ids ascend, and NOTHING is no score."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else NOTHING
    at = np.flatnonzero(scores >= max(least, NOTHING + 1))
    at = at[np.argsort(-scores[at], kind="stable")[:k]]
    return list(zip((-scores[at]).tolist(), ids[at].tolist(), strict=True))


def merged(heap: list[tuple[int, int]], more: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return list(islice(merge(heap, more), k)) if heap and more else heap or more


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives."""
    return -((-WINDOW[0] * positive) // 100), WINDOW[1] * positive // 100


def tiles(left: pa.Table, right: pa.Table, tile: tuple[int, int] = TILE) -> Iterator[tuple[range, np.ndarray, dict[str, np.ndarray]]]:
    """Score tiles of a task: places of anchors, scores, and the tile's candidates, whose ids ascend."""
    right = right.sort_by("vec_id")
    width = max(1, *(int(np.diff(t["x"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right)))
    a, b = matrix(left["x"], width), matrix(right["x"], width)
    told = {c: right[c].to_numpy() for c in ("vec_id", "label")}
    for j in range(0, len(b), tile[1]):
        part = np.ascontiguousarray(b[j : j + tile[1]].T)
        for i in range(0, len(a), tile[0]):
            yield range(i, min(i + tile[0], len(a))), strassen(a[i : i + tile[0]], part), {c: v[j : j + tile[1]] for c, v in told.items()}


def nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k other rows of each anchor's label."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {c: left[c].to_numpy() for c in ("a", "vec_id", "label")}
        heaps: list[list] = [[] for _ in own["a"]]
        if len(left) and len(right):
            for places, scores, told in tiles(left, right):
                s = slice(places.start, places.stop)
                of = np.where((told["label"] == own["label"][s, None]) & (told["vec_id"] != own["vec_id"][s, None]), scores, NOTHING)
                for i, row in zip(places, of, strict=True):
                    heaps[i] = merged(heaps[i], first(row, told["vec_id"], k), k)
        flat = [(int(a), -s, v) for a, heap in zip(own["a"], heaps, strict=True) for s, v in heap]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 3, ["a", "score", "id"])

    return task


def below(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k rows of other labels in the window of each anchor's positives."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {c: left[c].to_numpy() for c in ("a", "label")}
        slots = [[(p["slot"], *window(p["score"])) for p in ps] for ps in left["positives"].to_pylist()]
        heaps: dict[tuple[int, int], list] = {}
        if len(left) and len(right):
            for places, scores, told in tiles(left, right):
                of = np.where(told["label"] != own["label"][places.start : places.stop, None], scores, NOTHING)
                for i, row, values in zip(places, of, np.sort(of, axis=1), strict=True):
                    for slot, least, most in slots[i]:
                        end = int(np.searchsorted(values, most, "right"))
                        least = max(least, values[max(end - k, 0)], NOTHING + 1)
                        at = np.flatnonzero((row >= least) & (row <= most))
                        if len(at):
                            at = at[np.argsort(-row[at], kind="stable")[:k]]
                            found = list(zip((-row[at]).tolist(), told["vec_id"][at].tolist(), strict=True))
                            heaps[i, slot] = merged(heaps.get((i, slot), []), found, k)
        flat = [(int(own["a"][i]), slot, -s, v) for (i, slot), heap in heaps.items() for s, v in heap]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)] if flat else [pa.array([], pa.int64())] * 4, ["a", "slot", "score", "id"])

    return task


def blocks(anchors: DataFrame, rows: DataFrame, groups: tuple[int, int], task: Callable, schema: str) -> DataFrame:
    """The task on every anchor group and candidate group."""
    left = anchors.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(groups[1] - 1))))
    right = rows.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(groups[0] - 1))))
    return left.groupBy("of", "to").cogroup(right.groupBy("of", "to")).applyInArrow(task, schema)


def numbered(column: Column, limit: int) -> Column:
    """Components as integers within the limit."""
    return F.transform(column, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(256 * x.cast("double")))).cast("long"))


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by 100."""
    x, number = vectors[vector], vectors[key].cast("long")
    usable = vectors[label].isNotNull() & number.isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    moved = F.when(number % 7 == 0, (vectors[label].cast("long") + 1) % 10).otherwise(vectors[label].cast("long"))
    rows = vectors.filter(usable).select(number.alias("vec_id"), moved.alias("label"), x.alias("x"))
    n, ahead, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 100 == 0), F.max(F.size("x"))).first()
    width = max(width or 0, 1)
    groups = max(1, -(-ahead * width // ANCHOR_CELLS)), max(1, -(-n * width // CELLS))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups[1])).cast("int")
    rows = saved(rows.select("vec_id", "label", numbered(F.col("x"), isqrt(2**62 // width)).alias("x"), dealt.alias("to")), "vectors")
    anchors = rows.filter("vec_id % 100 = 0").select("vec_id", "label", "x").distinct().withColumn("a", F.monotonically_increasing_id())
    anchors = saved(anchors.withColumn("of", F.pmod(F.xxhash64("a"), F.lit(groups[0])).cast("int")), "anchors")

    order = F.col("score").desc(), F.col("id")
    near = blocks(anchors, rows, groups, nearest(positives), "a long, score long, id long")
    near = near.withColumn("slot", F.row_number().over(W.partitionBy("a").orderBy(*order))).filter(F.col("slot") <= positives)
    near = saved(near, "positives")
    asked = anchors.join(near.groupBy("a").agg(F.collect_list(F.struct("slot", "score")).alias("positives")), "a")
    hard = blocks(asked.select("a", "label", "x", "of", "positives"), rows, groups, below(negatives), "a long, slot long, score long, id long")
    hard = hard.withColumn("rank", F.row_number().over(W.partitionBy("a", "slot").orderBy(*order))).filter(F.col("rank") <= negatives)
    out = hard.withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).join(near.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}), ["a", "slot"])
    return out.join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB's SQL, over whole tables.
ORACLE = """
WITH r AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
  c AS (SELECT i, unnest(x) AS x, unnest(range(len(x))) AS k FROM r),
  s AS (SELECT p.i AS a, q.i AS b, sum(p.x * q.x)::BIGINT AS score FROM c p JOIN r ON r.i = p.i AND r.vec_id % 100 = 0 JOIN c q ON q.k = p.k GROUP BY ALL),
  t AS (SELECT a, m.vec_id AS anchor_id, m.label AS own, n.vec_id AS other, n.label, score FROM s JOIN r m ON m.i = a JOIN r n ON n.i = b),
  p AS (SELECT a, anchor_id, own, other AS positive_id, score AS positive_score FROM t WHERE label = own AND other <> anchor_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other) <= 5),
  h AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN t ON t.a = p.a AND t.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM h WHERE rank <= 10
"""
