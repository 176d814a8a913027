"""LM scoring by context-tree weighting over bytes: code length of each text under a model of the corpus.

A byte is eight binary decisions. A node is a context of 0 to ``DEPTH`` preceding bytes with the bits of the byte so far.
Each has a Krichevsky-Trofimov estimate from the training texts; a node's weighted estimate is half its own and half the
product of those of the contexts one byte longer. A text's bytes, A-Z lower-cased, and an end mark are then priced bit by
bit: from the longest context that training met down to the empty one, a node's estimate is mixed with that of the longer
context by their weights in training. The end mark is the byte 255, which UTF-8 lacks; it also fills the contexts at a start.

Only the distinct runs of ``DEPTH`` + 1 bytes matter. The corpus is cut into batches of whole documents; a batch asks for the
runs and words that it has, with their training counts, in sorted blocks dealt to shards: runs by their last three context
bytes, so that a shard has whole subtrees, words by hash. A shard adds up all batches' counts and answers each of them: a
run's code length, a word's count. Nodes of up to two context bytes are at most 2^24 + 2^16 + 2^8 whatever the corpus; they
are summed by Spark, weighed on the driver and broadcast. A batch then meets its answers and sums them by document. So no
task holds more than one batch's runs and words, or one shard's.

The base score prices words and one end a text by add-half unigram counts.

Null text counts as empty: an end only. A row that no id holds out trains, null ids included. Equal texts get equal scores;
repeated rows train as often as they stand. Without training rows every bit costs one bit. An empty table gives an empty one.
Other columns stay, but for one that has the result's name, which the result replaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import forget, fresh, saved

#: Context bytes; at least 3, at most 7.
DEPTH = 5
#: Context bytes of the nodes that are broadcast.
TOP = 2
#: Bytes of a batch's texts, and of the part of it that is coded at a time; bytes of text to a shard.
BATCH, PART, SHARD = 32 << 20, 2 << 20, 48 << 20
END, LAST = 255, b" "
RUNS, WORDS = 0, 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: the differences of each to the one before."""
    return zstandard.compress(np.diff(values.astype(np.uint64), prepend=np.uint64(0)).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint64), dtype=np.uint64)


def laid(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the run that ends at each place of the joined texts, and where each text begins and ends, its end mark included."""
    gap = bytes([END]) * (depth + 1)
    joined = np.frombuffer(gap[1:] + gap.join(texts) + gap[:1], np.uint8)
    codes = np.zeros(len(joined) - depth, np.uint64)
    for i in range(depth + 1):
        codes = (codes << np.uint64(8)) | joined[i : len(joined) - depth + i]
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    begins = np.cumsum(np.concatenate([[0], lengths[:-1] + depth]))
    return codes, begins, begins + lengths


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(count, starts) if len(key) else count


class Batch:
    """What a batch of texts asks for."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.parts: dict[bool, list[bytes]] = {True: [], False: []}
        self.waiting = {True: 0, False: 0}
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()

    def add(self, text: bytes, trains: bool) -> None:
        self.size += len(text) + 1
        self.parts[trains].append(text)
        self.waiting[trains] += len(text) + 1
        words = text.split()
        if trains:
            self.words.update(words)
            self.words[LAST] += 1
        else:
            self.words.update(dict.fromkeys(words, 0))
            self.words[LAST] += 0
        if self.waiting[trains] >= PART:
            self.code(trains)

    def code(self, trains: bool) -> None:
        if not self.parts[trains]:
            return
        codes, begins, ends = laid(self.parts[trains], self.depth)
        inside = np.zeros(len(codes) + 1, np.int8)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends, -1)
        found, counts = np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)
        self.runs.append((found, counts.astype(np.int64) if trains else np.zeros(len(found), np.int64)))
        self.parts[trains], self.waiting[trains] = [], 0
        if sum(len(k) for k, _ in self.runs) > BATCH // 16:
            self.runs = [added(*map(list, zip(*self.runs, strict=True)))]

    def asks(self, shards: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, shard, keys, training counts): sorted blocks."""
        self.code(True)
        self.code(False)
        if self.runs:
            keys, counts = added(*map(list, zip(*self.runs, strict=True)))
            of = shard_of(keys, shards)
            for s in np.unique(of):
                yield RUNS, int(s), packed(keys[of == s]), packed(counts[of == s])
        dealt: dict[int, list[bytes]] = {}
        for word in self.words:
            dealt.setdefault(crc32(word) % shards, []).append(word)
        for s, words in dealt.items():
            words.sort()
            yield WORDS, s, zstandard.compress(b"\n".join(words)), packed(np.array([self.words[w] for w in words]))


def shard_of(runs: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each run, by the three bytes before its last."""
    mixed = ((runs >> np.uint64(8)) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def asking(names: list[str], depth: int, shards: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents with the number of their batch, and each batch's asks. names: of the text, of whether it trains, and of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        batch, n, task = Batch(depth), 0, 0
        for rows in batches:
            text, trains, part = (rows.column(rows.schema.get_field_index(c)) for c in names)
            numbers = []
            for t, own, task in zip(text.cast(pa.binary()), trains.to_pylist(), part.to_pylist(), strict=True):
                if batch.size >= BATCH:
                    yield from told(batch, task, n)
                    batch, n = Batch(depth), n + 1
                numbers.append((task << 32) + n)
                batch.add((t.as_py() or b"").lower(), own)
            docs = {"batch": pa.array(numbers, pa.int64()), **{f.name: rows.column(rows.schema.get_field_index(f.name)) for f in schema if f.name in rows.schema.names}}
            yield from padded(docs, rows.num_rows)
        if batch.size:
            yield from told(batch, task, n)

    def told(batch: Batch, task: int, n: int) -> Iterator[pa.RecordBatch]:
        for kind, shard, keys, counts in batch.asks(shards):
            yield from padded({"batch": pa.array([(task << 32) + n], pa.int64()), "kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int64()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary())}, 1)

    def padded(columns: dict[str, pa.Array], n: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], names=schema.names)

    return run


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096) - 0.5))])
_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov estimate of counts of both bits."""

    def rising(n: np.ndarray) -> np.ndarray:  # log of 1/2 * 3/2 * ... of n factors
        return np.where(n < 4096, _SMALL[np.minimum(n, 4095)], _log_gamma(np.maximum(n, 1) + 0.5) - 0.5 * log(np.pi))

    n = zeros + ones
    return rising(zeros) + rising(ones) - np.where(n < 4096, _FACTORIAL[np.minimum(n, 4095)], _log_gamma(np.maximum(n, 1) + 1.0))


def half(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Logarithm of the mean of two numbers given by their logarithms."""
    return np.logaddexp(own, longer) - log(2)


class Prices:
    """Probability of each run's next eight bits, from the longest context down."""

    def __init__(self, runs: np.ndarray):
        self.runs = runs
        self.p = np.full((8, len(runs)), np.nan)  # nan: no context so far was met in training

    def mix(self, bit: int, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> None:
        """Mix in the nodes at these places by their weights."""
        total = zeros + ones
        set_ = (self.runs >> np.uint64(7 - bit)) & np.uint64(1) == 1
        own = (np.where(set_, ones[at], zeros[at]) + 0.5) / (total[at] + 1)
        before, w = self.p[bit], weight[at]
        self.p[bit] = np.where(total[at] == 0, before, np.where(np.isnan(before), own, w * own + (1 - w) * before))

    def lengths(self) -> np.ndarray:
        """log10 of each run's last byte."""
        return np.log10(np.where(np.isnan(self.p), 0.5, self.p)).sum(axis=0)


def weights(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate in its weighted one; longer: summed logarithms of the weighted estimates of the contexts one byte longer."""
    return 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


def nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of sorted (context, byte) keys after the first bits of the byte: their keys, place of each key, zeros, ones."""
    own = keys >> np.uint64(8 - bit)
    new = np.concatenate([[True], own[1:] != own[:-1]])
    starts, at = np.flatnonzero(new), np.cumsum(new) - 1
    ones = np.add.reduceat(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1) == 1, counts, 0), starts)
    return own[starts], at, np.add.reduceat(counts, starts) - ones, ones


def subtrees(runs: np.ndarray, counts: np.ndarray, depth: int) -> tuple[Prices, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Prices of sorted runs from their contexts of more than TOP bytes, and what the nodes above need.

    Those are (context of TOP bytes, byte) keys with counts and, for each number of bits, the nodes' summed logarithms of
    the weighted estimates of the contexts one byte longer.
    """
    prices, keys, own = Prices(runs), runs, counts
    to_key = np.arange(len(runs))
    longer: list[np.ndarray] = []
    for d in range(depth, TOP, -1):
        shorter = np.uint64((1 << 8 * d) - 1)  # the last d bytes of a run: a context one byte shorter, and the byte
        below = []
        for bit in range(8):
            key, at, zeros, ones = nodes(keys, own, bit)
            weighted = estimate(zeros, ones)
            if longer:  # of the same nodes, as every run has longer contexts
                prices.mix(bit, at[to_key], zeros, ones, weights(weighted, longer[bit]))
                weighted = half(weighted, longer[bit])
            else:
                prices.mix(bit, at[to_key], zeros, ones, np.ones(len(key)))
            parents, place = np.unique(key & (shorter >> np.uint64(8 - bit)), return_inverse=True)
            below.append(np.bincount(place, weighted, len(parents)))
        longer = below
        keys, place = np.unique(keys & shorter, return_inverse=True)
        own = _exact(place, own, len(keys))
        to_key = place[to_key]
    return prices, keys, own, longer


def _exact(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, counts)
    return out


def _read(rows: pa.Table) -> list[tuple[int, np.ndarray | list[bytes], np.ndarray]]:
    """(batch, keys, counts) of a shard's asks."""
    words = rows.num_rows and rows["kind"][0].as_py() == WORDS
    every = zip(rows["batch"].to_pylist(), rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True)
    return [(b, zstandard.decompress(k).split(b"\n") if words else unpacked(k), unpacked(c).astype(np.int64)) for b, k, c in every]


def _totals(asks: list) -> Counter:
    totals: Counter = Counter()
    for _, words, counts in asks:
        for word, n in zip(words, counts.tolist(), strict=True):
            totals[word] += n
    return totals


def summed(depth: int) -> Callable[[pa.Table], pa.Table]:
    """What the whole corpus must know of a shard: nodes of TOP context bytes, or its numbers of words and of distinct ones."""

    def run(rows: pa.Table) -> pa.Table:
        asks = _read(rows)
        if rows["kind"][0].as_py() == WORDS:
            counts = [n for n in _totals(asks).values() if n]
            key, zeros, ones, sums = [-1], [sum(counts)], [len(counts)], [0.0]
        else:
            runs, counts = added([a[1] for a in asks], [a[2] for a in asks])
            _, keys, own, longer = subtrees(runs, counts, depth)
            found = [nodes(keys, own, bit) for bit in range(8)]
            key = np.concatenate([((f[0] >> np.uint64(bit)) << np.uint64(8)) | np.uint64(1 << bit) | (f[0] & np.uint64((1 << bit) - 1)) for bit, f in enumerate(found)]).astype(np.int64)
            zeros, ones = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
            sums = np.concatenate(longer)
        return pa.table([pa.array(key, pa.int64()), pa.array(zeros, pa.int64()), pa.array(ones, pa.int64()), pa.array(sums, pa.float64())], ["key", "zeros", "ones", "longer"])

    return run


def weighed(top: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of TOP, ..., 0 context bytes: keys (context, 1, bits), zeros, ones, and the weights of their own estimates."""
    top = top.sort_by("key")
    key, zeros, ones, longer = (top[c].to_numpy() for c in ("key", "zeros", "ones", "longer"))
    out = []
    for d in range(TOP, -1, -1):
        own = estimate(zeros, ones)
        out.append((key, zeros, ones, weights(own, longer)))
        weighted = half(own, longer)
        parent = (key & 255) | (((key >> 8) & ((1 << 8 * max(d - 1, 0)) - 1)) << 8)
        key, place = np.unique(parent, return_inverse=True)
        zeros, ones, longer = _exact(place, zeros, len(key)), _exact(place, ones, len(key)), np.bincount(place, weighted, len(key))
    return out


def answers(depth: int, above: list) -> Callable[[pa.Table], pa.Table]:
    """A shard's answers to its batches: each run's log10 probability, or each word's training count."""

    def run(rows: pa.Table) -> pa.Table:
        asks, kind = _read(rows), rows["kind"][0].as_py()
        if kind == WORDS:
            totals = _totals(asks)
            values = [zstandard.compress(np.array([totals[w] for w in words], np.int64).tobytes()) for _, words, _ in asks]
        else:
            runs, counts = added([a[1] for a in asks], [a[2] for a in asks])
            prices = subtrees(runs, counts, depth)[0]
            for d, (key, zeros, ones, weight) in zip(range(TOP, -1, -1), above, strict=True):
                context = (runs >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)
                for bit in range(8):
                    node = (context << np.uint64(8)) | np.uint64(1 << bit) | ((runs & np.uint64(255)) >> np.uint64(8 - bit))
                    prices.mix(bit, np.searchsorted(key, node.astype(np.int64)), zeros, ones, weight)
            lengths = prices.lengths()
            values = [zstandard.compress(lengths[np.searchsorted(runs, own)].tobytes()) for _, own, _ in asks]
        return pa.table({"batch": rows["batch"], "kind": rows["kind"], "keys": rows["keys"], "values": pa.array(values, pa.binary())})

    return run


def scoring(text: str, into: str, depth: int, tokens: int, distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a batch's documents from its answers."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        runs, lengths, known = [], [], {}
        for kind, keys, values in zip(*(told[c].to_pylist() for c in ("kind", "keys", "values")), strict=True):
            if kind == WORDS:
                known.update(zip(zstandard.decompress(keys).split(b"\n"), np.frombuffer(zstandard.decompress(values), np.int64).tolist(), strict=True))
            else:
                runs.append(unpacked(keys))
                lengths.append(np.frombuffer(zstandard.decompress(values), np.float64))
        every = np.concatenate(runs)
        order = np.argsort(every, kind="stable")
        every, price = every[order], np.concatenate(lengths)[order]
        logs = {c: log10(c + 0.5) for c in set(known.values())}
        each = log10(tokens + 0.5 * (distinct + 1))
        rows, part, waiting = [], [], 0
        texts = [(t.as_py() or b"").lower() for t in docs[text].combine_chunks().cast(pa.binary())]
        for t in texts:
            counts = [known[w] for w in (*t.split(), LAST)]
            rows.append((len(t), len(counts), sum(c > 0 for c in counts), tokens, sum([logs[c] for c in counts]) - len(counts) * each))
        scores: list[float] = []
        for i, t in enumerate(texts):
            part.append(t)
            waiting += len(t)
            if waiting >= PART or i == len(texts) - 1:
                codes, begins, ends = laid(part, depth)
                coded = pa.array(codes).dictionary_encode()
                found = coded.dictionary.to_numpy()
                at = np.minimum(np.searchsorted(every, found), len(every) - 1)
                own = np.where(every[at] == found, price[at], 0.0)[coded.indices.to_numpy()]  # runs over a gap are no text's
                scores += np.add.reduceat(np.append(own, 0.0), np.stack([begins, ends], axis=1).ravel())[::2].tolist()
                part, waiting = [], 0
        del known, every, price, texts
        forget()
        size, n, seen, total, base = zip(*rows, strict=True)
        bits = [-s / log10(2) / (b + 1) for s, b in zip(scores, size, strict=True)]
        struct = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(total, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
        return docs.drop_columns(["batch"]).append_column(into, struct)

    return run


SCHEMA = StructType([*(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(StructField(c, DoubleType()) for c in ("base_score", "score", "bits_per_byte"))])


def score(docs: DataFrame, trains: Column, text: str = "text", into: str = "lm", depth: int = DEPTH) -> DataFrame:
    """docs with a struct column: words and the end, those known, training tokens, base score, the model's log10 probability, and its bits a byte.

    trains says of each row whether the model learns from it.
    """
    spark = docs.sparkSession
    kept = docs.drop(into)
    own = [f"c{i}" for i in range(len(kept.columns))]
    size = kept.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    shards = 1 + size // SHARD
    rows = kept.withColumns(dict(zip(fresh(kept, "trains", "task"), (F.coalesce(trains, F.lit(True)), F.spark_partition_id().cast("long")), strict=True))).toDF(*own, "trains", "task")
    planned = StructType([StructField("batch", LongType()), *(StructField(o, f.dataType) for o, f in zip(own, kept.schema, strict=True)), StructField("kind", IntegerType()), StructField("shard", LongType()), StructField("keys", BinaryType()), StructField("counts", BinaryType())])
    key = own[[c.lower() for c in kept.columns].index(text.lower())]
    table = saved(rows.mapInArrow(asking([key, "trains", "task"], depth, shards, to_arrow_schema(planned)), planned), "asks")

    asked = table.filter("kind IS NOT NULL").select("batch", "kind", "shard", "keys", "counts").groupBy("kind", "shard")
    top = asked.applyInArrow(summed(depth), "key long, zeros long, ones long, longer double")
    exact = F.sum(F.col("longer").cast("decimal(38, 9)")).cast("double").alias("longer")
    top = top.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), exact).toArrow()
    words = top.filter(pa.compute.less(top["key"], 0)).to_pylist()
    above = spark.sparkContext.broadcast(weighed(top.filter(pa.compute.greater_equal(top["key"], 0))))
    tokens, distinct = (words[0]["zeros"], words[0]["ones"]) if words else (0, 0)

    reply = asked.applyInArrow(lambda rows: answers(depth, above.value)(rows), "batch long, kind int, keys binary, values binary")
    whole = table.filter("kind IS NULL").select("batch", *own)
    out = whole.groupBy("batch").cogroup(reply.groupBy("batch")).applyInArrow(scoring(key, "lm", depth, tokens, distinct), StructType([*whole.schema.fields[1:], StructField("lm", SCHEMA)]))
    return out.toDF(*kept.columns, into)
