"""Quality rules: fixed counts, and a calibrated logistic regression over hashed word and character n-grams.

A text's features are the mean, over its words, of the word's slot and its character n-grams' slots. As the
model is linear, a word's whole contribution is one number, cached in the worker. The model is fitted on a
bounded sample of labelled rows (``SAMPLE`` of each class, chosen by hash of the id), calibrated by a logistic
curve on the fifth of them that the fit leaves out, and compared with a fixed threshold.

Null and empty texts have no words: all counts are 0, base_failed is true and kept false. Without labels of
both classes the model's verdict is "keep" and the base rules alone decide. Equal texts and repeated rows get equal
results; a probability equal to the threshold keeps. Windows are compared by 64 bits of hash over the numbers of their words,
so n_repeat_words is exact but for a collision of those. An empty table gives an empty one. Other columns stay, but for one
that has the result's name, which the result replaces.

In a fit an id counts once for each label that it has: where rows share it, by the text that sorts first. Texts of more than
``LONGEST`` characters take no part in a fit; they are scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import collected, held

SLOTS = 1 << 18
#: Labelled rows of each class that the fit uses at most.
SAMPLE = 1500
#: Characters of a text that may take part in a fit.
LONGEST = 1 << 20
#: A text stays if its calibrated probability of good quality is at least this.
KEEP_AT = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Words whose weight a worker holds.
CACHE_WORDS = 400_000
#: Bytes of the longest words among them. N-grams handled at a time.
CACHE_BYTES, PART = 64, 1 << 16

SCHEMA = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, probability: double, kept: boolean>"


def slots(word: bytes) -> list[int]:
    """Slots of a word and of its character 3- and 4-grams, with its ends marked."""
    return [crc32(b"w" + word) % SLOTS, *(g for part in grams_of(word) for g in part)]


def grams_of(word: bytes) -> Iterator[list[int]]:
    """Slots of the n-grams of a word of any length, in lists of bounded size."""
    marked = b"<" + word + b">"
    for at in range(0, len(marked), PART):
        yield [crc32(marked[i : i + n]) % SLOTS for n in (3, 4) for i in range(at, min(at + PART, len(marked) - n + 1))]


class _Weights(dict):
    """Word -> its summed weight; bounded, filled on demand."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        w, total, n = self.weights, 0.0, 0
        for grams in grams_of(word):
            total, n = total + float(w[grams].sum()), n + len(grams)
        value = float(w[crc32(b"w" + word) % SLOTS]) + total / max(n, 1)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= CACHE_BYTES:
            self[word] = value
        return value


def counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS), 0, 0
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80)) if not joined.isascii() else len(joined)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = Counter(text.split(b"\n"))
    dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    return len(words), chars, symbols, dup, repeated(words)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        mixed = (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = np.zeros(n, np.uint64)
        for i in range(window):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def judged(text: Column, model: dict, keep_at: float = KEEP_AT) -> Column:
    """Column of counts, base verdict, probability of good quality and verdict."""
    weights, bias, slope, shift = model["weights"], model["bias"], model["slope"], model["shift"]
    token = f"quality {crc32(weights.tobytes())}"

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        own = held(token, lambda: _Weights(weights))
        rows = []
        for t in texts.cast(pa.binary()):
            data = t.as_py() or b""
            words = data.split()
            n, chars, symbols, dup, again = counts(data, words)
            failed = n < 20 or 100 * again > 30 * n
            raw = bias + (sum([own[w] for w in words]) / n if n else 0.0)
            p = float(1 / (1 + np.exp(-np.clip(slope * raw + shift, -50, 50))))
            rows.append((n, chars, symbols, dup, again, failed, p, not failed and p >= keep_at))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    return run(text)


def features(texts: pa.Array) -> pa.Array:
    """A text's slots and their mean values."""
    ats, values = [], []
    for t in texts.cast(pa.binary()):
        words = (t.as_py() or b"").split()
        total: Counter = Counter()
        for word, n in Counter(words).items():
            own, *grams = slots(word)
            total[own] += n / len(words)
            for g in grams:
                total[g] += n / len(words) / len(grams)
        ats.append(list(total))
        values.append(list(total.values()))
    return pa.StructArray.from_arrays([pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["at", "value"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(text, y, h): at most ``sample`` labelled ids of each class, the first by hash, one row for each; the ids are few, so they are broadcast."""
    hashed = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key), F.lit(7)).alias("h")).distinct()
    few = hashed.filter("y = 0").orderBy("h", "_key").limit(sample).unionByName(hashed.filter("y = 1").orderBy("h", "_key").limit(sample))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).filter(F.length("text") <= LONGEST).join(F.broadcast(few), "_key")
    return rows.groupBy("_key", "y", "h").agg(F.min("text").alias("text")).select("text", "y", "h")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> dict:
    """Weights, bias and calibration, fitted on a bounded sample of labelled rows."""
    none = {"weights": np.zeros(SLOTS, np.float32), "bias": 9.0, "slope": 1.0, "shift": 0.0}
    featured = F.arrow_udf(features, "struct<at: array<int>, value: array<float>>")
    rows = labelled(docs, labels, "quality", sample, text, key).select("y", "h", featured("text").alias("f")).select("y", "h", "f.at", "f.value")
    rows = collected(rows).sort_by([("h", "ascending")])
    y = rows["y"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        return none
    n = len(y)
    at, value = rows["at"].combine_chunks(), rows["value"].combine_chunks()
    row = np.repeat(np.arange(n), np.diff(at.offsets.to_numpy()))
    at, value = at.values.to_numpy(), value.values.to_numpy().astype(np.float64)
    held = np.arange(n) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    weight = np.where(y == 1, 0.5 / max((y[~held] == 1).sum(), 1), 0.5 / max((y[~held] == 0).sum(), 1)) * ~held
    w, bias, seen, seen_bias = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-12), 1e-12
    for _ in range(80):  # full gradients, steps scaled by each slot's past
        raw = bias + np.bincount(row, w[at] * value, n)
        error = weight * (1 / (1 + np.exp(-raw)) - y)
        g = np.bincount(at, error[row] * value, SLOTS) + 1e-7 * w
        seen, seen_bias = seen + g * g, seen_bias + error.sum() ** 2
        w, bias = w - 0.7 * g / np.sqrt(seen), bias - 0.3 * error.sum() / np.sqrt(seen_bias)
    raw = bias + np.bincount(row, w[at] * value, n)
    slope, shift = calibrate(raw[held], y[held]) if held.any() else (1.0, 0.0)
    del rows, at, value, row
    pa.default_memory_pool().release_unused()
    return {"weights": w.astype(np.float32), "bias": float(bias), "slope": slope, "shift": shift}


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that best gives the labels from raw scores, with smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -50, 50)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * raw).sum() + 1e-6 * slope, (p - target).sum()])
        h = np.array([[(s * raw * raw).sum() + 1e-6, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        slope, shift = slope - step[0], shift - step[1]
    return float(slope), float(shift)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep_at: float = KEEP_AT, into: str = "quality_verdict") -> DataFrame:
    """docs with a struct column of the counts, the probability of good quality and the verdict."""
    return docs.withColumn(into, judged(docs[text], fit(docs, labels, text=text, key=key), keep_at))
