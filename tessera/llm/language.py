"""Language of words and texts by a linear-chain conditional random field.

A word's emission for a language is the sum of the weights of its features: the word itself (lexicon), its
affixes of one to three characters, and its character 3-grams. Learned transitions carry evidence from word to
word. The field is trained on its likelihood, by forward-backward, on sequences that splice runs of words from
documents of unlike languages, as in code-switched text. A word's label probabilities come from forward-backward
over its whole text; the text's language is the one with the greatest mean probability, that mean its score.

The training sample is about ``SAMPLE`` documents of each language, chosen by hash of the id.

Null text and text without a letter get ``und`` and score 0. Equal texts get equal results. Equal means go to the
first language in code-point order. Without a training row every text gets ``und``. An empty table gives an empty
one. Other columns stay, but for one that has the result's name, which the result replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import held, remainder

SLOTS = 1 << 16
#: Documents of each language in the training sample, in expectation.
SAMPLE = 150
#: Characters of a language's training sample at most: documents that would exceed it are left out of the fit, not of scoring.
CHARS = 1 << 22
#: Length of training sequences and of the runs that are spliced into them.
LENGTH, RUN = 64, 16
#: Words whose emissions a worker holds, and words that go through forward-backward together.
CACHE_WORDS, TOGETHER = 400_000, 400_000
#: Characters of the words that a worker holds; longer ones are worked out anew in each batch. N-grams handled at a time.
CACHE_CHARS, PART = 48, 1 << 16

UNKNOWN = "und"
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_ENDS = ".,;:!?()[]\"'|*#$%&"

SCHEMA = "struct<lang: string, score: double>"


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; signs such as a half or a superscript are numbers."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(text))


def slots(word: str) -> list[int]:
    """Slots of a word's lexicon, affix and n-gram features; none for a word without letters."""
    return [s for part in parts(word) for s in part]


def parts(word: str) -> Iterator[list[int]]:
    """The slots of a word of any length, in lists of bounded size."""
    word = word.strip(_ENDS)
    if not has_letter(word):
        return
    for at in range(0, len(word), PART):
        found = ["w" + word, *("p" + word[:n] for n in (1, 2, 3)), *("s" + word[-n:] for n in (1, 2, 3))] if at == 0 else []
        found += ["g" + word[i : i + 3] for i in range(at, min(at + PART, len(word) - 2))]
        yield [crc32(f.encode("utf-8", "replace")) % SLOTS for f in found]


def spread(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word's number) of every feature of the words."""
    each = [np.array(slots(w), np.int64) for w in words]
    return np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(words)), [len(x) for x in each])


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """(words, languages) summed weights, divided by the root of the number of features."""
    at, row = spread(words)
    n = np.bincount(row, minlength=len(words))
    out = np.stack([np.bincount(row, weights[at, k], len(words)) for k in range(weights.shape[1])], axis=1)
    return out / np.sqrt(np.maximum(n, 1))[:, None]


def long_emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """What emissions gives, part by part, so that words of any length take bounded memory."""
    out = np.zeros((len(words), weights.shape[1]))
    for i, word in enumerate(words):
        n = 0
        for part in parts(word):
            out[i] += weights[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        out[i] /= np.sqrt(max(n, 1))
    return out


def messages(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, scaled emission) of every word, over many texts at once.

    emission holds the texts' words one after the other, longest text first; start and move are the logs of the
    initial and the transition potentials. Each step handles the words at one place of all texts that reach it.
    """
    n, k = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    a, first = np.exp(move - move.max()), np.exp(start - start.max())
    most = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")
    forward, backward = np.empty((n, k)), np.empty((n, k))
    f = first * e[begin]
    f /= f.sum(axis=1, keepdims=True)
    forward[begin] = f
    for t in range(1, most):
        m = active[t]
        f = (f[:m] @ a) * e[begin[:m] + t]
        f /= f.sum(axis=1, keepdims=True)
        forward[begin[:m] + t] = f
    b = np.ones((len(lengths), k))
    for t in range(most - 1, -1, -1):
        m = active[t]
        rows = begin[:m] + t
        backward[rows] = b[:m]
        x = (b[:m] * e[rows]) @ a.T
        b[:m] = x / x.sum(axis=1, keepdims=True)
    return forward, backward, e


def posteriors(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Label probabilities of every word."""
    forward, backward, _ = messages(emission, lengths, start, move)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def train(sequences: list[list[str]], labels: list[np.ndarray], k: int, rounds: int = 25) -> dict:
    """Weights, start and transition potentials that raise the likelihood of the labelled sequences."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    distinct: dict[str, int] = {}
    word = np.array([distinct.setdefault(w, len(distinct)) for i in order for w in sequences[i]])
    y = np.concatenate([labels[i] for i in order])
    at, row = spread(list(distinct))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(distinct)), 1))
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    follows = np.ones(len(y), bool)
    follows[begin] = False
    target = np.eye(k)[y]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:-1][follows[1:]], y[1:][follows[1:]]), 1)
    w, start, move = np.zeros((SLOTS, k)), np.zeros(k), np.zeros((k, k))
    seen = [np.full(x.shape, 1e-6) for x in (w, start, move)]
    n = len(y)
    for _ in range(rounds):
        emission = (np.stack([np.bincount(row, w[at, j], len(distinct)) for j in range(k)], axis=1) * scale[:, None])[word]
        forward, backward, e = messages(emission, lengths, start, move)
        p = forward * backward
        p /= p.sum(axis=1, keepdims=True)
        error = p - target
        by_word = np.stack([np.bincount(word, error[:, j], len(distinct)) for j in range(k)], axis=1) * scale[:, None]
        g_w = np.stack([np.bincount(at, by_word[row, j], SLOTS) for j in range(k)], axis=1) / n + 1e-7 * w
        # Expected transitions: both labels of each pair of neighbours, given their whole sequence.
        joint = forward[:-1][follows[1:]][:, :, None] * np.exp(move - move.max()) * (backward * e)[1:][follows[1:]][:, None, :]
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        grads = (g_w, error[begin].sum(axis=0) / len(begin), (expected - pairs) / n)
        for x, g, s, rate in zip((w, start, move), grads, seen, (1.0, 0.1, 0.2), strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return {"weights": w.astype(np.float32), "start": start, "move": move}


def fit(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id", fold: tuple[int, int] | None = (4, 2)) -> dict:
    """The field, trained on a bounded sample of documents outside the held-out fold."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    if fold is not None:
        rows = rows.filter(F.coalesce(remainder(F.col("key"), fold[0]), F.lit(-1)) != fold[1])
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.xxhash64("key", F.lit(11)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    few = rows.join(F.broadcast(counts), "lang").filter(place * F.col("n") < sample).select("lang", "text", place.alias("h"))
    total = F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("h", "text").rowsBetween(W.unboundedPreceding, 0))
    table = few.withColumn("total", total).filter(F.col("total") <= CHARS).drop("total").toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    texts, langs = table["text"].to_pylist(), table["lang"].to_pylist()
    names = sorted(set(langs))
    if not names:
        return {"names": [], "weights": np.zeros((1, 1), np.float32), "start": np.zeros(1), "move": np.zeros((1, 1))}
    runs = [(words[i : i + RUN], names.index(g)) for t, g in zip(texts, langs, strict=True) for words in [t.lower().split()] for i in range(0, len(words), RUN)]
    # Most sequences are runs of one text in order; every third splices runs that lie apart.
    sequences, labels, each = [], [], LENGTH // RUN
    step = max(1, len(runs) // 7)
    for i in range(0, len(runs), each):
        part = runs[i : i + each] if i // each % 3 else [runs[(i + j * step) % len(runs)] for j in range(each)]
        sequences.append([w for words, _ in part for w in words])
        labels.append(np.concatenate([np.full(len(words), y) for words, y in part]) if part else np.zeros(0, int))
    kept = [i for i, s in enumerate(sequences) if s]
    if not kept:
        return {"names": names, "weights": np.zeros((SLOTS, len(names)), np.float32), "start": np.zeros(len(names)), "move": np.zeros((len(names), len(names)))}
    return {"names": names} | train([sequences[i] for i in kept], [labels[i] for i in kept], len(names))


class Labeller:
    """A worker's copy of a field, with a bounded cache of word emissions."""

    def __init__(self, model: dict):
        self.model = model
        self.places: dict[str, int] = {}
        self.held = np.zeros((1024, len(model["names"])), np.float32)

    def learn(self, words: set[str]) -> None:
        """Make room for, and emissions of, all words of a batch."""
        new = [w for w in words if w not in self.places]
        if len(self.places) + len(new) > CACHE_WORDS:
            self.places.clear()
            new = list(words)
        at, n = len(self.places), len(self.places) + len(new)
        if n > len(self.held):
            self.held = np.concatenate([self.held, np.zeros((max(n, 2 * len(self.held)) - len(self.held), self.held.shape[1]), np.float32)])
        self.held[at:n] = emissions(new, self.model["weights"])
        self.places.update(zip(new, range(at, n), strict=True))

    def probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of the words of each non-empty text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        words = set().union(*texts)
        long = sorted(w for w in words if len(w) > CACHE_CHARS)
        self.learn(words.difference(long))
        places, held = self.places, self.held
        if long:
            n = len(places)
            held = np.concatenate([held[:n], long_emissions(long, self.model["weights"]).astype(np.float32)])
            places = places | dict(zip(long, range(n, n + len(long)), strict=True))
        emission = held[np.array([places[w] for i in order for w in texts[i]])].astype(np.float64)
        lengths = np.array([len(texts[i]) for i in order])
        p = posteriors(emission, lengths, self.model["start"], self.model["move"])
        out: list = [None] * len(texts)
        for i, part in zip(order, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
            out[i] = part
        return out

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        names = self.model["names"]
        wait: list[tuple[int, list[str]]] = []
        total = 0

        def flush() -> None:
            for (i, _), p in zip(wait, self.probabilities([w for _, w in wait]), strict=True):
                mean = np.round(p.mean(axis=0), 9)
                best = int(mean.argmax())
                out[i] = (names[best], float(min(max(mean[best], 0.0), 1.0)))
            wait.clear()

        for i, text in enumerate(texts):
            if names and text and has_letter(text):
                wait.append((i, text.lower().split()))
                total += len(wait[-1][1])
                if total >= TOGETHER:
                    flush()
                    total = 0
        if wait:
            flush()
        return out


def labeller(model: dict) -> Labeller:
    return held(f"language {crc32(model['weights'].tobytes())}", lambda: Labeller(model))


def identified(text: Column, model: dict) -> Column:
    """Column of a text's language and score."""

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        found = labeller(model).languages(texts.to_pylist())
        return pa.array([{"lang": a, "score": b} for a, b in found], pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return run(text)


def word_labels(text: Column, model: dict) -> Column:
    """Column of (word, lang, p) for each word of a text: where code-switched text changes its language."""

    @F.arrow_udf("array<struct<word: string, lang: string, p: double>>")
    def run(texts: pa.Array) -> pa.Array:
        own, out = labeller(model), []
        for t in texts:
            words = (t.as_py() or "").split()
            if not words or not model["names"]:
                out.append([])
                continue
            p = own.probabilities([[w.lower() for w in words]])[0]
            out.append([{"word": w, "lang": model["names"][int(x.argmax())], "p": float(x.max())} for w, x in zip(words, p, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))

    return run(text)


def identify(docs: DataFrame, model: dict | None = None, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column of language and score; without a model, one is fitted on docs."""
    return docs.withColumn(into, identified(docs[text], fit(docs, text=text) if model is None else model))
