"""Toxicity by multiple-instance learning: sentences are scored, a document is toxic if any of its sentences is.

A sentence's probability is logistic in the summed weights of its words; a document's is their noisy-or,
1 - prod(1 - p). Only document labels are known: the gradient shares a document's label among its sentences.
The fit uses a bounded sample of labelled documents (``SAMPLE`` of each class, by hash of the id), words that
enough of them hold (``LEAST_DOCS`` and ``LEAST_SHARE``), and an L1 penalty, so that chance words keep no weight. Document scores
are calibrated by a logistic curve on the fifth of the sample that the fit leaves out.

Null, empty and wordless texts have no sentence and the score of one without known words. Without labels of
both classes all scores are 0. Equal texts and repeated rows get equal scores. Ties among sentences go to the first. In a fit
an id counts once for each label, by the text that sorts first, and texts of more than ``quality.LONGEST`` characters take no
part; they are scored whole. An empty table gives an empty one. Other columns stay, but for one that has the result's name,
which the result replaces.
"""

from __future__ import annotations

import re
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import remainder
from tessera.llm.quality import calibrate, labelled

#: Labelled documents of each class that the fit uses at most, and the number and share of them that must hold a word.
SAMPLE, LEAST_DOCS, LEAST_SHARE = 1500, 4, 0.004
#: Score from which a document counts as toxic.
TOXIC_AT = 0.7
PENALTY, BIAS_ROUNDS = 1e-3, 40
#: Lengths of stems.
STEMS = (5, 7)

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")

SCHEMA = "struct<score: double, sentence: struct<start: int, end: int, p: double>>"


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of a text's sentences."""
    return [m.span() for m in SENTENCE.finditer(text)]


def features(text: str) -> set[str]:
    """A sentence's words, and the stems that longer words begin with."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def bags(texts: pa.Array) -> pa.Array:
    """Each text's sentences, as lists of distinct features."""
    return pa.array([[sorted(features(t[a:b])) for a, b in sentences(t)] for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", fold: tuple[int, int] | None = (3, 1)) -> dict:
    """Word weights, bias and calibration from labelled documents outside the held-out fold."""
    known = labels if fold is None else labels.filter(F.coalesce(remainder(F.col(key), fold[0]), F.lit(-1)) != fold[1])
    rows = labelled(docs, known, "toxic", sample, text, key).select("y", "h", F.arrow_udf(bags, "array<array<string>>")("text").alias("bags"))
    table = rows.toArrow().sort_by([("h", "ascending")])
    return learn(table["bags"].combine_chunks(), table["y"].to_numpy().astype(np.float64))


def learn(bags: pa.ListArray, y: np.ndarray, rounds: int = 160) -> dict:
    """The model of documents given as lists of sentences, each a list of distinct words, and of their labels.

    Weights are not negative: a word can make a sentence toxic, none can excuse it.
    """
    n = len(y)
    if len(set(y.tolist())) < 2:
        return {"weights": {}, "bias": -50.0, "slope": 1.0, "shift": 0.0}
    sentence_doc = np.repeat(np.arange(n), np.diff(bags.offsets.to_numpy()))
    flat = bags.values
    word_sentence = np.repeat(np.arange(len(sentence_doc)), np.diff(flat.offsets.to_numpy()))
    coded = flat.values.dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    held_by = np.bincount(np.unique(sentence_doc[word_sentence] * len(vocabulary) + ids) % len(vocabulary), minlength=len(vocabulary))
    kept = held_by >= max(LEAST_DOCS, LEAST_SHARE * n)
    renumber = np.cumsum(kept) - 1
    use = kept[ids]
    ids, word_sentence = renumber[ids[use]], word_sentence[use]
    size, n_sentences = int(kept.sum()), len(sentence_doc)
    held = np.arange(n) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    weight = np.where(y == 1, 0.5 / max((y[~held] == 1).sum(), 1), 0.5 / max((y[~held] == 0).sum(), 1)) * ~held

    def forward(w: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(word_sentence, w[ids], n_sentences), -30, 30)))
        return p, np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)

    w, bias, pace, seen = np.zeros(size), -5.0, np.zeros(size + 1), np.zeros(size + 1)
    for i in range(rounds):
        p, clear = forward(w, bias)
        toxic = -np.expm1(clear)  # noisy-or of the document
        share = np.where(y == 1, -np.exp(clear) / np.maximum(toxic, 1e-6), 1.0)
        g_sentence = (weight * share)[sentence_doc] * p
        g = np.append(np.bincount(ids, g_sentence[word_sentence], size) + PENALTY, g_sentence.sum())
        if i < BIAS_ROUNDS:  # the bias alone first, so that common words start neutral
            g[:-1] = 0
        pace, seen = 0.9 * pace + 0.1 * g, 0.99 * seen + 0.01 * g * g
        step = 0.15 * pace / (np.sqrt(seen / (1 - 0.99 ** (i + 1))) + 1e-6)
        w, bias = np.clip(w - step[:-1], 0, 12), min(max(bias - step[-1], -12.0), 2.0)
    _, clear = forward(w, bias)
    raw = logit(clear)
    slope, shift = calibrate(raw[held], y[held]) if held.any() else (1.0, 0.0)
    names = np.array(vocabulary, object)[kept]
    return {"weights": {str(k): float(v) for k, v in zip(names, w, strict=True) if v > 0}, "bias": float(bias), "slope": max(slope, 1e-3), "shift": shift}


def logit(clear: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(clear)."""
    return np.log(np.maximum(-np.expm1(clear), 1e-12)) - clear


def scored(text: Column, model: dict) -> Column:
    """Column of a document's score and its most toxic sentence."""
    weights, bias, slope, shift = model["weights"], model["bias"], model["slope"], model["shift"]

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        base = 1 / (1 + exp(-max(bias, -30.0)))
        out = []
        get = weights.get
        for t in texts:
            s = t.as_py() or ""
            clear, best, where = 0.0, -1.0, None
            for a, b in sentences(s):
                z = bias
                for word in features(s[a:b]) & weights.keys():
                    z += get(word)
                p = base if z == bias else 1 / (1 + exp(-min(max(z, -30.0), 30.0)))
                clear += log1p(-min(p, 1 - 1e-9))
                if p > best:
                    best, where = p, {"start": a, "end": b, "p": p}
            toxic = max(1 - exp(clear), 1e-12)
            raw = slope * (log(toxic) - clear) + shift
            out.append({"score": 1 / (1 + exp(-min(max(raw, -50.0), 50.0))), "sentence": where})
        return pa.array(out, pa.struct([("score", pa.float64()), ("sentence", pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))]))

    return run(text)


def detect(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", into: str = "toxicity") -> DataFrame:
    """docs with a struct column of the score and the place of the most toxic sentence."""
    return docs.withColumn(into, scored(docs[text], fit(docs, labels, text=text, key=key)))
