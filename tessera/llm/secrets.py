"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class with an allow-list.

Candidate strings are runs of token characters, cut at stretches on the allow-list. A window of ``WINDOW`` characters slides over each; its counts
change by one character in and one out, so a step costs the same at any width. Windows whose entropy reaches
the threshold of their own character class join into a span. Windows without both a letter and a digit give none;
nor do spans inside a base span.

Null text counts as empty: no spans. Equal texts and repeated rows give equal spans, in order of start; spans that start
together are in the order of KINDS, entropy last. Text of any length is scanned in one pass, and base and added spans are
compared in one sweep. An empty table gives an empty one. Other columns stay, but for one that has the result's name, which
the result replaces.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import SPANS

KINDS = ["assign", "access", "hex"]
ADDED = "entropy"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Bits a character that a window must reach, by the class of its characters: of the class's log2 size, some four fifths.
CLASSES = [("hex", (_DIGITS + "abcdef", _DIGITS + "ABCDEF"), 3.0), ("word", (_LOWER + _DIGITS + "_-", _UPPER + _DIGITS + "_-"), 3.4), ("base64", (_LOWER + _UPPER + _DIGITS + "+/_=-",), 3.6)]


def _rising(run: str, least: int = 8) -> str:
    """A pattern of the run's first characters, least of them or more."""
    more = run[least:]
    return run[:least] + "".join("(?:" + c for c in more) + ")?" * len(more)


#: Stretches that look random and are no secrets: identifiers in UUID form, published example keys, alphabets and a leading date.
#: No window covers one; what is left on each side of it is scanned.
ALLOWED = re.compile("|".join([r"(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])", r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYz?EXAMPLEKEY", "EXAMPLE", *map(_rising, (_LOWER, _UPPER, _DIGITS)), r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"]))

_GAIN = [0.0, *(c * log2(c) for c in range(1, WINDOW + 1))]


def _lanes(c: str) -> int:
    """16 bits each: whether a character is outside the four small sets of CLASSES, a digit, a letter."""
    outside = [c not in chars for _, sets, _ in CLASSES[:2] for chars in sets]
    return sum(int(x) << 16 * i for i, x in enumerate([*outside, c.isdigit(), c.isalpha()]))


_LANES = {c: _lanes(c) for c in CLASSES[2][1][0]}
_LANE = (1 << 16) - 1


def _least(mix: int) -> float:
    """Bits that a window must reach, from the sums of its characters' lanes."""
    if not mix & _LANE or not mix >> 16 & _LANE:
        return CLASSES[0][2]
    return CLASSES[1][2] if not mix >> 32 & _LANE or not mix >> 48 & _LANE else CLASSES[2][2]


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(start, end, greatest entropy) of the high-entropy stretches of a text's candidate strings."""
    gain = _GAIN if window == WINDOW else [0.0, *(c * log2(c) for c in range(1, window + 1))]
    out: list[tuple[int, int, float]] = []
    for m in CANDIDATE.finditer(text):
        begin = m.start()
        for allowed in ALLOWED.finditer(m[0]):
            out += _stretches(text[begin : m.start() + allowed.start()], begin, window, gain)
            begin = m.start() + allowed.end()
        out += _stretches(text[begin : m.end()], begin, window, gain)
    return out


def _stretches(s: str, at: int, window: int, gain: list[float]) -> list[tuple[int, int, float]]:
    """The high-entropy stretches of a string of token characters that starts at a place of a text."""
    out: list[tuple[int, int, float]] = []
    if len(s) < window:
        return out
    counts: dict[str, int] = {}
    total, mix = 0.0, 0
    for i, c in enumerate(s):
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old], total, mix = n - 1, total + gain[n - 1] - gain[n], mix - _LANES[old]
        n = counts.get(c, 0)
        counts[c], total, mix = n + 1, total + gain[n + 1] - gain[n], mix + _LANES[c]
        if i < window - 1:
            continue
        bits, begin = log2(window) - total / window, at + i - window + 1
        if bits >= _least(mix) - 1e-9 and mix >> 64 & _LANE and mix >> 80 & _LANE:
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], at + i + 1, max(out[-1][2], bits))
            else:
                out.append((begin, at + i + 1, bits))
    return out


def find(text: str) -> list[dict]:
    """All spans of a text, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    spans = [{"kind": k, "start": a, "end": b, "base": True, "score": None} for k, a, b in found]
    bases, i, reach = sorted((x, y) for _, x, y in found), 0, -1  # reach: the furthest end of base spans that begin no later
    for a, b, bits in entropy_spans(text):
        while i < len(bases) and bases[i][0] <= a:
            reach, i = max(reach, bases[i][1]), i + 1
        if b > reach:
            spans.append({"kind": ADDED, "start": a, "end": b, "base": False, "score": round(bits, 6)})
    order = [*KINDS, ADDED]
    return sorted(spans, key=lambda s: (s["start"], order.index(s["kind"]), s["end"]))


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def secret_spans(text: Column) -> Column:
    """Column of the secrets' spans in a text column."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([find(t.as_py() or "") for t in texts], _TYPE)

    return run(text)


def scan(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """docs with a column of spans: kind, start, end, base and, for added ones, the entropy."""
    return docs.withColumn(into, secret_spans(docs[text]))
