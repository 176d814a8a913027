"""Spans found in a text, and the digest columns that queries derive from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and end are code points, end exclusive; base marks spans that the fixed patterns give.
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: Column, kinds: list[str]) -> list[Column]:
    """n_<kind> of base spans, their base_sha256, and the string of all spans."""
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]
