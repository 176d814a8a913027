"""Scalar functions: numbers in several encodings, addresses, signatures, text balances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits that one step of the conversion takes.
STEP = 12


def to_decimal(value: Column, fmt: str) -> Column:
    """Decimal text, hexadecimal text, big-endian bytes or an integer as decimal(38,0); null where it does not fit or parse."""
    if fmt in ("text", "int"):
        return F.trim(value.cast("string")).try_cast("decimal(38,0)")
    digits = F.hex(value) if fmt == "binary" else F.upper(F.regexp_replace(F.trim(value), "^0[xX]", ""))
    bare = F.regexp_replace(digits, "^0+", "")
    wide = F.lpad(bare, 3 * STEP, "0")
    parts = [F.conv(F.substring(wide, 1 + i * STEP, STEP), 16, 10).try_cast("decimal(38,0)") for i in range(3)]

    def join(acc: Column, part: Column) -> Column:
        return F.try_add(F.try_multiply(acc, F.lit(16**STEP).cast("decimal(15,0)")), part).cast("decimal(38,0)")

    fits = (F.length(bare) <= 32) & bare.rlike("^[0-9A-F]*$")
    return F.when(fits, reduce(join, parts))


def to_address(value: Column, binary: bool) -> Column:
    """Lower-case 0x text of the last 20 bytes of a binary or text value."""
    digits = F.lower(F.hex(value)) if binary else F.lower(F.regexp_replace(F.trim(value), "^0[xX]", ""))
    return F.when(digits.isNull(), None).otherwise(F.concat(F.lit("0x"), F.right(F.lpad(digits, F.greatest(F.lit(40), F.length(digits)), F.lit("0")), F.lit(40))))


def has_signatures(code: Column, signatures: list[str]) -> Column:
    """Whether a text holds all of the signatures."""
    return reduce(lambda a, s: a & code.contains(s), signatures, F.lit(True))


def proxy_target(code: Column) -> Column:
    """The address that a minimal proxy's bytecode embeds, else null."""
    found = F.regexp_extract(F.lower(code), "^(?:0x)?363d3d373d3d3d363d73([0-9a-f]{40})5af43d82803e903d91602b57fd5bf3", 1)
    return F.when(found != "", F.concat(F.lit("0x"), found))


def impossible_balance(text: Column) -> Column:
    """Whether a balance's text is beyond any ledger: 77 digits or more, as all above 2^255 - 1, or a printed 2^256."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^0-9].*$", ""), "^0+", "")
    return (F.length(digits) >= 77) | digits.startswith(str(2**256)[:60])


def holds_any(tokens: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, wanted)))


def n_assets(json: Column) -> Column:
    return F.coalesce(F.json_array_length(json), F.lit(0))


def weight_l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two weight maps over all their keys."""
    apart = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return F.aggregate(F.map_values(apart), F.lit(0.0), lambda s, x: s + x)


def month_index(day: Column, year: int = 2020) -> Column:
    return (F.year(day) - year) * 12 + F.month(day)


def is_true(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "y", "yes", "pass", "success", "1")
