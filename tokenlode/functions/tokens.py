"""Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """The words of a text in lower case: runs of letters and digits. A null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def byte_order(token: Column, width: int) -> Column:
    """A non-negative number that orders ids as their little-endian bytes do."""
    t = token.cast("bigint")
    out = F.lit(0).cast("bigint")
    for k in range(width):
        out = out + F.shiftleft(F.shiftright(t, 8 * k).bitwiseAND(255), 8 * (width - 1 - k))
    return out


def display(tokens: Column, start: Column, end: Column) -> Column:
    """tokens[start:end], clipped to the array."""
    lo = F.greatest(start, F.lit(0))
    return F.slice(tokens, (lo + 1).cast("int"), F.greatest(F.least(end, F.size(tokens)) - lo, F.lit(0)).cast("int"))


def count_bucket(n: Column) -> Column:
    """The name of the frequency class of a count."""
    out = F.lit("very_high")
    for name, most in (("high", 1000), ("mid", 100), ("low", 20), ("rare", 5), ("ultra_rare", 1)):
        out = F.when(n <= most, name).otherwise(out)
    return out
