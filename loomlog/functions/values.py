"""Field values: numbers, GUIDs, display text, sets of matched groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
GUID = r"^-*(?:[0-9a-fA-F]-*){32}$"
#: As many named groups as a hit's mask remembers.
MASK_BITS = 32


def number(text: Column) -> Column:
    """A finite number, or NULL. The guard keeps out what only one engine would read, such as '1d'."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(NUMBER), trimmed).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def guid(text: Column) -> Column:
    return F.when(text.rlike(GUID), F.lower(text))


def display(value: Column) -> Column:
    """A number as shown: whole ones below 1e15 without a point, others in plain decimals."""
    shortest = value.cast("string")
    plain = F.when(shortest.contains("E"), F.rtrim(F.rtrim(F.format_string("%.20f", value), F.lit("0")), F.lit("."))).otherwise(shortest)
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.try_cast("bigint").cast("string")).otherwise(plain)


def mask(flags: Sequence[Column]) -> Column:
    """One bit for each of the first MASK_BITS flags that is true."""
    out = F.lit(0).cast("long")
    for k, flag in enumerate(flags[:MASK_BITS]):
        out = out.bitwiseOR(F.when(flag, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mask_names(value: Column, names: Sequence[str]) -> Column:
    bits = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(names[:MASK_BITS])])
    if not names:
        return F.array().cast("array<string>")
    return F.transform(F.filter(bits, lambda b: value.bitwiseAND(b["bit"]) != 0), lambda b: b["name"])


def floor_to(seconds: Column, size: int) -> Column:
    """Start of the bucket of `size` seconds, also before 1970."""
    return seconds - F.pmod(seconds, F.lit(size))


def epoch(ts: Column) -> Column:
    """Whole seconds of a naive clock time since 1970, rounded down."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")
