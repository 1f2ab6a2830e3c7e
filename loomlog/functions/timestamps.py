"""Timestamps at the start of log lines as Columns. Naive clock times (TIMESTAMP_NTZ); NULL where a line has none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import Pattern, translate

BUILT_IN = ("iso8601", "dotted-dmy", "us-mdy")


def _number(line: Column, at: int, size: int) -> Column:
    return F.substring(line, at, size).cast("int")


def _stamp(y: Column, m: Column, d: Column, hour: Column, minute: Column, seconds: Column) -> Column:
    # The constructor would take second 60 as the next minute.
    return F.when(seconds < 60, F.try_make_timestamp_ntz(y, m, d, hour, minute, seconds))


def _fraction(digits: Column) -> Column:
    """Seconds from the digits after a point, to a microsecond."""
    return F.rpad(F.substring(digits, 1, 6), 6, "0").cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(16,0)")


def iso8601(line: Column) -> Column:
    """yyyy-mm-dd, T or a space, hh:mm:ss, and a fraction of any width; what follows is ignored, an offset too."""
    fraction = F.regexp_extract(F.substring(line, 20, 32), r"^\.([0-9]+)", 1)
    seconds = _number(line, 18, 2).cast("decimal(16,6)") + F.when(fraction != "", _fraction(fraction)).otherwise(F.lit(0).cast("decimal(16,6)"))
    stamp = _stamp(_number(line, 1, 4), _number(line, 6, 2), _number(line, 9, 2), _number(line, 12, 2), _number(line, 15, 2), seconds.cast("decimal(16,6)"))
    return F.when(line.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), stamp)


def dotted(line: Column) -> Column:
    """dd.mm.yyyy hh:mm:ss and three digits of a fraction; a malformed fraction counts as none."""
    milli = F.regexp_extract(F.substring(line, 20, 4), r"^\.([0-9]{3})", 1)
    seconds = _number(line, 18, 2).cast("decimal(16,6)") + F.when(milli != "", _fraction(milli)).otherwise(F.lit(0).cast("decimal(16,6)"))
    stamp = _stamp(_number(line, 7, 4), _number(line, 4, 2), _number(line, 1, 2), _number(line, 12, 2), _number(line, 15, 2), seconds.cast("decimal(16,6)"))
    return F.when(line.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}"), stamp)


US = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}) ((?i:[AP]M)) "


def us(line: Column) -> Column:
    """M/D/YYYY h:mm:ss AM, and a third space after it."""
    part = lambda k: F.regexp_extract(line, US, k)
    hour = part(4).cast("int")
    hour24 = F.when(hour.between(1, 12), hour % 12 + F.when(F.upper(part(7)) == "PM", 12).otherwise(0))
    stamp = _stamp(part(3).cast("int"), part(1).cast("int"), part(2).cast("int"), hour24, part(5).cast("int"), part(6).cast("decimal(16,6)"))
    return F.when(line.rlike(US), stamp)


def by_pattern(line: Column, pattern: Pattern) -> Column:
    """Named groups y, m, d, H, M, S and perhaps f (a fraction of any width), wherever the pattern matches."""
    part = lambda name: F.regexp_extract(line, pattern.java, pattern.number(name))
    whole = lambda name: F.when(part(name).rlike(r"^\+?[0-9]{1,9}$"), part(name)).try_cast("int")
    seconds = whole("S").cast("decimal(16,6)")
    if pattern.number("f"):
        digits = F.regexp_extract(part("f"), "^[0-9]+", 0)
        seconds = seconds + F.when(digits != "", _fraction(digits)).otherwise(F.lit(0).cast("decimal(16,6)"))
    return F.when(line.rlike(pattern.java), _stamp(whole("y"), whole("m"), whole("d"), whole("H"), whole("M"), seconds.cast("decimal(16,6)")))


def parse(line: Column, formats: Sequence[str | Pattern] = ()) -> Column:
    """The first format that fits, in the given order; without formats, the built-in ones. Built-in formats start with a
    digit, so other lines skip them at the price of one character."""
    known = {"iso8601": iso8601, "dotted-dmy": dotted, "us-mdy": us}
    digit = F.substring(line, 1, 1).between("0", "9")
    tried = [known[f](line) if isinstance(f, str) else by_pattern(line, f) for f in (formats or BUILT_IN)]
    if all(isinstance(f, str) for f in (formats or BUILT_IN)):
        return F.when(digit, F.coalesce(*tried))
    return F.coalesce(*[F.when(digit, t) if isinstance(f, str) else t for f, t in zip(formats, tried)])


def parse_by(tag: Column, line: Column, formats: Mapping[str, Sequence[str | Pattern]]) -> Column:
    """parse() by the formats of the line's tag (the pack or service it is from); other tags have the built-in formats.
    Tags with the same formats share one pass."""
    tags: dict[tuple, list[str]] = {}
    for name, own in formats.items():
        tags.setdefault(tuple(own), []).append(name)
    out = parse(line)
    for own, names in tags.items():
        if own:
            out = F.when(tag.isin(*names), parse(line, own)).otherwise(out)
    return out


def custom(regex: str) -> Pattern:
    pattern = translate(regex)
    missing = [g for g in ("y", "m", "d", "H", "M", "S") if pattern.number(g) is None]
    if missing:
        raise ValueError(f"lacks the groups {', '.join(missing)}")
    return pattern
