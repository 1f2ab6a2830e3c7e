"""Patterns as users write them (linear-engine or look-around syntax) as java.util.regex patterns for rlike and friends.

Differences that matter: group names may hold underscores (Java's may not) and may be written (?P<n>; `$` is the end of
the text, never before a final newline; \\d, \\w, \\b and case folding are Unicode; `.` stops at newline only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .repeats import guarded

CASE_FLAGS = {True: "(?dU)", False: "(?idU)"}


@dataclass(frozen=True)
class Pattern:
    """A translated pattern: Java text, its named groups in order as (name, number), and how many groups it has."""

    java: str
    names: tuple[tuple[str, int], ...] = ()
    groups: int = 0
    source: str = field(default="", compare=False)

    def number(self, name: str) -> int | None:
        return dict(self.names).get(name)


def tokens(pattern: str):
    """(text, inside a character class) for each escape, and each other character."""
    i, depth = 0, 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            yield pattern[i : i + 2], depth > 0
            i += 2
            continue
        c = pattern[i]
        yield c, depth > 0
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        i += 1


def translate(pattern: str, case_sensitive: bool = True) -> Pattern:
    out, names, groups = [], [], 0
    rename: dict[str, str] = {}
    multiline = "(?m" in pattern
    parts = [*tokens(pattern)]
    i, first_in_class = 0, False
    while i < len(parts):
        text, inside = parts[i]
        if inside:
            # A ] that comes first in its class is a literal.
            out.append("\\]" if text == "]" and first_in_class else text)
            first_in_class = first_in_class and text == "^"
            i += 1
            continue
        if text == "[":
            first_in_class = True
            out.append(text)
        elif text == "$" and not multiline:
            out.append("\\z")
        elif text == "(":
            ahead = "".join(t for t, _ in parts[i + 1 : i + 4])
            opening = "?P<" if ahead.startswith("?P<") else "?<" if ahead.startswith("?<") and ahead[2:3] not in ("=", "!") else None
            if opening:
                groups += 1
                end = i + 1 + len(opening)
                name = ""
                while end < len(parts) and parts[end][0] != ">":
                    name += parts[end][0]
                    end += 1
                names.append((name, groups))
                rename[name] = f"g{groups}"
                out.append(f"(?<g{groups}>")
                i = end + 1
                continue
            if not ahead.startswith("?"):
                groups += 1
            out.append("(")
        elif text == "\\k" and i + 1 < len(parts) and parts[i + 1][0] == "<":
            end = i + 2
            name = ""
            while end < len(parts) and parts[end][0] != ">":
                name += parts[end][0]
                end += 1
            out.append(f"\\k<{rename.get(name, name)}>")
            i = end + 1
            continue
        else:
            out.append(text)
        i += 1
    return Pattern(guarded(CASE_FLAGS[case_sensitive] + "".join(out)), tuple(names), groups, pattern)


def check(spark: SparkSession, pattern: Pattern) -> Pattern:
    """Fails while the query is planned, not when it runs."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern.java)
    except Exception as e:
        message = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise ValueError(f"Invalid regex: {message}") from None
    return pattern


def escape(text: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() and not c.isspace() and c != "_" else c for c in text)


def group_end(pattern: str, start: int) -> int:
    """Place of the parenthesis that closes the one at start, or -1."""
    at, depth = start, 0
    for text, inside in tokens(pattern[start:]):
        if not inside and text == "(":
            depth += 1
        elif not inside and text == ")":
            depth -= 1
            if depth == 0:
                return at
        at += len(text)
    return -1


def _named(java: str, number: int) -> tuple[int, int]:
    """Where the named group of this number stands in a translated pattern: its parenthesis and the closing one."""
    at, opening = 0, f"(?<g{number}>"
    for text, inside in tokens(java):
        if not inside and text == "(" and java.startswith(opening, at):
            return at, group_end(java, at)
        at += len(text)
    raise ValueError(f"no group {number}")


def never_empty(pattern: Pattern, number: int) -> bool:
    """Whether a named group plainly takes a character at least whenever it takes part: it begins with one that is not
    optional and has no alternatives. (False says nothing.)"""
    start, end = _named(pattern.java, number)
    parts = [*tokens(pattern.java[start + len(f"(?<g{number}>") : end])]
    if not parts or any(text == "|" and not inside for text, inside in parts):
        return False
    first = parts[0][0]
    after = 1
    if first == "[":
        while after < len(parts) and parts[after][1]:
            after += 1
    elif first in "(^$.*+?{" and first != "." or re.match(r"\\[bBAzZGQEk1-9]", first):
        return False
    return after >= len(parts) or parts[after][0] not in ("*", "?", "{")


def participation(pattern: Pattern, number: int) -> tuple[str, str, int, int]:
    """How to see whether a named group took part in a match, be it with no character: (pattern for lines, pattern for the
    empty line, group, group). Matches are the same; where the group took part, one of the two groups has a character.

    A group without content behind the named one takes part when that does, and only then a reference to it succeeds. So
    the whole, made atomic that it finds nothing else, is followed by that reference and, if it succeeds, by a look at
    the next or else the previous character, which is what can be told from nothing. An empty line has neither."""
    java = pattern.java
    start, end = _named(java, number)
    inner = start + len(f"(?<g{number}>")
    flags = java[: java.index(")") + 1]
    capturing = lambda at: java[at + 1] != "?" or java.startswith("(?<", at) and java[at + 3] not in "=!"
    out, at, opened, parts = [], 0, 0, [*tokens(java)]
    places = [0]
    for text, _ in parts:
        places.append(places[-1] + len(text))
    opened = sum(1 for (text, inside), at in zip(parts, places) if not inside and text == "(" and at < end and capturing(at))
    k = 0
    while k < len(parts):
        (text, inside), at = parts[k], places[k]
        out.append("(?:" if at == inner else "")
        if at == end:
            out.append(")(?<mark>)")
        if not inside and re.fullmatch(r"\\[1-9]", text):
            digits = text[1:]
            while k + 1 < len(parts) and parts[k + 1][0].isdigit() and int(digits + parts[k + 1][0]) <= pattern.groups:
                k += 1
                digits += parts[k][0]
            out.append(f"(?:\\{int(digits) + (int(digits) > opened)})")
        else:
            out.append(text)
        k += 1
    marked = f"{flags}(?>{''.join(out)[len(flags) :]})"
    return f"{marked}(?:\\k<mark>(?:(?=([\\s\\S]))|(?<=([\\s\\S]))))?", f"{marked}\\k<mark>", pattern.groups + 2, pattern.groups + 3


def lift_nots(pattern: str) -> tuple[str, str] | None:
    """`^(?!a)(?!b)rest` as (`^rest`, `(?:a)|(?:b)`); None where there is no such run, or where it does not close. A body's
    leading `.*` goes: what is searched for anywhere in a line need not be looked for behind anything, and with it a
    search would cost the square of a line's length."""
    if not pattern.startswith("^(?!"):
        return None
    at, bodies = 1, []
    while pattern.startswith("(?!", at):
        end = group_end(pattern, at)
        if end < 0:
            return None
        bodies.append(re.sub(r"^(?:\.\*\??(?![*+?{]))+", "", pattern[at + 3 : end]))
        at = end + 1
    return "^" + pattern[at:], "|".join(f"(?:{b})" for b in bodies)


def extract(text: Column, pattern: Pattern, group: int) -> Column:
    """Text of a group at the first match; NULL without a match. A group that took no part gives ''."""
    return F.when(text.rlike(pattern.java), F.regexp_extract(text, pattern.java, group))
