"""Runs of an entry's text to colour: the spans of named groups, or of whole matches. For pages of a result, not for scans."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import accumulate, islice, pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 200
PARTS = "array<struct<text:string,slots:array<int>>>"


def claims(text: str, pattern: re.Pattern, off: Sequence[str]) -> dict[tuple[int, int], set[int]]:
    """Stretches of the text that matches lay claim to, with the slots that do: k for the k-th named group, 0 for a match
    that has none. A group that is off claims nothing, nor does the match around it. Lines are matched each on its own."""
    slot = pattern.groupindex
    number = {name: k for k, name in enumerate(sorted(slot, key=slot.get), 1)}
    out: dict[tuple[int, int], set[int]] = {}
    matches = ((start, m) for start, line in lines_of(text) for m in islice(pattern.finditer(line), 1 if pattern.pattern.startswith("^") else None))
    for start, m in islice(matches, ROUNDS):
        took_part = {name: m.span(name) for name in slot if m[name]}
        stretches = [(number[n], span) for n, span in took_part.items() if n not in off] if took_part else [(0, m.span())] * bool(m[0])
        for k, (a, b) in stretches:
            out.setdefault((start + a, start + b), set()).add(k)
    return out


def lines_of(text: str) -> list[tuple[int, str]]:
    """Each line with its place in the text."""
    lines = text.split("\n")
    return list(zip(accumulate((len(x) + 1 for x in lines), initial=0), lines))


def highlight(text: str, query: str, is_regex: bool = True, case_sensitive: bool = False, off: Sequence[str] = ()) -> list[tuple[str, list[int]]]:
    """(text, slots) parts of a newline-joined entry. Of stretches that overlap, the one that begins first counts, or the
    longest of those; newlines are parts of their own. A pattern that does not compile colours nothing."""
    source = re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", query) if is_regex else re.escape(query)
    try:
        wanted = claims(text, re.compile(source, 0 if case_sensitive else re.IGNORECASE), off)
    except re.error:
        wanted = None
    if not wanted:
        return [(text, [])] if wanted is None else [(x, []) for x in re.split("(\n)", text) if x] or [("", [])]
    taken, free_from = {}, 0
    for a, b in sorted(wanted, key=lambda s: (s[0], -s[1])):
        if a >= free_from:
            taken[a, b], free_from = sorted(wanted[a, b]), b
    breaks = {m.start() + k for m in re.finditer("\n", text) for k in (0, 1)}
    edges = sorted({0, len(text)} | breaks | {x for span in taken for x in span})
    return [(text[a:b], taken.get((a, b), [])) for a, b in pairwise(edges)]


def highlighted(text: Column, query: str, is_regex: bool = True, case_sensitive: bool = False, off: Sequence[str] = ()) -> Column:
    @F.pandas_udf(PARTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": p, "slots": s} for p, s in highlight(t, query, is_regex, case_sensitive, off)])

    return run(text)
