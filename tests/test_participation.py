"""Named groups that took part in a match, with or without characters."""

import re

import pytest

from loomlog.functions.regexes import never_empty, translate
from loomlog.operators.matching import Matcher

LINES = ["", "x", "y", "xy", "xxz", "z", "abab", "aab1", "ab-ab", "q=7", "q=", "q", "(x)", "[x]", "zzyx z", "a1a1", "end"]
PATTERNS = [
    r"(?P<a>x*)|(?P<b>y)", r"(?P<b>y)|(?P<a>x*)", r"(?P<a>x)?(?P<b>y*)z", r"q=(?P<v>\d*)", r"(?:q(?P<v>=?)|z)+", r"(?P<a>(a|b)*)(?P<d>-?)(\2)?", r"(?P<w>[xyz]+)", r"(a)(?P<m>b|)(\1)", r"(?P<e>)", r"^(?P<s>)$",
    r"(?P<a>\(?)x(?P<c>\)?)", r"(?P<k>[]x]?)", r"(?P<n>(?=x))x|(?P<o>(?!x))z", r"((?P<p>a)|(?P<r>b)|(?P<t>\b))1", r"(?P<a_b>a?)(?P<c>b)(?P=a_b)",
]


def matches(compiled, line):
    """One match after another; behind an empty one, from the next place on (Python would try again for a longer one)."""
    at = 0
    while at <= len(line) and (m := compiled.search(line, at)):
        yield m
        at = m.end() + (m.end() == m.start())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_masks_are_what_took_part(spark, pattern):
    found = Matcher(pattern.replace("(?P=a_b)", r"\k<a_b>"), True, True, None, spark)
    rows = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = {r.line: r.m for r in rows.select("line", found.group_mask(rows.line).alias("m")).collect()}
    compiled = re.compile(pattern)
    names = sorted(compiled.groupindex, key=compiled.groupindex.get)
    assert found.group_names == names
    want = {x: sum(1 << k for k, n in enumerate(names) if any(m.group(n) is not None for m in matches(compiled, x))) for x in LINES}
    assert got == want


def test_plainly_never_empty():
    for pattern, want in ((r"(?<a>deadlock)", True), (r"(?<a>\d+)", True), (r"(?<a>[x]*)", False), (r"(?<a>[]x]y?)", True), (r"(?<a>a|)", False), (r"(?<a>(b))", False), (r"(?<a>\bx)", False), (r"(?<a>.)", True), (r"(?<a>x{0,2})", False)):
        assert never_empty(translate(pattern), 1) is want, pattern
