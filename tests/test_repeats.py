import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlog.functions.regexes import check, translate
from loomlog.functions.repeats import guarded
from loomlog.operators.matching import Matcher


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("(ab)*", "(ab)*"),  # a loop as it is
        ("(?:a|b|\\d)*b", "[ab\\d]*b"),
        ("(a|-|])+x", "([a\\-\\]])+x"),
        ("^(?:\\w+ )*\\z", "^(?:\\w+ )*+\\z"),
        ("(?:\\w+,)*x?", "(?:\\w+,)*+x?"),
        ("(?:,\\w+)*;", "(?:,\\w+)*+;"),
        ("(?:,\\w+)*?;", "(?:,\\w+)*+;"),
        ("(?:\\[\\w+\\] ?)+: ", "(?:\\[\\w+\\] ?)++: "),
        ("(?<g1>(?:ab|cd)+);", "(?<g1>(?:ab|cd)++);"),
        ("(?<g1>\\w+,)*;", "(?:(?>(?:\\w+,))(?=(?:\\w+,))){0,}+(?<g1>\\w+,)?;"),
        ("(?:(\\w)b?,){3,}+;", "(?:(\\w)b?,){3,}+;"),
        ("(?:(a)|bc)*;", "(?:(a)|bc){0,600};"),
        ("(?=(?:a+|b)*)x", "(?=(?:a+|b)*+)x"),
        ("(?:a|bc)*+a", "(?:a|bc)*+a"),
        ("(?:ab|cd){2,20}a", "(?:ab|cd){2,20}a"),
        ("(?:ab?)*?", "(?:ab?){0,800}?"),  # bounded from here on
        ("(?:a|ab)*c", "(?:a|ab){0,500}c"),
        ("(?:,\\w+)*x", "(?:,\\w+){0,800}x"),
        ("(?:a|ab){3,}\\b", "(?:a|ab){3,500}\\b"),
        ("(x)(?:a,|b)*\\1", "(x)(?:a,|b){0,500}\\1"),
        ("x(?i)(?:ab|c)*d", "x(?i)(?:ab|c){0,500}d"),
        ("\\Q(?:a|bc)*\\E", "\\Q(?:a|bc)*\\E"),
        ("(?:a|bc", "(?:a|bc"),
    ],
)
def test_repeats_are_rewritten(pattern, expected):
    got = guarded(pattern)
    counts = r"\{(\d+),\d{3,}\}"
    assert re.sub(counts, r"{\1,N}", got) == re.sub(counts, r"{\1,N}", expected)


atoms = st.sampled_from(["a", "b", "c", "[ab]", "[^a]", ".", "a+", "b*", "c?", "[bc]+?", "(?:ab|a)", "(b|c)", "(?=a)", "\\b"])
bodies = st.lists(st.lists(atoms, min_size=1, max_size=3).map("".join), min_size=1, max_size=3).map("|".join)
loops = st.builds(lambda body, opening, sign: f"{opening}{body}){sign}", bodies, st.sampled_from(["(?:", "("]), st.sampled_from(["*", "+", "*?", "+?", "{2,}", "{1,40}"]))
nested = st.builds(lambda a, b, c: f"(?:{a}{b}{c})*", atoms, loops, atoms)
patterns = st.lists(st.one_of(atoms, loops, nested), min_size=1, max_size=3).map("".join)


def found(spark, pattern, text):
    """Spans and groups of all matches, as Java finds them."""
    matcher = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher(text)
    out = []
    while matcher.find():
        out.append((matcher.start(), matcher.end(), *(matcher.group(i + 1) for i in range(matcher.groupCount()))))
    return out


def test_rewritten_patterns_find_the_same(spark):
    @settings(max_examples=1000, derandomize=True, deadline=None)
    @given(patterns, st.text("abc", max_size=9))
    def same(pattern, text):
        got = guarded(pattern)
        assert found(spark, got, text) == found(spark, pattern, text), got

    same()


LONG = 400_000


@pytest.mark.parametrize(
    "pattern, line, expected",
    [
        ("^(ab)*$", "ab" * LONG, True),
        ("^(?:a|b)*$", "ab" * LONG, True),
        ("^(?:a|b)*c", "ab" * LONG, False),
        ("^(?:\\w+ )*$", "ab " * LONG, True),
        ("^(?<w>\\w+,)*;", "ab," * LONG + ";", True),
        ("^(?:\\s*\\w+=\\w+;)+$", " k=v;" * LONG, True),
        ("^(?:a|ab)*c", "ab" * 50 + "c", True),
        ("^(?:a|ab)*c", "a" * LONG, False),
        ("^(?:(?:a|ab)*x|y)*z", "aax" * LONG, False),
        ("^(?:a|ab)*c", "ab" * LONG + "c", False),  # more repetitions than are looked at
    ],
)
def test_long_lines_end_no_task(spark, pattern, line, expected):
    java = check(spark, translate(pattern)).java
    lines = spark.createDataFrame([(line,)], "line string")
    assert lines.select(F.col("line").rlike(java)).first()[0] is expected


def test_groups_and_masks_of_rewritten_patterns(spark):
    matcher = Matcher("^(?<key>\\w+,)*(?<rest>(?:x|y)+)?;", is_regex=True)
    lines = ["a,bc,;", "a,xy;", "xyx;", ";", "a"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", matcher.group_mask(F.col("line")).alias("m")).collect()
    assert dict(got) == {"a,bc,;": 1, "a,xy;": 3, "xyx;": 2, ";": 0, "a": 0}
