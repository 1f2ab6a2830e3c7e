import pytest
from pyspark.sql import functions as F

from loomlog.functions import regexes, timestamps, values


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "line string").select(column(F.col("line")).alias("v")).first()[0]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("13.07.2026 00:00:02.611 INFO", "2026-07-13 00:00:02.611000"),
        ("14.07.2026 01:16:45 x", "2026-07-14 01:16:45"),
        ("14.07.2026 01:16:45.6x x", "2026-07-14 01:16:45"),
        ("7/14/2026 1:15:55 AM debug", "2026-07-14 01:15:55"),
        ("7/14/2026 12:15:55 PM debug", "2026-07-14 12:15:55"),
        ("7/14/2026 1:15:55 AM", None),
        ("2026-07-15T08:08:09.9533870Z GET", "2026-07-15 08:08:09.953387"),
        ("2026-07-15 08:08:09", "2026-07-15 08:08:09"),
        ("2026-02-30 08:08:09", None),
        ("2026-07-15 08:08:60", None),
        ("   at Foo.Bar()", None),
        ("", None),
    ],
)
def test_built_in_timestamps(spark, line, expected):
    assert one(spark, line, lambda c: timestamps.parse(c).cast("string")) == (expected.rstrip("0").rstrip(".") if expected and "." in expected else expected)


def test_custom_timestamp(spark):
    p = timestamps.custom(r"\[(?P<y>\d{4})/(?<m>\d+)/(?<d>\d+) (?<H>\d+):(?<M>\d+):(?<S>\d+)(?:,(?<f>\d+))?\]")
    assert str(one(spark, "x [2026/7/5 1:02:03,25] y", lambda c: timestamps.parse(c, [p]))) == "2026-07-05 01:02:03.250000"
    assert one(spark, "2026-07-05 01:02:03", lambda c: timestamps.parse(c, [p])) is None
    with pytest.raises(ValueError, match="lacks the groups"):
        timestamps.custom(r"(?<y>\d+)")


def test_translation_of_names_ends_and_flags(spark):
    p = regexes.translate(r"(?P<my_group>a+)$|[$\]](x)")
    assert p.names == (("my_group", 1),) and p.groups == 2
    assert one(spark, "baa", lambda c: c.rlike(p.java)) and not one(spark, "baa\n", lambda c: c.rlike(p.java))
    assert one(spark, "É", lambda c: c.rlike(regexes.translate("é", False).java))
    assert not one(spark, "É", lambda c: c.rlike(regexes.translate("é").java))
    assert one(spark, "a.b*c", lambda c: c.rlike(regexes.translate(regexes.escape("a.b*c")).java))
    with pytest.raises(ValueError, match="Invalid regex"):
        regexes.check(spark, regexes.translate("(a"))


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("^(?!.*a)(?!.*b)(?=.*c)", ("^(?=.*c)", "(?:a)|(?:b)")),
        (r"^(?!.*\))x", ("^x", r"(?:\))")),
        ("^(?![)]a)x", ("^x", "(?:[)]a)")),
        ("^(?!a)x|y", ("^x|y", "(?:a)")),
        ("(?!a)x", None),
        ("^(?!a", None),
        ("^x", None),
    ],
)
def test_nots_are_lifted(pattern, expected):
    assert regexes.lift_nots(pattern) == expected


def test_numbers_guids_and_display(spark):
    read = lambda t: one(spark, t, values.number)
    assert [read(t) for t in (" 42.5 ", "1e3", ".5", "NaN", "inf", "1d", "1e999", "")] == [42.5, 1000.0, 0.5, None, None, None, None, None]
    assert one(spark, "3306928E-1111-2222-3333-444455556666", values.guid) == "3306928e-1111-2222-3333-444455556666"
    assert one(spark, "3306928E", values.guid) is None
    shown = lambda v: spark.createDataFrame([(v,)], "v double").select(values.display(F.col("v"))).first()[0]
    assert [shown(v) for v in (5.0, 2.5, -3.0, 1.5e-7)] == ["5", "2.5", "-3", "0.00000015"]
    floors = spark.createDataFrame([(-5,), (7199,)], "v long").select(values.floor_to(F.col("v"), 3600)).collect()
    assert [r[0] for r in floors] == [-3600, 3600]
