import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomlog.functions.regexes import translate
from loomlog.operators.lines import around, entry_text, raw_search, raw_window, split_lines
from loomlog.operators.matching import Matcher
from loomlog.operators.result import search
from loomlog.operators.search import Field, Request, cap_of
from loomlog.plans.query_tree import Criterion, Group, parse, to_regex

from helpers import entries_of, files_table


def found(spark, text, request, fields=(), files=None, **options):
    texts = text if isinstance(text, dict) else {1: text}
    table = files_table(spark, files or [{"file_id": k, "log_date": dt.date(2026, 7, 14)} for k in texts])
    return search(entries_of(spark, texts, **options), table, request, fields)


def anchors(result):
    return sorted(r.line_no for r in result.hits.collect())


STACK = "14.07.2026 09:00:00 SELECT\n  from Adhikari\n  where x\n14.07.2026 09:00:01 Adhikari again\n"


def test_lines_split_on_newline_only(spark):
    df = spark.createDataFrame([(1, "one\r\ntwo\rx\nthree\n"), (2, ""), (3, None), (4, "a\n\n")], "file_id long, value string")
    assert [(r[0], r[1], r[2]) for r in split_lines(df).orderBy("file_id", "line_no").collect()] == [(1, 1, "one"), (1, 2, "two\rx"), (1, 3, "three"), (4, 1, "a"), (4, 2, "")]


def test_matching_lines_of_an_entry_are_one_hit(spark):
    assert anchors(found(spark, STACK, Request("adhikari"))) == [1, 4]
    assert anchors(found(spark, STACK, Request("adhikari", case_sensitive=True))) == []
    assert anchors(found(spark, STACK, Request(""))) == [1, 4]


@pytest.mark.parametrize("chunk", [1, 2, 3, 1_000_000])
def test_entries_do_not_depend_on_chunks(spark, chunk):
    text = "lead\n" + STACK + "tail\n"
    rows = entries_of(spark, {1: text, 2: STACK}, chunk=chunk).orderBy("file_id", "line_no").collect()
    assert [r.entry_line for r in rows] == [None, 2, 2, 2, 5, 5, 1, 1, 1, 4]


def test_veto_takes_the_whole_entry(spark):
    text = "".join(f"14.07.2026 09:00:0{k} {a}\n  {b}\n" for k, (a, b) in enumerate([("deadlock", "document x"), ("document", "deadlock"), ("deadlock", "row"), ("other", "row")]))
    query = "^(?!.*document)(?=.*?(?<name>deadlock))"
    result = found(spark, text, Request(query, True))
    assert anchors(result) == [5] and result.group_names == ("name",)
    tree = Group("all", [Criterion("document", "notContains"), Criterion("deadlock", label="name")])
    assert to_regex(tree) == query
    assert anchors(found(spark, text, Request(tree=tree))) == [5]


def test_time_window_and_offset(spark):
    text = "".join(f"14.07.2026 {h:02}:00:00 x\n" for h in (9, 12, 18))
    at = lambda h, m=0: dt.datetime(2026, 7, 14, h, m)
    assert anchors(found(spark, text, Request(time_from=at(11), time_to=at(13)))) == [2]
    files = [{"file_id": 1, "log_date": dt.date(2026, 7, 14), "log_offset_minutes": 120}]
    assert anchors(found(spark, text, Request(time_from=at(9, 59), time_to=at(10, 1)), files=files)) == [2]


def test_dates_filter_lines_of_undated_files_only(spark):
    text = "13.07.2026 09:00:00 x\n14.07.2026 09:00:00 x\n"
    day = dict(date_from=dt.date(2026, 7, 14), date_to=dt.date(2026, 7, 14))
    assert anchors(found(spark, text, Request(**day), files=[{"file_id": 1}])) == [2]
    assert anchors(found(spark, text, Request(**day))) == [1, 2]
    assert anchors(found(spark, text, Request(**day), files=[{"file_id": 1, "log_date": dt.date(2026, 7, 15)}])) == []


def test_head_block_is_dated_by_the_file_before(spark):
    head = "NEEDLE a\n  NEEDLE b\n15.07.2026 00:00:05 start NEEDLE\n"
    before = "14.07.2026 23:59:58 last\n"
    files = [{"file_id": 1, "log_date": dt.date(2026, 7, 14)}, {"file_id": 2, "log_date": dt.date(2026, 7, 15)}]
    rows = {r.line_no: str(r.ts) for r in found(spark, {1: before, 2: head}, Request("NEEDLE"), files=files).hits.collect()}
    assert rows == {1: "2026-07-14 23:59:58", 3: "2026-07-15 00:00:05"}
    alone = {r.line_no: str(r.ts) for r in found(spark, {2: head}, Request("NEEDLE"), files=files[1:]).hits.collect()}
    assert alone[1] == "2026-07-15 00:00:04.999000"
    other = [dict(files[0], instance="a"), dict(files[1], instance="b")]
    assert {r.line_no: str(r.ts) for r in found(spark, {1: before, 2: head}, Request("NEEDLE"), files=other).hits.collect()}[1] == "2026-07-15 00:00:04.999000"
    headless = {r.line_no: str(r.ts) for r in found(spark, {1: before, 2: "NEEDLE\n"}, Request("NEEDLE"), files=files).hits.collect()}
    assert headless == {1: "2026-07-14 23:59:58"}


def test_hourly_files_of_one_day(spark):
    texts = {h: f"14.07.2026 {h}:59:59 end\n" for h in (17, 18, 20)} | {19: "NEEDLE\n14.07.2026 19:00:10 x\n"}
    result = found(spark, texts, Request("NEEDLE"))
    assert [str(r.ts) for r in result.hits.collect()] == ["2026-07-14 18:59:59"]


FIELDS = (
    Field("app.level", "Level", "string", translate(r"\b(?<v>INFO|WARN|ERROR)\b")),
    Field("app.ms", "Duration", "number", translate(r"(\d+(?:\.\d+)?)ms"), "ms"),
    Field("app.login", "Login", "guid", translate(r"ID_Login:(?<v>\S+)")),
)


def test_fields_come_from_matched_lines(spark):
    text = "14.07.2026 09:00:00 INFO start 5ms\n  needle 42.5ms\n  needle 7ms\n14.07.2026 09:00:01 ERROR needle ID_Login:3306928E-1111-2222-3333-444455556666\n"
    rows = {r.line_no: r for r in found(spark, text, Request("needle"), FIELDS).hits.collect()}
    assert (rows[1]["app.level"], rows[1]["app.ms"]) == (None, 42.5)
    assert (rows[4]["app.level"], rows[4]["app.login"]) == ("ERROR", "3306928e-1111-2222-3333-444455556666")


def test_masks_and_groups(spark):
    text = "14.07.2026 09:00:00 WARN then ERROR\n14.07.2026 09:00:01 WARN\n14.07.2026 09:00:02 none\n"
    result = found(spark, text, Request("(?<err>ERROR)|(?<warn>WARN)|none", True, True))
    assert sorted(r.matched_groups for r in result.hits.collect()) == [0, 2, 3]
    assert anchors(result.without_groups(["warn"])) == [1, 3]
    page = result.page(context=1).collect()
    assert [r.groups for r in page] == [[], ["warn"], ["err", "warn"]]
    assert page[0].context_before == ["14.07.2026 09:00:01 WARN"] and page[0].context_after == []


NARROW = "\r\n".join(
    ["14.07.2026 09:00:00 GraphEmail one", "14.07.2026 09:00:01 ERROR a", "14.07.2026 09:00:02 x", "14.07.2026 09:00:03 GraphEmail two", "14.07.2026 09:00:04 y", "14.07.2026 09:00:05 z", "14.07.2026 09:00:06 GraphEmail three"]
) + "\r\n"


@pytest.mark.parametrize("before, after, expected", [(0, 0, []), (1, 0, []), (2, 0, [4]), (0, 1, [1]), (5, 0, [4, 7]), (1000, 1000, [1, 4, 7])])
def test_narrow_looks_around(spark, before, after, expected):
    result = found(spark, NARROW, Request("GraphEmail"))
    kept = result.narrow("error", before=before, after=after)
    assert anchors(kept) == expected
    assert anchors(result.narrow("error", before=before, after=after, invert=True)) == sorted({1, 4, 7} - set(expected))
    assert anchors(kept.undo()) == [1, 4, 7]


def test_sort_is_stable_and_reverses(spark):
    text = "lead x\n" + "".join(f"14.07.2026 09:00:0{k} x {v}ms\n" for k, v in enumerate([5, 5, 9])) + "14.07.2026 09:00:04 x\n"
    result = found(spark, {1: text}, Request("x"), FIELDS, files=[{"file_id": 1}])
    order = lambda r: [h.line_no for h in r.sorted_hits().collect()]
    assert order(result)[0] == 5
    up, down = order(result.sort("app.ms")), order(result.sort("app.ms", False))
    assert up[:3] == [3, 2, 4] and down == up[::-1]
    with pytest.raises(ValueError, match="Unknown sort field: k"):
        result.sort("k")
    assert result.populated_columns() == ["app.ms"]


@pytest.mark.parametrize(
    "query, text, excluded, expected",
    [
        ("(?<a>foo)", "x foo", (), "foo"),
        ("(?<a>foo).*(?<b>bar)", "foo and bar", (), "foo bar"),
        ("(?<a>foo).*(?<b>bar)", "foo and bar", ("a",), "bar"),
        ("fo+", "x\n  fooo", (), "fooo"),
        ("(f)oo", "foo", (), "foo"),
        ("nope", "foo", (), None),
    ],
)
def test_isolated_part(spark, query, text, excluded, expected):
    m = Matcher(query, True, True)
    assert spark.createDataFrame([(text,)], "t string").select(m.isolated(F.col("t"), excluded)).first()[0] == expected


def test_export_follows_order(spark, tmp_path):
    result = found(spark, STACK, Request("Adhikari"))
    assert [r.line for r in result.export().collect()] == ["14.07.2026 09:00:01 Adhikari again", "14.07.2026 09:00:00 SELECT\n  from Adhikari\n  where x"]
    result.write(str(tmp_path / "out"), extract=Matcher("Adh\\w+", True))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Adhikari", "Adhikari"]


@pytest.mark.parametrize("text, expected", [("foo\nbar", True), ("foo", True), ("foo\nno", False), ("", False)])
def test_entry_matching(spark, text, expected):
    m = Matcher("^(?!.*no)(?=.*foo)", True)
    assert spark.createDataFrame([(text,)], "t string").select(m.entry_matches(F.col("t"))).first()[0] is expected


def test_raw_view(spark):
    lines = split_lines(spark.createDataFrame([(1, "alpha\nBETA\nalpha beta\ngamma\n")], "file_id long, value string"))
    assert [r.line for r in raw_window(lines, 1, 2).collect()] == ["BETA", "alpha beta"]
    assert [r.line for r in raw_window(lines, 3, 9).collect()] == ["gamma"]
    total, first = raw_search(lines, Matcher("beta").line_matches(F.col("line")), 1)
    assert total.first()[0] == 2 and [r.line for r in first.collect()] == ["BETA"]
    assert raw_search(lines, None)[0].first()[0] == 0


def test_context_and_entry_text_limit(spark):
    lines = split_lines(spark.createDataFrame([(1, "1\n2\n3\n4\n5\n")], "file_id long, value string"))
    rows = {r.line: (r.context_before, r.context_after) for r in around(lines, 1, 1).collect()}
    assert rows["3"] == (["2"], ["4"]) and rows["5"] == (["4"], []) and rows["1"] == ([], ["2"])
    text = "14.07.2026 09:00:00 a\n" + "x" * 50 + "\n" + "y" * 50 + "\n"
    assert entry_text(entries_of(spark, {1: text}), limit=60).first().text == text[:72]


def test_caps():
    assert [cap_of(n) for n in (0, 5, 2_000_000)] == [None, 100_000, 2_000_000]


TREES = [
    Group("any", [Criterion("a.b", label="one"), Criterion("c+", "regex")]),
    Group("all", [Criterion("x"), Criterion("y", label="2nd"), Criterion("z", "notContains")]),
    Group("all", [Group("any", [Criterion("a"), Criterion("b")]), Criterion("c")]),
    Group("any", [Group("all", [Criterion("a"), Criterion("b", "regex")]), Group("all", [Criterion("c"), Criterion("d")])]),
    Group("all", [Criterion("no", "notRegex")]),
    Group("all", [Criterion("solo", label="me")]),
    Group("all", [Criterion("n", "notContains"), Group("any", [Criterion("a"), Criterion("b")])]),
]


@pytest.mark.parametrize("tree", TREES)
def test_tree_and_pattern_agree(spark, tree):
    pattern = to_regex(tree)
    back = parse(pattern)
    assert back is not None and to_regex(back) == pattern
    lines = ["a", "b", "a b", "c", "a c", "c d", "a.b", "axb c", "x y", "x y z", "no", "solo", "n a", "d", "ccc b"]
    text = "".join(f"14.07.2026 09:00:{k:02} {v}\n" for k, v in enumerate(lines))
    by_tree, by_pattern = found(spark, text, Request(tree=tree)), found(spark, text, Request(pattern, True))
    rows = lambda r: sorted((h.line_no, h.matched_groups) for h in r.hits.collect())
    if tree in (TREES[0],):  # alternation stops at the first branch at a place; the flags are those of the criteria
        assert anchors(by_tree) == anchors(by_pattern)
    else:
        assert rows(by_tree) == rows(by_pattern)


@pytest.mark.parametrize("pattern", ["foo", "(?<a>x)(?<b>y)", "^abc", "^(?=.*(a)", "(?<a>x)|y"])
def test_other_patterns_are_not_the_builders(pattern):
    assert parse(pattern) is None
