import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions.regexes import translate
from loomlog.operators.chart import ChartRequest, auto_bucket, chart, metric_label, percentiles, value_range
from loomlog.operators.result import Result
from loomlog.operators.search import Field, default_order

FIELDS = (Field("p.kind", "Kind", "string", translate("(x)")), Field("p.ms", "Duration", "number", translate("(x)")))
SCHEMA = "file_id long, entry_line long, ts timestamp_ntz, `p.kind` string, `p.ms` double, service_id string, file string, matched_groups long"


def at(hour, minute=0):
    return dt.datetime(2026, 7, 14, hour, minute)


def hits(spark, rows):
    return spark.createDataFrame([(1, k, *r, "s", "f", m) for k, (*r, m) in enumerate(rows)], SCHEMA)


def values(data):
    return [r.value for r in data.data.orderBy("series_rank", "label").collect()]


def test_hours_without_hits_count_zero(spark):
    data = chart(hits(spark, [(at(10, 5), None, None, 0), (at(10, 59), None, None, 0), (at(12), None, None, 0)]), ChartRequest(bucket="hour"))
    assert values(data) == [2, 0, 1] and data.charted == 3


def test_other_metrics_leave_gaps_empty(spark):
    data = chart(hits(spark, [(at(10), None, 100.0, 0), (at(10, 1), None, 300.0, 0), (at(12), None, 50.0, 0)]), ChartRequest(bucket="hour", metric="avg", value_field="p.ms"), FIELDS)
    assert values(data) == [200, None, 50] and data.metric_label == "Avg Duration"


@pytest.mark.parametrize("metric, n, expected", [("p95", 100, 95), ("p50", 100, 50), ("p99", 1, 1)])
def test_percentiles_are_nearest_rank(spark, metric, n, expected):
    rows = [(at(1), "k", float(v), 0) for v in range(1, n + 1)]
    assert values(chart(hits(spark, rows), ChartRequest("category", metric=metric, value_field="p.ms"), FIELDS)) == [expected]


def test_percentiles_of_any_values(spark):
    """Against sorting: values of both signs and of all sizes, ties, zeros, infinities and NaN."""
    rng = random.Random(5)
    draws = [lambda: rng.gauss(0, 1), lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300), lambda: float(rng.randint(-3, 3)), lambda: 1e6 + rng.random(), lambda: rng.choice((0.0, 5e-324, -5e-324, math.inf, -math.inf, math.nan, 1.7e308))]
    held = {(f"s{k}", b): [draw() for _ in range(rng.choice((1, 2, 40, 300)))] for k, draw in enumerate(draws) for b in range(3)}
    rows = spark.createDataFrame([(s, b, v) for (s, b), values in held.items() for v in values], "series string, bucket long, __value double")
    last = lambda v: (math.isnan(v), v if not math.isnan(v) else 0.0)
    for percent in (50, 95, 99):
        got = {(r.series, r.bucket): (r.value, r.n) for r in percentiles(rows, ("series", "bucket"), percent).collect()}
        want = {c: (sorted(values, key=last)[-(-percent * len(values) // 100) - 1], len(values)) for c, values in held.items()}
        assert {c: repr(v) for c, v in got.items()} == {c: repr(v) for c, v in want.items()}
    assert percentiles(rows.limit(0), ("series",), 50).count() == 0


def test_ranges_of_values_keep_their_order(spark):
    values = sorted({s * m * 2.0**e for s in (-1, 1) for m in (1.0, 1.0000001, 1.5, 1.9999999) for e in range(-1060, 1020, 13)} | {0.0, 5e-324, -5e-324, math.inf, -math.inf})
    ranges = [r.r for r in spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", value_range(F.col("v")).alias("r")).orderBy("k").collect()]
    assert ranges == sorted(ranges) and len(set(ranges)) > 600


def test_top_series_and_the_rest(spark):
    rows = [(at(1), k, v, 0) for k, v in (("Fast", 10.0), ("Slow", 900.0), ("Medium", 500.0))]
    data = chart(hits(spark, rows), ChartRequest("category", group_by="field", group_field="p.kind", metric="max", value_field="p.ms", top_n=2), FIELDS)
    assert [r.series for r in data.data.orderBy("series_rank").collect()] == ["Slow", "Medium"] and data.other_groups == 1


def test_custom_pattern_over_entries(spark):
    texts = ["GET /orders took 100 ms", "x\nGET /orders took 200 ms", "GET /users took 40 ms", "other"]
    h = hits(spark, [(at(1), None, None, 0)] * 4)
    t = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "file_id long, entry_line long, text string")
    request = ChartRequest("category", group_by="custom", metric="avg", value_source="custom", custom_regex=r"GET (?<key>\S+) took (?<value>\d+) ms")
    data = chart(h, request, FIELDS, texts=t)
    assert {r.series: r.value for r in data.data.collect()} == {"/orders": 150, "/users": 40} and data.skipped_no_key == 1


def test_services_are_shown_by_name(spark):
    rows = hits(spark, [(at(1), None, None, 0)] * 3).withColumn("service_id", F.concat(F.lit("s"), F.col("entry_line")))
    services = spark.createDataFrame([("s0", "Web"), ("s0", "Web"), ("s1", " "), ("s9", "Other")], "service_id string, name string")
    named = Result(rows, rows, rows, FIELDS, (), tuple(default_order())).named(services)
    assert {r.service_id: r.service_name for r in named.hits.collect()} == {"s0": "Web", "s1": "s1", "s2": "s2"} and named.hits.count() == 3
    assert {r.series for r in named.chart(ChartRequest("category", group_by="service")).data.collect()} == {"Web", "s1", "s2"}
    assert named.named(services).hits.columns == named.hits.columns


def test_every_matched_group_is_a_series(spark):
    data = chart(hits(spark, [(at(1), None, None, 2), (at(1), None, None, 1), (at(1), None, None, 3)]), ChartRequest(bucket="hour", group_by="matchedGroup"), FIELDS, ["err", "warn", "silent"])
    assert values(data) == [2, 2, 0] and data.charted == 3


def test_each_hit_is_skipped_for_one_reason(spark):
    rows = [(None, None, None, 0), (None, "k", None, 0), (None, "k", 1.0, 0), (at(1), "k", 1.0, 0)]
    d = chart(hits(spark, rows), ChartRequest(bucket="hour", group_by="field", group_field="p.kind", metric="sum", value_field="p.ms"), FIELDS)
    assert (d.skipped_no_key, d.skipped_no_value, d.skipped_no_time, d.charted) == (1, 1, 1, 1)


def test_empty_and_unknown(spark):
    assert values(chart(hits(spark, []), ChartRequest())) == []
    with pytest.raises(ValueError, match="not part of this result"):
        chart(hits(spark, []), ChartRequest(group_by="field", group_field="p.none"), FIELDS)
    with pytest.raises(ValueError, match="buckets"):
        chart(hits(spark, [(at(1), None, None, 0), (at(9), None, None, 0)]), ChartRequest(bucket="second"))


def test_bucket_ladder():
    assert [auto_bucket(s) for s in (120, 3600, 86400, 30 * 86400)] == [1, 60, 900, 21600]
    assert metric_label("count") == "Hits" and metric_label("p95", "Duration") == "P95 Duration"
