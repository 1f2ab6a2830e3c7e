"""Charts over a result's hits: series over time buckets, or one value per category."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import translate
from ..functions.values import display, epoch, floor_to, mask_names, number

BUCKETS = {"second": 1, "minute": 60, "fiveMinutes": 300, "fifteenMinutes": 900, "hour": 3600, "sixHours": 21600, "day": 86400}
TARGET_BUCKETS, MOST_BUCKETS, MOST_SERIES = 200, 2000, 50
METRICS = ("count", "sum", "avg", "min", "max", "p50", "p95", "p99")
LABELS = {1: "1 s", 60: "1 min", 300: "5 min", 900: "15 min", 3600: "1 h", 21600: "6 h", 86400: "1 day"}


@dataclass(frozen=True)
class ChartRequest:
    mode: str = "timeline"  # or category
    bucket: str = "auto"
    group_by: str = "none"  # none, service, file, field, matchedGroup, custom
    metric: str = "count"
    group_field: str | None = None
    value_source: str = "field"  # or custom
    value_field: str | None = None
    custom_regex: str | None = None
    top_n: int = 10

    @property
    def needs_text(self) -> bool:
        return self.group_by == "custom" or (self.metric != "count" and self.value_source == "custom")


@dataclass
class ChartData:
    """data: label, series, series_rank, value. The counts say what was charted and what was left out, and why."""

    data: DataFrame
    bucket_seconds: int | None
    charted: int
    skipped_no_key: int
    skipped_no_value: int
    skipped_no_time: int
    other_groups: int
    metric_label: str


def auto_bucket(span_seconds: int) -> int:
    return next((b for b in BUCKETS.values() if span_seconds // b <= TARGET_BUCKETS), 86400)


def metric_label(metric: str, value_label: str | None = None) -> str:
    if metric == "count":
        return "Hits"
    return f"{metric.capitalize() if metric[0] != 'p' else metric.upper()} {value_label or 'value'}"


def aggregate(metric: str, value: Column) -> Column:
    """One value of a cell's points. NaN is left out of extremes. For percentiles see percentiles()."""
    if metric == "count":
        return F.count(F.lit(1)).cast("double")
    if metric in ("min", "max"):
        real = F.when(~F.isnan(value), value)
        return F.min(real) if metric == "min" else F.max(real)
    return F.sum(value) if metric == "sum" else F.avg(value)


def value_range(value: Column) -> Column:
    """A number that never falls as value grows, 256 of them for each doubling: a cell has some thousand ranges, however many
    its points are. NaN sorts last and shares the last range with infinity."""
    size = F.floor((F.log2(F.abs(value)) + 1075) * 256)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def percentiles(good: DataFrame, cell: Sequence[str], percent: int) -> DataFrame:
    """cell, value (nearest rank) and n of the points. Equal values are counted first. The counts of a cell's value ranges,
    summed up in order, tell the range that holds the rank; only the values of that range are sorted. So no task sees all
    values of a cell, and the counts are shuffled once for both steps."""
    counts = good.groupBy(*cell, value_range(F.col("__value")).alias("__range"), "__value").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy(*cell, "__range").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*cell).orderBy("__range")
    ranges = ranges.withColumn("__upto", F.sum("n").over(in_order)).withColumn("__all", F.sum("n").over(Window.partitionBy(*cell)))
    rank, before = F.ceil(F.lit(percent) * F.col("__all") / 100), F.col("__upto") - F.col("n")
    picked = ranges.where((F.col("__upto") >= rank) & (before < rank)).select(*cell, "__range", (rank - before).alias("__rank"), "__all")
    upto = F.sum("n").over(Window.partitionBy(*cell, "__range").orderBy("__value"))
    inside = counts.join(picked, [*cell, "__range"]).withColumn("__upto", upto)
    reached = F.when(F.col("__upto") >= F.col("__rank"), F.col("__value"))
    return inside.groupBy(*cell, "__range").agg(F.min(reached).alias("value"), F.first("__all").alias("n")).drop("__range")


def cells_of(good: DataFrame, cell: Sequence[str], metric: str) -> DataFrame:
    """cell, value, n."""
    if metric[0] == "p":
        return percentiles(good, cell, int(metric[1:]))
    return good.groupBy(*cell).agg(aggregate(metric, F.col("__value")).alias("value"), F.count(F.lit(1)).alias("n"))


def points(hits: DataFrame, request: ChartRequest, fields: Sequence, names: Sequence[str], texts: DataFrame | None) -> DataFrame:
    """__keys (array of series of the hit), __value, __time: what a hit contributes, null where it has none."""
    kinds = {f.key: f.kind for f in fields}
    for wanted in ([request.group_field] if request.group_by == "field" else []) + ([request.value_field] if request.metric != "count" and request.value_source == "field" else []):
        if wanted not in kinds:
            raise ValueError(f"Field {wanted} is not part of this result")
    rows, captured_key, captured_value = hits, None, None
    if request.needs_text:
        pattern = translate(request.custom_regex or "", True)
        t = texts.select(F.col("file_id").alias("__f"), F.col("entry_line").alias("__e"), F.col("text").alias("__text"))
        rows = hits.join(t, (hits["file_id"] == F.col("__f")) & hits["entry_line"].eqNullSafe(F.col("__e")), "left")
        match = F.col("__text").rlike(pattern.java)
        group = lambda name: F.regexp_extract("__text", pattern.java, pattern.number(name) or (1 if pattern.groups else 0))
        first = F.regexp_extract("__text", pattern.java, 1 if pattern.groups else 0)
        key = F.when(group("key") != "", group("key")).otherwise(first)
        captured_key = F.when(match & (F.trim(key) != ""), F.trim(key))
        captured_value = F.when(match, number(F.translate(group("value"), ",", ".")))
    shown = lambda k: display(F.col(f"`{k}`")) if kinds[k] == "number" else F.col(f"`{k}`")
    if request.group_by == "matchedGroup":
        keys = mask_names(F.col("matched_groups"), names)
        keys = F.when(F.size(keys) > 0, keys)
    else:
        one = {
            "none": lambda: F.lit("All"),
            "service": lambda: F.coalesce(F.col("service_name"), F.col("service_id")) if "service_name" in hits.columns else F.col("service_id"),
            "file": lambda: F.col("file"),
            "field": lambda: F.when(F.trim(shown(request.group_field)) != "", shown(request.group_field)),
            "custom": lambda: captured_key,
        }[request.group_by]()
        keys = F.when(one.isNotNull(), F.array(one))
    if request.metric == "count":
        value = F.lit(1.0)
    elif request.value_source == "custom":
        value = captured_value
    else:
        raw = F.col(f"`{request.value_field}`")
        value = raw if kinds[request.value_field] == "number" else number(raw)
    return rows.select(keys.alias("__keys"), value.alias("__value"), epoch(F.col("ts")).alias("__time"))


def chart(hits: DataFrame, request: ChartRequest, fields: Sequence = (), names: Sequence[str] = (), texts: DataFrame | None = None) -> ChartData:
    """Two jobs at most: one counts and finds the span (a single row), which settles the bucket; another counts the groups
    beyond the first ones. The chart itself is lazy."""
    if request.metric not in METRICS or request.mode not in ("timeline", "category"):
        raise ValueError("Unknown metric or mode")
    timeline = request.mode == "timeline"
    p = points(hits, request, fields, names, texts)
    reason = F.when(F.col("__keys").isNull(), "key").when(F.col("__value").isNull(), "value")
    reason = reason.when(F.lit(timeline) & F.col("__time").isNull(), "time").otherwise("ok")
    p = p.withColumn("__reason", reason)
    when = lambda r: F.coalesce(F.sum((F.col("__reason") == r).cast("long")), F.lit(0))
    ok = F.when(F.col("__reason") == "ok", F.col("__time"))
    counts = p.agg(when("ok").alias("ok"), when("key").alias("key"), when("value").alias("value"), when("time").alias("time"), F.min(ok).alias("low"), F.max(ok).alias("high")).first()
    good = p.where("__reason = 'ok'").select(F.explode("__keys").alias("series"), "__value", "__time")
    bucket = None
    if timeline and counts["low"] is not None:
        bucket = BUCKETS[request.bucket] if request.bucket != "auto" else auto_bucket(counts["high"] - counts["low"])
        n = (counts["high"] // bucket) - (counts["low"] // bucket) + 1
        if n > MOST_BUCKETS:
            raise ValueError(f"{n} buckets are too many; choose a larger bucket")
    top = max(1, min(request.top_n, MOST_SERIES))
    if timeline:
        cells = cells_of(good.withColumn("bucket", floor_to(F.col("__time"), bucket or 1)), ("series", "bucket"), request.metric)
        # Points are counted without the values: the sorting of percentiles is not planned a second time for the ranking.
        sized = good.select("series", F.lit(1).alias("n")) if request.metric[0] == "p" else cells
        totals = sized.groupBy("series").agg(F.sum("n").cast("double").alias("weight"))
    else:
        cells = cells_of(good, ("series",), request.metric).drop("n")
        totals = cells.withColumn("weight", F.coalesce("value", F.lit(float("-inf"))))
    if request.group_by == "matchedGroup":
        kept = [(n, k + 1) for k, n in enumerate(names[:MOST_SERIES])]
        ranked = hits.sparkSession.createDataFrame(kept or [("", 0)], "series string, series_rank int").where("series <> ''")
        other = 0
    else:
        # Sorted and cut before they are numbered: the one task of the window sees `top` rows.
        first = totals.orderBy(F.desc("weight"), "series").limit(top)
        ranked = first.withColumn("series_rank", F.row_number().over(Window.orderBy(F.desc("weight"), F.asc("series")))).drop("weight")
        # Without a grouping there is one series at most.
        other = 0 if request.group_by == "none" else max(0, good.select("series").distinct().count() - top)
    if not timeline:
        with_value = ranked.join(cells, "series", "left") if request.group_by == "matchedGroup" else ranked
        data = with_value.select(F.col("series").alias("label"), "series", "series_rank", "value")
        if request.group_by == "matchedGroup" and request.metric == "count":
            data = data.fillna(0.0, ["value"])
    elif bucket is None:
        data = ranked.select(F.lit(None).cast("string").alias("label"), "series", "series_rank", F.lit(None).cast("double").alias("value")).limit(0)
    else:
        low = counts["low"] // bucket * bucket
        high = counts["high"] // bucket * bucket
        grid = ranked.select("series", "series_rank", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(bucket))).alias("bucket"))
        value = F.col("value") if request.metric != "count" else F.coalesce("value", F.lit(0.0))
        label = F.date_format(F.timestamp_seconds("bucket"), "yyyy-MM-dd'T'HH:mm:ss")
        data = grid.join(cells.drop("n"), ["series", "bucket"], "left").select(label.alias("label"), "series", "series_rank", value.alias("value"))
    labels = {f.key: f.label for f in fields}
    return ChartData(data, bucket, counts["ok"], counts["key"], counts["value"], counts["time"], other, metric_label(request.metric, labels.get(request.value_field)))
