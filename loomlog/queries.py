"""Registered queries over the test tables, one or more per operator, and the SQL they are compared with.

Tables stand in for logs: `events` are dated hits, the lines of `documents` are log lines, turns of `conversations` are
lines whose user turns open entries, `pages` are status pages, `orders` and `lineitem` are manifests of stored files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import timestamps, values
from .functions.regexes import translate
from .operators.chart import ChartRequest, chart
from .operators.lines import around, entry_text, fill_forward, raw_search, split_lines
from .operators.matching import Matcher
from .operators.result import Result, search
from .operators.search import Field, Request, capped, default_order, head_times, hits_of, in_window, order_columns, pruned_files
from .plans.packs import Location
from .plans.query_tree import Criterion, Group
from .sources import catalog
from .sources.store import shared_path
from .sources.discovery import scrape
from .sources.sync import summary_of
from .streaming.growing import day_segments, prefix_cut

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark, sf_dir) -> DataFrame:
    return split_lines(table(spark, sf_dir, "documents"), text="text", key="doc_id")


def turns(spark, sf_dir) -> DataFrame:
    """Turns as lines of a file per conversation; user turns are headers, a minute apart from 2024-01-01 on."""
    t = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stamp = start + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("turn") + F.col("conv_id") * 10).cast("int"), F.lit(0))
    lines = t.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("line_no"), F.coalesce("text", F.lit("")).alias("line"), F.when(F.col("role") == "user", stamp).alias("ts"))
    head = F.when(F.col("ts").isNotNull(), F.struct(F.col("line_no").alias("entry_line"), F.col("ts").alias("entry_ts")))
    return fill_forward(lines, head, "__h").select("*", "__h.entry_line", "__h.entry_ts").drop("__h")


def conversation_files(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id")).distinct()
    return ids.select("file_id", F.concat(F.lit("s"), F.col("file_id") % 5).alias("service_id"), F.concat(F.lit("f"), "file_id").alias("file"), F.to_date(F.lit("2024-01-01")).alias("log_date"), F.col("file_id").alias("file_ord"))


TURNS = """
    WITH l AS (
        SELECT conv_id AS file_id, turn + 1 AS line_no, coalesce(text, '') AS line, role = 'user' AS head,
               CASE WHEN role = 'user' THEN TIMESTAMP '2024-01-01' + to_minutes(turn + conv_id * 10) END AS ts
        FROM conversations
    ), e AS (
        SELECT *, max(CASE WHEN head THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS entry_line,
               max(ts) OVER (PARTITION BY file_id ORDER BY line_no) AS entry_ts FROM l
    )
"""


def conversation_result(spark, sf_dir, request: Request, fields=()) -> Result:
    entries, files = turns(spark, sf_dir), conversation_files(spark, sf_dir)
    matcher = request.matcher(spark)
    return Result(hits_of(entries, files, request, fields, matcher), entries, files, tuple(fields), tuple(matcher.group_names), tuple(default_order()))


def event_hits(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("file_id"), F.col("event_id").alias("line_no"), F.col("event_id").alias("entry_line"), "ts", F.col("event_type").alias("app.type"), F.col("value").alias("app.value"), F.col("user_id").cast("string").alias("service_id"), F.lit("events").alias("file"), F.lit(0).cast("long").alias("matched_groups"), "props")


EVENT_FIELDS = (Field("app.type", "Type", "string", translate("(x)")), Field("app.value", "Value", "number", translate("(x)")))


@query("""
    SELECT doc_id, unnest(generate_series(1, len(p))) AS line_no, rtrim(unnest(p), chr(13)) AS line
    FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
""")
def line_split_numbering(spark, sf_dir):
    return document_lines(spark, sf_dir)


@query("SELECT event_id, ts FROM events")
def ts_parse_iso(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z GET'").alias("line"))
    return e.select("event_id", timestamps.parse(F.col("line")).alias("ts"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def ts_parse_dotted(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy HH:mm:ss.SSS 'INFO'").alias("line"))
    return e.select("event_id", timestamps.parse(F.col("line")).alias("ts"))


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def ts_parse_us(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "M/d/yyyy h:mm:ss a 'debug'").alias("line"))
    return e.select("event_id", timestamps.parse(F.col("line")).alias("ts"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def ts_parse_custom(spark, sf_dir):
    pattern = timestamps.custom(r"at (?<H>\d+):(?<M>\d+):(?<S>\d+)(?:,(?<f>\d+))? on (?<y>\d{4})/(?<m>\d+)/(?<d>\d+)")
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "'x at 'H:m:s,SSS' on 'yyyy/M/d").alias("line"))
    return e.select("event_id", timestamps.parse(F.col("line"), [pattern]).alias("ts"))


@query(TURNS + "SELECT file_id, line_no, entry_line, entry_ts FROM e")
def entry_anchor_fill(spark, sf_dir):
    return turns(spark, sf_dir).select("file_id", "line_no", "entry_line", "entry_ts")


@query(TURNS + "SELECT file_id, entry_line, min(line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM e GROUP BY ALL")
def entry_texts(spark, sf_dir):
    return entry_text(turns(spark, sf_dir), limit=1 << 30)


@query(TURNS + """
    , b AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY file_id, entry_line ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT file_id, entry_line, min(line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM b WHERE coalesce(before, 0) <= 300 GROUP BY ALL
""")  # fmt: skip
def entry_texts_capped(spark, sf_dir):
    return entry_text(turns(spark, sf_dir), limit=300)


HITS = """
    , h AS (
        SELECT file_id, entry_line, min(line_no) FILTER (WHERE {hit} AND NOT {out}) AS first_line, max(entry_ts) AS ts
        FROM e GROUP BY ALL HAVING bool_or({hit} AND NOT {out}) AND NOT bool_or({out})
    )
    SELECT file_id, coalesce(entry_line, first_line) AS line_no, ts FROM h WHERE ts IS NOT NULL
"""


def dated(result: Result) -> DataFrame:
    return result.hits.where("entry_line is not null").select("file_id", "line_no", "ts")


@query(TURNS + HITS.format(hit="contains(lower(line), 'tion the')", out="false"))
def entry_hits_any_line(spark, sf_dir):
    return dated(conversation_result(spark, sf_dir, Request("tion the")))


@query(TURNS + HITS.format(hit="contains(lower(line), 'the')", out="contains(lower(line), 'tion and')"))
def entry_veto(spark, sf_dir):
    return dated(conversation_result(spark, sf_dir, Request("^(?!.*tion and)(?=(?s:.*)the)", True)))


STORED = TURNS.replace("FROM conversations", "FROM conversations WHERE conv_id % 5 IN (1, 3) AND conv_id % 7 BETWEEN 2 AND 4")


def stored_result(spark, sf_dir) -> Result:
    """Two services and three days of a store of five services and seven days, written by ingestion and searched."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("file_id") % 7).cast("int"))
    files = conversation_files(spark, sf_dir).withColumn("log_date", day)
    path = shared_path(spark, "store")
    catalog.ingest(turns(spark, sf_dir).join(files.select("file_id", "service_id", "log_date"), "file_id"), path)
    request = Request("tion the", service_ids=("s1", "s3"), date_from=dt.date(2024, 1, 3), date_to=dt.date(2024, 1, 5))
    return search(catalog.stored_entries(spark, path), files, request)


@query(STORED + HITS.format(hit="contains(lower(line), 'tion the')", out="false"))
def stored_search(spark, sf_dir):
    return dated(stored_result(spark, sf_dir))


@query(STORED + ", h AS (SELECT file_id, entry_line FROM e WHERE contains(lower(line), 'tion the') GROUP BY ALL) SELECT string_agg(line, chr(10) ORDER BY line_no) AS line FROM e JOIN h ON h.file_id = e.file_id AND h.entry_line IS NOT DISTINCT FROM e.entry_line GROUP BY e.file_id, e.entry_line")
def stored_export(spark, sf_dir):
    return stored_result(spark, sf_dir).export()


CONVERSATION_HEADS = """
    , f AS (SELECT file_id, file_id % 5 AS service, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY ALL),
      a AS (SELECT f.file_id, f.first_ts, max(o.last_ts) AS before FROM f LEFT JOIN f AS o ON o.service = f.service AND o.file_id <> f.file_id AND o.last_ts <= f.first_ts GROUP BY ALL)
"""


@query(TURNS + CONVERSATION_HEADS + """
    , h AS (SELECT file_id, min(line_no) AS line_no FROM e WHERE entry_line IS NULL AND contains(line, 'the') GROUP BY file_id)
    SELECT file_id, line_no, coalesce(before, first_ts - INTERVAL 1 MILLISECOND) AS ts FROM h JOIN a USING (file_id)
""")  # fmt: skip
def head_block_hits(spark, sf_dir):
    result = conversation_result(spark, sf_dir, Request("the", case_sensitive=True))
    return result.hits.where("entry_line is null").select("file_id", "line_no", "ts")


PACK_FIELDS = (Field("p0.article", "Article", "string", translate(r"(?<v>the\w+)")), Field("p1.article", "Article", "string", translate(r"(?<v>and\w+)")), Field("p2.article", "Article", "string", translate("(?<v>ing)")))


@query(TURNS + """
    , m AS (SELECT file_id, entry_line, line_no, nullif(regexp_extract(line, 'the\\w+'), '') AS a, nullif(regexp_extract(line, 'and\\w+'), '') AS b FROM e WHERE entry_line IS NOT NULL AND contains(line, 'tion'))
    SELECT file_id, entry_line AS line_no, CASE WHEN file_id % 3 = 0 THEN arg_min(a, line_no) FILTER (WHERE a IS NOT NULL) END AS first, CASE WHEN file_id % 3 = 1 THEN arg_min(b, line_no) FILTER (WHERE b IS NOT NULL) END AS second,
           CAST(NULL AS VARCHAR) AS third FROM m GROUP BY file_id, entry_line
""")  # fmt: skip
def fields_per_pack(spark, sf_dir):
    """Each service's lines carry the fields of its own pack only; every third file's pack is not loaded."""
    pack = F.element_at(F.array(F.lit("p0"), F.lit("p1"), F.lit("gone")), (F.col("file_id") % 3 + 1).cast("int"))
    files = conversation_files(spark, sf_dir).withColumn("pack_id", pack)
    hits = hits_of(turns(spark, sf_dir), files, Request("tion", case_sensitive=True), PACK_FIELDS).where("entry_line is not null")
    return hits.select("file_id", "line_no", F.col("`p0.article`").alias("first"), F.col("`p1.article`").alias("second"), F.col("`p2.article`").alias("third"))


@query(TURNS + HITS.format(hit="(contains(lower(line), 'ing the') AND contains(lower(line), 'and'))", out="false"))
def entry_all_per_line(spark, sf_dir):
    return dated(conversation_result(spark, sf_dir, Request(tree=Group("all", [Criterion("ing the"), Criterion("and")]))))


@query(TURNS + HITS.format(hit="((contains(lower(line), 'ing the') OR contains(lower(line), 'erst')) AND contains(lower(line), 'and'))", out="contains(lower(line), 'worthless')"))
def query_tree_nested(spark, sf_dir):
    tree = Group("all", [Group("any", [Criterion("ing the"), Criterion("erst", label="a")]), Criterion("and"), Criterion("worthless", "notContains")])
    return dated(conversation_result(spark, sf_dir, Request(tree=tree)))


@query(TURNS + """
    , h AS (SELECT file_id, entry_line, max(entry_ts) AS ts FROM e WHERE contains(line, 'the') GROUP BY ALL)
    SELECT file_id, ts FROM h WHERE entry_line IS NOT NULL AND ts - INTERVAL 120 MINUTE BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-02 03:30:00'
""")  # fmt: skip
def utc_window_offset(spark, sf_dir):
    files = conversation_files(spark, sf_dir).withColumn("log_offset_minutes", F.lit(120)).drop("log_date")
    request = Request("the", case_sensitive=True, time_from=dt.datetime(2024, 1, 1, 1), time_to=dt.datetime(2024, 1, 2, 3, 30))
    return hits_of(turns(spark, sf_dir), files, request).where("entry_line is not null").select("file_id", "ts")


LINES = """
    WITH l AS (
        SELECT doc_id, unnest(generate_series(1, len(p))) AS line_no, rtrim(unnest(p), chr(13)) AS line
        FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
    )
"""


@query(LINES + "SELECT doc_id, line_no FROM l WHERE contains(lower(line), 'license')")
def substring_ci(spark, sf_dir):
    return document_lines(spark, sf_dir).where(Matcher("LICENSE").line_matches(F.col("line"))).select("doc_id", "line_no")


@query(LINES + "SELECT doc_id, line_no FROM l WHERE contains(line, 'GNU (') OR contains(line, 'Apache License,')")
def substring_cs(spark, sf_dir):
    m, n = Matcher("GNU (", case_sensitive=True), Matcher("Apache License,", case_sensitive=True)
    return document_lines(spark, sf_dir).where(m.line_matches(F.col("line")) | n.line_matches(F.col("line"))).select("doc_id", "line_no")


@query(LINES + "SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '\\b(GNU|CC BY)[ -][A-Z]')")
def regex_filter(spark, sf_dir):
    return document_lines(spark, sf_dir).where(Matcher(r"\b(GNU|CC BY)[ -][A-Z]", True, True).line_matches(F.col("line"))).select("doc_id", "line_no")


@query("SELECT count(*) AS total FROM (" + LINES + "SELECT * FROM l WHERE contains(lower(line), 'license'))")
def raw_search_total(spark, sf_dir):
    return raw_search(document_lines(spark, sf_dir), Matcher("license").line_matches(F.col("line")))[0]


@query(LINES + "SELECT doc_id, line_no, coalesce(array_to_string(list_value(lag(line) OVER w, lead(line) OVER w), '|'), '') AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def context_lines(spark, sf_dir):
    rows = around(document_lines(spark, sf_dir), 1, 1, "doc_id")
    return rows.select("doc_id", "line_no", F.array_join(F.concat("context_before", "context_after"), "|").alias("near"))


@query("SELECT o_orderkey AS file_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-06-30' OR o_orderkey % 50 = 0")
def date_prune(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    files = o.select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 50 != 0, F.to_date("o_orderdate")).alias("log_date"))
    return pruned_files(files, Request(date_from=dt.date(1996, 3, 1), date_to=dt.date(1996, 6, 30))).select("file_id")


FIELD_QUERY = [
    Field("app.token", "Token", "string", translate('token = "(?<v>[0-9a-f]+)"'), "token"),
    Field("app.octet", "First octet", "number", translate(r"\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")),
]


@query(LINES + """
    SELECT doc_id, line_no, nullif(regexp_extract(line, 'token = "([0-9a-f]+)"', 1), '') AS token,
           TRY_CAST(nullif(regexp_extract(line, '\\b(\\d{1,3})\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\b', 1), '') AS DOUBLE) AS octet
    FROM l
""")  # fmt: skip
def field_extract(spark, sf_dir):
    line = F.col("line")
    return document_lines(spark, sf_dir).select("doc_id", "line_no", FIELD_QUERY[0].column(line).alias("token"), FIELD_QUERY[1].column(line).alias("octet"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lower(upper(md5(CAST(event_id AS VARCHAR)))) END AS id FROM events
""")
def guid_field(spark, sf_dir):
    hexed = F.upper(F.md5(F.col("event_id").cast("string").cast("binary")))
    text = F.concat(F.when(F.col("event_id") % 3 == 0, hexed).otherwise(F.substring(hexed, 1, 31)), F.lit(" end"))
    field = Field("app.id", "Id", "guid", translate(r"^(\S+) end"))
    return table(spark, sf_dir, "events").select("event_id", field.column(text).alias("id"))


@query("""
    WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '12.5' WHEN 1 THEN ' 1e3 ' WHEN 2 THEN '1d' WHEN 3 THEN 'NaN' ELSE '-7' END AS s FROM events)
    SELECT event_id, CASE WHEN regexp_matches(trim(s), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CAST(trim(s) AS DOUBLE) END AS n FROM t
""")
def number_field(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.element_at(F.array(*map(F.lit, ("12.5", " 1e3 ", "1d", "NaN", "-7"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", values.number(text).alias("n"))


GROUPS = r"(?<gpl>GNU)|(?<cc>CC BY)|(?<apache>Apache)"
GROUP_BITS = "(CASE WHEN contains(line, 'GNU') THEN 1 ELSE 0 END + CASE WHEN contains(line, 'CC BY') THEN 2 ELSE 0 END + CASE WHEN contains(line, 'Apache') THEN 4 ELSE 0 END)"


@query(LINES + f"SELECT doc_id, CAST(bit_or({GROUP_BITS}) AS BIGINT) AS mask FROM l WHERE {GROUP_BITS} > 0 GROUP BY doc_id")
def group_mask(spark, sf_dir):
    m = Matcher(GROUPS, True, True)
    rows = document_lines(spark, sf_dir).where(m.line_matches(F.col("line"))).withColumn("mask", m.group_mask(F.col("line")))
    return rows.groupBy("doc_id").agg(F.bit_or("mask").alias("mask"))


@query(LINES + f"""
    , m AS (SELECT doc_id, bit_or({GROUP_BITS}) AS mask FROM l GROUP BY doc_id)
    SELECT name, count(*) AS n FROM m, (VALUES ('gpl', 1), ('cc', 2), ('apache', 4)) AS g(name, bit) WHERE (mask & bit) <> 0 GROUP BY name
""")  # fmt: skip
def group_fanout(spark, sf_dir):
    names = values.mask_names(F.col("mask"), Matcher(GROUPS, True, True).group_names)
    return group_mask(spark, sf_dir).select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + "SELECT doc_id, line_no, concat_ws(' ', 'token', regexp_extract(line, 'token = \"([0-9a-f]{6})', 1)) AS part FROM l WHERE regexp_matches(line, 'token = \"[0-9a-f]{6}')")
def extract_isolate(spark, sf_dir):
    m = Matcher('(?<word>token) = "(?<value>[0-9a-f]{6})', True, True)
    return document_lines(spark, sf_dir).select("doc_id", "line_no", m.isolated(F.col("line")).alias("part")).where("part is not null")


SPAN = "epoch(ts)::BIGINT"


def chart_rows(data) -> DataFrame:
    return data.data.select("label", "series", "series_rank", "value")


@query("""
    WITH c AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS b, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1),
         g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), 3600)) AS b)
    SELECT strftime(make_timestamp(g.b * 1000000), '%Y-%m-%dT%H:%M:%S') AS label, 'All' AS series, 1 AS series_rank, coalesce(v, 0.0) AS value FROM g LEFT JOIN c USING (b)
""")
def chart_count_hour(spark, sf_dir):
    return chart_rows(chart(event_hits(spark, sf_dir), ChartRequest(bucket="hour"), EVENT_FIELDS))


RANKED = """
    WITH r AS (SELECT {key} AS series, CAST(row_number() OVER (ORDER BY count(*) DESC, {key}) AS INTEGER) AS series_rank FROM events GROUP BY 1),
         k AS (SELECT * FROM r WHERE series_rank <= {top}),
         c AS (SELECT {key} AS series, CAST(floor(epoch(ts) / {size}) AS BIGINT) * {size} AS b, {metric} AS v FROM events GROUP BY 1, 2),
         g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), {size})) AS b)
    SELECT strftime(make_timestamp(g.b * 1000000), '%Y-%m-%dT%H:%M:%S') AS label, k.series, k.series_rank, {filled} AS value
    FROM k CROSS JOIN g LEFT JOIN c ON c.series = k.series AND c.b = g.b
"""


@query(RANKED.format(key="event_type", top=3, size=21600, metric="CAST(count(*) AS DOUBLE)", filled="coalesce(v, 0.0)"))
def chart_by_type_topn(spark, sf_dir):
    return chart_rows(chart(event_hits(spark, sf_dir), ChartRequest(bucket="sixHours", group_by="field", group_field="app.type", top_n=3), EVENT_FIELDS))


NAMED = "FROM (SELECT * FROM events LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = user_id)"


@query(RANKED.replace("FROM events", NAMED).format(key="coalesce(c_name, CAST(user_id AS VARCHAR))", top=6, size=21600, metric="CAST(count(*) AS DOUBLE)", filled="coalesce(v, 0.0)"))
def chart_by_service_name(spark, sf_dir):
    """Some services have a display name, the others go by their id."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    services = c.select(F.col("c_custkey").cast("string").alias("service_id"), F.col("c_name").alias("name"))
    hits = event_hits(spark, sf_dir)
    named = Result(hits, hits, hits, EVENT_FIELDS, (), tuple(default_order())).named(services)
    return chart_rows(named.chart(ChartRequest(bucket="sixHours", group_by="service", top_n=6)))


@query(RANKED.format(key="CAST(user_id AS VARCHAR)", top=5, size=3600, metric="max(value)", filled="v"))
def chart_gap_fill(spark, sf_dir):
    return chart_rows(chart(event_hits(spark, sf_dir), ChartRequest(bucket="hour", group_by="service", metric="max", value_field="app.value", top_n=5), EVENT_FIELDS))


@query(RANKED.format(key="event_type", top=5, size=3600, metric="quantile_disc(value, 0.95)", filled="v"))
def chart_p95_hour_by_type(spark, sf_dir):
    """Flagship: hourly p95 of value for the five most frequent types, gaps filled."""
    return chart_rows(chart(event_hits(spark, sf_dir), ChartRequest(bucket="hour", group_by="field", group_field="app.type", metric="p95", value_field="app.value", top_n=5), EVENT_FIELDS))


CATEGORY = """
    WITH c AS (SELECT event_type AS series, {metric} AS value FROM events GROUP BY 1)
    SELECT series AS label, series, CAST(row_number() OVER (ORDER BY value DESC, series) AS INTEGER) AS series_rank, value FROM c QUALIFY series_rank <= 4
"""


def category(spark, sf_dir, metric):
    return chart_rows(chart(event_hits(spark, sf_dir), ChartRequest("category", group_by="field", group_field="app.type", metric=metric, value_field="app.value", top_n=4), EVENT_FIELDS))


@query(CATEGORY.format(metric="quantile_disc(value, 0.5)"))
def chart_p50_category(spark, sf_dir):
    return category(spark, sf_dir, "p50")


@query(CATEGORY.format(metric="quantile_disc(value, 0.99)"))
def chart_p99_category(spark, sf_dir):
    return category(spark, sf_dir, "p99")


@query(CATEGORY.format(metric="min(value)"))
def chart_min_category(spark, sf_dir):
    return category(spark, sf_dir, "min")


@query("SELECT event_type AS series, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS sum_value FROM events GROUP BY 1")
def chart_avg_sum(spark, sf_dir):
    parts = [category_all(spark, sf_dir, m).select("series", F.round("value", d).alias(f"{m}_value")) for m, d in (("avg", 6), ("sum", 4))]
    return parts[0].join(parts[1], "series")


def category_all(spark, sf_dir, metric):
    return chart(event_hits(spark, sf_dir), ChartRequest("category", group_by="field", group_field="app.type", metric=metric, value_field="app.value", top_n=50), EVENT_FIELDS).data


@query("""
    WITH s AS (SELECT max(floor(epoch(ts)))::BIGINT - min(floor(epoch(ts)))::BIGINT AS span FROM events)
    SELECT CAST(CASE WHEN span // 1 <= 200 THEN 1 WHEN span // 60 <= 200 THEN 60 WHEN span // 300 <= 200 THEN 300 WHEN span // 900 <= 200 THEN 900
           WHEN span // 3600 <= 200 THEN 3600 WHEN span // 21600 <= 200 THEN 21600 ELSE 86400 END AS BIGINT) AS bucket_seconds FROM s
""")
def chart_auto_bucket(spark, sf_dir):
    bucket = chart(event_hits(spark, sf_dir), ChartRequest(), EVENT_FIELDS).bucket_seconds
    return spark.range(1).select(F.lit(bucket).cast("long").alias("bucket_seconds"))


@query("""
    WITH t AS (SELECT regexp_extract(s, 'GET (\\S+) took (\\S+) ms', 1) AS series, CAST(replace(regexp_extract(s, 'GET (\\S+) took (\\S+) ms', 2), ',', '.') AS DOUBLE) AS v
               FROM (SELECT 'x' || chr(10) || 'GET /' || event_type || ' took ' || (event_id % 97) || ',5 ms' AS s FROM events WHERE event_id % 4 <> 0))
    SELECT series AS label, series, CAST(row_number() OVER (ORDER BY max(v) DESC, series) AS INTEGER) AS series_rank, max(v) AS value FROM t GROUP BY series
""")
def chart_custom_regex(spark, sf_dir):
    hits = event_hits(spark, sf_dir)
    took = F.concat(F.lit("x\nGET /"), F.col("`app.type`"), F.lit(" took "), (F.col("line_no") % 97).cast("string"), F.lit(",5 ms"))
    texts = hits.select("file_id", "entry_line", F.when(F.col("line_no") % 4 != 0, took).otherwise(F.lit("other")).alias("text"))
    request = ChartRequest("category", group_by="custom", metric="max", value_source="custom", custom_regex=r"GET (?<key>\S+) took (?<value>\S+) ms", top_n=50)
    return chart_rows(chart(hits, request, EVENT_FIELDS, texts=texts))


@query("""
    SELECT count(*) FILTER (WHERE event_id % 7 = 0) AS no_key, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 5 = 0) AS no_value,
           count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0) AS no_time,
           count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0) AS charted FROM events
""")
def chart_skips(spark, sf_dir):
    n = F.col("line_no")
    hits = event_hits(spark, sf_dir).withColumns({"app.type": F.when(n % 7 != 0, F.col("`app.type`")), "app.value": F.when(n % 5 != 0, F.col("`app.value`")), "ts": F.when(n % 3 != 0, F.col("ts"))})
    c = chart(hits, ChartRequest(bucket="day", group_by="field", group_field="app.type", metric="sum", value_field="app.value"), EVENT_FIELDS)
    counts = (c.skipped_no_key, c.skipped_no_value, c.skipped_no_time, c.charted)
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in zip(("no_key", "no_value", "no_time", "charted"), counts)])


ORDERED = "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS ts FROM events"


def undated_some(spark, sf_dir):
    return event_hits(spark, sf_dir).select(F.col("line_no").alias("event_id"), "line_no", F.col("file_id").alias("file_ord"), F.when(F.col("line_no") % 10 != 0, F.col("ts")).alias("ts"))


@query(f"SELECT event_id FROM ({ORDERED}) ORDER BY ts DESC NULLS FIRST, event_id DESC LIMIT 500 OFFSET 700")
def page_offset_limit(spark, sf_dir):
    return undated_some(spark, sf_dir).orderBy(*order_columns(default_order())).offset(700).limit(500).select("event_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS FIRST, event_id DESC) AS place FROM ({ORDERED}) ORDER BY place LIMIT 100")
def sort_time_desc_undated_first(spark, sf_dir):
    top = undated_some(spark, sf_dir).orderBy(*order_columns(default_order())).limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(*order_columns(default_order()))).cast("long").alias("place"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 1000")
def hit_cap(spark, sf_dir):
    return capped(undated_some(spark, sf_dir), 1000).select("event_id")


NARROW = """
    , s AS (SELECT file_id, entry_line, min(line_no) AS a, max(line_no) AS b FROM e WHERE entry_line IS NOT NULL GROUP BY ALL HAVING bool_or(contains(line, 'tion')))
    SELECT file_id, a AS line_no FROM s WHERE {not_} EXISTS (
        SELECT 1 FROM e WHERE e.file_id = s.file_id AND e.line_no BETWEEN s.a - {before} AND s.b + {after} AND contains(e.line, 'ing the'))
"""


def narrowed(spark, sf_dir, **how):
    result = conversation_result(spark, sf_dir, Request("tion", case_sensitive=True)).narrow("ing the", case_sensitive=True, **how)
    return result.hits.where("entry_line is not null").select("file_id", "line_no")


@query(TURNS + NARROW.format(not_="", before=0, after=0))
def narrow_keep(spark, sf_dir):
    return narrowed(spark, sf_dir)


@query(TURNS + NARROW.format(not_="NOT", before=0, after=0))
def narrow_invert(spark, sf_dir):
    return narrowed(spark, sf_dir, invert=True)


@query(TURNS + """
    , s AS (SELECT file_id, entry_line FROM e WHERE entry_line IS NOT NULL GROUP BY ALL HAVING bool_or(contains(line, 'tion')) AND bool_or(contains(line, 'ing')) AND NOT bool_or(contains(line, 'erst')))
    SELECT file_id, entry_line AS line_no FROM s
""")  # fmt: skip
def narrow_stacked(spark, sf_dir):
    result = conversation_result(spark, sf_dir, Request("tion", case_sensitive=True))
    return result.narrow("ing", case_sensitive=True).narrow("erst", case_sensitive=True, invert=True).hits.where("entry_line is not null").select("file_id", "line_no")


@query(TURNS + """
    , h AS (SELECT file_id, entry_line FROM e WHERE contains(line, 'tion') AND entry_line IS NOT NULL GROUP BY ALL),
      t AS (SELECT file_id, entry_line, max(entry_ts) AS ts, string_agg(line, chr(10) ORDER BY line_no) AS text, min(line_no) AS a, max(line_no) AS b FROM e JOIN h USING (file_id, entry_line) GROUP BY ALL),
      p AS (SELECT * FROM t ORDER BY ts DESC, file_id DESC, entry_line DESC LIMIT 40 OFFSET 15)
    SELECT 'f' || file_id AS file, entry_line AS line_no, ts, text,
           coalesce((SELECT string_agg(line, '|' ORDER BY line_no) FROM l WHERE l.file_id = p.file_id AND l.line_no BETWEEN p.a - 2 AND p.a - 1), '') AS before,
           coalesce((SELECT string_agg(line, '|' ORDER BY line_no) FROM l WHERE l.file_id = p.file_id AND l.line_no BETWEEN p.b + 1 AND p.b + 2), '') AS after FROM p
""")  # fmt: skip
def result_page(spark, sf_dir):
    result = conversation_result(spark, sf_dir, Request("tion", case_sensitive=True))
    page = replace(result, hits=result.hits.where("entry_line is not null")).page(15, 40, 2)
    return page.select("file", "line_no", "ts", "text", F.array_join("context_before", "|").alias("before"), F.array_join("context_after", "|").alias("after"))


@query(TURNS + """
    SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS files_scanned, (SELECT count(*) FROM conversations) AS lines_scanned, n AS total_hits, false AS truncated
    FROM (SELECT count(*) AS n FROM (SELECT DISTINCT file_id, entry_line FROM e WHERE contains(line, 'tion')))
""")  # fmt: skip
def search_totals(spark, sf_dir):
    request = Request("tion", case_sensitive=True)
    row = conversation_result(spark, sf_dir, request).totals(request)
    return spark.range(1).select(*[F.lit(v).cast("long" if k != "truncated" else "boolean").alias(k) for k, v in row.items()])


@query(TURNS + NARROW.format(not_="", before=1, after=2))
def narrow_around(spark, sf_dir):
    return narrowed(spark, sf_dir, before=1, after=2)


@query(TURNS + ", h AS (SELECT file_id, entry_line FROM e WHERE contains(line, 'tion the') GROUP BY ALL) SELECT string_agg(line, chr(10) ORDER BY line_no) AS line FROM e JOIN h USING (file_id, entry_line) GROUP BY file_id, entry_line")
def export_entries(spark, sf_dir):
    result = conversation_result(spark, sf_dir, Request("tion the", case_sensitive=True))
    return Result(result.hits.where("entry_line is not null"), *[getattr(result, n) for n in ("entries", "files", "fields", "group_names", "order")]).export()


DAY_FILES = """
    WITH d AS (SELECT user_id * 100 + day(ts) AS file_id, user_id % 20 AS service, user_id % 3 AS instance, CAST(ts AS DATE) AS log_date, min(ts) AS first_ts, max(ts) AS last_ts
               FROM events GROUP BY ALL),
         f AS (SELECT file_id, service, CASE WHEN instance > 0 THEN instance END AS instance, log_date,
                      CASE WHEN file_id % 11 <> 0 THEN first_ts END AS first_ts, CASE WHEN file_id % 11 <> 0 THEN last_ts END AS last_ts FROM d)
"""


@query(DAY_FILES + """
    SELECT f.file_id, CASE WHEN f.first_ts IS NOT NULL THEN coalesce(max(o.last_ts) FILTER (WHERE o.last_ts <= f.first_ts), f.first_ts - INTERVAL 1 MILLISECOND)
           ELSE first(o.last_ts ORDER BY o.log_date DESC NULLS LAST, o.last_ts DESC NULLS LAST) FILTER (WHERE o.log_date < f.log_date) END AS head_ts
    FROM f LEFT JOIN f AS o ON f.service = o.service AND f.instance IS NOT DISTINCT FROM o.instance AND f.file_id <> o.file_id
    GROUP BY f.file_id, f.first_ts, f.log_date
""")  # fmt: skip
def head_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("file_id")
    d = e.groupBy(key, (F.col("user_id") % 20).cast("string").alias("service_id"), (F.col("user_id") % 3).alias("i"), F.to_date("ts").alias("log_date")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    real = F.col("file_id") % 11 != 0
    files = d.select("file_id", "service_id", F.when(F.col("i") > 0, F.col("i").cast("string")).alias("instance"), "log_date")
    spans = d.select("file_id", F.when(real, F.col("a")).alias("first_ts"), F.when(real, F.col("b")).alias("last_ts"))
    return head_times(files, spans)


def order_manifest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.concat(F.lit("k"), "o_orderkey").alias("key"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("service_id"), F.col("o_orderkey").cast("string").alias("file"), F.to_date("o_orderdate").alias("log_date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("instance"), (F.col("o_orderkey") * 3).alias("size"), (ts - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_custkey") % 40 * 15 + F.col("o_orderkey") % 5).cast("int"), F.lit(0))).cast("timestamp").alias("mtime"),
        F.when(F.col("o_orderkey") % 3 != 0, ts).alias("first_ts"), F.when(F.col("o_orderkey") % 3 != 0, ts + F.expr("INTERVAL '10' MINUTE")).alias("last_ts"),
    )


MANIFEST = """
    WITH m AS (SELECT 'k' || o_orderkey AS key, 'c' || (o_custkey % 40) AS service_id, CAST(o_orderdate AS DATE) AS log_date, o_orderkey * 3 AS size,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS instance, o_orderdate - to_minutes(o_custkey % 40 * 15 + o_orderkey % 5) AS mtime,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS first_ts, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 10 MINUTE END AS last_ts FROM orders)
"""


@query(MANIFEST + "SELECT service_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(coalesce(first_ts, CAST(log_date AS TIMESTAMP))) AS oldest, max(coalesce(last_ts, CAST(log_date AS TIMESTAMP))) AS newest FROM m GROUP BY service_id")
def cache_status(spark, sf_dir):
    return catalog.status(order_manifest(spark, sf_dir))


@query(MANIFEST + """
    , s AS (SELECT service_id, coalesce(first_ts, CAST(log_date AS TIMESTAMP)) AS a, coalesce(last_ts, CAST(log_date AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND) AS b FROM m),
      d AS (SELECT service_id, a, b, CAST(unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
      g AS (SELECT service_id, day, min(greatest(a, CAST(day AS TIMESTAMP))) AS first, max(least(b, CAST(day AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND)) AS last FROM d GROUP BY ALL),
      w AS (SELECT *, lag(day) OVER v AS before, lag(last) OVER v AS gap_from FROM g WINDOW v AS (PARTITION BY service_id ORDER BY day))
    SELECT service_id, gap_from, first AS gap_to FROM w WHERE date_diff('day', before, day) > 1
""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"))  # fmt: skip
def coverage_gaps(spark, sf_dir):
    return catalog.coverage_gaps(order_manifest(spark, sf_dir))


@query(MANIFEST + """
    , d AS (SELECT service_id, CAST(trunc(epoch(last_ts - mtime) / 60) AS BIGINT) AS delta FROM m WHERE last_ts IS NOT NULL),
      l AS (SELECT service_id, list_sort(list(delta)) AS x FROM d WHERE abs(delta) <= 840 GROUP BY 1)
    SELECT service_id, CAST(round(x[len(x) // 2 + 1] / 15.0) * 15 AS INTEGER) AS offset_minutes FROM l
""")  # fmt: skip
def clock_offset(spark, sf_dir):
    return catalog.clock_offsets(order_manifest(spark, sf_dir))


@query(MANIFEST + """
    , g AS (SELECT service_id, log_date, last_ts, mtime, max(log_date) OVER (PARTITION BY service_id, size % 20) AS newest FROM m),
      d AS (SELECT service_id, CAST(trunc(epoch(last_ts - mtime) / 60) AS BIGINT) AS delta FROM g WHERE log_date = newest AND last_ts IS NOT NULL),
      l AS (SELECT service_id, list_sort(list(delta)) AS x FROM d WHERE abs(delta) <= 840 GROUP BY 1)
    SELECT service_id, CAST(round(x[len(x) // 2 + 1] / 15.0) * 15 AS INTEGER) AS offset_minutes FROM l
""")  # fmt: skip
def clock_offset_of_segments(spark, sf_dir):
    """Twenty growing files for each service, a segment for each day: the newest one counts."""
    m = order_manifest(spark, sf_dir)
    key = F.concat(F.lit("f"), (F.col("size") % 20).cast("string"), F.lit("#"), F.col("log_date").cast("string"))
    return catalog.clock_offsets(m.withColumn("key", key))


@query(MANIFEST + """
    , d AS (SELECT service_id, CAST(trunc(epoch(last_ts - mtime) / 60) AS BIGINT) AS delta FROM m WHERE last_ts IS NOT NULL AND service_id IN ('c4', 'c7')),
      l AS (SELECT service_id, list_sort(list(delta)) AS x FROM d WHERE abs(delta) <= 840 GROUP BY 1),
      o AS (SELECT service_id, CAST(round(x[len(x) // 2 + 1] / 15.0) * 15 AS INTEGER) AS m FROM l)
    SELECT (SELECT CASE WHEN min(m) = max(m) THEN min(m) END FROM o WHERE service_id = 'c4') AS alone, (SELECT CASE WHEN min(m) = max(m) THEN min(m) END FROM o) AS both
""")  # fmt: skip
def common_clock(spark, sf_dir):
    offsets = catalog.clock_offsets(order_manifest(spark, sf_dir))
    alone, both = (catalog.common_offset(offsets.where(F.col("service_id").isin(*ids))) for ids in (["c4"], ["c4", "c7"]))
    return spark.range(1).select(F.lit(alone).cast("int").alias("alone"), F.lit(both).cast("int").alias("both"))


@query(MANIFEST + "SELECT service_id, count(DISTINCT instance) AS n_instances FROM m GROUP BY 1 HAVING count(DISTINCT instance) > 1")
def distinct_instances(spark, sf_dir):
    return catalog.instances(order_manifest(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE trim(event_type) <> '') > 0 AS has_type, count(*) FILTER (WHERE event_id < 0) > 0 AS has_none FROM events")
def populated_columns(spark, sf_dir):
    hits = event_hits(spark, sf_dir).withColumn("app.none", F.when(F.col("line_no") < 0, F.lit("x")))
    fields = (*EVENT_FIELDS, Field("app.none", "None", "string", translate("(x)")))
    found = Result(hits, hits, hits, fields, (), tuple(default_order())).populated_columns()
    return spark.range(1).select(F.lit("app.type" in found).alias("has_type"), F.lit("app.none" in found).alias("has_none"))


EVENT_LINES = "WITH l AS (SELECT user_id AS file_id, event_id AS line_no, CASE WHEN event_id % 4 <> 0 THEN ts END AS ts FROM events)"


def event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("ts"))


@query(EVENT_LINES + "SELECT file_id, line_no FROM (SELECT *, bool_or(coalesce(ts > TIMESTAMP '2024-01-10', false)) OVER (PARTITION BY file_id ORDER BY line_no) AS ok FROM l) WHERE ok")
def growing_prefix_cut(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("cut", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return prefix_cut(lines).select("file_id", "line_no")


@query(EVENT_LINES + """
    , d AS (SELECT *, last_value(CAST(ts AS DATE) IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no) AS day,
                   first_value(CAST(ts AS DATE) IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM l)
    SELECT file_id, line_no, coalesce(day, first) AS log_date FROM d
""")  # fmt: skip
def day_segmentation(spark, sf_dir):
    return day_segments(event_lines(spark, sf_dir)).select("file_id", "line_no", "log_date")


CONTAINER = r'<li><a href="([^"]*)">([^<]*)</a>'


@query(f"""
    WITH p AS (SELECT page_id, regexp_extract_all(html, '{CONTAINER}', 1) AS s, regexp_extract_all(html, '{CONTAINER}', 2) AS n, regexp_split_to_array(html, '{CONTAINER}') AS b FROM pages WHERE html IS NOT NULL),
         r AS (SELECT page_id, unnest(generate_series(1, len(n))) AS k, s, n, b FROM p)
    SELECT page_id, CAST(k - 1 AS INTEGER) AS position, trim(n[k]) AS name, CASE WHEN contains(lower(s[k]), 'th') THEN 'test' WHEN contains(lower(s[k]), 'e') THEN 'production' ELSE 'default' END AS environment,
           CASE WHEN regexp_matches(b[k + 1], '<!-- (ad [0-9]+) -->') THEN regexp_extract(b[k + 1], '<!-- (ad [0-9]+) -->', 1) END AS endpoint
    FROM r WHERE trim(n[k]) <> ''
""")
def scrape_services(spark, sf_dir):
    container = translate(r'<li><a href="(?<section>[^"]*)">(?<name>[^<]*)</a>')
    found = scrape(table(spark, sf_dir, "pages"), container, translate("<!-- (ad [0-9]+) -->"), environments=[("th", "test"), ("e", "production")])
    return found.drop("location")


@query("""
    SELECT coalesce(c.id, f.id) AS service_id, coalesce(c.name, f.name) AS name, CASE WHEN c.manual THEN c.endpoint ELSE coalesce(f.endpoint, c.endpoint) END AS endpoint
    FROM (SELECT 'x' || c_custkey AS id, c_name AS name, c_mktsegment AS endpoint, c_custkey % 3 = 0 AS manual FROM customer) c
    FULL JOIN (SELECT 'x' || (s_suppkey * 2) AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS endpoint FROM supplier) f ON c.id = f.id
""")
def service_upsert(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    configured = c.select(F.concat(F.lit("x"), "c_custkey").alias("service_id"), F.col("c_name").alias("name"), none.alias("environment"), F.col("c_mktsegment").alias("endpoint"), none.alias("location"), (F.col("c_custkey") % 3 == 0).alias("manual"))
    found = s.select(F.concat(F.lit("x"), F.col("s_suppkey") * 2).alias("service_id"), F.col("s_name").alias("name"), none.alias("environment"), F.when(F.col("s_suppkey") % 2 == 0, "new").alias("endpoint"), none.alias("location"))
    return catalog.upsert_services(configured, found).select("service_id", "name", "endpoint")


@query("""
    WITH l AS (SELECT 'k' || o_orderkey AS key, o_orderkey * CASE WHEN o_orderkey % 4 = 0 THEN 4 ELSE 3 END AS size, CASE WHEN o_orderkey % 10 <> 0 THEN DATE '2000-01-01' END AS log_date FROM orders),
         m AS (SELECT 'k' || o_orderkey AS key, o_orderkey * 3 AS have FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT l.key, CASE WHEN have IS NULL THEN 'new' WHEN log_date IS NULL AND size >= have THEN CASE WHEN size = have THEN 'probe' ELSE 'append' END
           WHEN size = have THEN 'current' ELSE 'changed' END AS decision FROM l LEFT JOIN m USING (key)
""")
def manifest_decision(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key, at, k = F.concat(F.lit("k"), "o_orderkey").alias("key"), F.lit("2001-01-01").cast("timestamp").alias("mtime"), F.col("o_orderkey")
    files = o.select(key, (k * F.when(k % 4 == 0, 4).otherwise(3)).alias("size"), at, F.when(k % 10 != 0, F.to_date(F.lit("2000-01-01"))).alias("log_date"))
    manifest = o.where(k % 7 != 0).select(key, (k * 3).alias("size"), at)
    return catalog.sync_decisions(files, manifest, dt.date(2001, 1, 1)).select("key", "decision")


@query("""
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS log_date, 'i' || l_linenumber AS instance FROM lineitem
    WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AND l_linenumber > 1
""")
def files_for_range(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.when(F.col("l_linenumber") > 1, "log-").otherwise("old-"), F.date_format("l_shipdate", "yyyy_MM_dd"), F.lit("_i"), "l_linenumber", F.lit(".log")).alias("name"))
    location = Location("core", "Core", "logs", translate(r"^log-(?<y>\d{4})_(?<m>\d{2})_(?<d>\d{2})_(?<instance>[a-z0-9]+)\.log$"), True)
    return catalog.files_for_range(names, location, dt.date(1997, 1, 1), dt.date(1997, 3, 31)).drop("name")


SYNCED = """
    WITH d AS (SELECT 'k' || o_orderkey AS key, 'c' || (o_custkey % 40) AS service_id, CASE WHEN o_custkey % 2 = 0 THEN 'i' || (o_orderkey % 3) END AS instance,
                      CASE WHEN o_orderkey % 4 = 0 THEN 'current' WHEN o_orderkey % 4 = 1 THEN 'append' ELSE 'new' END AS decision, o_orderkey AS n FROM orders),
         r AS (SELECT *, decision <> 'current' AND n % 9 <> 0 AS done, decision = 'append' AS grown, CASE WHEN n % 6 = 1 THEN 0 ELSE n END AS got FROM d)
"""


@query(SYNCED + """
    SELECT service_id, count(*) AS listed, count(*) FILTER (WHERE done AND NOT grown) AS fetched, count(*) FILTER (WHERE done AND grown AND got > 0) AS appended,
           count(*) FILTER (WHERE decision = 'current' OR (done AND grown AND got = 0)) AS current, count(*) FILTER (WHERE decision <> 'current' AND NOT done) AS failed,
           CAST(coalesce(sum(got) FILTER (WHERE done), 0) AS BIGINT) AS bytes,
           CASE WHEN bool_or(decision <> 'current' AND NOT done) THEN 'lost' WHEN count(DISTINCT instance) > 1 THEN 'several instances write here' END AS message FROM r GROUP BY service_id
""")  # fmt: skip
def sync_summary(spark, sf_dir):
    """A sync's account: every ninth file that should be fetched fails, some live files have not grown."""
    n = F.col("n")
    decided = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), "o_orderkey").alias("key"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("service_id"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("i"), F.col("o_orderkey") % 3)).alias("instance"), F.col("o_orderkey").alias("n"),
    )
    decided = decided.withColumn("decision", F.when(n % 4 == 0, "current").when(n % 4 == 1, "append").otherwise("new"))
    due = decided.where("decision <> 'current'")
    ok = due.where(n % 9 != 0).select("key", F.when(F.col("decision") == "append", 100).otherwise(0).cast("long").alias("start"), F.when(n % 6 == 1, 0).otherwise(n).alias("got"))
    return summary_of(decided.drop("n"), ok, due.where(n % 9 == 0).select("key", F.lit("lost").alias("error")))


@query("""
    SELECT 'x' || c_custkey AS service_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0
""")
def services_seeded(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    named = lambda df: df.select(F.concat(F.lit("x"), "c_custkey").alias("service_id"))
    return catalog.seed_services(named(c.where(F.col("c_custkey") % 3 == 0)), named(c), named(c.where(F.col("c_custkey") % 5 == 0)))


@query(EVENT_LINES + """
    SELECT file_id, arg_min(ts, line_no) FILTER (WHERE ts IS NOT NULL) AS first_ts, arg_max(ts, line_no) FILTER (WHERE ts IS NOT NULL) AS last_ts FROM l GROUP BY file_id
""")  # fmt: skip
def stored_file_spans(spark, sf_dir):
    return catalog.time_spans(event_lines(spark, sf_dir))


@query("""
    SELECT 'k' || o_orderkey AS key, c_name AS service_name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment = 'BUILDING' AND (contains(CAST(o_orderkey AS VARCHAR), '77') OR contains(c_name, '77'))
""")
def files_view_filter(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), "o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("service_id"), F.col("o_orderkey").cast("string").alias("file"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("service_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("environment"))
    return catalog.visible_files(files, known, "77", "BUILDING").select("key", "service_name")


@query(f"SELECT event_id FROM ({ORDERED}) ORDER BY ts DESC NULLS FIRST, event_id DESC LIMIT 100")
def preview_hits(spark, sf_dir):
    hits = event_hits(spark, sf_dir).withColumn("ts", F.when(F.col("line_no") % 10 != 0, F.col("ts"))).withColumn("file_ord", F.col("file_id"))
    return Result(hits, hits, hits, EVENT_FIELDS, (), tuple(default_order())).preview().select(F.col("line_no").alias("event_id"))
