"""A search's result: sorted, paged, narrowed, exported and charted without touching its parent."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.values import display, mask_names
from .chart import ChartRequest, chart
from .lines import entry_text
from .matching import Matcher
from ..sources.store import counted, is_cancelled, shared_path
from .search import DEFAULT_CAP, Field, Request, cap_of, capped, default_order, hits_of, order_columns, pruned_files, scanned

PAGE, PREVIEW, CLIPBOARD = 500, 100, 50_000


@dataclass(frozen=True)
class Result:
    hits: DataFrame
    entries: DataFrame
    files: DataFrame
    fields: tuple[Field, ...]
    group_names: tuple[str, ...]
    order: tuple[tuple[str, bool], ...]
    parent: Result | None = None
    seen: dict | None = None  # totals that the search itself has counted
    complete: bool = True  # false: it was stopped, and these are the hits of the files that were through
    most: int | None = None  # the hits are no more than that

    def own_entries(self) -> DataFrame:
        """The lines of entries that are hits; no other line moves. Capped hits are sent to where the lines are, as they
        are at most some 50 MB of numbers."""
        keys = self.hits.select(F.col("file_id").alias("__f"), F.col("entry_line").alias("__e")).distinct()
        keys = F.broadcast(keys) if self.most is not None and self.most <= DEFAULT_CAP else keys
        return self.entries.join(keys, (F.col("file_id") == F.col("__f")) & F.col("entry_line").eqNullSafe(F.col("__e")), "left_semi")

    def sorted_hits(self) -> DataFrame:
        return self.hits.orderBy(*order_columns(self.order))

    def sort(self, by: str, ascending: bool = True) -> Result:
        """Stable on the present order; descending is the exact reverse of ascending. A file sorts by name, then line."""
        known = {"time": ["ts"], "service": ["service_id"], "file": ["file", "line_no"], **{f.key: [f.key] for f in self.fields}}
        if by not in known:
            raise ValueError(f"Unknown sort field: {by}")
        keys = [(c, True) for c in known[by]]
        order = keys + [x for x in self.order if x[0] not in known[by]]
        return replace(self, order=tuple(order if ascending else [(c, not up) for c, up in order]))

    def named(self, services: DataFrame) -> Result:
        """With service_name, the name that services (service_id, name) has for it; without one, the id. A service listed twice
        has the least of its names, so hits stay as many as they are."""
        names = services.groupBy(F.col("service_id").alias("__id")).agg(F.min(F.nullif(F.trim("name"), F.lit(""))).alias("__name"))
        hits = self.hits.drop("service_name")
        shown = F.coalesce("__name", "service_id").alias("service_name")
        return replace(self, hits=hits.join(names, F.col("service_id") == F.col("__id"), "left").select(*[F.col(f"`{c}`") for c in hits.columns], shown))

    def page(self, offset: int = 0, limit: int = PAGE, context: int = 2) -> DataFrame:
        """Hits offset .. offset + limit with their entry's text and the lines around it. A page is at most `limit` entries,
        so they are sent to where the lines are: only lines of these entries, and those around them, move."""
        page = self.sorted_hits().offset(offset).limit(limit)
        wanted = F.broadcast(page.select(F.col("file_id").alias("__f"), F.col("entry_line").alias("__e")).distinct())
        own = self.entries.join(wanted, (F.col("file_id") == F.col("__f")) & F.col("entry_line").eqNullSafe(F.col("__e")), "left_semi")
        texts = entry_text(own).select(F.col("file_id").alias("__tf"), F.col("entry_line").alias("__te"), "text")
        ends = own.groupBy("file_id", "entry_line").agg(F.min("line_no").alias("__a"), F.max("line_no").alias("__b"))
        ends = ends.select(F.col("file_id").alias("__f"), F.col("entry_line").alias("__e"), "__a", "__b")
        n = F.col("line_no")
        beside = n.between(F.col("__a") - context, F.col("__a") - 1) | n.between(F.col("__b") + 1, F.col("__b") + context)
        near = self.entries.select("file_id", "line_no", "line").join(F.broadcast(ends), (F.col("file_id") == F.col("__f")) & beside)
        lines = lambda where: F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("line_no", "line")))), lambda x: x["line"])
        near = near.groupBy("__f", "__e").agg(lines(n < F.col("__a")).alias("context_before"), lines(n > F.col("__b")).alias("context_after"))
        same = lambda f, e: (F.col("file_id") == F.col(f)) & F.col("entry_line").eqNullSafe(F.col(e))
        full = page.join(texts, same("__tf", "__te")).join(near, same("__f", "__e"), "left")
        none = F.array().cast("array<string>")
        shown = [(display(F.col(f"`{f.key}`")) if f.kind == "number" else F.col(f"`{f.key}`")) for f in self.fields]
        values = F.create_map(*[x for f, v in zip(self.fields, shown) for x in (F.lit(f.key), v)]) if self.fields else F.create_map().cast("map<string,string>")
        return full.select(
            "service_id", "file", "line_no", "ts", "text", F.coalesce("context_before", none).alias("context_before"), F.coalesce("context_after", none).alias("context_after"),
            mask_names(F.col("matched_groups"), self.group_names).alias("groups"), F.map_filter(values, lambda k, v: v.isNotNull()).alias("fields"), *[F.col(f"`{c}`").alias(f"__{c}") for c, _ in self.order],
        ).orderBy(*order_columns([(f"__{c}", up) for c, up in self.order])).drop(*[f"__{c}" for c, _ in self.order])

    def preview(self) -> DataFrame:
        return self.sorted_hits().limit(PREVIEW)

    def narrow(self, query: str = "", is_regex: bool = False, case_sensitive: bool = False, invert: bool = False, before: int = 0, after: int = 0, tree: object = None) -> Result:
        """Hits whose entry, with so many lines around it, matches too (or does not). A new result; this one stays as its
        parent, which is how a step is undone. Entries' spans and lines meet by ranges of lines within a file."""
        if not query and tree is None:
            raise ValueError("Enter a query to narrow by")
        if max(before, after) > 1000 or min(before, after) < 0:
            raise ValueError("At most 1000 lines around an entry")
        m = Matcher(query, is_regex, case_sensitive, tree)
        line = F.col("line")
        spans = self.own_entries().groupBy("file_id", "entry_line").agg(F.min("line_no").alias("__a"), F.max("line_no").alias("__b"))
        anchors = self.hits.select("file_id", "line_no", "entry_line").withColumnsRenamed({"file_id": "__f", "line_no": "__l", "entry_line": "__e"})
        spans = anchors.join(spans, (F.col("__f") == spans["file_id"]) & F.col("__e").eqNullSafe(spans["entry_line"])).select("__f", "__l", F.coalesce("__e", "__a").alias("__a"), "__b")
        files = self.hits.select("file_id").distinct()
        marked = self.entries.join(files, "file_id", "left_semi").select("file_id", "line_no", m.excludes(line).alias("__out"), m.is_match(line).alias("__in")).where("__out or __in")
        # A bucket of lines on both sides keeps the range join an equi-join: a span meets only the buckets it covers.
        step = 2048
        low, high = F.col("__a") - before, F.col("__b") + after
        spans = spans.withColumn("__k", F.explode(F.sequence(F.floor(low / step), F.floor(high / step))))
        marked = marked.withColumn("__m", F.floor(F.col("line_no") / step))
        near = spans.join(marked, (F.col("__f") == marked["file_id"]) & (F.col("__k") == F.col("__m")) & (marked["line_no"] >= low) & (marked["line_no"] <= high))
        kept = near.groupBy("__f", "__l").agg(F.bool_or(F.col("__in") & ~F.col("__out")).alias("__in"), F.bool_or("__out").alias("__out")).where("__in and not __out")
        hits = self.hits.join(kept, (self.hits["file_id"] == kept["__f"]) & (self.hits["line_no"] == kept["__l"]), "left_anti" if invert else "left_semi")
        return replace(self, hits=hits, parent=self, seen=None)

    def undo(self) -> Result:
        if self.parent is None:
            raise ValueError("Nothing to undo")
        return self.parent

    def without_groups(self, names: Sequence[str]) -> Result:
        """Hits whose matched groups are all switched off go; hits without groups stay."""
        off = sum(1 << k for k, n in enumerate(self.group_names[:32]) if n in set(names))
        mask = F.col("matched_groups")
        return replace(self, hits=self.hits.where((mask == 0) | (mask.bitwiseAND(F.lit(~off)) != 0)), seen=None)

    def export(self, extract: Matcher | None = None, excluded: Sequence[str] = (), max_lines: int | None = None) -> DataFrame:
        """One `line` per hit in the result's order: the entry's text, or the isolated part where there is one."""
        shown = self.without_groups(excluded) if excluded else self
        texts = entry_text(shown.own_entries()).select(F.col("file_id").alias("__f"), F.col("entry_line").alias("__e"), "text")
        rows = shown.hits.join(texts, (F.col("file_id") == F.col("__f")) & F.col("entry_line").eqNullSafe(F.col("__e")))
        value = F.col("text") if extract is None else extract.isolated(F.col("text"), excluded)
        rows = rows.withColumn("line", value).where("line is not null").orderBy(*order_columns(self.order)).select("line")
        return rows if max_lines is None else rows.limit(max_lines)

    def write(self, path: str, **options) -> None:
        """The export as text files whose names follow the result's order."""
        self.export(**options).write.mode("overwrite").text(path)

    def chart(self, request: ChartRequest):
        texts = None
        if request.needs_text:
            texts = entry_text(self.own_entries()).select("file_id", "entry_line", "text")
        return chart(self.hits, request, self.fields, self.group_names, texts)

    def populated_columns(self) -> list[str]:
        """Fields that some hit has a value for."""
        if not self.fields:
            return []
        row = self.hits.agg(*[F.max(F.trim(F.col(f"`{f.key}`").cast("string")) != "").alias(f"c{k}") for k, f in enumerate(self.fields)]).first()
        return [f.key for f, v in zip(self.fields, row) if v]

    def totals(self, request: Request) -> dict:
        """files_scanned, lines_scanned, total_hits, truncated: what the search counted while it ran, else by one job. A result
        of as many hits as its cap is truncated if one more was found."""
        if self.seen is not None:
            return self.seen
        files = pruned_files(self.files, request)
        counts = {"files": files, "lines": self.entries.join(files.select("file_id"), "file_id", "left_semi"), "hits": self.hits}
        frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, df in counts.items()]
        got = {r.k: r.n for r in reduce(DataFrame.unionByName, frames).collect()}
        return {"files_scanned": got["files"], "lines_scanned": got["lines"], "total_hits": got["hits"], "truncated": False}


#: Shares of the files, in their order, after which a search looks at what it has found.
STAGES = (1 / 64, 1 / 16, 1 / 4)
#: Fewer files than that are one stage.
STAGED_FILES = 64


def search(
    entries: DataFrame, files: DataFrame, request: Request, fields: Sequence[Field] = (), max_hits: int = DEFAULT_CAP, spark=None,
    progress: Callable[[dict], None] | None = None, stop: Callable[[], bool] | None = None,
) -> Result:
    """Search lines that ingestion has stored (see lines.to_entries).

    Files are searched in stages in their order, a growing share of them each, and the hits of a stage are written, once, to
    the shared folder. Once the cap is reached no other stage begins, so a search that finds much reads little. After each
    stage progress gets {"files", "lines", "hits", "stage", "stages"}, counted by the stage's own job. If stop() says so
    before a stage, or the jobs are cancelled (see store.cancellable), the result has the hits of the stages that were
    through and is not complete. Without a cap, progress and stop it is planned as one query, which runs when it is used.

    For head blocks, files should have first_ts and last_ts, as a manifest has; else all lines are read for them."""
    spark = spark or entries.sparkSession
    matcher, cap = request.matcher(spark), cap_of(max_hits)
    result = lambda hits, **x: Result(hits, scanned(entries, request), files, tuple(fields), tuple(matcher.group_names), tuple(default_order()), most=cap, **x)
    if cap is None and progress is None and stop is None:
        return result(hits_of(entries, files, request, fields, matcher))
    row = pruned_files(files, request).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("file_ord", list(STAGES), 10_000).alias("at")).first()
    edges = [None, *(sorted(set(row["at"])) if row["n"] > STAGED_FILES else []), None]
    folder, done, complete, kind = shared_path(spark, "hits"), {"files": 0, "lines": 0, "hits": 0}, True, None
    order = F.col("file_ord")
    for k, (after, upto) in enumerate(zip(edges, edges[1:])):
        if stop is not None and stop():
            complete = False
            break
        part = (order > after if after is not None else F.lit(True)) & (order <= upto if upto is not None else F.lit(True))
        lines, found = Observation(), Observation()
        hits = hits_of(entries, files, request, fields, matcher, part, lines).observe(found, F.count(F.lit(1)).alias("hits"))
        kind = hits.schema
        try:
            with counted(spark):
                hits.write.parquet(f"{folder}/stage-{k}")
        except Exception as e:
            if not is_cancelled(e):
                raise
            complete = False
            break
        n = row["n"] if len(edges) == 2 else pruned_files(files, request).where(part).count()
        done = {"files": done["files"] + n, "lines": done["lines"] + lines.get["lines"], "hits": done["hits"] + found.get["hits"], "stage": k + 1, "stages": len(edges) - 1}
        if progress is not None:
            progress(done)
        if cap is not None and done["hits"] > cap:
            break
    written = [f"{folder}/stage-{k}" for k in range(done.get("stage", 0))]
    kind = kind or hits_of(entries, files, request, fields, matcher).schema
    hits = spark.read.schema(kind).parquet(*written) if written else spark.createDataFrame([], kind)
    truncated = cap is not None and done["hits"] > cap
    totals = {"files_scanned": done["files"], "lines_scanned": done["lines"], "total_hits": min(done["hits"], cap or done["hits"]), "truncated": truncated}
    return result(capped(hits, cap) if truncated else hits, seen=totals, complete=complete)


def sorted_rows(rows: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Rows of a small table by one column, empty values last either way; texts without regard to case, then with it."""
    text = dict(rows.dtypes)[by] == "string"
    keys = ([F.lower(F.col(f"`{by}`"))] if text else []) + [F.col(f"`{by}`")]
    return rows.orderBy(*[k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys])
