from pyspark.sql import functions as F

from loomlog.operators.lines import split_lines, to_entries


def entries_of(spark, texts, formats=(), chunk=1_000_000):
    """texts: file_id -> text."""
    files = spark.createDataFrame(sorted(texts.items()), "file_id long, value string")
    return to_entries(split_lines(files), formats, chunk=chunk)


def files_table(spark, rows):
    """rows: dicts of file_id and what else is known."""
    schema = "file_id long, service_id string, file string, log_date date, instance string, log_offset_minutes int, file_ord long"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, {"service_id": "s", "file": f"f{r['file_id']}", "file_ord": r["file_id"]}.get(n)) for n in names) for r in rows], schema)


def ts(value):
    return F.lit(value).cast("timestamp_ntz")
