"""Services from a status page: one per match of a container pattern, each with the text up to the next match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import Pattern
from ..plans.packs import Location


def scrape(pages: DataFrame, container: Pattern, endpoint: Pattern | None = None, log_dir: Pattern | None = None, environments: list[tuple[str, str]] = (), default_environment: str = "default", locations: list[Location] = (), html: str = "html", key: str = "page_id") -> DataFrame:
    """key, position, name, environment, endpoint, location of each service, in the order of the page.

    A service's links are looked for between its match and the next one, so none is taken from a neighbour. environments:
    (text that the section contains, environment), first wins. A page is a row; its matches are cut inside that row.
    """
    text = F.col(html)
    blocks = F.split(text, container.java, -1)
    found = lambda g: F.regexp_extract_all(text, F.lit(container.java), F.lit(g))
    section = found(container.number("section")) if container.number("section") else F.transform(found(0), lambda _: F.lit(""))
    rows = F.zip_with(F.zip_with(found(container.number("name")), section, lambda n, s: F.struct(n.alias("name"), s.alias("section"))), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), lambda a, b: F.struct(F.trim(a["name"]).alias("name"), a["section"].alias("section"), b.alias("block")))
    out = pages.where(text.isNotNull()).select(key, F.posexplode(rows).alias("position", "s")).select(key, "position", "s.*").where("name <> ''")
    env = F.lit(default_environment)
    for contains, name in reversed(list(environments)):
        env = F.when(F.lower("section").contains(contains.lower()), F.lit(name)).otherwise(env)

    def first(p: Pattern | None, group: str):
        return F.lit(None).cast("string") if p is None else F.when(F.col("block").rlike(p.java), F.regexp_extract("block", p.java, p.number(group) or 1))

    folder = F.lower(F.trim(first(log_dir, "dir"), F.lit("/")))
    location = F.lit(None).cast("string")
    for x in reversed(list(locations)):
        location = F.when(folder == x.dir.strip("/").lower(), F.lit(x.id)).otherwise(location)
    return out.select(key, "position", "name", env.alias("environment"), first(endpoint, "endpoint").alias("endpoint"), location.alias("location"))
