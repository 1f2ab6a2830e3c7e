"""Packs: JSON files that declare where logs are, how their lines are dated, and what fields they hold. Nothing in a pack
executes. A pack is read and checked on the driver; what the engine runs are Columns made from it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.regexes import Pattern, translate
from ..functions.timestamps import BUILT_IN, custom
from ..operators.chart import BUCKETS, METRICS
from ..operators.search import Field

MOST_FIELDS = 32
SLUG, KEY = re.compile(r"[a-z0-9][a-z0-9-]*"), re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Allowed keys by place in the file; others are refused.
KEYS = {
    "": {"$schema", "id", "name", "version", "description", "environments", "source", "discovery", "logLocations", "timestamps", "fields", "presets", "charts"},
    "environments": {"id", "label"},
    "logLocations": {"id", "label", "dir", "file", "dated"},
    "fields": {"key", "label", "regex", "gate", "type"},
    "presets": {"name", "query", "isRegex"},
    "charts": {"name", "mode", "bucket", "groupBy", "metric", "value", "customRegex", "topN"},
    "services": {"name", "environment", "endpoint", "location"},
}
SOURCES = {"kudu": {"type", "auth"}, "local-folder": {"type", "root"}}
DISCOVERY = {"none": {"type"}, "static": {"type", "services"}, "scrape": {"type", "url", "container", "endpoint", "logDir", "environments", "defaultEnvironment"}}


class PackError(ValueError):
    pass


@dataclass(frozen=True)
class Location:
    id: str
    label: str
    dir: str
    file: Pattern
    dated: bool


@dataclass
class Pack:
    manifest: dict
    locations: list[Location]
    timestamps: list
    fields: list[Field]
    origin: str = "bundled"

    @property
    def id(self) -> str:
        return self.manifest["id"]

    def location_by_dir(self, path: str) -> Location | None:
        return next((x for x in self.locations if x.dir.strip("/").lower() == path.strip("/").lower()), None)


def need(ok: bool, message: str) -> None:
    if not ok:
        raise PackError(message)


def only(keys: Iterable[str], allowed: set[str], where: str) -> None:
    odd = sorted(set(keys) - allowed)
    need(not odd, f"{where or 'pack'}: unknown key {', '.join(odd)}")


def pattern_of(text, where: str, check: Callable[[Pattern], object] | None) -> Pattern:
    need(isinstance(text, str), f"{where}: a pattern is needed")
    pattern = translate(text)
    try:
        re.compile(re.sub(r"\\z|\(\?[id]*dU\)", "", pattern.java).replace("(?<g", "(?P<g")) if check is None else check(pattern)
    except (re.error, ValueError) as e:
        if check is not None or "unbalanced" in str(e) or "unterminated" in str(e) or "missing )" in str(e):
            raise PackError(f"{where}: {e}") from None
    return pattern


def distinct(items: list[dict], key: str, where: str, shape: re.Pattern) -> None:
    seen = set()
    for k, item in enumerate(items):
        value = item.get(key, "")
        need(bool(shape.fullmatch(value)), f"{where}[{k}].{key}: \"{value}\" is not a valid id")
        need(value not in seen, f"{where}: duplicate {key} \"{value}\"")
        seen.add(value)


def _locations(m: dict, check) -> list[Location]:
    items = m.get("logLocations", [])
    distinct(items, "id", "logLocations", SLUG)
    out = []
    for k, item in enumerate(items):
        only(item, KEYS["logLocations"], f"logLocations[{k}]")
        p = pattern_of(item.get("file"), f"logLocations[{k}].file", check)
        missing = [g for g in "ymd" if p.number(g) is None] if item.get("dated", True) else []
        need(not missing, f"logLocations[{k}].file: lacks the groups {', '.join(missing)}, which date a file; for others say \"dated\": false")
        out.append(Location(item["id"], item.get("label", item["id"]), item.get("dir", ""), p, item.get("dated", True)))
    return out


def _timestamps(m: dict) -> list:
    out = []
    for k, item in enumerate(m.get("timestamps", [])):
        if isinstance(item, str):
            need(item in BUILT_IN, f"timestamps[{k}]: \"{item}\" is not one of {', '.join(BUILT_IN)}")
            out.append(item)
            continue
        need(isinstance(item, dict) and isinstance(item.get("regex"), str), f"timestamps[{k}]: a name or a regex is needed")
        try:
            out.append(custom(item["regex"]))
        except ValueError as e:
            raise PackError(f"timestamps[{k}].regex: {e}") from None
    return out


def _fields(m: dict, check) -> list[Field]:
    items = m.get("fields", [])
    need(len(items) <= MOST_FIELDS, f"fields: {len(items)} are more than the {MOST_FIELDS} a pack may have")
    distinct(items, "key", "fields", KEY)
    out = []
    for k, item in enumerate(items):
        only(item, KEYS["fields"], f"fields[{k}]")
        p = pattern_of(item.get("regex"), f"fields[{k}].regex", check)
        need(p.groups > 0, f"fields[{k}].regex: has no group to take the value from")
        need(item.get("gate") != "", f"fields[{k}].gate: may not be empty")
        kind = item.get("type", "string")
        need(kind in ("string", "number", "guid"), f"fields[{k}].type: \"{kind}\" is not a type")
        out.append(Field(f"{m['id']}.{item['key']}", item.get("label", item["key"]), kind, p, item.get("gate")))
    return out


def _discovery(m: dict, locations: list[Location], environments: set[str], check) -> None:
    d = m.get("discovery", {"type": "none"})
    need(d.get("type") in DISCOVERY, f"discovery.type: \"{d.get('type')}\" is not one of {', '.join(DISCOVERY)}")
    only(d, DISCOVERY[d["type"]], "discovery")
    known = lambda env, where: need(env in environments, f"{where}: \"{env}\" names no environment of this pack")
    for k, s in enumerate(d.get("services", [])):
        only(s, KEYS["services"], f"discovery.services[{k}]")
        need(bool(s.get("name", "").strip()), f"discovery.services[{k}].name: may not be empty")
        known(s.get("environment"), f"discovery.services[{k}].environment")
        need(s.get("location") in {None, *(x.id for x in locations)}, f"discovery.services[{k}].location: \"{s.get('location')}\" names no log location of this pack")
    if d["type"] == "scrape":
        need(re.match("https?://", d.get("url", "")) is not None, "discovery.url: must be an http(s) URL")
        container = pattern_of(d.get("container"), "discovery.container", check)
        need(container.number("name") is not None, "discovery.container: has no group called name")
        need(not d.get("environments") or container.number("section") is not None, "discovery.environments: rules look at the group section, which the container lacks")
        for part in ("endpoint", "logDir"):
            if d.get(part) is not None:
                pattern_of(d[part], f"discovery.{part}", check)
        need(d.get("logDir") is None or bool(locations), "discovery.logDir: the pack has no logLocations to choose from")
        for k, rule in enumerate(d.get("environments", [])):
            known(rule.get("environment"), f"discovery.environments[{k}].environment")
        if d.get("defaultEnvironment") is not None:
            known(d["defaultEnvironment"], "discovery.defaultEnvironment")


def _charts(m: dict, fields: list[Field], check) -> None:
    kinds = {f.key.split(".", 1)[1]: f.kind for f in fields}
    for k, c in enumerate(m.get("charts", [])):
        where = f"charts[{k}]"
        only(c, KEYS["charts"], where)
        need(bool(c.get("name", "").strip()), f"{where}.name: may not be empty")
        group, metric, value = c.get("groupBy", "none"), c.get("metric", "count"), c.get("value")
        for name, got, allowed in (("mode", c.get("mode", "timeline"), ("timeline", "category")), ("bucket", c.get("bucket", "auto"), ("auto", *BUCKETS)), ("metric", metric, METRICS)):
            need(got in allowed, f"{where}.{name}: \"{got}\" is not one of {', '.join(allowed)}")
        if group.startswith("field:"):
            need(group[6:] in kinds, f"{where}.groupBy: no field \"{group[6:]}\" in this pack")
        else:
            need(group in ("none", "service", "file", "matchedGroup", "custom"), f"{where}.groupBy: \"{group}\" is not known")
        if value not in (None, "custom"):
            need(value.startswith("field:"), f"{where}.value: \"{value}\" is neither custom nor a field:<key>")
            need(value[6:] in kinds, f"{where}.value: no field \"{value[6:]}\" in this pack")
            need(kinds[value[6:]] == "number", f"{where}.value: field \"{value[6:]}\" holds no numbers")
        need(metric == "count" or value is not None, f"{where}.value: \"{metric}\" works on a number; say which")
        if "custom" in (group, value):
            need(c.get("customRegex") is not None, f"{where}.customRegex: \"custom\" needs one")
        if c.get("customRegex") is not None:
            pattern_of(c["customRegex"], f"{where}.customRegex", check)


def compile_pack(text: str, origin: str = "user", check: Callable[[Pattern], object] | None = None) -> Pack:
    """A checked pack, or PackError. `check` is given every pattern, e.g. to compile it where Java runs."""
    try:
        m = json.loads(text)
    except ValueError as e:
        raise PackError(f"Invalid pack JSON: {e}") from None
    need(isinstance(m, dict), "Invalid pack JSON: an object is needed")
    only(m, KEYS[""], "")
    need(bool(SLUG.fullmatch(m.get("id", ""))), f"id: \"{m.get('id', '')}\" is not made of a-z, 0-9 and -")
    need(bool(m.get("name", "").strip()), "name: may not be empty")
    source = m.get("source")
    need(isinstance(source, dict) and source.get("type") in SOURCES, f"source: a type of {', '.join(SOURCES)} is needed")
    only(source, SOURCES[source["type"]], "source")
    m["environments"] = m.get("environments") or [{"id": "default", "label": "Default"}]
    distinct(m["environments"], "id", "environments", SLUG)
    locations, fields = _locations(m, check), _fields(m, check)
    stamps = _timestamps(m)
    _discovery(m, locations, {e["id"] for e in m["environments"]}, check)
    _charts(m, fields, check)
    return Pack(m, locations, stamps, fields, origin)


@dataclass
class Registry:
    packs: list[Pack] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, bundled: Iterable[str], folder: str | None = None, disabled: Iterable[str] = ()) -> Registry:
        """Bundled packs, then the folder's *.json by name; one with a known id takes its place. Errors are kept by file."""
        out, off = cls(), set(disabled)
        files = sorted(Path(folder).glob("*.json")) if folder and Path(folder).is_dir() else []
        for name, origin, read in [*((f"bundled {k}", "bundled", lambda t=t: t) for k, t in enumerate(bundled)), *((p.name, "user", p.read_text) for p in files)]:
            try:
                pack = compile_pack(read(), origin)
            except (PackError, OSError) as e:
                out.errors[name] = str(e)
                continue
            at = next((k for k, p in enumerate(out.packs) if p.id == pack.id), None)
            if at is None:
                out.packs.append(pack)
            else:
                out.packs[at] = pack
        out.packs = [p for p in out.packs if p.id not in off]
        return out

    def environments(self) -> list[tuple[str, str]]:
        """Of several labels for one id the first counts."""
        out: dict[str, str] = {}
        for p in self.packs:
            for e in p.manifest["environments"]:
                out.setdefault(e["id"], e.get("label", e["id"]))
        return list(out.items())

    def fields(self) -> list[Field]:
        return [f for p in self.packs for f in p.fields]

    def presets(self) -> list[dict]:
        """Saved queries; with several packs, each named after its pack too."""
        several = len(self.packs) > 1
        return [{**q, "name": f"{p.manifest['name']}: {q['name']}" if several else q["name"]} for p in self.packs for q in p.manifest.get("presets", [])]

    def get(self, pack_id: str) -> Pack | None:
        return next((p for p in self.packs if p.id == pack_id), None)
