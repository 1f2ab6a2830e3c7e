"""Settings and saved queries, as JSON on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..operators.search import DEFAULT_CAP, LEAST_CAP

LEAST_MEMORY_MB, DEFAULT_MEMORY_MB = 64, 2048


@dataclass
class Config:
    services: list[dict] = field(default_factory=list)
    environments: list[dict] = field(default_factory=list)
    queries: list[dict] = field(default_factory=list)
    seeded: list[str] = field(default_factory=list)
    disabled_packs: list[str] = field(default_factory=list)
    max_hits: int = DEFAULT_CAP
    memory_mb: int = DEFAULT_MEMORY_MB
    use_memory: bool = False

    def normalised(self, default_pack: str | None = None) -> Config:
        """Caps within their bounds (0 hits: no limit); services without a pack belong to the default one."""
        self.max_hits = 0 if self.max_hits <= 0 else max(self.max_hits, LEAST_CAP)
        self.memory_mb = max(self.memory_mb, LEAST_MEMORY_MB)
        for s in self.services:
            s.setdefault("pack_id", default_pack)
        return self

    def save(self, path: str) -> None:
        """Written beside and moved into place, so a reader never sees half a file."""
        beside = Path(f"{path}.new")
        beside.write_text(json.dumps(asdict(self), indent=2))
        os.replace(beside, path)

    @classmethod
    def load(cls, path: str, default_pack: str | None = None) -> Config:
        """An unreadable file counts as none; unknown settings are left out."""
        try:
            data = json.loads(Path(path).read_text())
            return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__}).normalised(default_pack)
        except (OSError, ValueError, TypeError, AttributeError):
            return cls().normalised(default_pack)


def slug(label: str) -> str:
    """An environment's id from its label."""
    out = re.sub("[^a-z0-9]+", "-", label.strip().lower()).strip("-")
    if not out:
        raise ValueError("A name needs letters or digits")
    return out


def service_id(environment: str, name: str) -> str:
    """`<environment>/<name>`; a name that could leave its folder is refused."""
    name = name.strip()
    if not name or name in (".", "..") or re.search(r"[/\\:*?\"<>|\x00-\x1f]", name):
        raise ValueError(f"Not a usable service name: {name!r}")
    return f"{environment}/{name}"


def endpoint(text: str, source: str) -> str:
    """HTTP endpoints without a final slash, and https only; folders as they are."""
    text = text.strip()
    if source != "kudu":
        return text
    text = text if "://" in text else f"https://{text}"
    if not text.startswith("https://"):
        raise ValueError("The endpoint must be https, as a token travels with it")
    return text.rstrip("/")
