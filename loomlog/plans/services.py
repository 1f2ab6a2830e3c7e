"""The list of services: added, removed and set by hand, with what a refresh may and may not change. Services are dicts of
id, name, environment, pack_id, endpoint, endpoint_manual, location and source (manual, seeded or scraped)."""

from __future__ import annotations

from .config import Config, endpoint as usable_endpoint, service_id
from .packs import Pack, Registry


class ServiceError(ValueError):
    pass


def _service(config: Config, wanted: str) -> dict:
    found = next((s for s in config.services if s["id"] == wanted), None)
    if found is None:
        raise ServiceError(f"There is no service {wanted}")
    return found


def _pack(registry: Registry, pack_id: str | None) -> Pack:
    pack = registry.get(pack_id)
    if pack is None:
        raise ServiceError(f"There is no pack {pack_id}")
    return pack


def add(config: Config, registry: Registry, name: str, environment: str, pack_id: str, endpoint: str) -> dict:
    """A service that discovery does not list. Its environment may be any that a pack or the settings name."""
    pack = _pack(registry, pack_id)
    one = service_id(environment, name)
    if environment not in {e for e, _ in registry.environments()} | {e["id"] for e in config.environments}:
        raise ServiceError(f"There is no environment {environment}")
    if any(s["id"] == one for s in config.services):
        raise ServiceError(f"{one} exists already")
    service = {"id": one, "name": name.strip(), "environment": environment, "pack_id": pack_id, "endpoint": usable_endpoint(endpoint, pack.manifest["source"]["type"]), "endpoint_manual": True, "location": None, "source": "manual"}
    config.services = sorted([*config.services, service], key=lambda s: (s["id"].lower(), s["id"]))
    return service


def remove(config: Config, wanted: str) -> None:
    """Its stored files stay. A scraped service cannot go, as the next refresh would bring it back."""
    if _service(config, wanted).get("source") == "scraped":
        raise ServiceError(f"{wanted} comes from its pack's discovery and cannot be removed")
    config.services = [s for s in config.services if s["id"] != wanted]


def set_endpoint(config: Config, registry: Registry, wanted: str, endpoint: str) -> None:
    """Set, or with an empty text cleared; either way it is the user's from here on, and no refresh changes it."""
    service = _service(config, wanted)
    kind = _pack(registry, service.get("pack_id")).manifest["source"]["type"]
    service["endpoint"] = usable_endpoint(endpoint, kind) if endpoint.strip() else None
    service["endpoint_manual"] = True


def set_location(config: Config, registry: Registry, wanted: str, location: str) -> None:
    """One of the pack's locations, or with an empty text none, so that the next sync looks for it again."""
    service = _service(config, wanted)
    pack = _pack(registry, service.get("pack_id"))
    chosen = location.strip() or None
    if chosen is not None and all(x.id != chosen for x in pack.locations):
        raise ServiceError(f"{pack.manifest['name']} has no log location {chosen}")
    service["location"] = chosen
