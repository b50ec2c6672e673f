"""Settings from a YAML or JSON file as the small structures the operators take."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from chainlake.operators.identity import IdentityConfig


@dataclass(frozen=True)
class Settings:
    identity: IdentityConfig
    user_tables: list[tuple[str, list[str]]] = field(default_factory=list)
    user_collections: list[tuple[str, list[str]]] = field(default_factory=list)
    excluded_tables: list[str] = field(default_factory=list)
    sensitive_columns: dict[str, list[str]] = field(default_factory=dict)
    key_patterns: list[tuple[str, str]] = field(default_factory=list)
    excluded_prefixes: list[str] = field(default_factory=list)


def _parse(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _columns(value) -> list[str]:
    return list(value) if isinstance(value, list) else [value]


def load_settings(path: str) -> Settings:
    """Read the identity, schema and object sections; JSON where no YAML parser is installed."""
    with open(path, encoding="utf-8") as handle:
        return settings_from(_parse(handle.read()))


def settings_from(doc: dict) -> Settings:
    doc = doc.get("proxy", doc)
    identity = doc.get("identity", {})
    credentials = {
        protocol: tuple(
            name for entry in entries for name in (entry.get("username"), entry.get("access_key")) if name
        )
        for protocol, entries in (identity.get("app_credentials") or {}).items()
    }
    sources = tuple(s["ip"] for s in identity.get("app_sources") or [] if s.get("ip"))
    schema = doc.get("schema", {})
    objects = doc.get("s3", {})
    return Settings(
        identity=IdentityConfig(
            identity.get("mode", "source_credential").replace("+", "_"), sources, credentials
        ),
        user_tables=[(t["table"], _columns(t["user_id_column"])) for t in schema.get("user_tables") or []],
        user_collections=[
            (c["collection"], _columns(c["user_id_field"])) for c in schema.get("user_collections") or []
        ],
        excluded_tables=list(schema.get("excluded_tables") or []),
        sensitive_columns={
            t["table"]: list(t["sensitive_columns"])
            for t in schema.get("user_tables") or []
            if t.get("sensitive_columns")
        },
        key_patterns=[
            (p.get("bucket", "*"), p["key_pattern"]) for p in objects.get("user_data_patterns") or []
        ],
        excluded_prefixes=list(objects.get("excluded_prefixes") or []),
    )
