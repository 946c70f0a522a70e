"""Settings in four tiers: default, global, group, table."""

from __future__ import annotations

#: Keys, kinds and defaults of group and global settings.
KEYS = {
    "drain_poll_ms": ("int", 100), "duckdb_buffer_memory_mb": ("int", 16), "duckdb_flush_memory_mb": ("int", 512), "duckdb_threads": ("int", 1), "ducklake_catalog_connstr": ("string", None), "flush_interval_ms": ("int", 5000), "flush_batch_threshold": ("int", 50000), "max_concurrent_flushes": ("int", 4), "max_queued_bytes": ("bigint", 1_000_000_000),
}
#: Keys and kinds of table settings.
TABLE_KEYS = {"duckdb_flush_memory_mb": "int", "duckdb_threads": "int", "flush_batch_threshold": "int", "flush_interval_ms": "int", "routing_enabled": "bool"}
LIMITS = {"int": 2**31 - 1, "bigint": 2**63 - 1}


class ConfigError(ValueError):
    pass


def checked(key: str, value: str, table: bool = False):
    """The typed value of a setting, or ConfigError."""
    kinds = TABLE_KEYS if table else {k: kind for k, (kind, _) in KEYS.items()}
    if key not in kinds:
        raise ConfigError(f"unknown {'table config' if table else 'config'} key: '{key}'. Valid keys: {', '.join(kinds)}")
    kind, text = kinds[key], str(value)
    if kind == "string":
        if not text:
            raise ConfigError(f"'{key}' must be a non-empty string")
        return text
    if kind == "bool":
        if text not in ("true", "false"):
            raise ConfigError(f"'{key}' must be true or false, got '{text}'")
        return text == "true"
    digits = text[1:] if text[:1] in "+-" else text
    if not (digits.isascii() and digits.isdigit()) or abs(int(text)) > LIMITS[kind]:
        raise ConfigError(f"'{key}' must be an integer, got '{text}'")
    if int(text) <= 0:
        raise ConfigError(f"'{key}' must be positive, got {int(text)}")
    return int(text)


def resolved(global_: dict, group: dict | None = None) -> dict:
    return {k: (group or {}).get(k, global_.get(k, default)) for k, (_, default) in KEYS.items()}


def for_table(group: dict, table: dict) -> dict:
    """A group's resolved settings under a table's; routing is on unless the table says otherwise."""
    return {**group, **{k: v for k, v in table.items() if k in group}, "routing_enabled": table.get("routing_enabled", True)}


def shown(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
