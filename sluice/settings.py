"""Settings of a tenant from four JSON files, adopted all together or not at all."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from sluice import pipes, policy
from sluice.catalog import tenant_id
from sluice.errors import Invalid
from sluice.functions.timestamps import duration

FILES = ("roles.json", "policies.json", "pipes.json", "config.json")
SIZES = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}


# The sections of config.json with their keys and, of whole numbers, the range.
MOST = (1 << 63) - 1
SECTIONS = {
    "clickhouse": dict.fromkeys(("addr", "http_port", "http_scheme", "database", "username", "password", "query_timeout", "insert_timeout", "tls", "headers", "max_open_conns", "max_idle_conns")),
    "auth": dict.fromkeys(("jwks_url", "jwt_secret", "role_claim")),
    "dedupe": dict.fromkeys(("enabled", "id_field", "require_id", "retention", "tables")),
    "dlq": dict.fromkeys(("enabled", "tables")),
    "ingest": {"max_batch_bytes": (1, MOST), "max_batch_wait_ms": (1, MOST), "retry_backoff_max": (1, MOST)},
    "query": {"default_max_rows": (1, MOST), "timestamp_bucket_seconds": (0, MOST)},
    "schema": {"refresh_interval": (1, MOST)},
    "stream": {"keepalive_interval": (1, MOST), "keepalive_buckets": (1, MOST), "gap_window_minutes": (0, MOST), "subscriber_queue": (1, 10_000)},
    "mq": {"max_bytes_gb": (1, MOST)},
    "cors": dict.fromkeys(("allowed_origins",)),
}
SHORTEST_RETENTION = 120_000


def millis(value) -> int:
    """5s, 500ms or bare milliseconds; nothing finer."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    d = duration(value) if isinstance(value, str) else None
    if d is None or d.microseconds % 1000:
        raise Invalid(f"bad duration {value!r}")
    return round(d.total_seconds() * 1000)


def byte_size(value) -> int:
    """4GiB isn't 4GB."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KMGT]?i?B?)\s*", str(value))
    if not m or m[2] not in SIZES:
        raise Invalid(f"bad size {value!r}")
    return int(float(m[1]) * SIZES[m[2]])


@dataclass(frozen=True)
class Settings:
    policy: policy.Policy
    pipes: dict[str, pipes.Pipe] = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    def query(self, key: str, default: int) -> int:
        return int(self.config.get("query", {}).get(key, default))

    def dedupe(self, table: str) -> dict:
        """The table's own over the general; nothing if it is switched off."""
        general = dict(self.config.get("dedupe", {}))
        own = general.pop("tables", {}).get(table, {})
        return general | own if general.pop("enabled", True) else {}

    def retention(self, table: str) -> float:
        """Seconds that a stored id counts; 0 is for good."""
        return millis(self.dedupe(table).get("retention", 0)) / 1000

    def dead_letters(self, table: str) -> bool:
        general = self.config.get("dlq", {})
        return general.get("tables", {}).get(table, {}).get("enabled", general.get("enabled", True))

    def log_bytes(self) -> int:
        return self.config.get("mq", {}).get("max_bytes_gb", 0) * 10**9


def no_twins(pairs):
    seen = [k for k, _ in pairs]
    if len(seen) != len(set(seen)):
        raise Invalid(f"key given twice: {sorted(k for k in seen if seen.count(k) > 1)[0]!r}")
    return dict(pairs)


def read(folder: str) -> dict:
    out = {}
    for name in FILES:
        path = os.path.join(folder, name)
        try:
            with open(path, encoding="utf-8") as f:
                out[name] = json.load(f, object_pairs_hook=no_twins)
        except FileNotFoundError:
            out[name] = {}
        except ValueError as e:
            raise Invalid(f"{name}: {e}") from None
    return out


def decode(raw: dict) -> Settings:
    """Raises Invalid with every finding."""
    bad: list[str] = []
    roles, tables = raw["roles.json"], {}
    for table, by_role in raw["policies.json"].get("tables", {}).items():
        for role, ops in by_role.items():
            entry = {}
            for op, body in ops.items():
                body = dict(body)
                cols, aggs = body.pop("columns", {}), body.pop("aggregations", {})
                try:
                    if op == "select":
                        caps = {k: byte_size(v) if k == "max_memory_usage" else millis(v) if k == "max_execution_time" else int(v) for k, v in body.pop("limits", {}).items()}
                        entry[op] = policy.Select(tuple(cols.get("allow", ())), tuple(cols.get("deny", ())), body.pop("filter", {}), tuple(aggs.get("allow", ())), tuple(aggs.get("deny", ())), caps)
                    elif op == "insert":
                        entry[op] = policy.Insert(tuple(cols.get("allow", ())), tuple(cols.get("deny", ())), body.pop("check", {}))
                    else:
                        bad.append(f"{table}/{role}: unknown operation {op}")
                except (Invalid, ValueError) as e:
                    bad.append(f"{table}/{role}: {e}")
                bad += [f"{table}/{role}: unknown field {k}" for k in body if k not in ("filter", "check", "limits")]
            tables.setdefault(table, {})[role] = entry
    found = policy.Policy(tables, roles.get("default_role", "anonymous"), roles.get("admin_role", "admin"))
    known = set(roles.get("roles", ())) | {found.default_role, found.admin_role}
    bad += policy.validate(found, known)
    made = {}
    for p in raw["pipes.json"].get("pipes", []):
        try:
            pipe = pipes.Pipe(p["name"], p["sql"], tuple(pipes.Parameter(**x) for x in p.get("parameters", ())), p.get("description", ""), tuple(p.get("allowed_roles", ())))
        except (KeyError, TypeError) as e:
            bad.append(f"pipe: {e}")
            continue
        bad += [f"pipe {pipe.name}: {x}" for x in pipes.check(pipe)]
        bad += [f"pipe {pipe.name}: unknown role {r}" for r in pipe.allowed_roles if r not in known]
        bad += [f"pipe {pipe.name}: unknown type {x.type}" for x in pipe.parameters if x.type not in ("string", "number", "integer", "boolean", "array")]
        if pipe.name in made:
            bad.append(f"pipe {pipe.name}: given twice")
        made[pipe.name] = pipe
    bad += config_faults(raw["config.json"])
    if bad:
        raise Invalid("; ".join(bad), findings=bad)
    return Settings(found, made, raw["config.json"])


def config_faults(config: dict) -> list[str]:
    """Unknown sections and keys, numbers out of range, and retentions that the log's own window would outlast."""
    bad = [f"config.json: unknown section {name}" for name in config if name not in SECTIONS]
    for name, body in config.items():
        if name not in SECTIONS:
            continue
        if not isinstance(body, dict):
            bad.append(f"config.json: {name} must be an object")
            continue
        for key, value in body.items():
            if key not in SECTIONS[name]:
                bad.append(f"config.json: unknown field {name}.{key}")
            elif (span := SECTIONS[name][key]) and not (type(value) is int and span[0] <= value <= span[1]):
                bad.append(f"config.json: {name}.{key} must be a whole number from {span[0]} to {span[1]}")
    for name, keys in (("dedupe", {"id_field", "require_id", "retention"}), ("dlq", {"enabled"})):
        section = config.get(name) if isinstance(config.get(name), dict) else {}
        for where, body in ((name, section), *((f"{name}.tables.{t}", b) for t, b in section.get("tables", {}).items())):
            if where != name:
                bad += [f"config.json: unknown field {where}.{k}" for k in body if k not in keys]
            try:
                if 0 < millis(body.get("retention", 0)) < SHORTEST_RETENTION or millis(body.get("retention", 0)) < 0:
                    bad.append(f"config.json: {where}.retention must be 0 or at least two minutes")
            except Invalid as e:
                bad.append(f"config.json: {where}.retention: {e}")
    return bad


class Registry:
    """Settings by tenant: a flat folder is tenant 0, else a folder for each tenant.  A bad reload keeps the last good."""

    def __init__(self, folder: str):
        self.folder, self.current = folder, {}
        self.reload()

    def reload(self) -> None:
        flat = any(os.path.exists(os.path.join(self.folder, f)) for f in FILES)
        where = {tenant_id(): self.folder} if flat else {tenant_id(n): os.path.join(self.folder, n) for n in sorted(os.listdir(self.folder)) if os.path.isdir(os.path.join(self.folder, n))}
        self.current = {t: decode(read(p)) for t, p in where.items()}

    def __getitem__(self, tenant: str) -> Settings:
        return self.current[tenant_id(tenant)]
