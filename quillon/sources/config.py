"""Configuration: environment over file over defaults, checked as a whole."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str | float) -> float:
    """A duration such as ``1m30s``."""
    if not isinstance(text, str):
        return float(text)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if text.strip("+-") != "".join(a + b for a, b in parts) or not parts:
        if text == "0":
            return 0.0
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(a) * _UNITS[b] for a, b in parts)
    return -total if text.startswith("-") else total


def parse_key_list(text: str) -> dict[str, list[str]]:
    """``key:scope|scope`` entries. Errors never show a key."""
    out: dict[str, list[str]] = {}
    for entry in filter(None, (e.strip() for e in text.split(","))):
        key, _, scopes = entry.partition(":")
        if not key:
            raise ValueError("an API key entry has an empty key")
        if key in out:
            raise ValueError("API_KEYS lists a key twice")
        out[key] = [s.strip() for s in scopes.split("|") if s.strip()]
    return out


@dataclass
class Config:
    """Engine settings; durations in seconds."""

    addr: str = ":8080"
    read_header_timeout: float = 5.0
    read_timeout: float = 10.0
    write_timeout: float = 15.0
    idle_timeout: float = 60.0
    shutdown_timeout: float = 15.0
    log_level: str = "info"
    log_format: str = "json"
    coupons_url: str = "http://localhost:8081"
    coupons_timeout: float = 2.0
    coupon_cache_ttl: float = 300.0
    coupon_negative_cache_ttl: float = 60.0
    cache_max_entries: int = 10_000
    coupon_rate_limit: int = 20
    coupon_rate_window: float = 60.0
    order_rate_limit: int = 10
    order_rate_window: float = 60.0
    poll_interval: float = 2.0
    discount_percent: int = 10
    min_files: int = 2
    api_keys: dict[str, list[str]] = field(default_factory=lambda: {"apitest": ["create_order"]})
    trusted_proxies: list[str] = field(default_factory=list)
    cors_allowed_origins: list[str] = field(default_factory=lambda: ["*"])

    def problems(self) -> list[str]:
        """Everything that is wrong, not only the first."""
        out = [f"{n.upper()} must be positive" for n in ("read_header_timeout", "read_timeout", "write_timeout", "idle_timeout", "shutdown_timeout", "coupons_timeout", "coupon_rate_window", "order_rate_window", "poll_interval") if getattr(self, n) <= 0]
        if self.coupon_cache_ttl < 0 or self.coupon_negative_cache_ttl < 0:
            out.append("coupon cache TTLs must not be negative")
        if self.cache_max_entries < 1:
            out.append("CACHE_MAX_ENTRIES must be at least 1")
        if self.coupon_rate_limit < 1 or self.order_rate_limit < 1:
            out.append("rate limits must be at least 1")
        if not 0 <= self.discount_percent <= 100:
            out.append("DISCOUNT_PERCENT must be between 0 and 100")
        if not self.api_keys:
            out.append("API_KEYS must contain at least one key")
        return out + _log_problems(self)


@dataclass
class ServiceConfig:
    """Settings of the code service."""

    coupons_addr: str = "127.0.0.1:8081"
    coupons_dir: str = "data/coupons"
    coupons_poll_interval: float = 2.0
    coupons_discount_percent: int = 10
    shutdown_timeout: float = 10.0
    log_level: str = "info"
    log_format: str = "json"

    def problems(self) -> list[str]:
        out = [] if os.path.isdir(self.coupons_dir) else [f'COUPONS_DIR "{self.coupons_dir}" is not a readable directory']
        if not 0 <= self.coupons_discount_percent <= 100:
            out.append("COUPONS_DISCOUNT_PERCENT must be between 0 and 100")
        if self.coupons_poll_interval <= 0 or self.shutdown_timeout <= 0:
            out.append("COUPONS_POLL_INTERVAL and SHUTDOWN_TIMEOUT must be positive")
        return out + _log_problems(self)


def _log_problems(config: Config | ServiceConfig) -> list[str]:
    out = [] if config.log_format in ("json", "text") else [f'unknown LOG_FORMAT "{config.log_format}", want json or text']
    if not re.fullmatch(r"(?i)(debug|info|warn|error)([+-][0-9]+)?", config.log_level):
        out.append(f'unknown LOG_LEVEL "{config.log_level}"')
    return out


def _read(path: str) -> dict:
    """The settings of a TOML, YAML or JSON file."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            return tomllib.load(f)
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: no YAML reader is installed") from e
            return yaml.safe_load(f) or {}
        return json.load(f)


def load(env: Mapping[str, str] | None = None, path: str | None = None, kind: type = Config) -> Config | ServiceConfig:
    """Defaults, a JSON, TOML or YAML file over them, the environment over both. ValueError lists all problems."""
    given = {k.lower(): v for k, v in _read(path).items()} if path else {}
    env = os.environ if env is None else env
    given |= {f.name: env[f.name.upper()] for f in fields(kind) if f.name.upper() in env}
    config = kind()
    for f in fields(kind):
        if f.name not in given:
            continue
        value, default = given[f.name], getattr(config, f.name)
        if isinstance(default, dict):
            value = parse_key_list(value) if isinstance(value, str) else dict(value)
        elif isinstance(default, list):
            value = [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
        elif isinstance(default, str):
            value = str(value)
        elif isinstance(default, float):
            value = seconds(value)
        else:
            value = int(value)
        setattr(config, f.name, value)
    if found := config.problems():
        raise ValueError("; ".join(found))
    return config
