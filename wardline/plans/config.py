"""Settings, with defaults and from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Config:
    """Names (in upper case) and defaults are fixed values: deployments set them.

    Settings of a server that a batch or stream doesn't have (addresses, workers, limits of calls, deadlines,
    exporters, drain times) are left out; so are those of a model's files and of a judge's service, which
    belong to the functions that make them.
    """

    failure_mode: str = "failClosed"
    human_review_mode: str = "pass"
    max_content_bytes: int = 32768
    scan_tail_bytes: int = 8192
    scan_max_payload_bytes: int = 1048576
    enable_regex_scanner: bool = True
    enable_promptguard: bool = True
    enable_agent_alignment: bool = False
    enable_redaction: bool = True
    redact_on_review: bool = True
    redact_request_params: bool = False
    redaction_max_bytes: int = 262144
    lf_promptguard_block_threshold: float = 0.9
    pg_review_threshold: float = 0.5
    pg_max_windows: int = 16
    allow_tools: tuple[str, ...] = ()
    deny_tools: tuple[str, ...] = ()
    invariant_window: int = 256
    invariant_args_max_bytes: int = 4096
    invariant_trace_key_headers: tuple[str, ...] = ()
    invariant_sticky_ttl_s: float = 600.0
    audit_log_path: str = ""
    audit_caller_headers: tuple[str, ...] = ("x-forwarded-user",)
    audit_hash_chain: bool = True
    audit_hmac_key: str = ""
    guardrail_version: str = ""
    unhealthy_scanner_error_rate: float = 0.5
    unhealthy_scanner_window: int = 100
    unhealthy_scanner_min_samples: int = 20
    dry_run: bool = False


#: What a value may be, and what counts where it is something else.
_CHOICES = {"failure_mode": ("failClosed", "failOpen"), "human_review_mode": ("pass", "deny")}
#: Settings whose name in the environment isn't their own.
_NAMES = {"dry_run": "GUARDRAIL_DRY_RUN"}


def _parse(name: str, raw: str, default: Any) -> Any:
    if name in _CHOICES:
        return next((c for c in _CHOICES[name] if c.lower() == raw.strip().lower()), _CHOICES[name][0])
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(p.strip() for p in raw.split(",") if p.strip())
    try:
        return type(default)(raw)
    except ValueError:
        return default


def from_env(env: Mapping[str, str] | None = None) -> Config:
    """Fields by their upper-case names; numbers that can't be read leave the default. A review threshold over
    the block threshold comes down to it."""
    env = os.environ if env is None else env
    found = {f.name: _parse(f.name, env[n], f.default) for f in fields(Config) if (n := _NAMES.get(f.name, f.name.upper())) in env}
    cfg = Config(**found)
    return cfg if cfg.pg_review_threshold <= cfg.lf_promptguard_block_threshold else Config(**{**found, "pg_review_threshold": cfg.lf_promptguard_block_threshold})
