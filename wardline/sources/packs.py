"""Rule packs from JSON files that Spark can read or from Python modules, with versions; a bad file never replaces a good pack."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from wardline.operators.fold import TraceFold
from wardline.operators.rules import DEFAULT_PACK, SAMPLES, Rule, from_json, lint


def load(spark: SparkSession, path: str | None = None, module: str | None = None) -> tuple[Rule, ...]:
    """The pack at `path`, else that of `module` (its RULES), else those named by WARDLINE_RULES and
    WARDLINE_RULES_MODULE, else the bundled one. ValueError says what is wrong with a pack."""
    if not path and not module:
        path, module = os.environ.get("WARDLINE_RULES"), os.environ.get("WARDLINE_RULES_MODULE")
    if path:
        return from_json(spark.read.text(path, wholetext=True).first().value)
    if not module:
        return DEFAULT_PACK
    pack = tuple(importlib.reload(importlib.import_module(module)).RULES)
    if strange := [r for r in pack if not isinstance(r, Rule)]:
        raise ValueError(f"no rules: {strange}")
    if problems := lint(pack):
        raise ValueError("; ".join(problems))
    return pack


def tried(pack: Sequence[Rule]) -> dict[str, list[str]]:
    """Which rules of a pack hold on each of the sample traces, in order: what a pack would do, without data."""
    out = {}
    for name, calls in SAMPLES.items():
        out[name] = []
        for rule in pack:
            fold = TraceFold([rule])
            for tool, args in calls:
                fold.record(tool, json.dumps(args), 0.0)
            if fold.evaluate(0.0):
                out[name].append(rule.name)
    return out


@dataclass
class Reloader:
    """Holds the pack in force. `reload` counts the version up or keeps the old pack; both are logged."""

    spark: SparkSession
    path: str | None = None
    module: str | None = None
    pack: tuple[Rule, ...] = ()
    version: int = 0
    log: list[dict] = field(default_factory=list)

    def reload(self) -> bool:
        try:
            self.pack, error = load(self.spark, self.path, self.module), ""
            self.version += 1
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a file, the pack in force stays
            error = f"{type(e).__name__}: {e}"[:500]
        self.log.append({"event": "rules_reload", "ok": not error, "rules_version": str(self.version), "rule_count": len(self.pack), "error": error, "ts_ms": time.time() * 1000})
        return not error

    def lines(self) -> DataFrame:
        """The log as audit records (stream, seq, record) for `audit.chain` and `audit_log.write`; it is then empty."""
        rows, self.log = self.log, []
        return self.spark.createDataFrame([("rules", int(r["ts_ms"]), json.dumps(r)) for r in rows], "stream string, seq long, record string")
