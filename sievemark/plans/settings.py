"""Parameters of scanning from defaults, a JSON file, or the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from sievemark.functions import lists as L


@dataclass(frozen=True)
class Thresholds:
    short_circuit: float = 0.95
    scanners: Mapping[str, float] = field(default_factory=lambda: dict(L.THRESHOLDS))
    severities: Mapping[str, float] = field(default_factory=lambda: {"critical": 0.9, "high": 0.7, "medium": 0.4, "low": 0.01})
    confidences: Mapping[str, float] = field(default_factory=lambda: {"default": 0.5, "high_security": 0.3})

    def scanner(self, name: str) -> float:
        return self.scanners.get(name, L.DEFAULT_THRESHOLD)

    def confidence(self, category: str) -> float:
        return self.confidences.get(category, self.confidences.get("default", 0.5))


@dataclass(frozen=True)
class Rule:
    pattern: str
    category: str = ""
    case_sensitive: bool = False


@dataclass(frozen=True)
class Parameters:
    thresholds: Thresholds = field(default_factory=Thresholds)
    allowed: tuple[Rule, ...] = ()
    blocked: tuple[Rule, ...] = ()
    default_action: str = "block"
    redaction: bool = True
    source: str = "default"


def _parse(text: str, source: str) -> Parameters:
    given = json.loads(text)
    plain = Parameters()
    own = Thresholds(**{**plain.thresholds.__dict__, **given.get("thresholds", {})})
    rules = {k: tuple(Rule(**r) for r in given.get(k, ())) for k in ("allowed", "blocked")}
    return Parameters(own, rules["allowed"], rules["blocked"], given.get("default_action", plain.default_action), given.get("redaction", plain.redaction), source)


def from_file(spark: SparkSession, path: str) -> Parameters:
    """A JSON file in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return _parse(rows[0][0], path)


def from_environment(prefix: str, environment: Mapping[str, str] | None = None) -> Parameters:
    """PREFIX_SHORT_CIRCUIT_THRESHOLD, PREFIX_DEFAULT_ACTION and PREFIX_ENABLE_REDACTION; a number that can't be read is passed over."""
    env, plain = os.environ if environment is None else environment, Parameters()
    try:
        limit = float(env[f"{prefix}_SHORT_CIRCUIT_THRESHOLD"])
    except (KeyError, ValueError):
        limit = plain.thresholds.short_circuit
    redact = env.get(f"{prefix}_ENABLE_REDACTION")
    return Parameters(Thresholds(short_circuit=limit), default_action=env.get(f"{prefix}_DEFAULT_ACTION", plain.default_action), redaction=plain.redaction if redact is None else redact.lower() == "true", source=f"environment:{prefix}")


@dataclass(frozen=True)
class Cache:
    max_size: int = 1000
    ttl_seconds: int = 3600


# Cache sizes by purpose.
CACHES = {"production": Cache(), "edge": Cache(100, 600)}


@dataclass(frozen=True)
class Inference:
    """Settings of a model's use; variant is FP32, FP16 or INT8."""

    enabled: bool = False
    variant: str = "FP16"
    threshold: float = 0.5
    fallback_to_heuristic: bool = True
    cache_enabled: bool = True
    cache: Cache = CACHES["production"]
