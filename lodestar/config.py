"""Settings of a deployment, from a file of JSON or YAML, a dict, or the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from lodestar.errors import ValidationError


@dataclass(frozen=True)
class ServiceSettings:
    host: str = "127.0.0.1"
    port: int = 8000
    api_key: str | None = None
    requests_per_minute: int = 0
    data_dir: str | None = None
    auto_save_seconds: float = 60.0
    log_level: str = "INFO"


@dataclass(frozen=True)
class Settings:
    dimension: int = 128
    metric: str = "euclidean"
    index: str = "flat"
    batch_size: int = 1000
    ivf: dict = field(default_factory=lambda: {"n_clusters": 100, "n_probe": 10})
    pq: dict = field(default_factory=lambda: {"n_subvectors": 8, "n_bits": 8})
    service: ServiceSettings = field(default_factory=ServiceSettings)

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> Settings:
        """Unknown keys raise; the dict stays as it is."""
        known = {f.name for f in fields(cls)}
        if extra := set(values) - known:
            raise ValidationError(f"no settings {sorted(extra)}")
        values = dict(values)
        if isinstance(values.get("service"), Mapping):
            values["service"] = ServiceSettings(**values["service"])
        return cls(**values)


def load_settings(path: str | None = None, environ: Mapping[str, str] = os.environ) -> Settings:
    """Settings of a file, or of the one that LODESTAR_CONFIG names; defaults if there is none."""
    path = path or environ.get("LODESTAR_CONFIG")
    if not path or not os.path.exists(path):
        return Settings()
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValidationError("YAML files need the yaml package") from e
        return Settings.from_dict(yaml.safe_load(text) or {})
    return Settings.from_dict(json.loads(text) if text.strip() else {})
