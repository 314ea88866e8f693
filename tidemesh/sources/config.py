"""Configuration documents: nested settings with defaults, and radio presets."""

from __future__ import annotations

import copy
import json
import os
import secrets
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(default: Mapping, own: Mapping) -> dict:
    """own over default, key by key into nested mappings; what own lacks is filled in."""
    out = copy.deepcopy(dict(default))
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def from_environment(settings: Mapping, names: Mapping[str, tuple[str, ...]]) -> dict:
    """settings with those taken from environment variables that are set: variable -> path of keys."""
    out = copy.deepcopy(dict(settings))
    for variable, path in names.items():
        if variable in os.environ:
            at = out
            for k in path[:-1]:
                at = at.setdefault(k, {})
            at[path[-1]] = os.environ[variable]
    return out


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading and writing configuration files takes the yaml package") from e
    return yaml


def load(path: str | Path, key_path: str | Path | None = None, level_variable: str = "TIDEMESH_LOG_LEVEL") -> dict:
    """A YAML file's settings. A missing identity key is read from key_path, or made and kept there; the log level may come from the environment."""
    if not Path(path).exists():
        raise FileNotFoundError(f"no configuration at {path}")
    with open(path, encoding="utf-8") as f:
        settings = _yaml().safe_load(f) or {}
    mesh = settings.setdefault("mesh", {})
    if "identity_key" not in mesh:
        mesh["identity_key"] = identity_key(key_path or Path(path).with_name("identity.key"))
    return from_environment(settings, {level_variable: ("logging", "level")})


def identity_key(path: str | Path) -> bytes:
    """The 32 bytes kept at a path, made at random the first time."""
    path = Path(path)
    if path.exists():
        return path.read_bytes()
    path.parent.mkdir(parents=True, exist_ok=True)
    key = secrets.token_bytes(32)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.write(key)
    return key


def save(settings: Mapping, path: str | Path, backup: bool = True) -> Path | None:
    """Writes settings as YAML, in their order; returns where the file that was there before is kept."""
    path, kept = Path(path), None
    if backup and path.exists():
        kept = path.with_suffix(".yaml.backup")
        path.replace(kept)
    with open(path, "w", encoding="utf-8") as f:
        _yaml().safe_dump(dict(settings), f, default_flow_style=False, sort_keys=False, allow_unicode=True)
    return kept


class Refreshed:
    """A value that is loaded anew when it is older than ``ttl_s``: small tables that batches of a stream are joined with."""

    def __init__(self, load: Callable[[], object], ttl_s: float = 60.0) -> None:
        self.load, self.ttl_s, self.at, self.value = load, ttl_s, None, None

    def get(self, now: float):
        if self.at is None or now - self.at > self.ttl_s:
            self.value, self.at = self.load(), now
        return self.value


def flat(spark: SparkSession, settings: Mapping) -> DataFrame:
    """path, value (JSON text) of every setting."""

    def walk(at: Mapping, path: str):
        for k, v in at.items():
            if isinstance(v, Mapping):
                yield from walk(v, f"{path}{k}.")
            else:
                yield f"{path}{k}", json.dumps(v)

    return spark.createDataFrame(list(walk(settings, "")), "path string, value string")


def coerced(given: Mapping[str, str], defaults: Mapping) -> dict:
    """Request parameters in the type of their default; None stays as it is given."""
    return {k: (type(d)(given[k]) if d is not None else given[k]) if k in given else d for k, d in defaults.items()}


PRESETS = "config struct<suggested_radio_settings: struct<entries: array<struct<title: string, description: string, frequency: string, spreading_factor: string, bandwidth: string, coding_rate: string>>>>"


def radio_presets(spark: SparkSession, path: str) -> DataFrame:
    """title, description, frequency, spreading_factor, bandwidth, coding_rate of a document of suggested settings."""
    return presets_of(spark.read.text(path, wholetext=True))


def presets_of(documents: DataFrame) -> DataFrame:
    """radio_presets() of documents as JSON text (value); those without presets have none."""
    parsed = documents.select(F.from_json("value", PRESETS).alias("d"))
    return parsed.select(F.explode("d.config.suggested_radio_settings.entries").alias("e")).select("e.*")


def lookup(settings: Mapping, path: str, default=""):
    """The value at a dotted path, the default where it is missing or null."""
    at = settings
    for k in path.split("."):
        at = at.get(k) if isinstance(at, Mapping) else None
    return default if at is None else at
