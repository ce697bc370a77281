"""Settings from TOML, and run manifests."""

from __future__ import annotations

import json
import platform
import subprocess
import tomllib
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.daily import Terms
from .files import exists, file_record, write_text


@dataclass(frozen=True)
class Settings:
    """Sections of the file. `features`, `baseline` and `model` have no defaults for what depends on
    the organisation; the others do."""

    paths: dict[str, str]
    terms: Terms
    rolling_window_days: int
    min_history_days: int
    model: dict
    selection: dict = field(default_factory=lambda: {"correlation_limit": 0.9, "min_features": 20, "max_features": 30, "repetitions": 5})
    evaluation: dict = field(default_factory=lambda: {"alert_k": 10, "top_q": 3, "early_warning_days": 7})
    temporal: dict = field(default_factory=lambda: {"train_days": 180, "validation_days": 60, "test_days": 90, "step_days": 90, "embargo_days": 0})
    drift: dict = field(default_factory=lambda: {"method": "page_hinkley", "delta": 0.005, "threshold": 20.0, "min_instances": 30})


def load_settings(path: str) -> Settings:
    raw = tomllib.loads(Path(path).read_text())
    base = Path(path).resolve().parent
    full = lambda p: p if "://" in p else str((base / p).resolve())
    f = dict(raw["features"])
    terms = Terms(f.pop("start_hour"), f.pop("end_hour"), **{k: tuple(v) for k, v in f.items()})
    defaults = {k: Settings.__dataclass_fields__[k].default_factory() for k in ("selection", "evaluation", "temporal", "drift")}
    merged = {k: v | raw.get(k, {}) for k, v in defaults.items()}
    need = ("peer_clusters", "trees", "anomaly_weight", "peer_weight", "seed")
    if missing := [k for k in need if k not in raw["model"]]:
        raise ValueError(f"[model] lacks {', '.join(missing)}")
    return Settings({k: full(v) for k, v in raw["paths"].items()}, terms, raw["baseline"]["rolling_window_days"], raw["baseline"]["min_history_days"], {"family": "isolation_forest", "neighbours": 35, "nu": 0.01} | raw["model"], **merged)


def _commit(folder: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def write_manifest(spark: SparkSession, folder: str, command: str, seed: int, inputs: list[str], conf: dict[str, str], with_hash: bool = False) -> str:
    """A record of a run in a folder of its own under `folder`, in whatever store that is."""
    import pyspark

    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    n, out = 0, f"{folder}/{stamp}"
    while exists(spark, out):
        n += 1
        out = f"{folder}/{stamp}-{n}"
    body = {"command": command, "seed": seed, "commit": _commit(str(Path(__file__).parent)), "python": platform.python_version(), "pyspark": pyspark.__version__, "conf": conf, "inputs": [file_record(spark, p, with_hash) for p in inputs]}
    write_text(spark, f"{out}/manifest.json", json.dumps(body, indent=2, sort_keys=True))
    return out
