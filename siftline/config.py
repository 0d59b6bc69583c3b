"""Settings, their defaults and an INI-like loader."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Names of algorithms and of a job's states; fixed values.
ALGORITHMS = ("kmeans++", "dbscan", "birch", "mean_shift", "optics", "gmm", "agglomerative")
STATUSES = ("queued", "batching", "analyzing", "rendering", "ready", "failed")
# What a failed job says; fixed values.
SATURATED, UNSCHEDULED = "ingress queue is saturated", "failed to schedule analysis task"
MAX_DIMENSIONS, MAX_KEYS, MAX_ROWS, MAX_BATCH_JOBS = 8, 16, 2_000_000, 256
#: Jobs that wait at most, and jobs that are known at most.
MAX_WAITING, MAX_JOBS = 2048, 4096


@dataclass(frozen=True)
class Config:
    """Settings. Defaults are fixed values.

    encoding, memory_pool_size_mb, worker_threads, async_render_threads and fuzzy_threshold are read and kept for
    callers that show them; Spark's own settings take their place.
    """

    case_sensitive: bool = False
    fuzzy_threshold: float = 0.85
    max_rows_per_analysis: int = MAX_ROWS
    encoding: str = "UTF-8"
    memory_pool_size_mb: int = 1024
    aggregation_window_ms: int = 20
    min_batch_size_kb: int = 64
    worker_threads: int = 8
    async_render_threads: int = 4
    timestamp_keys: tuple[str, ...] = ("timestamp", "@timestamp", "ts", "time_local", "event_time")
    numeric_keys: tuple[str, ...] = ("latency", "duration", "cpu_usage", "mem_used", "status_code", "bytes_sent")
    category_keys: tuple[str, ...] = ("method", "level", "service_id", "node_role", "region_az", "client_ip")
    default_algorithm: str = "dbscan"
    dbscan_eps: float = 0.45
    dbscan_min_samples: int = 10
    enable_time_series_trend: bool = True
    enable_outlier_detection: bool = True
    enable_correlation_matrix: bool = True
    enable_shannon_entropy: bool = True
    enable_linear_regression: bool = True
    theme: str = "hyper-dark"
    canvas_width: int = 1440
    canvas_height: int = 500
    color_palette: tuple[str, ...] = ("#00FF41", "#00E5FF", "#FF0055", "#FFCC00", "#9D00FF")
    paths: tuple[str, ...] = ("metadata.context.source_ip", "payload.metrics.temp", "kubernetes.pod.name")

    def __post_init__(self):
        if self.dbscan_min_samples < 1:
            raise ValueError("dbscan_min_samples must be at least 1")
        if self.dbscan_eps < 0:
            raise ValueError("dbscan_eps must not be negative")

    @property
    def dims(self) -> int:
        """Feature columns: one per numeric key, eight without keys or with more."""
        return min(len(self.numeric_keys) or MAX_DIMENSIONS, MAX_DIMENSIONS)

    def effective_keys(self) -> Config:
        """The settings as an array read with the wrong stride sees them: every second key in each third place, else empty names."""
        keys = tuple(self.numeric_keys[i // 3 * 2] if i % 3 == 0 else "" for i in range(len(self.numeric_keys)))
        return replace(self, numeric_keys=keys)


def algorithm(name: str | None, default: str = "dbscan") -> str:
    """The algorithm of that name, without regard to case; "kmeans" is an alias; unknown names give the default."""
    lower = (name or "").lower()
    return "kmeans++" if lower == "kmeans" else lower if lower in ALGORITHMS else default


def _value(text: str, kind: type):
    if kind is bool:
        return text.lower() in ("true", "1", "yes", "on")
    if kind is tuple:
        return tuple(str(x) for x in json.loads(text))[:MAX_KEYS]
    return kind(text.strip('"')) if kind is str else kind(text)


def from_environment() -> Config:
    """Settings of the file that SIFTLINE_CONFIG names, ``collect.ini`` in the working folder without it; defaults where there is no file."""
    path = Path(os.environ.get("SIFTLINE_CONFIG", "collect.ini"))
    return load(path.read_text(encoding="utf-8")) if path.is_file() else Config()


def load(text: str) -> Config:
    """Settings from ``key = value`` lines; sections, comments (; or #) and unknown keys are passed over."""
    known = {f.name: type(f.default) for f in fields(Config)}
    found = {}
    for line in text.splitlines():
        key, mark, value = line.strip().partition("=")
        key = key.strip()
        if mark and key in known and line.strip()[0] not in ";#[":
            found[key] = _value(value.strip(), known[key])
    if "default_algorithm" in found:
        found["default_algorithm"] = algorithm(found["default_algorithm"])
    return Config(**found)
