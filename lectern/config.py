"""Settings of the engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from lectern.errors import ConfigError

CHARS_PER_TOKEN = 1.5


@dataclass(frozen=True)
class EngineConfig:
    """Sizes, windows and weights; checked on creation."""

    # The defaults of all settings.
    chunk_target_tokens: int = 350
    chunk_hard_max_tokens: int = 700
    chunk_overlap_ratio: float = 0.15
    candidates: int = 30
    dense_overfetch: int = 2
    rrf_k: int = 60
    dense_weight: float = 0.9
    lexical_weight: float = 0.1
    top_k: int = 5
    max_sentences: int = 5
    batch_items: int = 32
    batch_chars: int = 160_000
    item_chars: int = 20_000

    def __post_init__(self) -> None:
        whole = ("chunk_target_tokens", "chunk_hard_max_tokens", "candidates", "dense_overfetch", "rrf_k", "top_k", "max_sentences", "batch_items", "batch_chars", "item_chars")
        for name in whole:
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be at least 1")
        if not 0 <= self.chunk_overlap_ratio < 1:
            raise ConfigError("chunk_overlap_ratio must lie in [0, 1)")
        if min(self.dense_weight, self.lexical_weight) < 0 or self.dense_weight + self.lexical_weight == 0:
            raise ConfigError("weights must not be negative, and one of them must be positive")

    @property
    def target_chars(self) -> int:
        """Characters up to which sentences are packed into one chunk."""
        return max(1, int(self.chunk_target_tokens * CHARS_PER_TOKEN))

    @property
    def hard_chars(self) -> int:
        """Characters no chunk exceeds."""
        return max(1, int(self.chunk_hard_max_tokens * CHARS_PER_TOKEN))

    @property
    def overlap_chars(self) -> int:
        """Characters a chunk repeats of the one before it."""
        return int(self.target_chars * self.chunk_overlap_ratio)


def load_config(path: str) -> EngineConfig:
    """Settings of a JSON file; what it does not name keeps its default. Messages name settings, never values."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError) as problem:
        raise ConfigError(f"settings can't be read: {type(problem).__name__}") from None
    default = asdict(EngineConfig())
    if not isinstance(held, dict) or set(held) - set(default):
        raise ConfigError("unknown settings", names=sorted(set(held) - set(default)) if isinstance(held, dict) else [])
    wrong = [k for k, v in held.items() if isinstance(v, bool) or not isinstance(v, (int, type(default[k])))]
    if wrong:
        raise ConfigError("settings of the wrong kind", names=sorted(wrong))
    return EngineConfig(**held)


@dataclass(frozen=True)
class Thresholds:
    """Bars of the evidence gate, for one model."""

    # The calibrated bars.
    min_dense: float = 0.54
    min_coverage: float = 0.40
    min_coverage_high: float = 0.75
    min_sentence_overlap: float = 0.15
    model_id: str = ""
    version: int = 0
    calibrated: bool = False

    def __post_init__(self) -> None:
        bars = (self.min_dense, self.min_coverage, self.min_coverage_high, self.min_sentence_overlap)
        if any(not 0 <= b <= 1 for b in bars):
            raise ConfigError("bars must lie in [0, 1]")
        if self.min_coverage_high < self.min_coverage:
            raise ConfigError("min_coverage_high must not be below min_coverage")


def load_thresholds(path: str, model_id: str) -> Thresholds:
    """Bars of a file; defaults if it is missing, unreadable or not calibrated. Calibrated bars of another model are an
    error: they are never reused."""
    default = Thresholds(model_id=model_id)
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return default
    if not isinstance(held, dict) or not held.get("calibrated"):
        return default
    if held.get("model_id") != model_id:
        raise ConfigError(f"thresholds were calibrated for {held.get('model_id')!r}, not for {model_id!r}")
    return replace(default, **{k: held[k] for k in asdict(default) if k in held})


def save_thresholds(path: str, thresholds: Thresholds) -> Thresholds:
    """Write calibrated bars under the next version of the file."""
    try:
        with open(path, encoding="utf-8") as f:
            version = int(json.load(f).get("version", 0))
    except (OSError, ValueError, AttributeError):
        version = 0
    out = replace(thresholds, version=version + 1, calibrated=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(out), f, indent=2, sort_keys=True)
    return out
