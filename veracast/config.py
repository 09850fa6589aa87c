"""Configuration: one nested dictionary, overridden by a JSON document."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path
from typing import Any

from . import schema

#: The defaults that scores are defined with.
DEFAULTS: dict[str, Any] = {
    "paths": {
        "input": "data/messages.parquet",
        "store": "out/store",
        "author_scores": "out/author_scores.parquet",
        "scored_messages": "out/scored_messages.parquet",
        "manifest": "out/manifest.json",
    },
    "runtime": {
        "mode": "full",
        "build_mode": "lean",
        "batch_size": 50_000,
        "max_batches": None,
        "sample_n_rows": None,
        "overwrite_outputs": True,
        "enable_progress_logs": True,
        "progress_every_batches": 5,
        "top_n_domain_context": 128,
        "author_batch_size": 5_000,
        "message_batch_size": 100_000,
        "refs_mode": "max",
        "dedup_scope": "global",
        "null_text_mode": "cluster",
        "nfkc": True,
    },
    "semantic_adapter": {
        "enabled": True,
        "model_name": None,
        "loader": None,
        "supported_languages": ["en"],
        "unsupported_language_score": 0.5,
        "max_length": 512,
        "batch_size": 32,
        "device": "auto",
    },
    "thresholds": {
        "min_text_len": 5,
        "rare_language_threshold": 100,
        "long_text_start": 30,
        "hourly_penalty_start": 10,
        "language_penalty_start": 4,
        "hard_hourly_bot_threshold": 15,
        "hard_bot_time_window_sec": 300,
        "hard_bot_repeat_threshold": 5,
        "hard_bot_multi_author_threshold": 2,
        "hard_bot_time_cluster_threshold": 3,
        "spam_repeat_threshold": 3,
        "spam_multi_author_threshold": 2,
        "spam_time_cluster_threshold": 3,
    },
    "rules": {"long_text_requires_spam": False},
    "dynamic_final_weighting": {"enabled": True, "min_confidence_weight": 0.2, "power": 2.0, "sigmoid_steepness": 8.0},
    "neutral_score_policy": {"neutral_score": 0.5, "epsilon": 1e-6},
    "dominant_signal_policy": {
        "enabled": True,
        "mode": "floor",
        "threshold": 0.68,
        "repeat_hard_threshold": 5,
        "scope": {"author": True, "message": True},
    },
    "derived_thresholds": {},
    "weights": {
        "behavioral_vs_semantic": {"behavioral": 0.60, "semantic": 0.40},
        "author_vs_message": {"author": 0.70, "message": 0.30},
        "author": {"activity": 0.35, "timing": 0.25, "repetition": 0.30, "diversity": 0.10, "metadata": 0.0},
        "message": {
            "same_text_repeat": 0.24,
            "spam_pattern": 0.25,
            "hashtag_spam": 0.18,
            "token_repetition": 0.15,
            "long_text": 0.10,
            "keyword_signal": 0.08,
        },
    },
}

#: Further names that settings files use, and ours (None: accepted, and of no use here).
ALIASES: dict[tuple[str, str], str | None] = {
    ("paths", "input_parquet"): "input",
    ("paths", "batch_sqlite_db"): "store",
    ("paths", "author_scores_parquet"): "author_scores",
    ("paths", "scored_messages_parquet"): "scored_messages",
    ("paths", "manifest_path"): "manifest",
    ("paths", "clean_output_parquet"): None,
    ("paths", "author_feature_stage_parquet"): None,
    ("weights", "author_components"): "author",
    ("weights", "message_components"): "message",
}
#: Settings that hold names of the user's own, or have no default.
_OPEN = {("derived_thresholds",), ("semantic_adapter", "models")}
_OPTIONAL = {("semantic_adapter", "models"), ("semantic_adapter", "selected_model_key")}

#: Overrides by name: a run over everything, a bounded trial with the model, a small one without.
PRESETS: dict[str, dict[str, Any]] = {
    "full_build": {"runtime": {"mode": "full", "sample_n_rows": None, "max_batches": None}},
    "model_test": {"runtime": {"mode": "sample", "sample_n_rows": 200_000, "max_batches": 2}, "semantic_adapter": {"enabled": True}},
    "demo": {"runtime": {"mode": "sample", "sample_n_rows": 5_000, "max_batches": 1}, "semantic_adapter": {"enabled": False}},
}


def deep_merge(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``override``, nested dictionaries merged key by key; neither argument changes."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def settled(override: dict[str, Any]) -> dict[str, Any]:
    """``override`` under our names; KeyError for a setting that there is not."""
    out: dict[str, Any] = {}
    for section, values in override.items():
        if not isinstance(values, dict):
            out[section] = values
            continue
        out[section] = {}
        for name, value in values.items():
            ours = ALIASES.get((section, name), name)
            if ours is not None:
                out[section][ours] = value
    _check(out, DEFAULTS, ())
    return out


def _check(override: dict[str, Any], known: dict[str, Any], at: tuple[str, ...]) -> None:
    for name, value in override.items():
        path = (*at, name)
        if path in _OPEN or path in _OPTIONAL:
            continue
        if name not in known:
            raise KeyError(f"there is no setting {'.'.join(path)}")
        if isinstance(known[name], dict):
            if not isinstance(value, dict):
                raise TypeError(f"{'.'.join(path)} is a section")
            _check(value, known[name], path)


def make_config(override: dict[str, Any] | None = None, preset: str | None = None) -> dict[str, Any]:
    """The defaults with a preset and then ``override`` laid over them; unknown settings raise."""
    base = deep_merge(DEFAULTS, PRESETS[preset]) if preset else DEFAULTS
    return deep_merge(base, settled(override or {}))


def load_config(path: str | Path | None = None) -> dict[str, Any]:
    return make_config(json.loads(Path(path).read_text(encoding="utf-8")) if path else None)


def write_default_config(path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(DEFAULTS, indent=2), encoding="utf-8")
    return path


def semantic_settings(config: dict[str, Any]) -> dict[str, Any]:
    """The semantic section, with the chosen entry of ``models`` (named by ``selected_model_key``) laid over it."""
    section = config["semantic_adapter"]
    if "models" not in section:
        return dict(section)
    key = section.get("selected_model_key")
    if key not in section["models"]:
        raise KeyError(f"no model named {key!r}; there are {sorted(section['models'])}")
    return {k: v for k, v in section.items() if k != "models"} | section["models"][key]


def canonical_hash(value: Any) -> str:
    """SHA-256 of the value as JSON with sorted keys, ASCII only and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


#: The thresholds that the store depends on.
_STORE_THRESHOLDS = ("min_text_len", "rare_language_threshold", "long_text_start", "hard_bot_time_window_sec")


def store_config(config: dict[str, Any]) -> dict[str, Any]:
    """What the store's content depends on."""
    return {
        "input": config["paths"]["input"],
        "top_n_domain_context": config["runtime"]["top_n_domain_context"],
        "build_mode": config["runtime"]["build_mode"],
        "thresholds": {k: config["thresholds"][k] for k in _STORE_THRESHOLDS},
        "rules": config["rules"],
        "semantic_adapter": config["semantic_adapter"],
        "store_schema_version": schema.STORE_SCHEMA_VERSION,
        "store_columns": list(schema.store_columns(config["runtime"]["build_mode"])),
    }


def scoring_config(config: dict[str, Any]) -> dict[str, Any]:
    """What the scores depend on besides the store, the final weighting included."""
    return {
        "thresholds": {k: v for k, v in config["thresholds"].items() if k not in _STORE_THRESHOLDS},
        "rules": config["rules"],
        "dynamic_final_weighting": config["dynamic_final_weighting"],
        "neutral_score_policy": config["neutral_score_policy"],
        "dominant_signal_policy": config["dominant_signal_policy"],
        "weights": config["weights"],
        "score_schema_version": schema.SCORE_SCHEMA_VERSION,
    }
