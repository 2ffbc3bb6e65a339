"""Settings: defaults, overridden by a .env file and the environment. [A13]

Numbers that do not parse fall back to their default.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    data_root: str = "data"
    gemini_api_key: str = ""
    gemini_model: str = ""
    mlx_model_path: str = ""
    ocr_min_dim: int = 1200
    ocr_max_dim: int = 2400
    ocr_mode: str = "Hybrid"
    dpi: int = 150
    chunk_max_words: int = 220
    chunk_overlap_words: int = 40
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    dense_dimensions: int = 384
    late_dimensions: int = 128
    late_max_doc_tokens: int = 256
    visual_dimensions: int = 384
    visual_backend: str = "baseline"
    visual_compression: str = "none"
    colpali_model: str = ""
    device: str = "auto"
    jobs_root: str = "data/jobs"
    job_poll_interval: float = 2.0
    top_k: int = 5
    retrieval_mode: str = "planner"
    planner_merge_strategy: str = "score_max"
    planner_rerank: bool = True
    route_vote_bonus: float = 0.08
    rerank_overlap_weight: float = 0.10


#: Names that do not follow the rule RR_<NAME>.
NAMES = {"gemini_api_key": "GEMINI_API_KEY", "gemini_model": "GEMINI_MODEL", "mlx_model_path": "MLX_GLM_OCR_MODEL", "ocr_min_dim": "OCR_MIN_DIM", "ocr_max_dim": "OCR_MAX_DIM"}


def parse(text: str, default):
    if isinstance(default, bool):
        return text.strip().lower() in TRUE
    if isinstance(default, int | float):
        try:
            return type(default)(text)
        except ValueError:
            return default
    return text


def read_settings(environment: dict[str, str], dotenv: str = "") -> Settings:
    given: dict[str, str] = {}
    for line in dotenv.splitlines():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not name.startswith("#"):
            given[name.strip()] = value.strip().strip("'\"")
    given |= environment
    return Settings(**{f.name: parse(given[n], f.default) for f in fields(Settings) if (n := NAMES.get(f.name, f"RR_{f.name.upper()}")) in given})


@lru_cache(1)
def settings() -> Settings:
    at = Path(".env")
    return read_settings(dict(os.environ), at.read_text(encoding="utf-8", errors="replace") if at.is_file() else "")


def factory(name: str):
    """What module:name names."""
    import importlib

    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)
