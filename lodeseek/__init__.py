"""A Spark-native engine for document search and corpus work; the names below are imported when they are first used. [Q1]"""

from __future__ import annotations

import importlib

_PLACES = {
    "Engine": "lodeseek.api", "NotFoundError": "lodeseek.api", "Store": "lodeseek.sources.store", "Queue": "lodeseek.streaming.jobs", "Settings": "lodeseek.sources.config", "settings": "lodeseek.sources.config",
    "session": "lodeseek.session", "ingest": "lodeseek.sources.ingest", "chunk_pages": "lodeseek.operators.chunking", "bm25": "lodeseek.operators.retrievers", "dense": "lodeseek.operators.retrievers",
    "late": "lodeseek.operators.retrievers", "hybrid": "lodeseek.operators.retrievers", "visual": "lodeseek.operators.retrievers", "page_vectors": "lodeseek.operators.retrievers", "graph": "lodeseek.operators.graph",
    "build_indexes": "lodeseek.plans.retrieve", "retrieve": "lodeseek.plans.retrieve", "MODES": "lodeseek.plans.retrieve", "plan_query": "lodeseek.plans.planner", "plan_batch": "lodeseek.plans.planner",
    "QueryPlan": "lodeseek.plans.planner", "MERGE_STRATEGIES": "lodeseek.plans.planner", "cards": "lodeseek.operators.evidence", "profiles": "lodeseek.operators.profile",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_PLACES[name]), name)
