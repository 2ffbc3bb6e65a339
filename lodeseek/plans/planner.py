"""The rule-based planner: which retrievers a question goes to, and how deep. [L1-L3]

One question is planned in Python on the driver; ``plan_batch`` is the same ladder as one CASE expression over a
table of questions. Both are driven by the same rule table.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T

MERGE_STRATEGIES = ("score_max", "route_vote")


@dataclass(frozen=True)
class Rule:
    """Needs words of all its groups; a rule without groups always applies."""

    kind: str
    groups: tuple[str, ...]
    routes: tuple[str, ...]
    reason: str
    explanation: str


# --- fixed values ---------------------------------------------------------------------------------------------
TABLE_TERMS = [
    "table", "tables", "tabular", "row", "rows", "column", "columns", "cell", "cells", "invoice", "invoices", "form", "forms", "total", "totals",
    "amount", "amounts", "spreadsheet", "spreadsheets", "ledger", "register", "financial", "metric", "metrics", "stat", "stats", "grid", "matrix",
    "receipt", "receipts", "schedule", "schedules", "roster", "rosters", "catalog", "catalogs", "catalogue", "inventory", "inventories", "budget",
    "budgets", "roi", "cost", "costs", "revenue", "revenues", "payroll", "balance", "transaction", "transactions", "checkbook",
]
VISUAL_TERMS = [
    "figure", "figures", "diagram", "diagrams", "chart", "charts", "plot", "plots", "image", "images", "imagery", "screenshot", "screenshots",
    "flowchart", "flowcharts", "visual", "visually", "visualization", "visualizations", "layout", "layouts", "page", "pages", "scan", "scans",
    "scanning", "handwriting", "graph", "graphs", "drawing", "drawings", "sketch", "sketches", "photo", "photos", "photograph", "photographs",
    "illustration", "illustrations", "map", "maps", "ui", "interface", "interfaces", "mockup", "mockups", "wireframe", "wireframes", "thumbnail",
    "thumbnails", "logo", "logos", "icon", "icons", "blueprint", "blueprints", "render", "renders", "rendering", "infographic", "infographics",
    "painting", "paintings",
]
MULTIHOP_TERMS = [
    "compare", "comparison", "comparing", "contrast", "relationship", "relationships", "across", "between", "cross", "corpus", "documents", "multi",
    "summarize", "summarizes", "summary", "synthesis", "synthesize", "aggregate", "among", "difference", "differences", "similar", "similarities",
    "similarly", "both", "vs", "versus", "common", "commonalities", "together", "relation", "relations", "correlation", "correlations", "trend",
    "trends", "pattern", "patterns", "merge", "merging", "combine", "combines", "combination", "intersection", "overlap", "overlaps", "overlapping",
    "align", "aligns", "alignment",
]
GRAPH_TERMS = [
    "section", "sections", "reference", "references", "entity", "entities", "topic", "topics", "related", "neighbor", "neighbors", "neighborhood",
    "context", "contexts", "hierarchy", "hierarchical", "outline", "structure", "structures", "navigation", "routing", "citation", "citations",
    "cite", "cites", "bibliography", "bibliographic", "appendix", "appendices", "subsection", "subsections", "paragraph", "paragraphs", "clause",
    "clauses", "chapter", "chapters", "preface", "foreword", "index", "indexes", "glossary", "tableofcontents", "toc", "parent", "child", "sibling",
    "ancestor", "descendant", "subtree", "subgraph",
]
GROUPS = {"visual": VISUAL_TERMS, "table": TABLE_TERMS, "multihop": MULTIHOP_TERMS, "graph": GRAPH_TERMS}
#: In order; "identifier" and "prose" (any word outside all groups) are predicates of their own.
RULES = (
    Rule("exact_lookup", ("identifier",), ("bm25",), "strong identifier pattern detected", "Detected strong identifier pattern (DOI, code, version, or alphanumeric ID), routing directly to BM25."),
    Rule("visual", ("visual", "prose"), ("visual", "hybrid"), "visual/layout terms detected", "Detected visual/layout terms, prioritizing visual retrieval with hybrid fallback."),
    Rule("visual", ("visual",), ("visual",), "visual/layout terms detected", "Detected visual-only terms, using visual retrieval."),
    Rule("multi_hop", ("table", "multihop"), ("hybrid", "late", "bm25"), "table/form terms with multi-hop intent", "Detected table/form terms with multi-hop/comparison intent, routing to late interaction and hybrid."),
    Rule("table_or_form", ("table",), ("late", "hybrid"), "table/form terms detected", "Detected table/form terms, prioritizing late interaction with hybrid fallback."),
    Rule("multi_hop", ("graph", "multihop"), ("graph", "hybrid"), "graph/section terms with multi-hop intent", "Detected graph/section terms with multi-hop intent, routing to graph traversal and hybrid."),
    Rule("graph_nav", ("graph",), ("graph", "hybrid"), "graph/section terms detected", "Detected graph/section terms, routing to graph retrieval with hybrid fallback."),
    Rule("multi_hop", ("multihop",), ("hybrid", "dense"), "multi-hop terms detected", "Detected multi-hop/comparison terms, routing to hybrid and dense retrieval."),
    Rule("semantic", (), ("dense", "bm25"), "default semantic routing", "No specific visual/table/graph/identifier terms detected; using dense + BM25 hybrid."),
)
# --- end of fixed values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class QueryPlan:
    query_type: str
    routes: list[str]
    reason: str
    route_explanation: str
    route_settings: dict[str, dict] = field(default_factory=dict)
    merge_strategy: str = "score_max"

    def to_dict(self) -> dict:
        return asdict(self)


def route_settings(kind: str, routes: tuple[str, ...]) -> dict[str, dict]:
    """Depth factors and labels of each route. [L3]"""
    extra = {"late": {"scorer": "maxsim"}, "graph": {"expansion": "section_entity_reference_graph"}, "hybrid": {"fusion": "reciprocal_rank"}}
    out = {r: {"top_k_factor": 3.0 if kind == "multi_hop" else 2.0, **extra.get(r, {})} for r in routes}
    if kind == "exact_lookup":
        out["bm25"] = {"top_k_factor": 2.5}
    if kind == "visual":
        out["visual"] = {"top_k_factor": 3.0}
    return out


def route_depth(k: int, factor: float) -> int:
    """[D26]"""
    return max(k, round(k * factor))


def check_strategy(merge_strategy: str) -> None:
    if merge_strategy not in MERGE_STRATEGIES:
        raise ValueError(f"Unsupported planner merge strategy: {merge_strategy}")


def question_words(question: str) -> set[str]:
    import re

    words = set(re.findall(r"[a-z0-9_]+", question.lower()))
    cut = {(w[: -len(s)], s) for w in words for s in T.STEM_SUFFIXES if w.endswith(s) and len(w) > len(s) + 2}
    return words | {c for c, _ in cut} | {c + "y" for c, s in cut if s == "ies"}


def names_identifier(question: str, words: set[str]) -> bool:
    import re

    if re.search(r"\b(?:10\.\d{4,9}/[^\s]+|[\w.-]+@[\w.-]+)\b", question, re.IGNORECASE) or re.search(r"\b[A-Z]{2,}[-_ ]?\d{2,}\b|\bv?\d+[.]\d+[.]\d+\b", question):
        return True
    mixed = any(len(w) >= 4 and re.search("[a-z]", w) and re.search("[0-9]", w) for w in words)
    return bool(words & set(T.IDENTIFIER_HINTS)) and (mixed or bool(re.search(r"\b\d{3,}\b", question)))


def plan_query(question: str, merge_strategy: str = "score_max") -> QueryPlan:
    check_strategy(merge_strategy)
    words = question_words(question)
    holds = {name: bool(words & set(terms)) for name, terms in GROUPS.items()}
    holds["identifier"] = names_identifier(question, words)
    holds["prose"] = bool(words.difference(*GROUPS.values()))
    rule = next(r for r in RULES if all(holds[g] for g in r.groups))
    return QueryPlan(rule.kind, list(rule.routes), rule.reason, rule.explanation, route_settings(rule.kind, rule.routes), merge_strategy)


def plan_batch(questions: DataFrame, merge_strategy: str = "score_max") -> DataFrame:
    """questions (query_id, question) with query_type, routes, reason, route_factors (map<string,double>)."""
    check_strategy(merge_strategy)
    rows = questions.select("*", F.inline(F.array(F.struct(T.stems(T.token_set("question")).alias("terms")))))
    listed = {name: F.array(*map(F.lit, terms)) for name, terms in GROUPS.items()}
    holds = {name: F.arrays_overlap("terms", words) for name, words in listed.items()}
    holds["identifier"] = T.is_identifier("question", F.col("terms"))
    holds["prose"] = F.size(F.array_except("terms", F.concat(*listed.values()))) > 0
    chosen = F
    for r in RULES:
        value = F.struct(
            F.lit(r.kind).alias("query_type"), F.array(*map(F.lit, r.routes)).alias("routes"), F.lit(r.reason).alias("reason"),
            F.map_from_arrays(F.array(*map(F.lit, r.routes)), F.array(*[F.lit(s["top_k_factor"]) for s in route_settings(r.kind, r.routes).values()])).alias("route_factors"),
        )
        if not r.groups:
            chosen = chosen.otherwise(value)
            break
        wanted = holds[r.groups[0]]
        for g in r.groups[1:]:
            wanted = wanted & holds[g]
        chosen = chosen.when(wanted, value)
    return rows.select(*questions.columns, F.inline(F.array(chosen))).withColumn("merge_strategy", F.lit(merge_strategy))
