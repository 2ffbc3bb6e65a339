"""Evaluation of what is stored: scopes, settings of cases, missing indexes and sweeps as rows."""

from __future__ import annotations

import pytest

from lodeseek.api import Engine
from lodeseek.operators import evaluate
from lodeseek.plans import retrieve


def test_a_case_goes_before_its_manifest():
    assert evaluate.scope_of({"document_id": "own"}, {"document_id": "all"}) == ("own",)
    assert evaluate.scope_of({"document_ids": ["own"]}, {"document_id": "all"}) == ("all",)  # a document of the manifest goes before a list of the case
    assert evaluate.scope_of({"document_ids": ["x", "y"]}, {"document_ids": ["z"]}) == ("x", "y")
    assert evaluate.scope_of({}, {"document_ids": ["z"]}) == ("z",)
    with pytest.raises(ValueError, match="needs document_id"):
        evaluate.scope_of({"query": "?"}, {})
    plan = evaluate.parameters({"planner_rerank": "false", "planner_route_vote_bonus": 1}, {"strategy": "score_max", "rerank": True, "vote_bonus": 0.08, "overlap_weight": 0.1})
    assert plan == {"strategy": "score_max", "rerank": False, "vote_bonus": 1.0, "overlap_weight": 0.1}
    assert evaluate.parameters({"planner_merge_strategy": "route_vote"}, plan) == plan | {"strategy": "route_vote"}
    with pytest.raises(ValueError, match="Unsupported"):
        evaluate.parameters({"planner_merge_strategy": "best"}, plan)


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "store"))
    ids = {}
    for name, text in (("a", "# 1 Start\nalpha beta gamma by Solver Engine\n# 2 End\nalpha delta, see Table 2"), ("b", "alpha epsilon zeta of Solver Engine"), ("c", "alpha eta theta")):
        (tmp_path / f"{name}.md").write_text(text)
        ids[name] = made.pipeline(str(tmp_path / f"{name}.md"), "bm25" if name == "c" else "all")["document_id"]
    return made, ids


def test_evaluation_reads_indexes_and_settings_of_the_store(engine, monkeypatch):
    engine, ids = engine
    asked, plain = [], retrieve.retrieve

    def watched(mode, chunks, pages, questions, k=5, scope="document", indexes=None, **made):
        asked.append((mode, sorted(indexes), made["k1"], made["dense_dimensions"]))
        return plain(mode, chunks, pages, questions, k, scope, indexes, **made)

    monkeypatch.setattr(retrieve, "retrieve", watched)
    monkeypatch.setattr(Engine, "made", lambda self: {"k1": 0.9, "b": 0.1, "dense_dimensions": 384, "late_dimensions": 128})
    manifest = {
        "document_ids": list(ids.values()), "document_quality_tiers": {ids["a"]: "clean"}, "expected_entities": ["Solver Engine"], "expected_entities_by_tier": {"unlabeled": ["solver engine", "Nobody"]},
        "queries": [{"query": "alpha epsilon", "expected_terms": ["epsilon"], "expected_references_by_tier": {"clean": ["table:2"]}}, {"query": "alpha theta", "document_id": ids["c"], "expected_terms": ["theta"]}, {"query": "gone", "document_id": "unknown"}],
    }
    report = engine.evaluate(manifest, 3, ("bm25", "dense"))
    assert all(k1 == 0.9 and d == 384 for _, _, k1, d in asked)
    # c has no dense index: it finds nothing there, and the report says so
    got = {(r["case_id"], r["mode"]): r["term_hit"] for r in report["cases"]}
    assert got["1", "bm25"] and not got["1", "dense"] and got["0", "dense"]
    assert [(m["index"], m["documents"], m["cases"]) for m in report["missing_indexes"] if m["cases"] == ["1"]] == [("dense", [ids["c"]], ["1"])]
    assert [(m["index"], m["documents"]) for m in report["missing_indexes"] if m["cases"] == ["0"]] == [("dense", [ids["c"]])]
    assert report["missing_documents"] == ["unknown"]
    assert {(r["tier"], r["kind"]): (r["expected"], r["found"], r["missing"]) for r in report["recall"]} == {(None, "entity"): (1, 1, []), ("unlabeled", "entity"): (2, 1, ["Nobody"]), ("clean", "reference"): (1, 1, [])}
    assert {r["tier"]: r["documents"] for r in report["graph_extraction"]} == {None: 3, "clean": 1, "unlabeled": 2}


def test_planner_values_of_a_case_reach_the_merge_and_sweeps_take_one_plan(spark, engine):
    engine, ids = engine
    queries = [{"query": "alpha beta", "planner_rerank": True, "planner_rerank_overlap_weight": 0.9}, {"query": "alpha beta", "planner_rerank": False}]
    report = engine.evaluate({"document_ids": [ids["a"], ids["b"]], "queries": queries}, 3, ("planner",))
    told = {r["case_id"]: (r["planner"]["rerank"], r["planner"]["overlap_weight"], r["confidence"]) for r in report["cases"]}
    assert told["0"][:2] == (True, 0.9) and told["1"][0] is False and told["0"][2] > told["1"][2]


def test_a_sweep_is_one_plan_for_any_number_of_variants(spark):
    rows = [("0", "a:chunk:0", "a", [1], "alpha beta", 0.5, "bm25", 1), ("0", "a:chunk:1", "a", [2], "alpha gamma delta", 0.6, "dense", 2), ("0", "a:chunk:1", "a", [2], "alpha gamma delta", 0.3, "bm25", 3), ("1", "a:chunk:0", "a", [1], "alpha beta", 0.2, "bm25", 1)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, ord int")
    cases = spark.createDataFrame([("0", "alpha beta", ["beta"], [1]), ("1", "zeta", ["zeta"], [])], evaluate.CASE)
    jobs, got = {}, {}
    for n in (2, 12):
        variants = evaluate.sweep_variants([{"merge_strategy": ("score_max", "route_vote")[i % 2], "rerank": i > 1, "rerank_overlap_weight": 0.1 * i} for i in range(n)])
        spark.sparkContext.setJobGroup(f"sweep-{n}", "")
        got[n] = {r.ordinal: r for r in evaluate.swept(hits, variants, cases, 3).collect()}
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep-{n}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[12] <= jobs[2] + 4 and got[12][0] == got[2][0] and len(got[12]) == 12
    # without rerank the second chunk is first; an overlap of 2 of 2 words against 1 of 4 turns them from 0.2 on
    assert [got[12][i].mrr for i in (0, 1, 2, 3, 4)] == [0.25, 0.25, 0.5, 0.5, 0.5] and all(r.cases == 2 for r in got[12].values())
