"""The labelled collections, built and evaluated as a whole."""

from __future__ import annotations

from lodeseek import fixtures
from lodeseek.api import Engine
from lodeseek.operators import images


def test_planner_tuning_collection(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    manifest = fixtures.tuning_corpus(engine, tmp_path, 2)
    assert len(manifest["queries"]) == 4 and len(manifest["planner_sweep"]) == 5
    report = engine.evaluate(manifest, 3, ("bm25", "planner"))
    planner = report["modes"]["planner"]
    assert planner["term_hit_rate"] == planner["citation_support_rate"] == planner["answerable_rate"] == 1.0 and planner["mrr"] >= 0.736
    assert {r["kind"]: r["recall"] for r in report["recall"]} == {"entity": 1.0, "reference": 1.0, "section": 1.0}
    assert [v["name"] for v in report["sweep"]][-1] == "score_rerank_soft" and report["best_by_mrr"]


def test_drawn_pages_are_found(spark, tmp_path):
    assert len({images.image_profile(fixtures.drawn(k)) for k in ("table", "photo", "text")}) == 3
    engine = Engine(spark, str(tmp_path / "store"))
    manifest = fixtures.visual_benchmark(engine, tmp_path, ("table", "chart"))
    for q in manifest["queries"]:
        got = engine.query(q["query"], q.get("document_id") or q["document_ids"], mode="visual", save=False)["evidence"]
        wanted = next(k for k in ("table", "chart") if k in q["query"])
        assert got[0]["page_numbers"] == [1] and engine.document(got[0]["document_id"])["title"] == f"{wanted}_sheet"


def test_badly_read_pages(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    manifest = fixtures.weak_pages(engine, tmp_path)
    report = engine.evaluate(manifest, 2, ("visual", "planner"))
    assert report["modes"]["visual"]["page_hit_rate"] == report["modes"]["planner"]["page_hit_rate"] == 1.0
    assert report["visual_diagnostics"]["visual_cases"] == 3 and report["visual_diagnostics"]["planner_contribution_rate"] > 0
    assert [(r["kind"], r["missing"]) for r in report["recall"]] == [("reference", [])]
