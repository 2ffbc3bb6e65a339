"""The planner's trace lists pairs that were redundant or in conflict."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodeseek.operators import merge
from lodeseek.plans import retrieve


def test_a_trace_lists_redundant_and_conflicting_pairs(spark):
    words = "alpha beta gamma delta epsilon zeta"
    texts = [words, f"{words} eta", "alpha beta gamma never other things here", "nothing of it"]
    rows = [("q", f"a:chunk:{i}", "a", [1], t, 0.9 - 0.1 * i, "bm25", {"x": "y"}, i) for i, t in enumerate(texts)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, metadata map<string,string>, ord int")
    questions = spark.createDataFrame([("q", "compare alpha and beta")], "query_id string, question string")
    found = merge.merged(hits, questions, 3)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["a:chunk:0", "a:chunk:2", "a:chunk:3"]
    first = found.where("rank = 1").first().metadata
    assert first["x"] == "y" and [p["chunk_id_b"] for p in json.loads(first["redundant_list"])] == ["a:chunk:1"] and [p["chunk_id_b"] for p in json.loads(first["conflict_list"])] == ["a:chunk:2"]
    steps = retrieve.trace("planner", questions, found.select(*[c for c in found.columns if c not in ("source_score", "routes")]), 3).where("path = 'planner_merge'").select(F.to_json("payload")).collect()
    payload = json.loads(steps[0][0])
    assert [(p["chunk_id_a"], p["chunk_id_b"]) for p in payload["redundant_list"]] == [("a:chunk:0", "a:chunk:1")] and len(payload["conflict_list"]) == 1 and payload["kept"] == 3
    stats = merge.merge_statistics(hits, questions, 3).first()
    assert (stats.redundant, stats.conflicts) == (1, 1)  # 3 of 10 words with the first, 3 of 11 with the second
