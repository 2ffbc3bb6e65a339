"""What a viewer narrows down."""

from __future__ import annotations

from lodeseek.operators import filters


def test_rows_by_text_relation_path_and_inventory(spark):
    rows = spark.createDataFrame([("a", ["Table One"], 1), ("b", ["none"], 2), ("c", None, 31)], "name string, `odd name` array<string>, n int")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(filters.holding(rows, " TABLE one ")) == ["a"] and names(filters.holding(rows, "1")) == ["a", "c"] and names(filters.holding(rows, "  ")) == ["a", "b", "c"] and names(filters.holding(rows, "odd name")) == ["a", "b"]
    edges = spark.createDataFrame([("x", "reference"), ("y", "same_page")], "name string, relation string")
    assert names(filters.of_relation(edges, "reference")) == ["x"] and names(filters.of_relation(edges)) == ["x", "y"]
    found = spark.createDataFrame([("x", "graph", {"relations": "seed,reference"}), ("y", "visual:page", {"relations": ""}), ("z", "planner:graph", {"relations": "same_page"}), ("w", "bm25", {})], "name string, retrieval_path string, metadata map<string,string>")
    assert names(filters.reached_by(found)) == ["x", "z"] and names(filters.reached_by(found, "reference")) == ["x"] and names(filters.on_path(found, "visual", "retrieval_path")) == ["y"]
    profiles = spark.createDataFrame([("d", {"table": ["Table:1", "table:2"], "doi": ["10.1/x"]}), ("e", {})], "document_id string, references map<string,array<string>>")
    kinds = lambda text: sorted(r.kind for r in filters.inventory(profiles, text).collect())
    assert kinds("") == ["doi", "table"] and kinds("TABLE") == ["table"] and kinds("10.1") == ["doi"] and kinds("nothing") == []
    assert [r["name"] for r in filters.first_rows(rows, "name", n=2).collect()] == ["a", "b"]
