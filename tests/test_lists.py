"""One pass for the lists of BM25 and of vectors: the rows of the plain steps, with nothing but k rows a question leaving a task."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import blocks as B
from lodeseek.operators import lists as L
from lodeseek.operators import retrievers as R
from lodeseek.plans import retrieve


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(80)] + ["É", "İx", "a_1", "!", "日本"]
    rows = [(f"d{d:02}:chunk:{i}", f"d{d:02}", [1], " ".join(draw.choices(words, k=draw.randint(0, 30))), i) for d in range(40) for i in range(1 + d % 13)]
    rows += [("e:chunk:0", "e", [1], None, 0), (None, None, [1], "w1 w2", 0)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int").repartition(3).cache()
    asked = [("q0", "w1 w2 w3"), ("q1", "W5 w5 w9 a_1"), ("q2", "none of it"), ("q3", ""), ("q4", " ".join(words[:25]))]
    return chunks, spark.createDataFrame(asked, "query_id string, question string")


def rows_of(df) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7])
def test_rows_are_those_of_all_scores_ranked(spark, corpus, k, monkeypatch):
    chunks, asked = corpus
    known = chunks.where("document_id is not null")
    plain = {"bm25": R.bm25_scores(known, asked), "dense": R.dense_scores(known, asked)}
    expected = {path: rows_of(R.ranked(rows, k, ["query_id"])) for path, rows in plain.items()}
    monkeypatch.setattr(B, "BLOCK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # documents go over the ends of batches
    try:
        found = R.bm25_and_dense(chunks, asked, asked, k)
        assert {path: rows_of(found.where(F.col("retrieval_path") == path)) for path in expected} == expected
        assert rows_of(R.bm25(chunks, asked, k)) == expected["bm25"] and rows_of(R.dense(chunks, asked, k)) == expected["dense"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_bytes_are_those_of_the_pattern():
    texts = ["", "Ab", "cd", "é1é", None, " x_9 ", "\x00Q", "a b", "ÀB", "z"]
    flat, number = L.byte_words(pa.array(texts).slice(1))
    assert flat.to_pylist() == [w.lower() for t in texts[1:] for w in re.findall("[A-Za-z0-9_]+", t or "")]
    assert number.tolist() == [len(re.findall("[A-Za-z0-9_]+", t or "")) for t in texts[1:]]
    assert L.byte_words(pa.array([], pa.string()))[0].to_pylist() == []


def test_no_row_for_a_word_is_shuffled(corpus):
    chunks, asked = corpus
    rows = R.bm25_scores(chunks, asked, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Generate" not in plan and "Aggregate" not in plan
    assert rows.count() <= 5 * 5 * rows.rdd.getNumPartitions()


def test_routes_of_a_plan_share_one_pass(corpus, monkeypatch):
    chunks, asked = corpus
    seen = []
    monkeypatch.setattr(L, "best_rows", lambda *a, real=L.best_rows: (seen.append(1), real(*a))[1])
    got = retrieve.plan_and_merge(chunks, None, asked, 3)
    assert got.count() > 0 and len(seen) == 1


def test_document_terms_are_counts_of_postings(spark, corpus):
    chunks, _ = corpus
    plain = R.postings(chunks).where("term is not null").groupBy("document_id", "term").agg(F.count("*").alias("df"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = L.document_terms(chunks)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no table of words is aggregated
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert L.document_terms(chunks.limit(0)).count() == 0


def test_texts_are_looked_at_by_bytes():
    texts = ["a" * 5, None, "b" * 4, "c" * 30, "", "d" * 10, "e"]
    cut = list(L.pieces([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], 10))
    assert [x for t in cut for x in t.column("text").to_pylist()] == texts
    assert [t.num_rows for t in cut] == [3, 1, 2, 1]
