"""Hybrid retrieval in one pass by document: the rows of ranking both lists and fusing them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseek.operators import blocks as B
from lodeseek.operators import fused
from lodeseek.operators import retrievers as R


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{d:02}:chunk:{i}", f"d{d:02}", [1], " ".join(draw.choices(words, k=draw.randint(0, 12))), i) for d in range(30) for i in range(1 + d % 17)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int").repartition(3).cache()
    asked = [("q0", "w1 w2 w3"), ("q1", "w5 w5 w9"), ("q2", "none of it"), ("q3", ""), ("q4", " ".join(words[:25]))]
    return chunks, spark.createDataFrame(asked, "query_id string, question string")


def plainly(chunks, asked, k: int):
    """Both lists of every document ranked in windows, then fused."""
    per, many = ["query_id", "document_id"], max(k, 10)
    both = R.fuse(R.ranked(R.bm25_scores(chunks, asked), many, per), R.ranked(R.dense_scores(chunks, asked), many, per), k, per).drop("rank")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "seen", "chunk_index")
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rows_of(df) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 12])
def test_rows_equal_two_ranked_lists(corpus, k):
    chunks, asked = corpus
    expected = rows_of(plainly(chunks, asked, k))
    assert rows_of(R.hybrid(chunks, asked, k)) == expected and len(expected) == 3 * k
    # and from stored indexes
    assert rows_of(R.hybrid(chunks, asked, k, bm25_index=R.postings(chunks), dense_index=B.dense_rows(chunks, 384))) == expected


def test_no_pairs_leave_a_task(corpus):
    chunks, asked = corpus
    rows = fused.fused_scores(fused.chunk_rows(chunks), asked, 5, 1.5, 0.75, 384)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan
    assert rows.count() <= 5 * 5 * rows.rdd.getNumPartitions()
    assert fused.fused_scores(fused.chunk_rows(chunks.limit(0)), asked, 5, 1.5, 0.75, 384).count() == 0
