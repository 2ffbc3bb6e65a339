"""The steps that the retrievers of chunks share: words, counts, and texts of the documents that won only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import retrievers as R
from lodeseek.operators.chunking import chunk_pages
from lodeseek.sources import ingest


def test_words_and_tokens_are_those_of_the_plain_rules(spark):
    every = spark.createDataFrame([(i, f"a{chr(i)}B {chr(i)}") for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF], "id int, t string")
    plain = F.regexp_extract_all("t", F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))
    lower = F.transform(F.regexp_extract_all("t", F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    wrong = every.where(~plain.eqNullSafe(T.words("t")) | ~lower.eqNullSafe(T.tokens("t")) | (T.has_words(F.expr("substr(t, 5)")) != (F.size(T.words(F.expr("substr(t, 5)"))) > 0)))
    assert wrong.count() == 0


def test_counts_inside_a_row_need_no_shuffle(spark):
    texts = ["b a b", "", "A a_1 a", None, "!?", "x"]
    c = spark.createDataFrame([("d", f"c{i}", i, t) for i, t in enumerate(texts)], "document_id string, chunk_id string, chunk_index int, text string")
    rows = R.postings(c)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = {(r.chunk_id, r.term): r.tf for r in rows.collect()}
    expected = {(f"c{i}", w): n for i, t in enumerate(texts) for w, n in Counter((t or "").replace("!?", "").lower().split()).items()}
    assert found == expected | {(f"c{i}", None): 1 for i in range(len(texts))}


def test_only_documents_that_won_are_cut_into_chunks_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} common text") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "word7")], "query_id string, question string")
    chunks = chunk_pages(ingest.table_pages(docs))
    found = R.bm25(chunks, asked, 3)
    assert [r.document_id for r in found.collect()] == ["7"]
    items, _ = R.of_documents(chunks, found.select("document_id"))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Filter") and items.count() == 1
    monkeypatch.setattr(R, "NAMED", 0)
    assert [tuple(r)[:6] for r in R.bm25(chunks, asked, 3).collect()] == [tuple(r)[:6] for r in found.collect()]
