"""The index by term: the rows of BM25 over all chunks, and what a search reads and scores."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodeseek.operators import postings
from lodeseek.operators import retrievers as R


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(f"d{i // 9:03}:chunk:{i % 9}", f"d{i // 9:03}", [1], " ".join(draw.choices(words, weights, k=draw.randint(0, 40))), i % 9) for i in range(3000)]
    rows += [(f"e:chunk:{i}", "e", [1], "w1 w2 w3 same text", i) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int").repartition(5).cache()
    asked = [("q0", "w0 w7 w350"), ("q1", "w1 w1 w2"), ("q2", "nothing of it"), ("q3", "w399"), ("q4", ""), ("q5", "same text w3 w0"), ("q6", " ".join(words[:60]))]
    return chunks, spark.createDataFrame(asked, "query_id string, question string")


def rows_of(df) -> list[tuple]:
    return sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("scope", "span", "k"), [("corpus", 64, 5), ("document", 64, 5), ("corpus", 4096, 50), ("document", 16, 1)])
def test_rows_equal_those_of_bm25(corpus, tmp_path, scope, span, k):
    chunks, asked = corpus
    index = postings.build(chunks, str(tmp_path), scope, span=span)
    assert index.chunks == 3040 and sum(r.n for r in index.spark.read.parquet(f"{tmp_path}/blocks").select("n").collect()) == R.postings(chunks).where("term is not null").count()
    assert rows_of(postings.bm25(index, chunks, asked, k)) == rows_of(R.bm25(chunks, asked, k, scope=scope))


def test_an_empty_corpus_and_questions_without_terms(spark, corpus, tmp_path):
    chunks, asked = corpus
    index = postings.build(chunks.limit(0), str(tmp_path))
    assert postings.bm25(index, chunks, asked).collect() == []
    index = postings.build(chunks, f"{tmp_path}/full")
    assert postings.bm25(index, chunks, asked.where("query_id = 'q4'")).collect() == []


def scanned(df) -> int:
    """Rows that leave the scans of an executed plan."""
    plan, total, stack = df._jdf.queryExecution().executedPlan(), 0, []
    df.collect()
    stack.append(plan)
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_a_question_of_one_word_reads_a_small_part_of_the_index(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f"d{i:05}:chunk:0", f"d{i:05}", [1], " ".join(draw.choices([f"t{j:04}" for j in range(3000)], k=40)), 0) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int")
    index = postings.build(chunks, str(tmp_path), span=64)
    every = spark.read.parquet(f"{tmp_path}/blocks").count()
    read = scanned(index.blocks(["t1234"]))
    assert 0 < read <= 3 * postings.PAGE_ROWS < every / 8
    found = index.spark.createDataFrame([(7, 1.0), (9, 2.0)], "no long, score double")
    assert {r.document_id for r in index.keys(found).collect()} == {"d00007", "d00009"}


def test_ranges_that_cannot_win_are_neither_shuffled_nor_opened(spark, tmp_path, monkeypatch):
    # the word is short of company in every hundredth range only
    rows = [(f"d{i:05}:chunk:0", f"d{i:05}", [1], "rare" if i < 64 else "rare " + "filler " * (20 + i % 50), 0) for i in range(6400)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int")
    index = postings.build(chunks, str(tmp_path), span=64)
    seen, scored = [], postings.scored

    def watched(blocks, asked, span):
        seen.append(blocks.select("span").distinct().count())
        return scored(blocks, asked, span)

    monkeypatch.setattr(postings, "scored", watched)
    asked = spark.createDataFrame([("q", "rare")], "query_id string, question string")
    got = postings.bm25(index, chunks, asked, 5)
    assert [r.document_id for r in got.orderBy("rank").collect()] == [f"d{i:05}" for i in range(5)]
    assert seen == [postings.LEADING, 0]


def test_max_score_adds_no_chunk_that_cannot_reach_the_floor():
    asked = postings.Asked([("q", "a b", ["a", "b"])], 1)
    asked.floor[0] = 2.0
    lists = [(np.array([1, 5], "<u4").tobytes(), np.array([1.5, 2.5]).tobytes()), (np.arange(1000, dtype="<u4").tobytes(), np.full(1000, 0.5).tobytes())]
    (q, places, scores), = asked.best(["a", "b"], np.array([2.5, 0.5]), lists)
    assert q == 0 and places.tolist() == [5] and scores.tolist() == [3.0]
    asked.floor[0] = 3.1
    assert list(asked.best(["a", "b"], np.array([2.5, 0.5]), lists)) == []


def test_the_engine_asks_the_index_by_term_until_something_is_written(spark, tmp_path, monkeypatch):
    from lodeseek.api import Engine

    engine = Engine(spark, str(tmp_path / "store"))
    for name, text in (("a", "alpha beta gamma"), ("b", "alpha alpha delta"), ("c", "beta epsilon")):
        (tmp_path / f"{name}.txt").write_text(text)
        engine.pipeline(str(tmp_path / f"{name}.txt"), "bm25")
    told = lambda found: [(e["chunk_id"], e["score"], e["rank"]) for e in found["evidence"]]
    plain = told(engine.query("alpha beta", mode="bm25", save=False))
    engine.seal()
    asked, by_term = [], postings.bm25
    monkeypatch.setattr(postings, "bm25", lambda *a: asked.append(a) or by_term(*a))
    assert told(engine.query("alpha beta", mode="bm25", save=False)) == plain and len(plain) == 3 and len(asked) == 1
    (tmp_path / "d.txt").write_text("alpha beta alpha")
    engine.pipeline(str(tmp_path / "d.txt"), "bm25")
    assert len(told(engine.query("alpha beta", mode="bm25", save=False))) == 4 and len(asked) == 1


def test_an_index_over_a_corpus_has_no_row_for_a_posting(spark, monkeypatch, tmp_path):
    texts = ["one two two", "", "three ONE", "x " * 70_000, "two", "!"]
    rows = [(f"d{i % 2}", f"d{i % 2}:chunk:{i}", i, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, text string").repartition(3)
    expected = {}
    monkeypatch.setattr(postings, "impacts", lambda *_: pytest.fail("rows of postings"))
    index = postings.build(chunks, str(tmp_path / "index"), span=2)
    assert not (tmp_path / "index" / "counted").exists() and index.chunks == len(texts)
    order = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    words = [r[3].lower().replace("!", "").split() for r in order]
    avg = sum(map(len, words)) / len(words)
    for no, held in enumerate(words):
        for term in set(held):
            tf = held.count(term)
            expected.setdefault((term, no // 2), []).append((no % 2, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(held) / avg))))
    found = {}
    for r in spark.read.parquet(f"{tmp_path}/index/blocks").collect():
        found[r.term, r.span] = list(zip(np.frombuffer(r.places, "<u4").tolist(), np.frombuffer(r.impacts, "<f8").tolist(), strict=True))
        assert r.n == len(found[r.term, r.span]) and r.top == max(x for _, x in found[r.term, r.span])
    assert found.keys() == expected.keys()
    for key, postings_of in expected.items():
        assert [p for p, _ in found[key]] == [p for p, _ in postings_of] and np.allclose([x for _, x in found[key]], [x for _, x in postings_of], rtol=1e-12, atol=0)
