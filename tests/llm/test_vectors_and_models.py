"""Top-k search, the quality classifier and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from lodeseek.llm import quality, topk


def top_expected(rows: list[tuple], k: int, every: int) -> list[tuple]:
    """By exact whole numbers; scores beyond a long as the nearest long."""
    from fractions import Fraction

    fine = [(i, [math.floor(Fraction(1024) * Fraction(c)) for c in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    asked: dict = {}
    for i, x in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, x), x)
    out = []
    for q, x in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(y) == len(x))[:k]
        out += [(q, r, i, min(2**63 - 1, max(-(2**63), -s))) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def top_got(spark, rows: list[tuple], kind: str, k: int, every: int, **settings) -> list[tuple]:
    clashing = [(i, v, "e", 1, 2, 3, "f", "g") for i, v in rows]
    table = spark.createDataFrame(clashing, f"vec_id long, embedding array<{kind}>, score string, n int, cell int, part int, v string, id string")
    return sorted(tuple(r) for r in topk.top_k(table, k=k, every=every, **settings).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("settings", [{"shard": 7, "block": 2}, {}, {"shard": 50, "cells": 2, "sample": 20}])
def test_top_k(spark, settings):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=5).round(1).astype(np.float32)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (400, [float("nan")] * 5), (500, [float("inf")] * 5), (7, rows[7][1]), (100, rows[9][1]), (None, rows[8][1]), (600, [0.5, 0.5]), (601, [1.0, 2.0]), (700, []), (701, [])]
    # a third of all vectors is one
    rows += [(1000 + i, rows[3][1]) for i in range(150)]
    assert top_got(spark, rows, "float", 6, 100, **settings) == top_expected(rows, 6, 100)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_scores_stay_exact_beyond_doubles_and_longs(spark):
    # a long holds the scores, a double does not: one query with a large component, many shards without
    rows = [(0, [(2**40 + 1) / 1024, 0.0]), *((i, [(2**19 + i) / 1024, 0.0]) for i in range(1, 2971) if i % 1000)]
    assert top_got(spark, rows, "double", 10, 1000, shard=100) == top_expected(rows, 10, 1000)
    # beyond a long: ranks by exact values, scores as the nearest long
    draw = np.random.default_rng(3)
    big = [(i, [float(x) for x in draw.choice([3e30, -3e30, 1e308, -1.5e307, 1.0, -0.25, 1e16], 3)]) for i in range(120)]
    assert top_got(spark, big, "double", 119, 40, shard=16, block=1) == top_expected(big, 119, 40)
    assert topk.kind_of(8.0, 64, 1024) == "float" and topk.kind_of(2.0**18, 64, 1024) == "int" and topk.kind_of(3e30, 1, 1024) == "big"


def test_no_vector_is_lost_between_cells():
    draw = np.random.default_rng(5)
    for x in (draw.normal(size=(500, 3)), np.zeros((50, 2)), np.repeat(draw.normal(size=(3, 2)), 40, axis=0)):
        nodes = topk.coarse_tree(x, 16)
        cells = topk.cells_of(nodes, x)
        assert len(cells) == len(x) and cells.min() >= 0 and cells.max() < 16
        assert len(nodes) == cells.max() or len(x) == 120


def texts(n: int) -> list[tuple]:
    draw = random.Random(2)
    word = lambda: "".join(draw.choice(["th", "er", "on", "ing", "sh"]) for _ in range(draw.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(5, 60))]
        bad = i % 4 == 0
        out.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + ".", 0 if bad else 1))
    return out


def test_quality(spark):
    rows = texts(400)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "er on", "x"), (1, "er on", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows] + [(None, 1, 0), (950, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {d: q for d, _, q in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 1]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert quality.quality_scores(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="needs the generated tables")
def test_held_out_labels_of_the_generated_tables(spark):
    """Accuracy and the area under the curve over labelled rows that training never saw, and how well scores are calibrated."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 30 and len(bad) > 10
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.05


def test_training_never_sees_held_out_rows(spark):
    rows = texts(300)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    seen = quality.training_rows(docs, labels, 1000, 10_000)
    assert sorted(seen) == sorted((t, q) for d, t, q in rows if zlib.crc32(str(d).encode()) % 3 != 1)
    assert len(quality.training_rows(docs, labels, 10, 10_000)) == 10


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = texts(200)
    shared = "\n".join(f"common line number {i} of the page" for i in range(12))
    passage = "the benchmark passage has more than ten words so that it can be found anywhere"
    docs = [(d, t, "en", "s", len(t)) for d, t, _ in rows]
    long = " ".join(t for _, t, q in rows[:60] if q)
    docs += [(1000, long, "en", "s", 0), (1001, long + " extra", "en", "s", 0), (1002, f"er on ing. {passage} er on", "en", "s", 0)]
    docs += [(1010 + i, f"{shared}\n{rows[4 * i + 1][1]}", "en", "s", 0) for i in range(3)]
    docs += [(None, None, None, None, None), (1020, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == columns
            now = spark.createDataFrame(seen[name], now.schema)
    bad = {d for d, _, q in rows if not q}
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert len(ids("quality") & bad) <= 2 and len(ids("quality")) >= 140
    by = {r.doc_id: r for r in seen["lines"]}
    assert len(by[1010].text) > len(by[1011].text) and by[1011].n_chars == len(by[1011].text)
    assert 1000 in ids("simhash") and 1001 not in ids("simhash")
    assert 1002 in ids("simhash") and 1002 not in ids("decontamination") and len(ids("decontamination")) == len(ids("simhash")) - 1
    assert {r.doc_id for r in seen["packing"]} == ids("decontamination")
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.drop("sequence_id", "offset").collect())) == sorted(str(r) for r in spark.createDataFrame(seen["packing"], ran.schema).drop("sequence_id", "offset").collect())
