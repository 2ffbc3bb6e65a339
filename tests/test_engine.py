"""The engine's rules as tables of examples, and naive models on small corpora."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.operators import evaluate, evidence, graph, images, merge, page_vectors, profile, sensitive
from lodeseek.operators import retrievers as R
from lodeseek.operators.chunking import chunk_pages
from lodeseek.plans import planner, retrieve

PAGES = "document_id string, number int, page_id string, text string"


def pages_of(spark, texts: dict) -> object:
    return spark.createDataFrame([(d, n, f"{d}:page:{n}", t) for d, ts in texts.items() for n, t in enumerate(ts, 1)], PAGES)


def chunks_of(spark, texts: dict):
    """One chunk for each text."""
    rows = [(f"{d}:chunk:{i}", d, [1], t, i, None) for d, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int, parent_section string")


def corpus(seed: int) -> dict:
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "Iota", "kappa_1"]
    return {d: [" ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(1, 4))] for d in "abc"}


def asked(spark, *texts: str):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, question string")


def tokens(t: str) -> list[str]:
    import re

    return [w.lower() for w in re.findall("[A-Za-z0-9_]+", t)]


# --- chunks ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("most", "overlap"), [(5, 2), (3, 0), (4, 9), (220, 40)])
def test_chunks_against_the_sliding_window(spark, most, overlap):
    draw = random.Random(most)
    texts = {d: ["\n".join(draw.choice(["# Top", "words " * draw.randint(0, 9), " ## Sub title ", "", "x y z"]) for _ in range(6)) for _ in range(3)] for d in "ab"}
    got = [(r.document_id, r.chunk_index, r.page_numbers[0], r.parent_section, r.word_start, r.word_end, r.text) for r in chunk_pages(pages_of(spark, texts), most, overlap).collect()]
    expected = []
    for d, ts in texts.items():
        index = 0
        for n, t in enumerate(ts, 1):
            parts, section, words = [], None, []
            for line in t.splitlines():
                s = line.strip()
                if s.startswith("#"):
                    parts.append((section, words))
                    section, words = s.lstrip("#").strip(), []
                words = words + line.split()
            for section, words in [*parts, (section, words)]:
                start = 0
                while words:
                    end = min(start + most, len(words))
                    expected.append((d, index, n, section, start, end, " ".join(words[start:end])))
                    index += 1
                    if end == len(words):
                        break
                    start += max(most - overlap, 1)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_line_separators_of_python(spark):
    rows = spark.createDataFrame([("a\x0bb\x85c d\r\ne f",)], "t string")
    assert rows.select(T.lines("t")).first()[0] == "a\x0bb\x85c d\r\ne f".splitlines()


# --- retrievers -----------------------------------------------------------------------------------------------
def naive_bm25(texts: dict, question: str, k1=1.5, b=0.75) -> dict:
    out = {}
    for d, ts in texts.items():
        counts = [Counter(tokens(t)) for t in ts]
        size = [sum(c.values()) for c in counts]
        mean = sum(size) / len(size) or 1
        for i, c in enumerate(counts):
            score = 0.0
            for w in tokens(question):
                df = sum(w in x for x in counts)
                if c[w]:
                    score += math.log(1 + (len(ts) - df + 0.5) / (df + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * (size[i] or 1) / mean))
            if score > 0:
                out[f"{d}:chunk:{i}"] = score
    return out


def digest(token: str) -> bytes:
    import hashlib

    return hashlib.sha1(token.encode()).digest()


def naive_dense(t: str, n: int) -> np.ndarray:
    v = np.zeros(n)
    for w in tokens(t):
        h = digest(w)
        v[int.from_bytes(h[:4], "big") % n] += (1 if h[4] % 2 == 0 else -1) * (0.75 + h[0] / 255)
    return v / (np.linalg.norm(v) or 1)


def naive_token(w: str, n: int) -> np.ndarray:
    v, h = np.zeros(n), digest(w)
    for o in (0, 4, 8):
        v[int.from_bytes(h[o : o + 4], "big") % n] += 1 if h[o] % 2 == 0 else -1
    return v / (np.linalg.norm(v) or 1)


def close(got: dict, expected: dict) -> None:
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k], abs=1e-8)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_naive_models(spark, seed):
    texts, question = corpus(seed), "alpha beta BETA iota none"
    chunks, q = chunks_of(spark, texts), asked(spark, question)
    ids = lambda df: {r.chunk_id: r.score for r in df.collect()}
    close(ids(R.bm25_scores(chunks, q)), naive_bm25(texts, question))
    every = {f"{d}:chunk:{i}": t for d, ts in texts.items() for i, t in enumerate(ts)}
    dense = {c: s for c, t in every.items() if (s := float(naive_dense(t, 16) @ naive_dense(question, 16))) > 1e-9}
    close(ids(R.dense_scores(chunks, q, 16)), dense)
    late = {}
    for c, t in every.items():
        held = [naive_token(w, 4) for w in tokens(t)[:5]]
        s = sum(max(float(naive_token(w, 4) @ v) for v in held) for w in tokens(question)) / len(tokens(question))
        if s > 1e-9:
            late[c] = s
    close(ids(R.late_scores(chunks, q, 4, 5)), late)


def test_hybrid_fuses_ranks_inside_documents(spark):
    texts = corpus(3)
    chunks, q = chunks_of(spark, texts), asked(spark, "alpha delta")
    bm, de = naive_bm25(texts, "alpha delta"), {f"{d}:chunk:{i}": s for d, ts in texts.items() for i, t in enumerate(ts) if (s := float(naive_dense(t, 384) @ naive_dense("alpha delta", 384))) > 1e-9}
    score: Counter = Counter()
    for side in (bm, de):
        for d in "abc":
            for r, (c, _) in enumerate(sorted(((c, s) for c, s in side.items() if c.startswith(d)), key=lambda x: (-round(x[1], 9), x[0])), 1):
                score[c] += 1 / (60 + r)
    got = {r.chunk_id: r.score for r in R.hybrid(chunks, q, 50).collect()}
    close(got, dict(score))


def test_results_do_not_depend_on_partitions(spark):
    chunks, q = chunks_of(spark, corpus(5)), asked(spark, "alpha beta", "delta")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(str, retrieve.retrieve(m, chunks, None, q, 3).collect())) for m in ("bm25", "dense", "late", "hybrid", "graph")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_document_top_k_comes_before_the_global_one(spark):
    chunks = chunks_of(spark, {"a": ["x"] * 4, "b": ["x y"]})
    got = R.bm25(chunks, asked(spark, "x y"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got][0] == "b:chunk:0" and len(got) == 2


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError, match="Unsupported retrieval mode"):
        retrieve.check_mode("sql")
    with pytest.raises(ValueError, match="Unsupported planner merge strategy"):
        planner.plan_query("x", "best")
    with pytest.raises(ValueError, match="Unsupported embedding compression"):
        V.maybe_compress(F.lit(None), "int4")


def test_int8_round_trip(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0],)], "v array<double>")
    packed = rows.select("v", V.quantize(F.col("v")).alias("q")).select("v", "q", V.dequantize(F.col("q")).alias("w")).collect()
    assert packed[0].q["values"] == [64, -127, 32] and packed[1].q["scale"] == 1.0
    assert packed[0].w == pytest.approx(packed[0].v, abs=1 / 127)


# --- planner --------------------------------------------------------------------------------------------------
QUESTIONS = [
    "find 10.1234/abcd", "mail me@example.org", "what is AB-1234", "release v1.2.3", "invoice 4711", "code abc123", "total of the year", "show the diagram", "figure", "page layout of the form",
    "compare totals", "compare sections", "which rows", "states of matter", "studies", "why", "", "summaries across documents", "neighbors of the entity", "the invoice table", "license key 12", "uuid token deadbeef01",
]


def test_one_question_and_a_table_of_them_get_the_same_plan(spark):
    got = {r.question: r for r in planner.plan_batch(asked(spark, *QUESTIONS)).collect()}
    for q in QUESTIONS:
        p = planner.plan_query(q)
        assert (got[q].query_type, got[q].routes, got[q].reason) == (p.query_type, p.routes, p.reason), q
        assert got[q].route_factors == {r: s["top_k_factor"] for r, s in p.route_settings.items()}


@pytest.mark.parametrize(
    ("question", "kind", "routes"),
    [("find invoice INV-2024", "exact_lookup", ["bm25"]), ("show the diagram", "visual", ["visual", "hybrid"]), ("figure", "visual", ["visual"]), ("compare the totals in the tables", "multi_hop", ["hybrid", "late", "bm25"]), ("states of matter", "table_or_form", ["late", "hybrid"]), ("what does the appendix cite", "graph_nav", ["graph", "hybrid"]), ("common to both", "multi_hop", ["hybrid", "dense"]), ("why is the sky blue", "semantic", ["dense", "bm25"])],
)
def test_plans(question, kind, routes):
    p = planner.plan_query(question)
    assert (p.query_type, p.routes) == (kind, routes)


def test_route_depths():
    assert [planner.route_depth(5, 2.5), planner.route_depth(3, 2.5), planner.route_depth(5, 2.0)] == [12, 8, 10]
    assert planner.plan_query("show the diagram").route_settings == {"visual": {"top_k_factor": 3.0}, "hybrid": {"top_k_factor": 2.0, "fusion": "reciprocal_rank"}}


def naive_merge(rows, question, k, strategy, rerank):
    words = lambda t: set(tokens(t))
    jac = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b)) if words(a) and words(b) else 0.0
    best, routes = {}, {}
    for r in rows:
        routes.setdefault(r[1], set()).add(r[6])
        if r[1] not in best or r[5] > best[r[1]][5]:
            best[r[1]] = r
    value = {c: round(r[5] + (0.08 * (len(routes[c]) - 1) if strategy == "route_vote" else 0) + (0.1 * jac(question, r[4]) if rerank else 0), 9) for c, r in best.items()}
    order = sorted(best, key=lambda c: -value[c])
    near = order[: max(k, 8)]
    gone = {b for i, a in enumerate(near) for b in near[i + 1 :] if set(best[a][3]) & set(best[b][3]) and jac(best[a][4], best[b][4]) >= 0.72}
    return [(c, pytest.approx(value[c])) for c in order if c not in gone][:k]


@pytest.mark.parametrize("seed", range(4))
def test_merge_against_the_naive_model(spark, seed):
    draw = random.Random(seed)
    rows = [("q", f"c{draw.randint(0, 11)}", "d", [draw.randint(1, 2)], "", round(draw.random(), 4), draw.choice(["bm25", "dense", "late"]), i) for i in range(24)]
    body = {f"c{i}": " ".join(draw.choice("abcdef") for _ in range(4)) for i in range(12)}
    rows = [(*r[:4], body[r[1]], *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, ord long")
    for strategy, rerank in (("score_max", False), ("route_vote", True)):
        got = merge.merged(df, asked(spark, "a b c").withColumn("query_id", F.lit("q")), 5, strategy=strategy, rerank=rerank).orderBy("rank").collect()
        assert [(r.chunk_id, r.score) for r in got] == naive_merge(rows, "a b c", 5, strategy, rerank)


def test_merge_statistics(spark):
    r = merge.merge_statistics(*example_hits(spark), 5).first()
    assert (r.candidates, r.redundant, r.conflicts) == (4, 0, 2) and len(r.conflict_pairs) == 2


HITS = [("q", "a", "d", [1], "alpha only words here", 0.90, "bm25", 0), ("q", "b", "d", [2], "alpha beta", 0.86, "bm25", 1), ("q", "b", "d", [2], "alpha beta", 0.84, "dense", 10_000), ("q", "c", "d", [2], "alpha beta gamma", 0.80, "dense", 10_001), ("q", "e", "d", [2], "not alpha beta delta gamma eta", 0.70, "dense", 10_002)]


def example_hits(spark):
    h = spark.createDataFrame(HITS, "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, ord long")
    return h, spark.createDataFrame([("q", "alpha beta")], "query_id string, question string")


@pytest.mark.parametrize(("settings", "expected"), [({}, [("a", 0.9), ("b", 0.86), ("c", 0.8), ("e", 0.7)]), ({"strategy": "route_vote"}, [("b", 0.94), ("a", 0.9), ("c", 0.8), ("e", 0.7)]), ({"rerank": True}, [("b", 0.96), ("a", 0.92), ("c", 0.866667), ("e", 0.733333)])])
def test_merge_examples(spark, settings, expected):
    got = merge.merged(*example_hits(spark), 5, **settings).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == expected
    assert {r.chunk_id: (r.metadata["routes"], r.metadata["conflict_pairs"]) for r in got} == {"a": ("bm25", "0"), "b": ("bm25,dense", "1"), "c": ("dense", "1"), "e": ("dense", "2")}


# --- graph ----------------------------------------------------------------------------------------------------
GRAPH_CHUNKS = [
    ("a", 0, 1, "2 Methods", "We use the Solver Engine as Table 1 shows"), ("a", 1, 1, "2.1 Setup", "Solver Engine setup follows section 2"), ("a", 2, 2, "3 Results", "Table 1 has results of page 1"),
    ("b", 0, 1, None, "nothing of note here"), ("b", 1, 1, None, "the Solver Engine again"),
]


def graph_chunks(spark):
    rows = [(f"{d}:chunk:{i}", d, [p], t, i, s) for d, i, p, s, t in GRAPH_CHUNKS]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, page_numbers array<int>, text string, chunk_index int, parent_section string")


def test_graph_search_example(spark):
    # two words of two and three entities make 1.9; the reference 0.75 of it, the next chunk 0.4 of it
    got = graph.graph(graph_chunks(spark), asked(spark, "Solver Engine"), 5, "corpus").orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [("a:chunk:0", 1.9), ("a:chunk:1", 1.9), ("b:chunk:1", 1.9), ("a:chunk:2", 1.425), ("b:chunk:0", 0.76)]
    assert "reference" in got[3].metadata["relations"] and got[3].metadata["parent_section"] == "3 Results"
    cut = graph.graph(graph_chunks(spark), asked(spark, "Solver Engine"), 4, "corpus").orderBy("rank").collect()
    assert [(r.chunk_id, r.metadata) for r in cut] == [(r.chunk_id, r.metadata) for r in got[:4]]


EXAMPLES = [
    (T.undo_misreadings, "see sectlon 3", "see section 3"), (T.undo_misreadings, "chapler 2, appendlx A", "chapter 2, appendix A"), (T.undo_misreadings, "f1g 1 and tab1e 2", "figure 1 and table 2"), (T.undo_misreadings, "equat1on 4 arx1v: 2401.00001", "equation 4 arXiv: 2401.00001"),
    (T.entities, "the Support Vector Machine (SVM) works", ["SVM", "Machine", "Support", "Support Vector", "Support Vector Machine", "Vector", "Vector Machine"]), (T.entities, 'so-called "deep neural nets" are', ["deep neural nets"]),
    (T.number_values, "A1-A3", ["a1", "a2", "a3"]), (T.number_values, "1.1-1.3", ["1.1", "1.3"]), (T.number_values, "5 to 8", ["5", "6", "7", "8"]),
    (T.section_aliases, "3.2.1 Algorithm", ["3", "3.2", "3.2.1", "3.2.1 algorithm", "algorithm"]), (T.section_aliases, " Introduction: ", ["introduction"]),
    (T.references, "see Figures 1-3 and Table 4", ["figure:1", "figure:2", "figure:3", "table:4"]), (T.references, "as [12] in 10.1234/ABC.d and arXiv: 2401.12345v2", ["arxiv:2401.12345v2", "citation:12", "doi:10.1234/abc.d"]),
]


@pytest.mark.parametrize(("function", "text", "expected"), EXAMPLES)
def test_text_examples(spark, function, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(function("t")).first()[0]
    assert (sorted(got) if isinstance(got, list) else got) == (sorted(expected) if isinstance(expected, list) else expected)


def test_edge_counts_in_closed_form_equal_the_edges(spark):
    for scope in ("document", "corpus"):
        c = graph_chunks(spark)
        counted = {(r.scope, r.relation): r.n for r in graph.relation_counts(c, scope).collect()}
        built = Counter((r.scope, r.relation) for r in graph.edges(c, scope).collect())
        assert counted == dict(built)


def test_graph_search_equals_expansion_over_all_edges(spark):
    c, q = graph_chunks(spark), asked(spark, "Solver Engine setup")
    seeds = {r.chunk_id: r.score for r in graph.seed_scores(graph.index_rows(c).withColumn("scope", F.lit("")), q).collect()}
    edges = graph.edges(c, "corpus").collect()
    top = dict(sorted(seeds.items(), key=lambda x: -x[1])[:8])
    final, relations = dict(top), {s: {"seed"} for s in top}
    for e in edges:
        if e.src in top:
            final[e.dst] = max(final.get(e.dst, 0), round(top[e.src] * e.weight, 9))
            relations.setdefault(e.dst, set()).add(e.relation)
    got = {r.chunk_id: r for r in graph.search_rows(c, q, 50, "corpus").collect()}
    close({k: r.score for k, r in got.items()}, final)
    assert {k: set(r.relations) for k, r in got.items()} == relations
    assert graph.graph(c, asked(spark, "..."), 5).count() == 0


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_chunks_before(spark, scope):
    rows = [(f"d{d}" if scope == "document" else "", i, f"d{d}", f"d{d}:{i}", f"s{(d + i) // 3}") for d in range(40) for i in range(d % 5)]
    n = spark.createDataFrame(rows, "scope string, chunk_index int, document_id string, chunk_id string, section string")
    expected, last = set(), {}
    for r in sorted(rows):
        if r[0] in last:
            expected.add((r[0], r[3], r[4], *last[r[0]]))
        last[r[0]] = r[3:]
    assert {tuple(r) for r in graph.with_previous(n, scope).collect()} == expected
    assert graph.with_previous(n.where("false"), scope).count() == 0


def test_knowledge_graph(spark):
    c = graph_chunks(spark)
    entities = {r.entity: r for r in graph.knowledge_entities(c).collect()}
    assert entities["Solver Engine"].chunk_ids == ["a:chunk:0", "a:chunk:1", "b:chunk:1"] and entities["Solver Engine"].document_ids == ["a", "b"]
    sections = {r.section: r.name for r in graph.knowledge_sections(c).collect()}
    assert sections == {"2 methods": "2 Methods", "2.1 setup": "2.1 Setup", "3 results": "3 Results"}
    refs = {r.ref: r for r in graph.knowledge_references(c, "document").collect()}
    assert refs["table:1"].source_chunk_ids == refs["table:1"].target_chunk_ids == ["a:chunk:0", "a:chunk:2"]


@pytest.mark.parametrize(("text", "expected"), [("see Fig. 3", []), ("Figure 3", ["figure:3"]), ("f1gures 2 and 4", ["figure:2", "figure:4"]), ("eq. 5", ["equation:5"]), ("chapt3r 2", ["section:2"]), ("beyond", [])])
def test_references(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.references("t")).first()[0] == expected


# --- cards, profiles, evaluation ------------------------------------------------------------------------------
def test_cards(spark):
    rows = [("0", "a:chunk:0", "a", [1, 2], " first\nline ", 0.2, "bm25", 1), ("0", "b:chunk:0", "b", [3], "second", 0.18, "graph", 2)]
    e = spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, rank int")
    cards = {r.query_id: r for r in evidence.cards(e, asked(spark, "what", "nothing")).collect()}
    c = cards["0"]
    assert c.answer == "Query: what\n\nGrounded answer:\n- first line [C1: a/a:chunk:0, page(s) 1, 2]\n- second [C2: b/b:chunk:0, page(s) 3]"
    assert c.confidence == pytest.approx(0.19) and c.ambiguity == [evidence.LOW_NOTE, evidence.MANY_NOTE, evidence.CLOSE_NOTE]
    assert c.follow_ups == [evidence.DEEPER, evidence.TRY_VISUAL, "Inspect page(s) 1, 2, 3 from the top evidence."] and c.reason == "Evidence confidence is 0.19 across top retrieval hits."
    assert not cards["1"].answerable and cards["1"].answer == evidence.NO_EVIDENCE and cards["1"].confidence == 0
    assert {r.query_id: r.supported for r in evidence.supported(evidence.cards(e, asked(spark, "what", "nothing"))).collect()} == {"0": True, "1": False}


def test_profiles(spark):
    r = profile.profiles(pages_of(spark, {"d": ["# Title One\nGradient descent gradient | x\tTable 2", "", "Deep Learning and Deep Learning"]})).first()
    assert (r.page_count, r.text_page_count, r.empty_pages, r.headings) == (3, 2, 1, ["Title One"])
    assert r.page_types == {"table_or_form": 1, "text": 2} and r.topics[0] == "gradient" and r.entities[0] == "Deep Learning"
    assert r.references == {"table": ["table:2"]} and r.average_block_confidence is None


def test_scanner(spark):
    docs = spark.createDataFrame([(1, "ok\nmail a.b@example.org\n\npassword = 'hunter2hunter2'"), (2, "123-45-6789 AKIA" + "A" * 16), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.line_number, r.label) for r in sensitive.findings(docs).collect()) == [(1, 2, "Email address"), (1, 4, "Generic secret assignment"), (2, 1, "AWS access key"), (2, 1, "US SSN")]


def test_sweep_variants():
    assert evaluate.sweep_variants(None) == []
    assert [v["name"] for v in evaluate.sweep_variants(True)] == ["score_max", "score_max_rerank", "route_vote", "route_vote_rerank"]
    assert evaluate.sweep_variants([{"merge_strategy": "route_vote", "rerank": "false", "name": "x"}])[0]["rerank"] is False
    with pytest.raises(ValueError, match="Unsupported"):
        evaluate.sweep_variants([{"merge_strategy": "best"}])


def test_evaluation_of_a_manifest(spark, tmp_path):
    pages = pages_of(spark, {"a": ["the solver converges quickly, see Table 2", "boundary terms vanish in the Solver Engine"], "b": ["unrelated words"]}).selectExpr("*", "'t' AS title", "'.md' AS source_type", "CAST(map() AS map<string,string>) AS metadata")
    manifest = {"document_ids": ["a", "b"], "planner_sweep": True, "planner_rerank": "true", "document_quality_tiers": {"a": "clean"}, "expected_entities": ["Solver Engine", "Nobody"], "expected_references_by_tier": {"clean": ["table:2"]}, "queries": [{"query": "why does the solver converge", "expected_terms": ["SOLVER"], "expected_pages": [1]}, {"query": "boundary terms", "document_id": "a", "expected_terms": ["vanish", "missing"]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    report = evaluate.run(spark, evaluate.load_manifest(str(tmp_path / "m.json")), chunk_pages(pages), pages, 3, ("bm25", "dense", "planner", "graph"))
    assert report["modes"]["bm25"]["term_hit_rate"] == 0.5 and report["modes"]["bm25"]["mrr"] == 0.5 and report["modes"]["dense"]["cases"] == 2
    assert len(report["sweep"]) == 4 and report["best_by_mrr"] == "score_max" and report["modes"]["planner"]["answerable_rate"] == 1.0
    assert report["graph_diagnostics"]["cases"] == 2 and report["graph_diagnostics"]["nodes"] == 3 and report["graph_diagnostics"]["relations"]["next_chunk"] == 1 and report["visual_diagnostics"]["planner_contribution_rate"] == 0.0
    assert {r["tier"]: (r["documents"], r["nodes"], r["references"], r["average_nodes"]) for r in report["graph_extraction"]} == {None: (2, 3, 1, 1.5), "clean": (1, 2, 1, 2.0), "unlabeled": (1, 1, 0, 1.0)}
    assert [(r["tier"], r["kind"], r["found"], r["missing"]) for r in report["recall"]] == [(None, "entity", 1, ["Nobody"]), ("clean", "reference", 1, [])]
    assert [(e["kind"], e["tier"], e["values"]) for e in report["expected"]] == [("entities", None, ["Nobody", "Solver Engine"]), ("references", "clean", ["table:2"])] and report["missing_documents"] == []
    text = evaluate.markdown(report)
    assert all(f"## {title}" in text for title in ("Mode Metrics", "Planner vs Static", "Planner Sweep", "Visual Diagnostics", "Graph Diagnostics", "Graph Extraction", "Recall", "Queries"))
    with pytest.raises(ValueError, match="Could not read manifest"):
        evaluate.load_manifest(str(tmp_path / "none.json"))


# --- pixels ---------------------------------------------------------------------------------------------------
def test_image_profiles_and_ocr():
    flat = np.full((400, 800, 3), 250, np.uint8)
    assert images.image_profile(flat) == "layout_visual orientation_landscape texture_low contrast_low line_density_low brightness_high"
    noise = np.random.default_rng(1).integers(0, 256, (90, 60, 3)).astype(np.uint8)
    assert "texture_high" in images.image_profile(noise) and "orientation_portrait" in images.image_profile(noise)
    assert images.image_profile(None) == "layout_unknown"
    assert [images.target_size(*s) for s in ((1000, 500), (4800, 2400), (6000, 1500))] == [(1000, 500), (2400, 1200), (4800, 1200)]
    fails = lambda *_: 1 / 0
    assert images.read_page(flat, "Hybrid", lambda p: "raw", lambda p, t: t + "!") == ("raw", "raw!")
    assert images.read_page(flat, "Hybrid", lambda p: "raw", fails) == ("raw", "raw")
    assert images.read_page(flat, "Pure Cloud", lambda p: "raw", lambda p, t: "c" + t) == ("", "c")
    assert images.read_page(flat, "Pure Local", fails, None) == ("", "")


def test_encoders_score_by_best_vectors(spark):
    items = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 1.0]]), ("b", [[0.5, 0.5]]), ("c", [])], "item_id string, vectors array<array<double>>")
    q = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 2.0]])], "query_id string, vectors array<array<double>>")
    best, share = page_vectors.search(page_vectors.summarised(items), q, 3)
    assert {r.item_id: r.score for r in best.collect()} == {"a": 3.0, "b": 1.5, "c": 0.0} and share == 1
    with pytest.raises(images.EncoderUnavailableError, match="No page encoder"):
        images.encode_pages(items, None)
