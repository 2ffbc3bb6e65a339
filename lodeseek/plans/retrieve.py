"""Retrieval by mode, for one question or a table of them, over one document, some or all. [K13-K16, L6, L7]"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import vectors as V
from lodeseek.operators import blocks as B
from lodeseek.operators import graph as G
from lodeseek.operators import images, merge, page_vectors, postings
from lodeseek.operators import retrievers as R
from lodeseek.plans import planner
from lodeseek.session import settled

MODES = ("bm25", "dense", "late", "visual", "graph", "hybrid", "planner")
INDEXES = {"bm25": ("bm25",), "dense": ("dense",), "late": ("late",), "visual": ("visual",), "graph": ("graph",), "hybrid": ("bm25", "dense"), "planner": ("bm25", "dense", "late", "visual", "graph"), "all": ("bm25", "dense", "late", "visual", "graph")}
EVIDENCE_SCHEMA = "query_id string, chunk_id string, document_id string, page_numbers array<int>, text string, score double, retrieval_path string, rank int, metadata map<string,string>"
HIT_SCHEMA = EVIDENCE_SCHEMA.replace(", rank int", "") + ", ord int"


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"Unsupported retrieval mode: {mode}")


def one_question(spark: SparkSession, question: str) -> DataFrame:
    return spark.createDataFrame([("q", question)], "query_id string, question string")


def visual_pages(pages: DataFrame) -> DataFrame:
    """Pages with what page retrieval needs: their image and profile, from the metadata."""
    image = F.col("metadata")["image_path"]
    return pages.select("document_id", "page_id", "number", "text", "title", "source_type", image.isNotNull().alias("has_image"), F.coalesce(F.col("metadata")["profile"], F.lit("layout_unknown")).alias("profile"))


def missing_indexes(mode: str, indexes: dict[str, DataFrame] | None) -> list[str]:
    """Which of the indexes that a mode reads are not there; a planner's routes look for their own."""
    return [] if indexes is None or mode == "planner" else [n for n in INDEXES[mode] if n not in indexes]


def retrieve(mode: str, chunks: DataFrame, pages: DataFrame | None, questions: DataFrame, k: int = 5, scope: str = "document", indexes: dict[str, DataFrame] | None = None, k1: float = 1.5, b: float = 0.75, dense_dimensions: int = 384, late_dimensions: int = 128, question_vectors: DataFrame | None = None, **planning) -> DataFrame:
    """Evidence rows of all questions in one mode. Graph search treats several documents as one.

    indexes: stored tables by name. With them, nothing is built again: a mode whose index is not among them finds
    nothing. Without them, each mode makes its rows from chunks and pages. With question_vectors (query_id, vectors) and
    an index of model vectors, page retrieval goes by these. An index by term (bm25_by_term, an object of postings.py) of the
    same scope and settings goes before the table bm25.
    """
    check_mode(mode)
    made = {"k1": k1, "b": b, "dense_dimensions": dense_dimensions, "late_dimensions": late_dimensions, "question_vectors": question_vectors}
    if mode == "planner":
        return plan_and_merge(chunks, pages, questions, k, scope, indexes=indexes, **made, **planning)
    if missing_indexes(mode, indexes):
        return chunks.sparkSession.createDataFrame([], EVIDENCE_SCHEMA)
    held = indexes or {}
    if mode == "bm25":
        by_term = held.get("bm25_by_term")
        if by_term is not None and (by_term.scope, by_term.k1, by_term.b) == (scope, k1, b):
            return postings.bm25(by_term, chunks, questions, k)
        return R.bm25(chunks, questions, k, scope=scope, k1=k1, b=b, index=held.get("bm25"))
    if mode == "dense":
        return R.dense(chunks, questions, k, dense_dimensions, held.get("dense"))
    if mode == "late":
        return R.late(chunks, questions, k, late_dimensions, index=held.get("late"))
    if mode == "graph":
        return G.graph(chunks, questions, k, "corpus", held.get("graph"))
    if mode == "visual":
        if pages is None:
            raise ValueError("Visual retrieval needs pages")
        if question_vectors is not None and "vectors" in held:
            return R.page_vectors(pages, question_vectors.join(questions.select("query_id"), "query_id", "left_semi"), held["vectors"], k)
        return R.visual(visual_pages(pages), questions, k, dense_dimensions, held.get("visual"))
    return R.hybrid(chunks, questions, k, scope, held.get("bm25"), held.get("dense"), k1, b, dense_dimensions)


def planner_hits(chunks: DataFrame, pages: DataFrame | None, questions: DataFrame, k: int, scope: str, strategy: str = "score_max", indexes: dict[str, DataFrame] | None = None, **made) -> DataFrame:
    """Hits of every route of every question's plan, with ord; one retrieval for each route in use, for all its questions.

    Each route fetches for its deepest question; a question's own depth cuts its list.
    """
    planned = planner.plan_batch(questions, strategy)
    steps = planned.select("query_id", "question", F.posexplode("routes").alias("place", "route"), "route_factors")
    # a few rows a question, read by each route
    steps = settled(steps.withColumn("depth", F.greatest(F.lit(k), F.bround(F.lit(k) * F.element_at("route_factors", F.col("route"))).cast("int"))).drop("route_factors"))
    used = {r["route"] for r in steps.select("route").distinct().collect()}  # at most the six routes
    asked = lambda route: steps.where(F.col("route") == route).select("query_id", "question")
    out, shared = None, None
    if {"bm25", "dense"} <= used and indexes is None and scope == "document":
        # both lists come from one pass over the chunks
        shared = settled(R.bm25_and_dense(chunks, asked("bm25"), asked("dense"), 3 * k, made.get("k1", 1.5), made.get("b", 0.75), made.get("dense_dimensions", 384)))
    for route in ("bm25", "dense", "late", "visual", "graph", "hybrid"):
        if route not in used or missing_indexes(route, indexes) or (route == "visual" and pages is None):
            continue  # a route without its index is left out; the trace says so
        own = steps.where(F.col("route") == route)
        if shared is not None and route in ("bm25", "dense"):
            hits = shared.where(F.col("retrieval_path") == route)
        else:
            hits = retrieve(route, chunks, pages, asked(route), 3 * k, scope, indexes, **made)
        hits = hits.join(own.select("query_id", "place", "depth"), "query_id").where(F.col("rank") <= F.col("depth"))
        hits = hits.withColumn("ord", F.col("place") * 10_000 + F.col("rank")).drop("place", "depth", "rank")
        out = hits if out is None else out.unionByName(hits)
    return chunks.sparkSession.createDataFrame([], HIT_SCHEMA) if out is None else out


def plan_and_merge(chunks: DataFrame, pages: DataFrame | None, questions: DataFrame, k: int = 5, scope: str = "document", strategy: str = "score_max", rerank: bool = True, vote_bonus: float = 0.08, overlap_weight: float = 0.10, indexes: dict[str, DataFrame] | None = None, **made) -> DataFrame:
    hits = planner_hits(chunks, pages, questions, k, scope, strategy, indexes, **made)
    got = merge.merged(hits, questions, k, strategy=strategy, rerank=rerank, vote_bonus=vote_bonus, overlap_weight=overlap_weight)
    return got.select(*R.EVIDENCE)


def build_indexes(store, chunks: DataFrame, pages: DataFrame, mode: str = "all", dense_dimensions: int = 384, late_words: int = 256, encoder: Callable | None = None, compression: str = "none") -> list[str]:
    """Writes the tables that a mode reads; returns their names. [K13]

    encoder: the factory of a page encoder (images.encode_pages); with it, the visual index has model vectors, too, of the
    pages that have an image.
    """
    if mode not in INDEXES:
        raise ValueError(f"Unsupported index mode: {mode}")
    made = []
    for name in INDEXES[mode]:
        if name == "bm25":
            df = R.postings(chunks)
        elif name == "dense":
            df = B.dense_rows(chunks, dense_dimensions)
        elif name == "late":
            df = B.late_rows(chunks, late_words)
        elif name == "visual":
            df = B.dense_rows(R.visual_items(visual_pages(pages)), dense_dimensions, ("has_image",))
        else:
            df = G.index_rows(chunks).drop("scope")
            for kind, rows in (("kg_sections", G.knowledge_sections(chunks, "document")), ("kg_entities", G.knowledge_entities(chunks, "document")), ("kg_references", G.knowledge_references(chunks, "document")), ("kg_stats", G.knowledge_stats(chunks, "document"))):
                store.save(kind, rows.withColumnRenamed("scope", "document_id"))
        store.save(f"index_{name}", df)
        made.append(f"index_{name}")
    if encoder and "visual" in INDEXES[mode]:
        drawn = pages.select("document_id", F.col("page_id").alias("chunk_id"), F.col("number").alias("chunk_index"), F.col("metadata")["image_path"].alias("path")).where("path is not null")
        paths = [r["path"] for r in drawn.select("path").distinct().collect()]  # the images of one document
        if not paths:
            raise ValueError("No page images to index")
        pixels = store.spark.read.format("image").option("dropInvalid", "true").load(paths).select(F.regexp_replace("image.origin", "^file:/*", "/").alias("page_id"), "image")
        vectors = images.encode_pages(pixels, encoder).select(F.col("item_id").alias("path"), V.maybe_compress(F.col("vectors"), compression, rows=True).alias("vectors"))
        rows = drawn.join(vectors, "path").drop("path")
        # summaries are of the numbers that are stored; kept under their own key, so that compression stays as it is
        made_of = page_vectors.summarised(rows.select(*B.KEY, V.maybe_dequantize(rows, "vectors", rows=True).alias("vectors"))).drop("vectors")
        store.save("index_vectors", rows.join(made_of, B.KEY))
        made.append("index_vectors")
    return made


def trace(mode: str, questions: DataFrame, evidence: DataFrame, k: int, lacking: dict[str, list[str]] | None = None) -> DataFrame:
    """query_id, step, path, payload (variant): what was planned, which indexes were missing, what each route gave, and the merge.

    lacking: for each missing index, the documents (at most the first eight are told) that have none.
    """
    spark = questions.sparkSession
    json = lambda *columns: F.parse_json(F.to_json(F.struct(*columns)))
    steps = evidence.groupBy("query_id", "retrieval_path").agg(F.count("*").alias("hits"), F.max("score").alias("top_score"), F.slice(F.array_sort(F.collect_set("document_id")), 1, 8).alias("documents"))
    rows = steps.select("query_id", F.col("retrieval_path").alias("path"), json("hits", "top_score", "documents").alias("payload"), F.lit(2).alias("kind"))
    if lacking:
        gone = spark.createDataFrame([(n, d[:8], len(d)) for n, d in sorted(lacking.items())], "index string, documents array<string>, n int")
        rows = rows.unionByName(questions.select("query_id").crossJoin(F.broadcast(gone)).select("query_id", F.lit("missing_index").alias("path"), json("index", "documents", "n").alias("payload"), F.lit(1).alias("kind")))
    if mode == "planner":
        plan = planner.plan_batch(questions)
        about = json("query_type", "routes", "reason", "route_factors", "merge_strategy", F.lit(k).alias("top_k"))
        rows = rows.unionByName(plan.select("query_id", F.lit("planner").alias("path"), about.alias("payload"), F.lit(0).alias("kind")))
        routes = plan.select("query_id", F.posexplode("routes").alias("place", "route"), F.element_at("route_factors", F.col("route")).alias("top_k_factor"))
        rows = rows.unionByName(routes.select("query_id", F.lit("planner_route").alias("path"), json("route", "top_k_factor").alias("payload"), F.lit(1).alias("kind")))
        number = lambda name: F.coalesce(F.element_at("metadata", name), F.lit("0")).cast("int")
        merged = evidence.groupBy("query_id").agg(F.count("*").alias("kept"), F.sum(number("redundant_pairs")).alias("redundant_pairs"), F.sum(number("conflict_pairs")).alias("conflict_pairs"))
        # the first eight pairs of each kind, in the order of their evidence [I6]
        pair = "array<struct<chunk_id_a:string,chunk_id_b:string,overlap:double>>"
        listed = lambda name: F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.from_json(F.element_at("metadata", name), pair), F.array().cast(pair)).alias("p")))), lambda x: x["p"])), 1, merge.LISTED).alias(name)
        lists = evidence.groupBy("query_id").agg(listed("redundant_list"), listed("conflict_list"))
        merged = merged.join(lists, "query_id")
        rows = rows.unionByName(merged.select("query_id", F.lit("planner_merge").alias("path"), json("kept", "redundant_pairs", "conflict_pairs", "redundant_list", "conflict_list").alias("payload"), F.lit(3).alias("kind")))
    step = F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "path", F.to_json("payload")))
    return rows.withColumn("step", step).select("query_id", "step", "path", "payload")
