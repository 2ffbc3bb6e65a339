"""Merging of planner hits: best evidence per chunk, votes, rerank, redundancy and conflicts. [L4, L5]

Hits are evidence rows with ``ord``, their place in the order of routes and ranks. Everything after the first
aggregation concerns at most a few dozen rows a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.plans.planner import check_strategy
from lodeseek.session import settled

# --- fixed values ---------------------------------------------------------------------------------------------
REDUNDANT, CONFLICTING, WINDOW, LISTED = 0.72, 0.28, 8, 8
# --- end of fixed values --------------------------------------------------------------------------------------


def scored(hits: DataFrame, questions: DataFrame, strategy: str = "score_max", rerank: bool = False, vote_bonus: float = 0.08, overlap_weight: float = 0.10, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One row for each question and chunk: best score, first of equals; routes; rank_score; rank. [G6, L4]

    Columns of questions that are named like these parameters go before them, so that questions can have their own.
    """
    check_strategy(strategy)
    given = {"strategy": strategy, "rerank": rerank, "vote_bonus": vote_bonus, "overlap_weight": overlap_weight}
    own = [c for c in given if c in questions.columns]
    setting = lambda c: F.col(f"own_{c}") if c in own else F.lit(given[c])
    first = F.struct(F.col("score"), -F.col("ord"))
    best = hits.groupBy(*keys, "chunk_id").agg(
        F.max_by(F.struct("document_id", "page_numbers", "text", "score", "retrieval_path", *(("metadata",) if "metadata" in hits.columns else ())), first).alias("e"), F.array_sort(F.collect_set("retrieval_path")).alias("routes"), F.min("ord").alias("ord")
    )
    rows = best.select(*keys, "chunk_id", "e.*", "routes", "ord").join(questions.select("query_id", "question", *[F.col(c).alias(f"own_{c}") for c in own]), "query_id")
    votes = F.when(setting("strategy") == "route_vote", setting("vote_bonus") * (F.size("routes") - 1)).otherwise(0.0)
    shared = F.when(setting("rerank"), setting("overlap_weight") * T.jaccard(T.token_set("question"), T.token_set("text"))).otherwise(0.0)
    value = F.col("score") + votes + shared
    rows = rows.withColumn("rank_score", F.round(value, 9)).drop("question", *[f"own_{c}" for c in own])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rank_score"), "ord", "document_id", "chunk_id")))


def pairs(rows: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Pairs of the best max(k, 8) rows on a common page: overlap, redundant, conflict. [F10]

    A join of at most max(k, 8) rows a question with themselves.
    """
    near = rows.where(F.col("rank") <= max(k, WINDOW)).select(*keys, "rank", "chunk_id", "page_numbers", "document_id", "text", T.token_set("text").alias("words"), T.has_negation("text").alias("negated"))
    near = settled(near)  # both sides read it
    left, right = (near.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in near.columns if c not in keys]) for s in "ab")
    joined = left.join(right, list(keys)).where((F.col("rank_a") < F.col("rank_b")) & F.arrays_overlap("page_numbers_a", "page_numbers_b"))
    joined = joined.withColumn("overlap", F.round(T.jaccard(F.col("words_a"), F.col("words_b")), 9))
    return joined.select(*keys, "rank_a", "rank_b", "chunk_id_a", "chunk_id_b", "overlap", (F.col("overlap") >= REDUNDANT).alias("redundant"), ((F.col("overlap") >= CONFLICTING) & (F.col("overlap") < REDUNDANT) & (F.col("negated_a") != F.col("negated_b"))).alias("conflict")).where("redundant or conflict")


def merged(hits: DataFrame, questions: DataFrame, k: int = 5, keys: tuple[str, ...] = ("query_id",), **settings) -> DataFrame:
    """The k best that no better one makes redundant: evidence rows with source_score and routes. [F11, I5]"""
    rows = settled(scored(hits, questions, keys=keys, **settings))
    near = pairs(rows, k, keys)
    pair = F.struct("chunk_id_a", "chunk_id_b", "overlap")
    ends = near.select(*keys, F.inline(F.array(F.struct(F.col("chunk_id_a").alias("chunk_id"), F.lit(False).alias("loses")), F.struct(F.col("chunk_id_b").alias("chunk_id"), F.lit(True).alias("loses")))), "redundant", "conflict", pair.alias("pair"))
    # at most max(k, 8) rows a question: which of them go, how many pairs each is in, and the first of those that it leads
    led = lambda flag: F.slice(F.array_sort(F.collect_list(F.when(F.col(flag) & ~F.col("loses"), F.col("pair")))), 1, LISTED)
    said = ends.groupBy(*keys, "chunk_id").agg(F.bool_or(F.col("redundant") & F.col("loses")).alias("gone"), F.count_if("redundant").alias("redundant"), F.count_if("conflict").alias("conflicts"), led("redundant").alias("redundant_list"), led("conflict").alias("conflict_list"))
    left = rows.join(said, [*keys, "chunk_id"], "left").where(~F.coalesce("gone", F.lit(False)))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where(F.col("rank") <= k)
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    told = F.create_map(F.lit("routes"), F.array_join("routes", ","), F.lit("source_score"), F.col("score").cast("string"), F.lit("redundant_pairs"), text("redundant"), F.lit("conflict_pairs"), text("conflicts"))
    # lists are JSON in a map of strings; the trace reads them again
    for name in ("redundant_list", "conflict_list"):
        told = F.map_concat(told, F.when(F.size(name) > 0, F.create_map(F.lit(name), F.to_json(name))).otherwise(F.create_map().cast("map<string,string>")))
    told = F.map_concat("metadata", told) if "metadata" in hits.columns else told
    return left.select(*keys, "chunk_id", "document_id", "page_numbers", "text", F.col("rank_score").alias("score"), F.concat(F.lit("planner:"), "retrieval_path").alias("retrieval_path"), "rank", F.col("score").alias("source_score"), "routes", told.alias("metadata"))


def merge_statistics(hits: DataFrame, questions: DataFrame, k: int = 5, **settings) -> DataFrame:
    """query_id, candidates, redundant, conflicts and the first eight of each as arrays of structs."""
    rows = settled(scored(hits, questions, **settings))
    found = pairs(rows, k)
    item = F.struct("rank_a", "rank_b", "chunk_id_a", "chunk_id_b", "overlap")
    listed = lambda flag: F.slice(F.array_sort(F.collect_list(F.when(F.col(flag), item))), 1, LISTED).alias(f"{flag}_pairs")
    stats = found.groupBy("query_id").agg(F.count_if("redundant").alias("redundant"), F.count_if("conflict").alias("conflicts"), listed("redundant"), listed("conflict"))
    return rows.groupBy("query_id").agg(F.count("*").alias("candidates")).join(stats, "query_id", "left").fillna(0, ["redundant", "conflicts"])
