"""Knowledge cards: citations, claims, the extractive answer, confidence and notes. [M1-M4]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T

# --- fixed values ---------------------------------------------------------------------------------------------
LOW, FOLLOW_UP, CLOSE, MOST_FOLLOW_UPS = 0.35, 0.5, 0.05, 4
NO_EVIDENCE = "No evidence found for this query."
NO_HITS = "No retrieval hits were returned."
NO_SUPPORT = ["No retrieved evidence was available to support an answer."]
NO_HITS_FOLLOW_UPS = ["Run a broader planner query across all indexed documents.", "Build missing indexes, especially hybrid and graph, before retrying."]
LOW_NOTE = "Top evidence scores are low, so the answer may be under-supported."
MANY_NOTE = "Evidence spans multiple documents and may need cross-document reconciliation."
CLOSE_NOTE = "The top retrieval hits are closely scored, leaving ranking ambiguity."
DEEPER = "Increase top_k and rerun in planner mode to gather more corroborating evidence."
TRY_GRAPH = "Try graph mode for section, entity, or reference expansion around the current hits."
TRY_VISUAL = "Try visual mode if the answer may depend on figures, tables, scans, or page layout."
CONFIDENCE = "Evidence confidence is %.2f across top retrieval hits."
QUERY, GROUNDED = "Query: ", "\n\nGrounded answer:\n"
# --- end of fixed values --------------------------------------------------------------------------------------


def confidence(scores: Column) -> Column:
    """Mean of the first three scores, each within [0, 1]. [G13]"""
    best = F.slice(scores, 1, 3)
    return F.when(F.size(best) == 0, 0.0).otherwise(F.aggregate(F.transform(best, T.clamp), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(best), F.lit(1)))


def page_label(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")


def cards(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """One card for each question: query_id, query, answer, answerable, confidence, citations, claims, ambiguity, follow_ups, reason."""
    row = F.struct("rank", "chunk_id", "document_id", "page_numbers", "text", "score", "retrieval_path")
    held = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("e"))
    rows = questions.select("query_id", F.col("question").alias("query")).join(held, "query_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<rank:int,chunk_id:string,document_id:string,page_numbers:array<int>,text:string,score:double,retrieval_path:string>>")))
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform("e", lambda x: T.snippet(x["text"])).alias("short")))))
    name = lambda i: F.concat(F.lit("C"), (i + 1).cast("string"))
    citations = F.transform("e", lambda x, i: F.struct(name(i).alias("id"), x["chunk_id"].alias("chunk_id"), x["document_id"].alias("document_id"), x["page_numbers"].alias("page_numbers"), x["score"].alias("score"), x["retrieval_path"].alias("retrieval_path")))
    claims = F.transform("e", lambda x, i: F.struct(F.get("short", i).alias("text"), F.array(name(i)).alias("citation_ids"), T.clamp(x["score"]).alias("confidence")))
    lines = F.transform("e", lambda x, i: F.concat(F.lit("- "), F.get("short", i), F.lit(" ["), name(i), F.lit(": "), x["document_id"], F.lit("/"), x["chunk_id"], F.lit(", page(s) "), page_label(x["page_numbers"]), F.lit("]")))
    sure = confidence(F.transform("e", lambda x: x["score"]))
    some = F.size("e") > 0
    second = F.size("e") > 1
    gap = F.abs(F.get("e", F.lit(0))["score"] - F.get("e", F.lit(1))["score"])
    notes = [
        F.when(sure < LOW, LOW_NOTE), F.when(F.size(F.array_distinct(F.transform("e", lambda x: x["document_id"]))) > 1, MANY_NOTE),
        F.when(second & (gap < CLOSE), CLOSE_NOTE),
    ]
    paths = F.transform("e", lambda x: x["retrieval_path"])
    lacks = lambda word: ~F.exists(paths, lambda p: F.contains(p, F.lit(word)))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.slice("e", 1, 3), lambda x: x["page_numbers"]))))
    look = F.array(F.when(F.size(seen) > 0, F.concat(F.lit("Inspect page(s) "), page_label(seen), F.lit(" from the top evidence."))))
    more = F.concat(F.array(F.when(sure < FOLLOW_UP, DEEPER), F.when(lacks("graph"), TRY_GRAPH), F.when(lacks("visual"), TRY_VISUAL)), look)
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    return rows.select(
        "query_id", "query", F.when(some, F.concat(F.lit(QUERY), "query", F.lit(GROUNDED), F.array_join(lines, "\n"))).otherwise(F.lit(NO_EVIDENCE)).alias("answer"), some.alias("answerable"), F.round(sure, 9).alias("confidence"),
        citations.alias("citations"), claims.alias("claims"), F.when(some, present(F.array(*notes))).otherwise(F.array(*map(F.lit, NO_SUPPORT))).alias("ambiguity"),
        F.when(some, F.slice(present(more), 1, MOST_FOLLOW_UPS)).otherwise(F.array(*map(F.lit, NO_HITS_FOLLOW_UPS))).alias("follow_ups"),
        F.when(some, F.format_string(CONFIDENCE, sure)).otherwise(F.lit(NO_HITS)).alias("reason"),
    )


def supported(card_rows: DataFrame) -> DataFrame:
    """query_id, supported: answerable, with citations, and every claim cites some of them. [E8]"""
    ids = F.transform("citations", lambda c: c["id"])
    fine = F.forall("claims", lambda c: (F.size(c["citation_ids"]) > 0) & (F.size(F.array_except(c["citation_ids"], ids)) == 0))
    return card_rows.select("query_id", (F.col("answerable") & (F.size("citations") > 0) & fine).alias("supported"))
