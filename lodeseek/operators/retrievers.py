"""Retrievers over chunks: BM25, hashed dense vectors, late interaction, page text, and their fusion. [K1-K7]

Each takes items (chunks or pages) and questions (query_id, question), and returns the same evidence rows for all
questions at once: query_id, chunk_id, document_id, page_numbers, text, score, retrieval_path, rank. Scores are
rounded to nine places before ranking, ties go to (document_id, position, chunk_id), so plans and partitions do not
change a result. With scope "document" statistics and ranks are of each document alone; "corpus" takes them all.

Indexes are tables: postings, vectors and distinct words. They can be built once, stored and passed in as ``index``;
without one, the same rows are made from the items. Questions are multiplied block by block (blocks.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.operators import blocks as B
from lodeseek.operators import fused as H
from lodeseek.operators import lists as L
from lodeseek.operators import page_vectors as M
from lodeseek.operators.chunking import barrier
from lodeseek.session import settled

EVIDENCE = ["query_id", "chunk_id", "document_id", "page_numbers", "text", "score", "retrieval_path", "rank", "metadata"]


def scope_columns(scope: str) -> list[str]:
    if scope not in ("document", "corpus"):
        raise ValueError(f"Unsupported statistics scope: {scope}")
    return ["document_id"] if scope == "document" else []


def ranked(scored: DataFrame, k: int, per: list[str], order: str = "chunk_index") -> DataFrame:
    """The k best rows of each group by score, with their rank."""
    by = Window.partitionBy(*per).orderBy(F.desc("score"), "document_id", order, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top(scored: DataFrame, k: int, order: str = "chunk_index") -> DataFrame:
    """The k best per document, then the k best of all, for each question. [I4]"""
    first = ranked(scored, k, ["query_id", "document_id"], order).drop("rank")
    return ranked(first, k, ["query_id"], order)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most most rows; they are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Documents whose ids become a filter.
NAMED = 20_000


def of_documents(items: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items of best's documents (best is written), and best: a filter by id reaches the scan, so that no other document is cut into chunks."""
    ids = best.select("document_id").distinct().limit(NAMED + 1).collect()
    if "document_id" in items.columns and len(ids) <= NAMED:
        items = items.where(F.col("document_id").isin([r[0] for r in ids]))
    return items, best


def as_evidence(best: DataFrame, items: DataFrame, path: str | None) -> DataFrame:
    """Ranked ids with their texts: texts meet only the few rows that won. [E5] metadata: what a retriever says of a row, and the item's section. Without path, best has retrieval_path."""
    said = F.col("metadata") if "metadata" in best.columns else F.create_map().cast("map<string,string>")
    best = best.select("query_id", "chunk_id", "document_id", "score", "rank", (F.col("retrieval_path") if path is None else F.lit(path)).alias("retrieval_path"), said.alias("said"))
    items, best = of_documents(items, settled(best))
    section = F.col("parent_section") if "parent_section" in items.columns else F.lit(None).cast("string")
    got = items.select("chunk_id", "page_numbers", "text", section.alias("section")).join(best, "chunk_id")
    own = F.when(F.col("section").isNotNull(), F.create_map(F.lit("parent_section"), F.col("section"))).otherwise(F.create_map().cast("map<string,string>"))
    return got.withColumn("metadata", F.map_concat(own, "said")).select(*EVIDENCE)


def question_terms(questions: DataFrame) -> DataFrame:
    """query_id, term, m: the words of each question with their number."""
    return questions.select("query_id", F.explode(T.tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("m"))


# --- BM25 -----------------------------------------------------------------------------------------------------
def with_words(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, chunk_index, len and words, in order: found once for all that follows."""
    rows = barrier(chunks.select(*B.KEY, "text"), words=F.sort_array(T.tokens("text"))).drop("text")
    return rows.select(*B.KEY, F.size("words").alias("len"), "words")


def counted(words: DataFrame) -> DataFrame:
    """with_words as document_id, chunk_id, chunk_index, len, term, tf: runs of equal words, inside each chunk's own row."""
    first = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: (i == 0) | (i == F.size("words")) | (F.get("words", i) != F.get("words", i - 1)))
    rows = barrier(words.where("len > 0"), cuts=first)
    runs = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda s, i: F.struct(F.get("words", s).alias("term"), (F.get("cuts", i + 1) - s).cast("long").alias("tf")))
    return rows.select(*B.KEY, "len", F.inline(runs))


def postings(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_id, chunk_index, len, term, tf; and a row without a term for each chunk, which has its length. [G1]"""
    rows = with_words(chunks)
    return rows.select(*B.KEY, "len", F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")).unionByName(counted(rows))


def word_counts(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """postings of the words that are in terms (a table of one column), written."""
    rows = with_words(chunks).select(*B.KEY, "len", F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("term"))
    kept = rows.join(terms.withColumn("wanted", F.lit(True)), "term", "left").where("term is null or wanted").drop("wanted")
    return settled(kept.groupBy(*B.KEY, "len", "term").agg(F.count("*").alias("tf")))


def bm25_weights(chunks: DataFrame | None, questions: DataFrame, k1: float = 1.5, b: float = 0.75, scope: str = "document", index: DataFrame | None = None) -> DataFrame:
    """document_id, chunk_id, chunk_index, weights: of each chunk's words, those that any question has."""
    per = scope_columns(scope)
    terms = small(question_terms(questions).select("term").distinct())
    if index is None:
        # one pass over the chunks; only the questions' words and a row without a term for each chunk are counted and written
        rows = word_counts(chunks, terms)
        size, held = rows.where("term is null").select("document_id", "len"), rows.where("term is not null")
    else:
        size, held = index.where("term is null").select("document_id", "len"), index.where("term is not null").join(terms, "term")
    stats = size.groupBy(*per).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    df = held.groupBy(*per, "term").agg(F.count("*").alias("df"))
    if per:
        rows = held.join(df, [*per, "term"]).join(stats, per)
    else:
        # as many rows as the questions have words, and one row
        rows = held.join(small(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avg = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    length = F.when(F.col("len") == 0, 1).otherwise(F.col("len"))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / avg))
    return rows.withColumn("w", weight).groupBy(*B.KEY).agg(F.collect_list(F.struct("term", "w")).alias("weights"))


def bm25_scores(chunks: DataFrame | None, questions: DataFrame, k: int | None = None, **settings) -> DataFrame:
    """query_id, document_id, chunk_id, chunk_index, score of every chunk that shares a word with the question; with k, a superset of the k best."""
    if k and settings.get("index") is None and settings.get("scope", "document") == "document":
        return L.best_rows(chunks, k, L.word_blocks(questions, settings.get("k1", 1.5), settings.get("b", 0.75)), [], 1).drop("side")
    blocks = [B.WeightBlock([(q, w) for q, _, w in part]) for part in B.question_blocks(questions)]
    return B.scores(bm25_weights(chunks, questions, **settings), blocks, k)


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 5, **settings) -> DataFrame:
    return as_evidence(top(bm25_scores(chunks, questions, k, **settings), k), chunks, "bm25")


# --- dense ----------------------------------------------------------------------------------------------------
def dense_vectors(rows: DataFrame, key: list[str], dimensions: int = 384) -> DataFrame:
    """Normalised hashed vectors as (key, bucket, v); rows has the key and text. Empty texts have none. [D6]"""
    words = rows.select(*key, F.explode(T.tokens("text")).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    raw = words.select(*key, V.dense_bucket(F.col("term"), dimensions).alias("bucket"), (V.dense_value(F.col("term")) * F.col("tf")).alias("v"))
    raw = raw.groupBy(*key, "bucket").agg(F.sum("v").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*key)))
    return raw.withColumn("norm", norm).where("norm > 0").select(*key, "bucket", (F.col("v") / F.col("norm")).alias("v"))


def dense_scores(items: DataFrame | None, questions: DataFrame, dimensions: int = 384, index: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """query_id, document_id, chunk_id, chunk_index, score; with k, a superset of the k best. index: rows of blocks.dense_rows."""
    blocks = L.dense_blocks(questions, dimensions)
    if k and index is None:
        return L.best_rows(items, k, [], blocks, dimensions).drop("side")
    return B.scores(B.dense_rows(items, dimensions) if index is None else index, blocks, k)


def dense(chunks: DataFrame, questions: DataFrame, k: int = 5, dimensions: int = 384, index: DataFrame | None = None) -> DataFrame:
    return as_evidence(top(dense_scores(chunks, questions, dimensions, index, k), k), chunks, "dense")


def bm25_and_dense(chunks: DataFrame, words: DataFrame, vectors: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, dimensions: int = 384) -> DataFrame:
    """The rows of bm25() in scope "document" for the questions in words and of dense() for those in vectors; one pass over the chunks finds both, one more their texts."""
    found = L.both(chunks, words, vectors, k, k1, b, dimensions)
    best = [top(rows, k).withColumn("retrieval_path", F.lit(path)) for rows, path in zip(found, ("bm25", "dense"), strict=True)]
    return as_evidence(best[0].unionByName(best[1]), chunks, None)


# --- late interaction -----------------------------------------------------------------------------------------
def token_vectors(terms: DataFrame, dimensions: int = 128) -> DataFrame:
    """term, bucket, v: once for each distinct word. [D8]"""
    entries = terms.select("term", F.inline(V.token_entries(F.col("term"), dimensions))).groupBy("term", "bucket").agg(F.sum("value").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("term")))
    return entries.withColumn("norm", norm).where("norm > 0").select("term", "bucket", (F.col("v") / F.col("norm")).alias("v"))


def late_scores(chunks: DataFrame | None, questions: DataFrame, dimensions: int = 128, most: int = 256, index: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Mean over the question's words of the best dot product with any of a chunk's first words. index: rows of blocks.late_rows. [G4]"""
    blocks = [B.LateBlock([(q, w) for q, _, w in part], dimensions) for part in B.question_blocks(questions)]
    return B.scores(B.late_rows(chunks, most) if index is None else index, blocks, k)


def late(chunks: DataFrame, questions: DataFrame, k: int = 5, dimensions: int = 128, most: int = 256, index: DataFrame | None = None) -> DataFrame:
    return as_evidence(top(late_scores(chunks, questions, dimensions, most, index, k), k), chunks, "late")


# --- fusion ---------------------------------------------------------------------------------------------------
def fuse(left: DataFrame, right: DataFrame, k: int, per: list[str], left_weight: float = 1.0, right_weight: float = 1.0) -> DataFrame:
    """Reciprocal ranks of two ranked lists, added: a union and one aggregation instead of a full outer join. [K4]"""
    one = lambda df, side, w: df.select("query_id", "document_id", "chunk_id", "chunk_index", F.lit(side).alias("side"), "rank", (F.lit(w) / (60 + F.col("rank"))).alias("part"))
    both = one(left, 0, left_weight).unionByName(one(right, 1, right_weight))
    fused = both.groupBy("query_id", "document_id", "chunk_id", "chunk_index").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.col("side") * 1_000_000 + F.col("rank")).alias("seen"))
    by = Window.partitionBy(*per).orderBy(F.desc("score"), "seen", "document_id", "chunk_index")
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hybrid(chunks: DataFrame, questions: DataFrame, k: int = 5, scope: str = "document", bm25_index: DataFrame | None = None, dense_index: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, dimensions: int = 384) -> DataFrame:
    """BM25 and dense lists of at least ten, fused inside each document, in one pass (fused.py), or over the corpus. [K5]"""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "seen", "chunk_index")
    if scope_columns(scope):
        stored = bm25_index is not None and dense_index is not None
        rows = H.stored_rows(bm25_index, dense_index, small(question_terms(questions).select("term").distinct())) if stored else H.chunk_rows(chunks)
        fused = H.fused_scores(rows, questions, k, k1, b, dimensions)
    else:
        many = max(k, 10)
        words = bm25_scores(chunks, questions, many, scope=scope, index=bm25_index, k1=k1, b=b)
        fused = fuse(ranked(words, many, ["query_id"]), ranked(dense_scores(chunks, questions, dimensions, dense_index, many), many, ["query_id"]), k, ["query_id"]).drop("rank")
    best = fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return as_evidence(best, chunks, "hybrid")


# --- pages ----------------------------------------------------------------------------------------------------
VISUAL_HINTS = ["page", "image", "figure", "diagram", "visual"]


def page_text(title: Column, text: Column, has_image: Column, source_type: Column, profile: Column) -> Column:
    """What a page's vector is made of: title, text, tags and image profile. [K7]"""
    tags = F.concat_ws(" ", F.lit("page document"), F.when(has_image, F.lit("page image visual layout scan figure diagram")), source_type)
    return F.concat_ws(" ", title, text, tags, profile)


def visual_items(pages: DataFrame) -> DataFrame:
    """Pages as items: their ids in place of a chunk's, and the text that their vector is made of."""
    return pages.select("document_id", F.col("page_id").alias("chunk_id"), F.col("number").alias("chunk_index"), "has_image", page_text(F.col("title"), F.col("text"), F.col("has_image"), F.col("source_type"), F.col("profile")).alias("text"))


def visual(pages: DataFrame, questions: DataFrame, k: int = 5, dimensions: int = 384, index: DataFrame | None = None) -> DataFrame:
    """Page retrieval; pages has document_id, page_id, number, text, title, has_image, source_type, profile. [K6]

    Evidence has the page's id in place of a chunk's. Pages with images that score over 0 are boosted for questions
    that name one. index: rows of blocks.dense_rows over visual_items, with has_image.
    """
    hinted = lambda question: any(h in question.lower() for h in VISUAL_HINTS)
    blocks = [B.DenseBlock([(q, w) for q, _, w in part], dimensions, [hinted(t) for _, t, _ in part], 0.05) for part in B.question_blocks(questions)]
    scores = L.best_rows(visual_items(pages), k, [], blocks, dimensions).drop("side") if index is None else B.scores(index, blocks, k)
    shown = pages.select(F.col("page_id").alias("chunk_id"), F.array(F.col("number").cast("int")).alias("page_numbers"), "text")
    return as_evidence(top(scores, k), shown, "visual")


def page_vectors(pages: DataFrame, asked: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """Page retrieval by model vectors. index: document_id, chunk_id, chunk_index, vectors (compressed or not) and, if it has them, centres and radii; asked: query_id, vectors. [K9]"""
    items = index.withColumn("vectors", V.maybe_dequantize(index, "vectors", rows=True))
    best, _ = M.search(items if "centres" in index.columns else M.summarised(items.select(*B.KEY, "vectors")), asked, k, ("document_id", "chunk_index", "chunk_id"))
    shown = pages.select(F.col("page_id").alias("chunk_id"), F.array(F.col("number").cast("int")).alias("page_numbers"), "text")
    return as_evidence(ranked(best, k, ["query_id"]), shown, "visual")
