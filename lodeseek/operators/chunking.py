"""Page-aware chunks. [C1-C3]

Pages are (document_id, number, page_id, text). Everything up to a page's chunks is a projection; the one shuffle
brings the pages of a document together for its running chunk index, and everything that later goes by document
finds its rows placed that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T

CHUNK_COLUMNS = ["chunk_id", "document_id", "page_numbers", "text", "chunk_index", "parent_section", "word_start", "word_end", "source_page_id"]


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns behind a Generate node: lambdas that use them read them instead of computing them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def segments(pages: DataFrame) -> DataFrame:
    """document_id, number, page_id, segment, section, words: the parts of each page between markdown headings."""
    heading = r"(?U)^(#{1,6})\s+(.+)$"
    # most lines have no sign of a heading, and are not looked at further
    titled = lambda line: F.contains(line, F.lit("#")) & T.squeeze_ends(line).rlike(heading)
    rows = barrier(pages.where(T.has_words("text")).select("document_id", "number", "page_id", "text"), lines=T.lines("text"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: titled(F.get("lines", i)))
    rows = barrier(rows.drop("text"), cuts=F.array_distinct(F.concat(F.array(F.lit(0)), starts)))
    part = F.transform("cuts", lambda s, i: F.struct(i.alias("segment"), s.alias("s"), (F.coalesce(F.get("cuts", i + 1), F.size("lines")) - s).alias("n")))
    rows = rows.select("document_id", "number", "page_id", "lines", F.inline(part))
    first = F.get("lines", F.col("s"))
    section = F.when(titled(first), T.squeeze_ends(F.regexp_extract(T.squeeze_ends(first), heading, 2)))
    body = F.array_join(F.slice("lines", F.col("s") + 1, F.col("n")), "\n")
    rows = barrier(rows, section=section, words=T.words(body))
    return rows.select("document_id", "number", "page_id", "segment", "section", "words").where(F.size("words") > 0)


def chunk_pages(pages: DataFrame, max_words: int = 220, overlap_words: int = 40) -> DataFrame:
    """Chunks of at most max_words words that never cross a page or a heading. max_words 0 is the default."""
    max_words = max_words or 220
    step = max(max_words - overlap_words, 1)
    n = F.size("words")
    last = F.when(n <= max_words, 0).otherwise(F.ceil((n - max_words) / step)).cast("int")
    rows = segments(pages).select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start, end = F.col("k") * step, F.least(F.col("k") * step + max_words, n)
    rows = rows.select("document_id", "number", "page_id", "segment", "section", "k", start.alias("word_start"), end.alias("word_end"), F.array_join(F.slice("words", start + 1, end - start), " ").alias("text"))
    order = Window.partitionBy("document_id").orderBy("number", "segment", "k")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    return rows.select(
        F.concat("document_id", F.lit(":chunk:"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", F.array(F.col("number").cast("int")).alias("page_numbers"), "text", "chunk_index",
        F.col("section").alias("parent_section"), "word_start", "word_end", F.col("page_id").alias("source_page_id"),
    )
