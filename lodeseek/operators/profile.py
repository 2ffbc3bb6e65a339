"""Document profiles. [G10-G12, D23, D24]"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T

TOPICS, ENTITIES = 12, 20


def page_facts(pages: DataFrame) -> DataFrame:
    image = F.col("has_image") if "has_image" in pages.columns else F.lit(False)
    return pages.select("document_id", "number", "text", image.alias("has_image"), T.page_type("text", image).alias("page_type"), F.size(T.words("text")).alias("words"), (T.squeeze_ends(F.col("text")) == "").alias("empty"))


def frequent(pages: DataFrame, pattern: str, keep, lower: bool, most: int) -> DataFrame:
    """document_id, value, n: the most frequent matches of a document, ties by first occurrence. [G11]"""
    found = T.find_all(F.col("text"), pattern)
    rows = pages.select("document_id", "number", F.posexplode(F.transform(found, F.lower) if lower else found).alias("pos", "value"))
    counts = rows.where(keep(F.col("value"))).groupBy("document_id", "value").agg(F.count("*").alias("n"), F.min(F.struct("number", "pos")).alias("first"))
    order = Window.partitionBy("document_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("document_id", "value", "n", "place")


def topics(pages: DataFrame, most: int = TOPICS) -> DataFrame:
    return frequent(pages, r"[A-Za-z][A-Za-z0-9_-]*", lambda v: (F.length(v) > 4) & ~v.isin(T.PROFILE_STOPWORDS), True, most)


def frequent_entities(pages: DataFrame, most: int = ENTITIES) -> DataFrame:
    pattern = rf"(?U)\b{T.CAPITAL}(?:[\s\x1c-\x1f]+{T.CAPITAL}){{0,3}}\b"
    return frequent(pages, pattern, lambda v: (F.length(v) >= 3) & ~F.lower(v).isin(T.PROFILE_STOPWORDS), False, most)


def inventory(pages: DataFrame) -> DataFrame:
    """document_id, kind, refs: references by kind, sorted. [G12]"""
    refs = pages.select("document_id", F.explode(T.references("text")).alias("ref")).distinct()
    return refs.groupBy("document_id", F.substring_index("ref", ":", 1).alias("kind")).agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def profiles(pages: DataFrame) -> DataFrame:
    """One row for each document with counts, page types, headings, topics, entities and references. [G10]"""
    facts = page_facts(pages)
    base = facts.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.count_if(~F.col("empty")).alias("text_page_count"), F.count_if("has_image").alias("image_page_count"), F.sum("words").alias("word_count"), F.count_if("empty").alias("empty_pages"),
    )
    kinds = facts.groupBy("document_id", "page_type").agg(F.count("*").alias("n")).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_type", "n")))).alias("page_types"))
    heads = pages.select("document_id", "number", F.posexplode(T.headings("text", 20)).alias("pos", "title")).groupBy("document_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("number", "pos", "title"))), 1, 20).alias("h"))
    heads = heads.select("document_id", F.transform("h", lambda x: x["title"]).alias("headings"))
    listed = lambda df, name: df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(name))
    held = inventory(pages).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "refs")))).alias("references"))
    out = base
    for part in (kinds, heads, listed(topics(pages), "topics"), listed(frequent_entities(pages), "entities"), held):
        out = out.join(part, "document_id", "left")
    # no source makes layout blocks, so their mean confidence is unknown
    return out.withColumn("average_block_confidence", F.lit(None).cast("double"))
