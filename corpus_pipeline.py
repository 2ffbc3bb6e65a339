"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written and read again as the next one's docs.

Defined results of every stage: a row is its id and text, so rows that share an id, or have none, are decided one by
one; null texts are empty (the stage lines returns them as empty texts) and stay unless another row is a copy; rows that
agree in id and text are one row after the stage simhash; ties go to the smallest id, then text hash; very long texts
are taken whole; further columns, whatever their names, keep their values (a row travels as one struct); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontamination, line_dedup, near_copies, packing, quality
from lodeseek.llm.common import Work, packed

#: What tells rows apart.
ROW = ["__ls_k", "__ls_t"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least 0.5)."""
    model = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("score >= 0.5").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; n_chars follows the text."""
    return line_dedup.with_deduped_text(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (operator 4 with five-word shingles, widened to a similarity of 0.8): the one with the smallest id, then text hash."""
    found = near_copies.first_of_groups(docs.select("doc_id", "text"))
    keep = found.where(F.struct("__ls_k", "__ls_t") == F.col("first")).select("__ls_k", "__ls_t")
    # merge joins at every size: what is kept or dropped grows with the documents
    kept = packed(docs).join(keep.hint("merge"), ROW, "left_semi")
    # rows that agree in id and text are copies; this costs a shuffle of texts only where there are such rows
    twice = packed(docs).groupBy(*ROW).count().where("count > 1")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(ROW)
    return kept.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # a number for each distinct row stands for its id, so that rows that share an id are told apart
    rows = packed(docs.select("doc_id", "text")).select(F.xxhash64(*ROW).alias("doc_id"), "row.text")
    drop = decontamination.decontaminate(rows, benchmark).where("contaminated").select(F.col("doc_id").alias("__ls_r")).distinct()
    return packed(docs).withColumn("__ls_r", F.xxhash64(*ROW)).join(drop.hint("merge"), "__ls_r", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are a written table in the shared folder."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            work.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
