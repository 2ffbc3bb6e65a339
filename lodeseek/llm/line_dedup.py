"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

A rolling hash over each line's hash and the one before it decides whether a chunk ends after the line, so boundaries
depend on the lines around them alone and come back in step after an insertion. Chunks of at least two lines whose
hash occurs more than once are compared byte by byte (they are grouped by their whole text); the first occurrence, by
(doc_id, chunk number), stays and all others are removed.

Hashes of chunks are shuffled for the count; texts of chunks once, to meet the counts of their hashes, and those of
repeated chunks once more for the comparison; texts of documents once, to meet their removed chunks.
The count and the choice of the first occurrence combine before their shuffle and are written tables, so the joins back
have two plain shuffles: merge joins, never broadcasts of a side that grows, which Spark can split where a chunk occurs
in a third of all documents.

Defined results: lines end at a line feed; a null text is an empty text of one empty line; a single-line chunk is
never removed; a null doc_id is the smallest id; rows that agree in id and text share their decisions (each of their
chunks occurs once); ties among equal chunks go to the smallest (id, text hash, chunk number); a very long text is one
row of many chunks and is never cut; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Work, keyed, packed

#: One line in so many ends a chunk.
EVERY = 3


def chunked(docs: DataFrame, every: int) -> DataFrame:
    """__ls_k, __ls_t, c (number), s (first line), n (lines), h (hash of the chunk's bytes), chunk (its bytes)."""

    def barrier(df: DataFrame, **columns) -> DataFrame:
        """New columns behind a Generate node: lambdas below then read them instead of computing them again."""
        names = list(columns)
        one = F.array(F.struct(*[columns[n].alias(n) for n in names]))
        return df.select("*", F.inline(one))

    rows = barrier(docs, lines=F.split("text", "\n"))
    # 32 bits of MD5, which other SQL engines have, too
    rows = barrier(rows, hashes=F.transform("lines", lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")))
    rolled = F.transform("hashes", lambda h, i: (h + 31 * F.coalesce(F.get("hashes", i - 1), F.lit(0))) % every == 0)
    rows = barrier(rows, ends=rolled)
    last = F.size("lines") - 1
    cuts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | F.get("ends", i))
    rows = barrier(rows, cuts=cuts)
    first = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1) + 1)
    spans = F.transform("cuts", lambda e, i: F.struct(i.alias("c"), first(i).alias("s"), (e - first(i) + 1).alias("n")))
    rows = rows.select("__ls_k", "__ls_t", "lines", F.explode(spans).alias("span")).select("__ls_k", "__ls_t", "span.*", "lines")
    text = F.array_join(F.slice("lines", F.col("s") + 1, F.col("n")), "\n")
    return rows.select("__ls_k", "__ls_t", "c", "s", "n", text.alias("chunk")).withColumn("h", F.xxhash64("chunk"))


def repeated_chunks(docs: DataFrame, every: int, work: Work) -> DataFrame:
    """Per document with any: __ls_k, __ls_t, gone (array of struct<s, n>: the removed chunks)."""
    # one row for copies of a row
    chunks = work.table(chunked(docs, every).where("n >= 2"), "chunks")
    often = work.table(chunks.groupBy("h").agg(F.count("*").alias("x")).where("x > 1").select("h"), "often")
    again = work.table(chunks.join(often.hint("merge"), "h", "left_semi"), "again")
    first = work.table(again.groupBy("h", "chunk").agg(F.min(F.struct("__ls_k", "__ls_t", "c")).alias("first")), "first")
    gone = again.join(first.hint("merge"), ["h", "chunk"]).where(F.struct("__ls_k", "__ls_t", "c") != F.col("first"))
    return gone.groupBy("__ls_k", "__ls_t").agg(F.collect_set(F.struct("s", "n")).alias("gone"))


def kept_lines(docs: DataFrame, every: int, work: Work) -> DataFrame:
    """The columns of docs (__ls_k, __ls_t, text and doc_id or row) with kept (array of lines) and n_lines."""
    gone = work.table(repeated_chunks(docs.select("__ls_k", "__ls_t", "text"), every, work), "gone")
    work.drop("chunks", "often", "again", "first")
    work.tidy()
    got = docs.join(gone.hint("merge"), ["__ls_k", "__ls_t"], "left")
    got = got.select("*", F.inline(F.array(F.struct(F.split("text", "\n").alias("lines"), F.array_sort(F.coalesce("gone", F.array().cast("array<struct<s:int,n:int>>"))).alias("out")))))
    # the runs of lines between removed chunks, which do not overlap
    begin = F.concat(F.array(F.lit(0)), F.transform("out", lambda g: g["s"] + g["n"]))
    end = F.concat(F.transform("out", lambda g: g["s"]), F.array(F.size("lines")))
    got = got.select("*", F.inline(F.array(F.struct(F.zip_with(begin, end, lambda b, e: F.struct(b.alias("b"), (e - b).alias("n"))).alias("runs")))))
    kept = F.flatten(F.transform("runs", lambda r: F.slice("lines", r["b"] + 1, r["n"])))
    kept = F.when(F.size("out") == 0, F.col("lines")).otherwise(kept)
    return got.withColumn("n_lines", F.size("lines").cast("long")).withColumn("kept", kept).drop("lines", "out", "gone", "runs")


def dedup_lines(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept_bytes for every row of docs (doc_id, text)."""
    work = Work(docs.sparkSession, "lines")
    got = kept_lines(keyed(docs), every, work)
    text = F.array_join("kept", "\n")
    return got.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), F.octet_length(text).cast("long").alias("kept_bytes"))


def with_deduped_text(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """docs with the kept lines as text (and n_chars, if there is such a column, to match); all columns stay."""
    work = Work(docs.sparkSession, "lines")
    rows = packed(docs).withColumn("text", F.coalesce("row.text", F.lit("")))
    got = kept_lines(rows, every, work).select("row", F.array_join("kept", "\n").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
