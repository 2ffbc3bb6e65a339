"""Target-distribution importance resampling over hashed word features.

Features are all runs of 1 to ``longest`` consecutive words; a feature's bucket is the CRC-32 of its bytes modulo
``buckets``. The sparse matrix of documents by buckets is persisted as *CSR blocks*: a row of the written table holds the
row pointers, buckets and counts of some hundred documents, made where the documents are read, without a shuffle. Column
sums of the blocks of the corpus and of the target give the two distributions, from which every bucket has a gain; the
product of each block with the gains gives the documents' weights. Only column sums (at most ``buckets`` numbers of each
task) and then keys and scores are shuffled, never texts or counts of documents.

Perturbed by Gumbel noise that the id fixes, the weights are scores whose highest are a draw without replacement. Ranks
come from a range sort: each of its partitions counts its rows, and a rank is the place in the partition after the rows of
all before it. Nothing is sorted in one task.

Defined results: null and empty texts have no features and weight 0; a null doc_id is shown as null, hashes as an empty
string after the seed and comes before all other ids of equal score, as does -2**63; ties in score go to the smaller id,
then repeated rows in any order, each with a rank of its own; a very long text is one row of its block and is never cut;
without a target (an empty table) its distribution is the smoothing alone; an empty table of documents gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import NULL_ID, Work, id_key
from lodeseek.llm.decontamination import FOLD

#: Documents in a block, and stored counts after which a block ends with its document.
BLOCK_ROWS, BLOCK_COUNTS = 512, 400_000
#: ids, words and indptr of a block's documents; indices (uint16 or uint32) and data (uint32) of their stored counts.
CSR = "ids array<long>, words array<long>, indptr array<long>, indices binary, data binary"


def features(words: list[bytes], longest: int) -> list[int]:
    """The CRC-32 of every run of 1 to longest words, joined by one space; a longer run goes on from the shorter one's."""
    ends = list(map(crc32, words))
    out, now, spaced = list(ends), ends, [b" " + w for w in words] if longest > 1 else []
    for n in range(1, longest):
        now = list(map(crc32, spaced[n:], now))
        out += now
    return out


def counts_of(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, and the buckets (ascending) and counts of a text's features."""
    words = (text or b"").translate(FOLD).split()
    found = features(words, longest)
    hashed = np.fromiter(found, np.int64, len(found)) % buckets
    if len(hashed) > buckets:
        count = np.bincount(hashed, minlength=buckets)
        where = np.flatnonzero(count)
        return len(words), where, count[where]
    return len(words), *np.unique(hashed, return_counts=True)


class Block:
    """CSR rows, gathered until they are handed on."""

    def __init__(self, wide: bool, rows: int):
        self.kind, self.rows = np.dtype("<u4" if wide else "<u2"), rows
        self.clear()

    def clear(self) -> None:
        self.ids, self.words, self.indices, self.data, self.stored = [], [], [], [], 0

    def add(self, key: int, words: int, indices: np.ndarray, data: np.ndarray) -> None:
        self.ids.append(key)
        self.words.append(words)
        self.indices.append(indices)
        self.data.append(data)
        self.stored += len(indices)

    def full(self) -> bool:
        return len(self.ids) >= self.rows or self.stored >= BLOCK_COUNTS

    def batch(self):
        import pyarrow as pa

        indptr = np.concatenate([[0], np.cumsum([len(x) for x in self.indices])])
        bytes_ = [np.concatenate(x).astype(k).tobytes() for x, k in ((self.indices, self.kind), (self.data, np.dtype("<u4")))]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (self.ids, self.words, indptr)]
        self.clear()
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in bytes_)], names=["ids", "words", "indptr", "indices", "data"])


def csr_blocks(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """CSR blocks of all rows (__ls_k, text as bytes)."""
    most = BLOCK_ROWS

    def run(batches: Iterator) -> Iterator:
        block = Block(buckets > 1 << 16, most)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(key, *counts_of(text.as_py(), longest, buckets))
                if block.full():
                    yield block.batch()
        if block.ids:
            yield block.batch()

    return rows.mapInArrow(run, CSR)


def opened(batch, i: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices and data of row i of a batch of blocks."""
    indptr = batch.column("indptr")[i].values.to_numpy(zero_copy_only=False)
    return indptr, np.frombuffer(batch.column("indices")[i].as_buffer(), "<u4" if wide else "<u2"), np.frombuffer(batch.column("data")[i].as_buffer(), "<u4")


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """The sum of every column; one number for each bucket reaches the driver."""
    wide = buckets > 1 << 16

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                _, indices, data = opened(b, i, wide)
                np.add.at(total, indices, data.astype(np.int64))
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total[where])], names=["bucket", "n"])

    sums = blocks.select("indptr", "indices", "data").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most buckets rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold logarithm of the smoothed target share over the smoothed corpus share, for every bucket."""
    every, wanted, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float((t + 1) * (every + buckets)) / float((s + 1) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def products(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """__ls_k, n_words, n_features and weight (the floored mean of the gains) of every document: each block times the gains."""
    wide = len(gain) > 1 << 16
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                indptr, indices, data = opened(b, i, wide)
                count = data.astype(np.int64)
                # sums up to each stored count, so that empty rows need no case of their own
                n, total = (np.concatenate([[0], np.cumsum(x)])[indptr] for x in (count, shared.value[indices] * count))
                n, total = np.diff(n), np.diff(total)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("words")[i].values, pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["__ls_k", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "__ls_k long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """The floored thousandfold Gumbel number of a key."""
    text = F.concat(F.lit(f"{seed}:"), F.when(F.col("__ls_k") == NULL_ID, F.lit("")).otherwise(F.col("__ls_k").cast("string")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], work: Work) -> DataFrame:
    """rows with rank (from 1) in the given order, by a range sort; equal rows have ranks of their own."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number within the partition is in the low 33 bits
    placed = work.table(dealt.select("*", F.spark_partition_id().alias("__ls_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__ls_i")), "sorted")
    before, total = [], 0
    for p, n in sorted(placed.groupBy("__ls_p").count().collect()):  # one row for each partition
        before.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__ls_p int, __ls_o long"))
    return placed.join(offsets, "__ls_p").withColumn("rank", F.col("__ls_o") + F.col("__ls_i") + 1).drop("__ls_p", "__ls_i", "__ls_o")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) for every row of docs (doc_id, text); target: rows with text.

    Of the documents of at least least_words words, percent in a hundred (rounded down) are drawn.
    """
    work = Work(docs.sparkSession, "resample")
    blocks = work.table(csr_blocks(docs.select(id_key().alias("__ls_k"), F.col("text").cast("binary").alias("text")), longest, buckets), "blocks")
    wanted = work.table(csr_blocks(target.select(F.lit(0).cast("long").alias("__ls_k"), F.col("text").cast("binary").alias("text")), longest, buckets), "target")
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    scored = work.table(products(blocks, gain).withColumn("score", F.col("weight") + noise(seed)).withColumn("__ls_n", F.monotonically_increasing_id()), "scored")
    work.drop("blocks", "target")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    # repeated rows differ in their number, so they are dealt out like any others
    order = [F.desc("score"), F.asc("__ls_k"), F.asc("__ls_n")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = [F.nullif(F.col("__ls_k"), F.lit(NULL_ID)).alias("doc_id"), "n_features", "weight", "score"]
    placed = ranked(scored.where(enough), order, work).select(*columns, rank.alias("rank"))
    return placed.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
