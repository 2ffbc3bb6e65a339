"""Hybrid retrieval inside documents: both lists of a document and their fusion in one pass. [K4, K5]

Chunks are dealt out by document, once. A task reads a document's chunks in their order, scores all questions of a
block against them by BM25 with the document's own statistics and by hashed vectors, ranks both lists, adds reciprocal
ranks and keeps each question's k best of all its documents. So k rows a question leave a task, not every pair of a question and a
chunk with a common word. Documents come in the order of their ids, which also breaks ties between them; once k rows are held,
only a higher score replaces one.

Defined results: those of ``retrievers.hybrid`` in scope "document".
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import blocks as B
from lodeseek.session import ship

#: What a document is read from: its chunks' lengths, words that questions have (with numbers) and vectors; or all words.
STORED = "len long, words array<struct<term:string,tf:long>>, vector array<double>"


def stored_rows(bm25_index: DataFrame, dense_index: DataFrame, terms: DataFrame) -> DataFrame:
    """KEY and STORED of chunks that have a length and a word of terms, or a vector."""
    lengths = bm25_index.where("term is null").select(*B.KEY, F.col("len").cast("long").alias("len"))
    held = bm25_index.join(terms, "term").groupBy(*B.KEY).agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))).alias("words"))
    rows = lengths.join(held, B.KEY, "left").join(dense_index.select(*B.KEY, "vector"), B.KEY, "full")
    return rows.select(*B.KEY, "len", F.coalesce("words", F.array().cast("array<struct<term:string,tf:long>>")).alias("words"), "vector")


class Hybrid:
    """A block of questions against whole documents."""

    def __init__(self, asked: list[tuple[str, list[str]]], k: int, k1: float, b: float, dimensions: int):
        words = B.Block(asked)
        self.ids, self.terms, self.times = words.ids, words.terms, words.times
        self.k, self.many, self.k1, self.b, self.dimensions = k, max(k, 10), k1, b, dimensions
        self.vectors = B.DenseBlock(asked, dimensions).vectors

    def start(self) -> None:
        self.hashes = B.Hashes(self.dimensions)
        self.held = [[] for _ in self.ids]
        self.floor = np.zeros(len(self.ids))

    def weights(self, counts: list[dict[str, int]], lengths: list[int]) -> np.ndarray:
        """BM25 weights of chunks (rows) for terms (columns), by their document's statistics; 0 where a chunk has no such term."""
        tf = np.zeros((len(counts), len(self.terms)))
        for i, c in enumerate(counts):
            for t, n in c.items():
                tf[i, self.terms[t]] = n
        size, known = np.array(lengths, np.float64), len(lengths)
        average = size.mean() or 1.0
        df = (tf > 0).sum(axis=0)
        idf = np.log(1 + (known - df + 0.5) / (df + 0.5))
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * np.where(size == 0, 1, size)[:, None] / average))

    def ranks(self, scores: np.ndarray) -> np.ndarray:
        """The place of each chunk in each question's list, from 1; 0 beyond the list."""
        order = np.argsort(-scores, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(1, len(scores) + 1)[:, None], axis=0)
        return np.where((scores > 0) & (place <= self.many), place, 0)

    def document(self, document, chunks: list[tuple], counts: list[dict[str, int]], lengths: list[int | None], vectors: np.ndarray) -> None:
        """Takes in one document; chunks: (chunk_index, chunk_id) in order. A chunk without a length has no place in the BM25 index."""
        there = [i for i, n in enumerate(lengths) if n is not None]
        words = np.zeros((len(chunks), len(self.ids)))
        if there and self.terms:
            words[there] = np.round(self.weights([counts[i] for i in there], [lengths[i] for i in there]) @ self.times, 9)
        first, second = self.ranks(words), self.ranks(np.round(vectors @ self.vectors, 9))
        score = np.round(np.where(first > 0, 1.0 / (60 + first), 0.0) + np.where(second > 0, 1.0 / (60 + second), 0.0), 9)
        seen = np.where(first > 0, first, 1_000_000 + second)
        rows, questions = np.nonzero(score > self.floor)
        found: dict[int, list[tuple]] = {}
        for i, q in zip(rows.tolist(), questions.tolist(), strict=True):
            found.setdefault(q, []).append((-float(score[i, q]), int(seen[i, q]), *chunks[i]))
        for q, mine in found.items():
            # a document gives its k best in the order of its fused list
            best = [(s, document, x, index, chunk) for s, x, index, chunk in sorted(mine)[: self.k]]
            self.held[q] = sorted([*self.held[q], *best])[: self.k]
            if len(self.held[q]) == self.k:
                self.floor[q] = -self.held[q][-1][0]


def fused_scores(rows: DataFrame, questions: DataFrame, k: int, k1: float, b: float, dimensions: int) -> DataFrame:
    """query_id, KEY, score, seen: each task's k best of every question. rows: KEY and tokens (array of string), or KEY and STORED."""
    spark = rows.sparkSession
    ship(spark)
    plain = "tokens" in rows.columns
    dealt = rows.repartition("document_id").sortWithinPartitions("document_id", "chunk_index", "chunk_id")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "query_id string, " + ", ".join(f"{c} {types[c]}" for c in B.KEY) + ", score double, seen long"
    out = None
    for part in B.question_blocks(questions):
        shared = spark.sparkContext.broadcast(Hybrid([(q, w) for q, _, w in part], k, k1, b, dimensions))

        def scan(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            asked, last, chunks, counts, lengths, vectors, kinds = shared.value, None, [], [], [], [], None
            asked.start()
            nothing = np.zeros(asked.dimensions)
            for batch in batches:
                kinds = [pa.string(), *(batch.schema.field(n).type for n in B.KEY), pa.float64(), pa.int64()]
                for row in batch.to_pylist():
                    if row["document_id"] != last:
                        if chunks:
                            asked.document(last, chunks, counts, lengths, np.array(vectors))
                        last, chunks, counts, lengths, vectors = row["document_id"], [], [], [], []
                    chunks.append((row["chunk_index"], row["chunk_id"]))
                    if plain:
                        words = row["tokens"] or []
                        counts.append(Counter(w for w in words if w in asked.terms))
                        lengths.append(len(words))
                        vectors.append(asked.hashes.vector(words))
                    else:
                        counts.append({x["term"]: x["tf"] for x in row["words"] if x["term"] in asked.terms})
                        lengths.append(row["len"])
                        vectors.append(nothing if row["vector"] is None else np.array(row["vector"]))
            if chunks:
                asked.document(last, chunks, counts, lengths, np.array(vectors))
            if kinds:
                got = [(asked.ids[q], document, chunk, index, -s, seen) for q, held in enumerate(asked.held) for s, document, seen, index, chunk in held]
                columns = list(zip(*got, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", *B.KEY, "score", "seen"])

        one = dealt.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(*B.KEY, T.tokens("text").alias("tokens"))
