"""The k best rows by BM25 inside documents and by hashed vectors, in one pass over texts. [K1, K2, K6]

A task reads texts once. Their words are found in the bytes of an Arrow batch, all at a time, and each distinct word of a
batch is looked up once; counts, statistics and vectors are array operations over the words' numbers. For BM25 the
chunks of a document lie together, as cutting pages into chunks leaves them, so a document's statistics are made where
its chunks are read. No row for a word and no vector leaves a task, only k rows a question, however many it read.

Defined results: those of ``retrievers.bm25_weights`` in scope "document" and of ``blocks.dense_rows``, multiplied with the questions.
Rows without a document's id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators import blocks as B
from lodeseek.session import settled, ship

BM25, DENSE = "bm25", "dense"
#: Bytes of text that are looked at together where documents need not be whole; a longer text is taken alone.
TEXT = 8 << 20
#: For each byte: itself in lower case if it is part of a word, or 0.
LETTERS = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    LETTERS[_c] = LETTERS[ord(chr(_c).upper())] = _c


def byte_words(column) -> tuple:
    """The words of an Arrow string column as text.tokens finds them, one string array, and their number in each row."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low = LETTERS[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and data.size else np.zeros(0, np.uint8)
    at -= at[0]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[at < len(low)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    place = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside))
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(low[inside])])
    return flat, np.diff(np.searchsorted(starts, at))


def runs(column) -> np.ndarray:
    """For each row the number of changes in a column before it."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])


def whole(batches: Iterator, by: str = "document_id") -> Iterator:
    """The rows of batches, in the order of their documents (or another column), again, but none ends inside a document."""
    import pyarrow as pa

    held = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and held[-1].column(by)[-1] != b.column(by)[0]:
            yield pa.Table.from_batches(held)
            held = []
        number = runs(b.column(by))
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterator, most: int) -> Iterator:
    """The rows of batches again, cut so that texts have at most so many bytes together, or are one row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield pa.Table.from_batches([b.slice(start, end - start)])
            start = end


class Words(B.Block):
    """Questions by BM25 with the statistics of each document."""

    def __init__(self, asked: list[tuple[str, list[str]]], k1: float, b: float):
        super().__init__(asked)
        self.k1, self.b = k1, b

    def weights(self, words: list[str], code: np.ndarray, row: np.ndarray, length: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of each term in each row, by rows; code and row of all words; length and document of all rows."""
        many = max(1, len(self.terms))
        known = np.array([self.terms.get(w, -1) for w in words], np.int64)
        term = known[code] if len(words) else np.zeros(0, np.int64)
        place, tf = np.unique(row[term >= 0] * many + term[term >= 0], return_counts=True)
        at, term = np.divmod(place, many)
        _, of, df = np.unique(document[at] * many + term, return_inverse=True, return_counts=True)
        chunks = np.bincount(document).astype(np.float64)
        average = np.bincount(document, weights=length) / np.maximum(chunks, 1)
        average[average == 0] = 1.0
        n, df = chunks[document[at]], df[of]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.maximum(length[at], 1) / average[document[at]]
        return at, term, idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size))

    def multiplied(self, at: np.ndarray, term: np.ndarray, w: np.ndarray, start: int, end: int) -> np.ndarray:
        """Scores of the rows from start to end."""
        lo, hi = np.searchsorted(at, [start, end])
        used, column = np.unique(term[lo:hi], return_inverse=True)
        a = np.zeros((end - start, len(used)))
        a[at[lo:hi] - start, column] = w[lo:hi]
        return a @ self.times[used]


def vectors(bucket: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int, dimensions: int) -> np.ndarray:
    """The normalised vector of each row; bucket, value and row of all words."""
    v = np.bincount(row * dimensions + bucket, weights=value, minlength=rows * dimensions).astype(np.float64, copy=False).reshape(rows, dimensions)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def best_rows(items: DataFrame, k: int, words: list[Words], dense: list[B.DenseBlock], dimensions: int) -> DataFrame:
    """side, query_id, KEY, score: each task's k best of every question of the blocks. items: KEY, text and, for dense blocks with hints, has_image."""
    spark = items.sparkSession
    ship(spark)
    rows = items.select(*B.KEY, "text", *(["has_image"] if "has_image" in items.columns else [])).where("document_id is not null")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "side string, query_id string, " + ", ".join(f"{c} {types[c]}" for c in B.KEY) + ", score double"
    dealt = rows.repartition("document_id").sortWithinPartitions("document_id") if words else rows
    out = None
    for one, two in zip_longest(words, dense):
        shared = spark.sparkContext.broadcast((one, two))

        def scan(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            one, two = shared.value
            asked = [(side, block, B.Best(len(block.ids), k)) for side, block in ((BM25, one), (DENSE, two)) if block is not None]
            hashes, kinds = B.Hashes(dimensions), None
            tables = whole(batches) if one is not None else pieces(batches, TEXT)
            for t in tables:
                t = t.combine_chunks()
                kinds = [pa.string(), pa.string(), *(t.schema.field(n).type for n in B.KEY), pa.float64()]
                flat, length = byte_words(t.column("text").chunk(0))
                coded = flat.dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                row = np.repeat(np.arange(t.num_rows), length)
                if one is not None:
                    weights = one.weights(names, code, row, length, runs(t.column("document_id").chunk(0)))
                if two is not None:
                    bucket, value = hashes.dense(names)
                    ends = np.concatenate([[0], np.cumsum(length)])
                for s in range(0, t.num_rows, B.SLICE):
                    e = min(s + B.SLICE, t.num_rows)
                    keys = None
                    for side, block, best in asked:
                        if side == BM25:
                            found = block.multiplied(*weights, s, e)
                        else:
                            own = slice(ends[s], ends[e])
                            image = t.column("has_image").slice(s, e - s).combine_chunks() if block.hinted is not None else None
                            found = block.products(vectors(bucket[code[own]], value[code[own]], row[own] - s, e - s, dimensions), image)
                        found = np.round(found, 9)
                        if not (found >= best.floor).any():
                            continue
                        if keys is None:
                            document, chunk, index = (t.column(n).slice(s, e - s).to_pylist() for n in B.KEY)
                            keys = list(zip(document, index, chunk, strict=True))
                        best.add(found, keys)
            if kinds:
                got = [(side, block.ids[q], document, chunk, index, -s) for side, block, best in asked for q, held in enumerate(best.rows) for s, document, index, chunk in held]
                columns = list(zip(*got, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["side", "query_id", *B.KEY, "score"])

        part = dealt.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def document_terms(chunks: DataFrame) -> DataFrame:
    """document_id, term, df: the number of a document's chunks with each of its words, made where the document lies. [G2]"""
    ship(chunks.sparkSession)
    rows = chunks.select("document_id", "text").repartition("document_id").sortWithinPartitions("document_id")
    kind = rows.schema["document_id"].dataType.simpleString()

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in whole(batches):
            t = t.combine_chunks()
            ids = t.column("document_id").chunk(0)
            flat, length = byte_words(t.column("text").chunk(0))
            coded = flat.dictionary_encode()
            many = max(1, len(coded.dictionary))
            row, word = np.divmod(np.unique(np.repeat(np.arange(t.num_rows), length) * many + coded.indices.to_numpy()), many)
            number = runs(ids)
            place, df = np.unique(number[row] * many + word, return_counts=True)
            document, word = np.divmod(place, many)
            first = np.searchsorted(number, document)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), coded.dictionary.cast(pa.string()).take(pa.array(word)), pa.array(df.astype(np.int64))], names=["document_id", "term", "df"])

    return rows.mapInArrow(scan, f"document_id {kind}, term string, df long")


def both(items: DataFrame, words: DataFrame, dense: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, dimensions: int = 384) -> tuple[DataFrame, DataFrame]:
    """Two tables of query_id, KEY, score: supersets of the k best by BM25 for the questions in words, and by vectors for those in dense; written by one pass."""
    got = settled(best_rows(items, k, word_blocks(words, k1, b), dense_blocks(dense, dimensions), dimensions))
    return tuple(got.where(F.col("side") == side).drop("side") for side in (BM25, DENSE))


def word_blocks(questions: DataFrame, k1: float, b: float) -> list[Words]:
    return [Words([(q, w) for q, _, w in part], k1, b) for part in B.question_blocks(questions)]


def dense_blocks(questions: DataFrame, dimensions: int) -> list[B.DenseBlock]:
    return [B.DenseBlock([(q, w) for q, _, w in part], dimensions) for part in B.question_blocks(questions)]
