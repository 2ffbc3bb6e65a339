"""Rows against blocks of questions: the inner loops of the retrievers, in Arrow batches.

A block of at most ``BLOCK`` questions becomes a few matrices, which are broadcast; every task multiplies the rows it
reads with them and keeps each question's k best rows so far, so what leaves a task is k rows a question, however many
rows it read. More questions are more blocks; no join ever pairs words of rows with words of questions.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.session import ship

#: Questions in a block; rows that are multiplied at a time; words whose hashes a task remembers.
BLOCK, SLICE, REMEMBERED = 256, 512, 200_000
KEY = ["document_id", "chunk_id", "chunk_index"]


def digits(word: str) -> str:
    return hashlib.sha1(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


class Hashes:
    """Per word: dense bucket and signed weight, or the three signed buckets of its own vector. Forgets all at a limit."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def dense(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        out = []
        for w in words:
            one = self.known.get(w)
            if one is None:
                h = digits(w)
                weight = 0.75 + int(h[:2], 16) / 255.0
                one = self.known[w] = (int(h[:8], 16) % self.dimensions, weight if int(h[8:10], 16) % 2 == 0 else -weight)
            out.append(one)
        return np.array([b for b, _ in out], np.int64), np.array([v for _, v in out], np.float64)

    def vector(self, words: list[str]) -> np.ndarray:
        """The normalised vector of a text; zeros for a text without words."""
        if not words:
            return np.zeros(self.dimensions)
        v = np.bincount(*self.dense(words), minlength=self.dimensions)
        norm = math.sqrt(float(v @ v))
        return v / norm if norm > 0 else v


def own_vector(word: str, dimensions: int) -> dict[int, int]:
    """Signed counts of the word's three buckets; their squares sum to 1, 3, 5 or 9."""
    h, out = digits(word), {}
    for at in (0, 8, 16):
        b = int(h[at : at + 8], 16) % dimensions
        out[b] = out.get(b, 0) + (1 if int(h[at : at + 2], 16) % 2 == 0 else -1)
    return out


class Block:
    """Questions as matrices. matrix(batch) scores the rows of a batch: one row each, one column a question."""

    slice = SLICE

    def __init__(self, asked: list[tuple[str, list[str]]]):
        self.ids = [q for q, _ in asked]
        self.terms: dict[str, int] = {}
        for _, words in asked:
            for w in words:
                self.terms.setdefault(w, len(self.terms))
        self.times = np.zeros((len(self.terms), len(asked)))
        for i, (_, words) in enumerate(asked):
            for w, m in Counter(words).items():
                self.times[self.terms[w], i] = m

    def start(self) -> None:
        """Called once in each task."""

    def matrix(self, batch) -> np.ndarray:
        raise NotImplementedError


class WeightBlock(Block):
    """Rows with weights: array of struct<term, w>; the score is the sum of weights times the term's number in the question."""

    def matrix(self, batch) -> np.ndarray:
        column = batch.column("weights")
        flat = column.flatten()
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        get = self.terms.get
        at = np.array([get(t, -1) for t in flat.field(0).to_pylist()], np.int64)
        a = np.zeros((len(column), len(self.terms)))
        ok = at >= 0
        a[row[ok], at[ok]] = flat.field(1).to_numpy(zero_copy_only=False)[ok]
        return a @ self.times


class DenseBlock(Block):
    """Rows with a vector; with image (boolean), questions that name one of hints score pages with images higher."""

    def __init__(self, asked: list[tuple[str, list[str]]], dimensions: int, hinted: list[bool] | None = None, boost: float = 0.0):
        super().__init__(asked)
        hashes = Hashes(dimensions)
        self.vectors = np.array([hashes.vector(words) for _, words in asked]).T.reshape(dimensions, -1)
        self.hinted, self.boost, self.times = None if hinted is None else np.array(hinted), boost, None

    def matrix(self, batch) -> np.ndarray:
        v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return self.products(v, batch.column("has_image") if self.hinted is not None else None)

    def products(self, v: np.ndarray, has_image) -> np.ndarray:
        """Scores of rows by their vectors; has_image: an Arrow column of booleans, for questions with hints."""
        s = np.round(v @ self.vectors, 9)
        if self.hinted is not None:
            image = has_image.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            s[(s > 0) & image[:, None] & self.hinted] += self.boost
        return s


#: Products of two words' own vectors are d / sqrt(a * b): d from -9 to 9, a and b among these.
SQUARES = (1, 3, 5, 9)
PRODUCTS = np.unique([round(d / math.sqrt(a * b), 15) for d in range(-9, 10) for a in SQUARES for b in SQUARES])


class LateBlock(Block):
    """Rows with terms (distinct words); the mean over a question's words of the best product with any of the terms.

    A product has few possible values, so it is kept as its rank among them, one byte.
    """

    slice = 128

    def __init__(self, asked: list[tuple[str, list[str]]], dimensions: int):
        super().__init__(asked)
        self.dimensions = dimensions
        self.table = np.zeros((dimensions + 1, len(self.terms)), np.int8)
        kinds = np.zeros(len(self.terms), np.int64)
        for w, i in self.terms.items():
            v = own_vector(w, dimensions)
            for b, n in v.items():
                self.table[b, i] = n
            kinds[i] = SQUARES.index(sum(n * n for n in v.values()))
        # rank of d / sqrt(a * b), by the kind of a: place kind of b * 19 + d + 9
        self.ranks = np.array([[np.abs(PRODUCTS - d / math.sqrt(a * b)).argmin() for b in SQUARES for d in range(-9, 10)] for a in SQUARES], np.uint8)
        self.offsets = (kinds * 19 + 9).astype(np.int16)
        self.times = self.times / np.maximum(self.times.sum(axis=0), 1)

    def start(self) -> None:
        # a row of products for each remembered word; about 64 MB at most
        self.most = max(1_000, (64 << 20) // max(1, len(self.terms)))
        self.known, self.rows = {}, np.zeros((0, len(self.terms)), np.uint8)

    def products(self, words: list[str]) -> np.ndarray:
        buckets, signs, kind = np.full((len(words), 3), self.dimensions), np.zeros((len(words), 3), np.int8), np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            v = own_vector(w, self.dimensions)
            for j, (b, n) in enumerate(v.items()):
                buckets[i, j], signs[i, j] = b, n
            kind[i] = SQUARES.index(sum(n * n for n in v.values()))
        out = np.empty((len(words), len(self.terms)), np.uint8)
        for at in range(0, len(words), 256):
            b, s = buckets[at : at + 256], signs[at : at + 256]
            d = sum(self.table[b[:, j]] * s[:, j, None] for j in range(3))
            places = d + self.offsets
            for k in np.unique(kind[at : at + 256]):
                mine = np.flatnonzero(kind[at : at + 256] == k)
                out[at + mine] = self.ranks[k][places[mine]]
        return out

    def matrix(self, batch) -> np.ndarray:
        column = batch.column("terms")
        offsets = column.offsets.to_numpy()
        offsets = offsets - offsets[0]
        words = column.flatten().to_pylist()
        if len(self.known) > self.most:
            self.start()
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            self.known.update({w: i for i, w in enumerate(new, len(self.known))})
            if len(self.known) > len(self.rows):
                room = np.empty((max(len(self.known), min(2 * len(self.rows), self.most)), len(self.terms)), np.uint8)
                room[: len(self.rows)] = self.rows
                self.rows = room
            self.rows[len(self.known) - len(new) : len(self.known)] = self.products(new)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        best = np.zeros((batch.num_rows, len(self.terms)))
        for i in range(batch.num_rows):
            if offsets[i + 1] > offsets[i]:
                best[i] = PRODUCTS[self.rows[ids[offsets[i] : offsets[i + 1]]].max(axis=0)]
        return best @ self.times


class Best:
    """The k best rows of each question so far: by score, then document_id, chunk_index, chunk_id."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        #: What a row has to reach, by question: more than nothing, or the k-th score.
        self.floor = np.full(n, np.nextafter(0.0, 1.0))

    def add(self, scores: np.ndarray, keys: list[tuple]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        s = scores[order]  # ties are now in the order of the keys
        many = len(order) > self.k
        least = -np.partition(-s, self.k - 1, axis=0)[self.k - 1] if many else None
        for q in range(s.shape[1]):
            column, held = s[:, q], self.rows[q]
            floor = max(0.0, least[q] if many else 0.0, -held[-1][0] if len(held) == self.k else 0.0)
            at = np.flatnonzero((column >= floor) & (column > 0))
            if len(at) > self.k:
                at = at[np.argsort(-column[at], kind="stable")[: self.k]]
            if len(at):
                self.rows[q] = sorted([*held, *((-float(column[i]), *keys[order[i]]) for i in at.tolist())])[: self.k]
                if len(self.rows[q]) == self.k:
                    self.floor[q] = -self.rows[q][-1][0]


def question_blocks(questions: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[str, str, list[str]]]]:
    """(query_id, question, words) of the questions, at most about size at a time."""
    rows = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"), T.tokens(F.coalesce("question", F.lit(""))).alias("words"))
    part = []
    for r in rows.toLocalIterator():
        part.append((r["query_id"], r["question"], r["words"]))
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def scores(rows: DataFrame, blocks: list[Block], k: int | None) -> DataFrame:
    """query_id, document_id, chunk_id, chunk_index, score: each question's k best rows of every task, or all rows over 0."""
    spark = rows.sparkSession
    ship(spark)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"query_id string, document_id {types['document_id']}, chunk_id {types['chunk_id']}, chunk_index {types['chunk_index']}, score double"
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            block = shared.value
            block.start()
            best = Best(len(block.ids), k) if k else None
            kinds = None
            for b in batches:
                kinds = [pa.string(), *(b.schema.field(n).type for n in KEY), pa.float64()]
                for s in range(0, b.num_rows, block.slice):
                    part = b.slice(s, block.slice)
                    found = np.round(block.matrix(part), 9)
                    if best:
                        document, chunk, index = (part.column(n).to_pylist() for n in KEY)
                        best.add(found, list(zip(document, index, chunk, strict=True)))
                        continue
                    row, q = np.nonzero(found > 0)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.string()).take(pa.array(q)), *(part.column(n).take(at) for n in KEY), pa.array(found[row, q])], names=["query_id", *KEY, "score"])
            if best and kinds:
                got = [(block.ids[q], document, chunk, index, -s) for q, rows_ in enumerate(best.rows) for s, document, index, chunk in rows_]
                columns = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", *KEY, "score"])

        one = rows.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def dense_rows(items: DataFrame, dimensions: int, more: tuple[str, ...] = ()) -> DataFrame:
    """document_id, chunk_id, chunk_index, vector and more of items with a text; texts without words are left out."""
    ship(items.sparkSession)
    rows = items.select(*KEY, *more, T.tokens("text").alias("words")).where(F.size("words") > 0)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = Hashes(dimensions)
        for b in batches:
            words = b.column("words")
            offsets = words.offsets.to_numpy() - words.offsets.to_numpy()[0] if len(words) else np.zeros(1, np.int64)
            flat = words.flatten().to_pylist()
            for s in range(0, b.num_rows, SLICE):
                part = b.slice(s, SLICE)
                v = np.array([hashes.vector(flat[offsets[i] : offsets[i + 1]]) for i in range(s, s + part.num_rows)])
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * dimensions
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in (*KEY, *more)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], names=[*KEY, *more, "vector"])

    return rows.mapInArrow(scan, ", ".join(f"{n} {fields[n]}" for n in (*KEY, *more)) + ", vector array<double>")


def late_rows(items: DataFrame, most: int) -> DataFrame:
    """document_id, chunk_id, chunk_index, terms: the distinct words among a text's first most words; texts without words are left out."""
    return items.select(*KEY, F.array_distinct(F.slice(T.tokens("text"), 1, most)).alias("terms")).where(F.size("terms") > 0)
