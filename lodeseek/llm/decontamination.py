"""Benchmark decontamination with a stored, distributed positional inverted index.

The documents' words become *postings*: (term, segment, n, places), one row for each term of a segment, with the
places of all its occurrences as packed differences. A segment is the documents that one task read until they had
``SEGMENT_WORDS`` words; a document lies in one segment. Postings are a written table, dealt out by term; the rows
of a frequent term are dealt out by (term, segment), so no task holds all of a common word. Every word of every
document is indexed, whatever the benchmark holds, and one index answers any number of benchmarks.

A search joins the postings with a block of the benchmark's terms, whose frequencies over the whole corpus say which
are rare. The postings found meet again by segment, and there the lists of a phrase, shifted by the terms' places in
it, are intersected from the globally rarest term on. Proximity works on the same lists: an item is *near* in a
document if some ``2 * n`` consecutive words there hold all its distinct words (n: the words of the item).
The items come in blocks of at most ``BLOCK_WORDS`` words (or one longer item); a block's terms and phrases are what
is broadcast. Each block reads the index, not the corpus; hits of all blocks are united in the same way, however many
there are, so the number of blocks never changes a result.

Defined results: null or empty texts have no words and no hits; items without words match nothing; items shorter
than a window are one window; each row of the benchmark counts for itself, also when rows share an item_id or a text;
repeated documents each give a row, as do rows that share an id; null ids stay null (a null item_id is left out of
the list of items, not of their number); a very long text is one document of one segment, however long, and is never
cut; further columns, whatever their names, are ignored; an empty table of documents gives an empty result, an empty
benchmark no hits. There is no order among hits, so ties do not arise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import Work

#: A-Z in lower case, every ASCII character but letters and digits as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Words of items in a block; a block is broadcast.
BLOCK_WORDS = 400_000
#: Words after which a segment ends with its document.
SEGMENT_WORDS = 2_000_000
#: A term with more places in a segment is dealt out by segment, too.
FREQUENT = 1_000
#: Kinds of rows that indexing yields.
POSTING, DOCUMENT, LAYOUT = 0, 1, 2
#: Of a document: the places of its hit words, and the ids and the number of the items that occur or are near in it.
HITS = "segment long, number int, at array<int>, items array<string>, n_items long, near array<string>, n_near long"


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(FOLD).split()


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2**35 as bytes of seven bits, the highest bit set where another byte follows; and their ends."""
    size = 1 + sum((numbers >= 1 << 7 * j).astype(np.int64) for j in range(1, 5))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(5):
        has = size > j
        out[(ends - size)[has] + j] = (numbers[has] >> 7 * j & 127) | ((size[has] > j + 1) << 7)
    return out, ends


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, begins)


class Numbers(dict):
    """A number for each word, in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def raw_rows(docs: DataFrame, segment_words: int) -> DataFrame:
    """kind, term, segment, n, data, number, doc_id: postings, documents and the lengths of each segment's documents."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["kind", "term", "segment", "n", "data", "number", "doc_id"]
        segment = TaskContext.get().partitionId() << 32
        numbers, ids, keys, total = Numbers(), [], [], 0

        def spans(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            """Pieces of bytes as a binary column."""
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])

        def flush() -> Iterator:
            lengths = np.array([len(x) for x in ids], np.int64)
            m, nothing = len(keys), pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, DOCUMENT, np.int32)), nothing, pa.array(np.full(m, segment)), pa.array(lengths), nothing, pa.array(np.arange(m, dtype=np.int32)), pa.array(keys, pa.int64())], names=names)
            layout = packed(lengths)[0].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([LAYOUT], pa.int32()), pa.nulls(1, pa.binary()), pa.array([segment], pa.int64()), pa.array([m], pa.int64()), pa.array([layout], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names=names)
            at = np.repeat(starts_of(lengths) - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            if not len(at):
                return
            flat = np.concatenate(ids)
            order = np.argsort(flat, kind="stable")
            count = np.bincount(flat, minlength=len(numbers))
            ends = np.cumsum(count)
            places = at[order]
            steps = np.diff(places, prepend=0)
            steps[ends[:-1]] = places[ends[:-1]]
            data, byte_ends = packed(steps)
            term_ends = byte_ends[ends - 1]
            terms = list(numbers)
            for a in range(0, len(terms), 50_000):
                z = min(a + 50_000, len(terms))
                first = int(term_ends[a - 1]) if a else 0
                cut = spans(data[first : int(term_ends[z - 1])], term_ends[a:z] - first)
                k = z - a
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, POSTING, np.int32)), pa.array(terms[a:z], pa.binary()), pa.array(np.full(k, segment)), pa.array(count[a:z].astype(np.int64)), cut, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_buffer().to_pybytes())
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                keys.append(key)
                total += len(words) + 1
                if total >= segment_words:
                    yield from flush()
                    numbers, ids, keys, total, segment = Numbers(), [], [], 0, segment + 1
        if keys:
            yield from flush()

    return docs.mapInArrow(scan, "kind int, term binary, segment long, n long, data binary, number int, doc_id long")


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Places of the documents' first words in their segment; one free place follows each document."""
    return np.cumsum(lengths + 1) - (lengths + 1)


class PositionalIndex:
    """The written tables of one corpus below a folder: postings, documents and layouts."""

    def __init__(self, work: Work):
        self.work = work

    @staticmethod
    def build(docs: DataFrame, work: Work, segment_words: int = SEGMENT_WORDS) -> PositionalIndex:
        """Indexes every row of docs (doc_id, text)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
        # written first: a segment's number must stand for the same documents wherever it is read
        raw = work.table(raw_rows(rows, segment_words), "raw")
        work.table(raw.where(F.col("kind") == DOCUMENT).select("segment", "number", "doc_id", F.col("n").alias("n_words")), "documents")
        work.table(raw.where(F.col("kind") == LAYOUT).select("segment", "data"), "layouts")
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.when(F.col("n") > FREQUENT, F.col("segment")).otherwise(F.lit(0))
        postings = raw.where(F.col("kind") == POSTING).select("term", "segment", "n", F.col("data").alias("places"))
        work.table(postings.repartition(parts, "term", salt).sortWithinPartitions("term", "segment"), "postings")
        work.drop("raw")
        work.tidy()
        return PositionalIndex(work)

    def table(self, name: str) -> DataFrame:
        return self.work.read(name)

    def drop(self) -> None:
        self.work.drop("postings", "layouts")
        self.work.tidy()

    def search(self, items: list[tuple[object, list[bytes]]], size: int) -> DataFrame:
        """HITS of the documents where items of one block occur or are near."""
        import pyarrow as pa

        spark: SparkSession = self.work.spark
        phrases = Phrases(items, size)
        # bounded by the words of a block
        terms = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(list(phrases.terms), pa.binary()), "id": pa.array(range(len(phrases.terms)), pa.int32())})))
        found = self.table("postings").join(terms, "term")
        frequency = np.zeros(len(phrases.terms), np.int64)
        for row in found.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row for each term of the block
            frequency[row["id"]] = row["n"]
        phrases.arrange(frequency)
        shared = spark.sparkContext.broadcast(phrases)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        there = found.select("segment", "id", "places").unionByName(self.table("layouts").select("segment", F.lit(-1).alias("id"), F.col("data").alias("places")))
        dealt = there.repartition(parts, "segment").sortWithinPartitions("segment", "id")

        def look(batches: Iterator) -> Iterator:
            import pyarrow as pa

            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.int64()]
            names = ["segment", "number", "at", "items", "n_items", "near", "n_near"]

            def run(segment: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
                out = [(segment, *row) for row in shared.value.hits(Postings(held, len(shared.value.terms)))]
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

            last, held = None, {}
            for b in batches:
                for s, i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if s != last and held:
                        yield run(last, held)
                        held = {}
                    last = s
                    held[i] = unpacked(data.as_buffer().to_pybytes())
            if held:
                yield run(last, held)

        return dealt.mapInArrow(look, HITS)


class Postings:
    """The lists of one segment as one sorted array, term after term."""

    def __init__(self, held: dict[int, np.ndarray], n_terms: int):
        self.lengths = held.pop(-1)
        self.starts = starts_of(self.lengths)
        self.room = int(self.lengths.sum()) + len(self.lengths) + 1
        self.count = np.zeros(n_terms, np.int64)
        ids = sorted(held)
        for i in ids:
            self.count[i] = len(held[i])
        self.places = np.concatenate([np.cumsum(held[i]) for i in ids]) if ids else np.zeros(0, np.int64)
        self.keys = np.repeat(np.array(ids, np.int64), self.count[ids]) * self.room + self.places if ids else self.places
        self.begins = np.cumsum(self.count) - self.count

    def of(self, term: int) -> np.ndarray:
        return self.places[self.begins[term] : self.begins[term] + self.count[term]]

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each place is in the list of its term."""
        key = terms.astype(np.int64) * self.room + places
        at = np.searchsorted(self.keys, key)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class Phrases:
    """The distinct windows of a block of items, as rows of term numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int):
        self.terms: dict[bytes, int] = {}
        self.items = [k for k, _ in items]
        self.sets: list[tuple[np.ndarray, int]] = []
        found: dict[tuple, set[int]] = {}
        for i, (_, words) in enumerate(items):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words]
            self.sets.append((np.unique(ids), 2 * len(ids)))
            for s in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + size]), set()).add(i)
        by: dict[int, list] = {}
        for key, owners in found.items():
            by.setdefault(len(key), []).append((key, np.array(sorted(owners))))
        self.by_length = {n: (np.array([k for k, _ in x], np.int32), [o for _, o in x]) for n, x in by.items()}

    def arrange(self, frequency: np.ndarray) -> None:
        """Orders the terms of windows and items from the rarest of the corpus on; what has a term that never occurs is left out."""
        self.windows = []
        for rows, owners in self.by_length.values():
            use = np.flatnonzero(frequency[rows].min(axis=1) > 0)
            self.windows.append((rows[use], np.argsort(frequency[rows[use]], axis=1, kind="stable"), [owners[i] for i in use.tolist()]))
        self.sets = [(t[np.argsort(frequency[t], kind="stable")], span) if len(t) and frequency[t].min() > 0 else None for t, span in self.sets]

    def named(self, found: set[int]) -> list[str]:
        return [str(self.items[i]) for i in sorted(found) if self.items[i] is not None]

    def hits(self, p: Postings) -> Iterator[tuple[int, list[int], list[str], int, list[str], int]]:
        """HITS without the segment."""
        depth = np.zeros(p.room + 1, np.int32)
        items_of: dict[int, set[int]] = {}
        for rows, order, owners in self.windows:
            row, start = intersected(p, rows, order)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + rows.shape[1], -1)
            for d, r in set(zip(p.document(start).tolist(), row.tolist(), strict=True)):
                items_of.setdefault(d, set()).update(owners[r].tolist())
        near_in: dict[int, set[int]] = {}
        for i, one in enumerate(self.sets):
            if one is not None:
                for d in near_documents(p, *one):
                    near_in.setdefault(d, set()).add(i)
        hit = np.cumsum(depth[:-1]) > 0
        for d in sorted({*items_of, *near_in}):
            first, found, near = int(p.starts[d]), items_of.get(d, set()), near_in.get(d, set())
            yield d, np.flatnonzero(hit[first : first + int(p.lengths[d])]).tolist(), self.named(found), len(found), self.named(near), len(near)


def intersected(p: Postings, rows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first place) of every occurrence of the phrases: lists shifted by their places, from the rarest term on."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare = order[:, 0]
    head = rows[np.arange(len(rows)), rare]
    n = np.where(p.count[rows].min(axis=1) > 0, p.count[head], 0)
    row = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = p.places[p.begins[head[row]] + inside] - rare[row]
    ok = (start >= 0) & (start + rows.shape[1] < p.room)
    row, start = row[ok], start[ok]
    for j in range(1, rows.shape[1]):
        place = order[row, j]
        ok = p.holds(rows[row, place], start + place)
        row, start = row[ok], start[ok]
    return row, start


def near_documents(p: Postings, terms: np.ndarray, span: int) -> list[int]:
    """Documents with all terms (the rarest first) in some span consecutive words."""
    at = p.of(terms[0])
    for t in terms[1:]:
        if not len(at):
            break
        other, doc = p.of(t), p.document(at)
        i = np.searchsorted(other, np.stack([np.maximum(p.starts[doc], at - span + 1), np.minimum(p.starts[doc] + p.lengths[doc], at + span)]))
        at = at[i[1] > i[0]]
    found: list[int] = []
    for place, d in zip(at.tolist(), p.document(at).tolist(), strict=True):
        if found and found[-1] == d:
            continue
        low, high = max(int(p.starts[d]), place - span + 1), min(int(p.starts[d] + p.lengths[d]), place + span)
        lists = [x[slice(*np.searchsorted(x, (low, high)))] for x in map(p.of, terms)]
        where = np.concatenate(lists)
        who = np.repeat(np.arange(len(terms)), [len(x) for x in lists])
        by = np.argsort(where)
        latest = np.full(len(terms), -span - 1, np.int64)
        for x, w in zip(where[by].tolist(), who[by].tolist(), strict=True):
            latest[w] = x
            if x - latest.min() < span:
                found.append(d)
                break
    return found


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items and their words, block by block; the driver holds one block at a time."""
    part, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        if words := words_of(text):
            if part and n + len(words) > block_words:
                yield part
                part, n = [], 0
            part.append((item, words))
            n += len(words)
    if part:
        yield part


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row of docs (doc_id, text).

    A document's word is hit if it lies in an occurrence of any window of size consecutive words of an item; n_near
    counts the items that are near in the document. An index of docs is built, searched and dropped.
    """
    work = Work(docs.sparkSession, "decontaminate")
    index = PositionalIndex.build(docs, work, segment_words)
    found = searched(index, benchmark, size, block_words)
    index.drop()
    return found


def block_hits(index: PositionalIndex, benchmark: DataFrame, size: int, block_words: int) -> DataFrame:
    """HITS of all blocks, a written table for each; a document has a row for each block that hits it."""
    spark = index.work.spark
    paths = []
    for i, items in enumerate(blocks(benchmark, block_words)):
        index.work.table(index.search(items, size), f"hits-{i}")
        paths.append(index.work.path(f"hits-{i}"))
    return spark.read.schema(HITS).parquet(*paths) if paths else spark.createDataFrame([], HITS)


def searched(index: PositionalIndex, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of decontaminate for every document of a stored index, which stays."""
    every = block_hits(index, benchmark, size, block_words)
    merged = every.groupBy("segment", "number").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.sum("n_items").alias("n_items"), F.sum("n_near").alias("n_near"))
    hits = merged.select("segment", "number", F.size("at").cast("long").alias("n_hit"), "n_items", "n_near", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    got = index.table("documents").join(hits, ["segment", "number"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return got.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): items that are near in a document; rows of the benchmark without an id are left out."""
    index = PositionalIndex.build(docs, Work(docs.sparkSession, "proximity"))
    near = block_hits(index, benchmark, 10, block_words).select("segment", "number", F.explode("near").alias("item_id"))
    return index.table("documents").join(near, ["segment", "number"]).select("doc_id", "item_id")
