"""A BM25 index ordered by term, with block maxima, for questions against all that is stored. [K1, F1, A11]

Chunks are numbered in the order of ties (document, place, id). A *block* is the postings of one term in one range of
``SPAN`` numbers: places in the range and impacts, packed in two binary columns, with the number of postings and the
largest impact beside them. Blocks are written in the order of their terms, with small pages, so that a reader that asks
for a few terms skips all other pages by their statistics. An impact is a posting's BM25 score but for what the question
says: its number of the word and, over a corpus, the word's idf.

A search reads the numbers and maxima of the questions' terms first. They bound what a range can give a question. The
ranges with the highest bounds are scored, which gives each question a k-th score; then only ranges whose bound reaches
it are scored, too: their blocks alone are shuffled, by range, and unpacked. Inside a range the terms with the largest maxima
come first; once what is left cannot lift a new chunk to the k-th score, the other terms only add to chunks that are
there (MaxScore), and chunks that can no longer reach it go.

Defined results: rows and ties are those of ``retrievers.bm25``. A question that names no term finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import blocks as B
from lodeseek.operators.lists import byte_words, runs, whole
from lodeseek.operators.retrievers import as_evidence, ranked, scope_columns, small
from lodeseek.session import settled, ship

#: Chunks in a range; ranges that each question has scored first; rows of a written page.
SPAN, LEADING, PAGE_ROWS = 1024, 4, 2_000
#: More terms than this are not named in the filter of the scan, which Spark would turn into one wide range.
NAMED = 10
COUNTED = ["term", "span", "n", "places", "tfs", "sizes"]
BLOCK = "term string, span long, n long, top double, places binary, impacts binary"


def numbered(chunks: DataFrame) -> DataFrame:
    """no (dense, from 0, in the order of ties) with the key of every chunk."""
    order = ["document_id", "chunk_index", "chunk_id"]
    slim = chunks.select(*B.KEY)
    # written, so that both readers see the same ranges
    ranges = settled(slim.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # one row for each range
    return ranges.join(F.broadcast(before), "range").select((F.col("before") + F.col("place")).alias("no"), *B.KEY)


def impacts(chunks: DataFrame, scope: str, k1: float, b: float) -> DataFrame:
    """KEY, term, impact of every word of every chunk. In scope "document" the idf of the chunk's document is in it."""
    per = scope_columns(scope)
    words = chunks.select(*B.KEY, T.tokens("text").alias("words"))
    stats = words.select(*per, F.size("words").alias("len")).groupBy(*per).agg(F.count("*").alias("chunks"), F.avg("len").alias("avgdl"))
    held = words.select(*B.KEY, F.size("words").alias("len"), F.explode("words").alias("term")).groupBy(*B.KEY, "len", "term").agg(F.count("*").alias("tf"))
    held = held.join(stats, per) if per else held.crossJoin(F.broadcast(stats))  # one row
    avg = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    length = F.when(F.col("len") == 0, 1).otherwise(F.col("len"))
    static = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / avg))
    if not per:
        return held.select(*B.KEY, "term", static.alias("impact"))
    df = held.groupBy("document_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return held.join(df, ["document_id", "term"]).select(*B.KEY, "term", (idf * static).alias("impact"))


def build(chunks: DataFrame, at: str, scope: str = "corpus", k1: float = 1.5, b: float = 0.75, span: int = SPAN) -> Index:
    """Writes the index of all chunks to the folder at."""
    spark = chunks.sparkSession
    ship(spark)
    keys = numbered(chunks)
    keys.sortWithinPartitions("no").write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{at}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{at}/keys")
    if scope == "corpus":
        packed = packed_spans(chunks, keys, f"{at}/counted", k1, b, span)
    else:
        packed = packed_rows(impacts(chunks, scope, k1, b).join(keys.hint("merge"), B.KEY), span)
    packed.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").parquet(f"{at}/blocks")
    counted = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/counted")
    counted.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(counted, True)
    spark.createDataFrame([(scope, k1, b, span, keys.count())], "scope string, k1 double, b double, span int, chunks long").coalesce(1).write.mode("overwrite").json(f"{at}/about")
    return Index(spark, at)


def packed_rows(rows: DataFrame, span: int) -> DataFrame:
    """The blocks of postings (term, no, impact), in order."""
    rows = rows.select("term", F.expr(f"no div {span}").alias("span"), (F.col("no") % span).cast("int").alias("place"), "impact")
    # at most span postings meet in a group
    grouped = rows.groupBy("term", "span").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.array_sort(F.collect_list(F.struct("place", "impact"))).alias("p"))

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("p")
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            flat = lists.flatten()
            columns = []
            for i, kind in ((0, np.dtype("<u4")), (1, np.dtype("<f8"))):
                data = flat.field(i).to_numpy(zero_copy_only=False).astype(kind)
                offsets = (ends * kind.itemsize).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("term", "span", "n", "top")), *columns], names=["term", "span", "n", "top", "places", "impacts"])

    return grouped.repartitionByRange("term", "span").sortWithinPartitions("term", "span").mapInArrow(pack, BLOCK)


def word_counts(batches: Iterator, span: int) -> Iterator:
    """The blocks of the ranges of some texts, whose rows (span, place, text) come in the order of ranges: term, span, n and, packed,
    places, numbers of the term and sizes of the chunks; a row without a term has the number of words of a batch, and of its texts."""
    import pyarrow as pa

    for t in whole(batches, "span"):
        t = t.combine_chunks()
        column, at, place = t.column("text").chunk(0), t.column("span").to_numpy(), t.column("place").to_numpy().astype(np.int64)
        flat, length = byte_words(column)
        coded = flat.dictionary_encode()
        many, number = max(1, len(coded.dictionary)), runs(t.column("span").chunk(0))
        row = np.repeat(np.arange(t.num_rows), length)
        key, tf = np.unique((number[row] * many + coded.indices.to_numpy()) * span + place[row], return_counts=True)
        size = np.zeros((int(number[-1]) + 1) * span, np.int64)
        size[number * span + place] = length
        block, where = np.divmod(key, span)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        n = np.diff(np.append(first, len(block)))
        of, word = np.divmod(block[first], many)
        # two bytes a number where that is enough
        columns = [bytes_of(x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4"), n) for x in (where, tf, size[of.repeat(n) * span + where])]
        head = np.searchsorted(number, of)
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()).take(pa.array(word)), pa.array(at[head]), pa.array(n.astype(np.int64)), *columns], names=COUNTED)
        total = [pa.array([None], pa.string()), pa.array([int(length.sum())]), pa.array([len(column) - column.null_count]), *([pa.array([None], pa.binary())] * 3)]
        yield pa.RecordBatch.from_arrays(total, names=COUNTED)


def unpacked(column, n: np.ndarray) -> np.ndarray:
    """The numbers of all rows of a packed column, of which row i has n[i]."""
    import pyarrow as pa
    import pyarrow.compute as pc

    two = pc.binary_length(column).to_numpy() == 2 * n
    if two.all():
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        start = int(np.frombuffer(offsets, np.int64)[column.offset])
        return np.frombuffer(data, "<u2", int(n.sum()), start)
    return np.concatenate([np.frombuffer(x.as_buffer(), "<u2" if t else "<u4").astype(np.int64) for x, t in zip(column, two.tolist(), strict=True)])


def bytes_of(numbers: np.ndarray, n: np.ndarray):
    """A packed column, of which row i has the next n[i] numbers."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * numbers.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))]).cast(pa.binary())


def packed_spans(chunks: DataFrame, keys: DataFrame, at: str, k1: float, b: float, span: int) -> DataFrame:
    """The blocks of an index over a corpus, in order.

    A range's texts meet in a task, which counts its words there, so there is no row for a posting. Texts are shuffled to
    their ranges, and the blocks to the order of terms, with six bytes a posting. The
    numbers of words are written to the folder at first, as impacts need the average length; the caller removes it.
    """
    first = keys.groupBy("document_id").agg(F.min("no").alias("first")).hint("merge")
    # chunks that lie by document are not shuffled for their numbers
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    rows = chunks.select(*B.KEY, "text").join(first, "document_id").select((F.col("first") + place - 1).alias("no"), "text")
    rows = rows.select(F.expr(f"no div {span}").alias("span"), (F.col("no") % span).cast("int").alias("place"), "text").repartition("span").sortWithinPartitions("span")
    counted = rows.mapInArrow(lambda batches: word_counts(batches, span), "term string, span long, n long, places binary, tfs binary, sizes binary")
    counted.write.mode("overwrite").option("compression", "zstd").parquet(at)
    counted = chunks.sparkSession.read.schema(counted.schema).parquet(at)
    total = counted.where("term is null").agg(F.sum("span").alias("words"), F.sum("n").alias("texts")).first()
    avg = (total["words"] or 0) / total["texts"] if total["texts"] else 0.0
    avg = avg or 1.0

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            place, tf, size = (unpacked(batch.column(c), n) for c in COUNTED[3:])
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.maximum(size, 1) / avg))
            tops = np.maximum.reduceat(impact, np.cumsum(n) - n)
            columns = [*(batch.column(c) for c in COUNTED[:3]), pa.array(tops), bytes_of(place.astype("<u4"), n), bytes_of(impact.astype("<f8"), n)]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "span", "n", "top", "places", "impacts"])

    return counted.where("term is not null").repartitionByRange("term", "span").sortWithinPartitions("term", "span").mapInArrow(pack, BLOCK)


class Index:
    """The written tables of one index: blocks, keys and how it was made."""

    def __init__(self, spark, at: str):
        about = spark.read.json(f"{at}/about").first()
        self.spark, self.at, self.scope, self.k1, self.b, self.span, self.chunks = spark, at, about["scope"], about["k1"], about["b"], about["span"], about["chunks"]

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms."""
        every = self.spark.read.schema(BLOCK).parquet(f"{self.at}/blocks")
        if len(terms) <= NAMED:
            return every.where(F.col("term").isin(terms))
        return every.join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term")  # the words of a block of questions

    def keys(self, found: DataFrame) -> DataFrame:
        """found (no, ...: the k best of a block of questions) with the keys of its chunks."""
        every = self.spark.read.parquet(f"{self.at}/keys")
        numbers = [r["no"] for r in found.select("no").distinct().limit(NAMED + 1).collect()]
        if len(numbers) <= NAMED:
            every = every.where(F.col("no").isin(numbers))
        return every.join(small(found), "no")


class Asked:
    """A block of questions: how often each has a term, times the term's idf."""

    def __init__(self, part: list[tuple[str, str, list[str]]], k: int):
        block = B.Block([(q, w) for q, _, w in part])
        self.ids, self.terms, self.k, self.floor = block.ids, block.terms, k, np.zeros(len(part))
        self.weights = block.times

    def weigh(self, df: dict[str, int], chunks: int) -> None:
        """Over a corpus: the terms' idf."""
        for t, i in self.terms.items():
            n = df.get(t, 0)
            self.weights[i] *= np.log(1 + (chunks - n + 0.5) / (n + 0.5))

    def bounds(self, terms: list[str], tops: np.ndarray) -> np.ndarray:
        """For blocks of one range: the most that each question can get there."""
        return tops @ self.weights[[self.terms[t] for t in terms]]

    def best(self, terms: list[str], tops: np.ndarray, lists: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, scores) of one range: all that can be among a question's k best there, and no score under its floor."""
        rows = [self.terms[t] for t in terms]
        reach = np.round(self.bounds(terms, tops), 9)
        opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in np.flatnonzero((reach > 0) & (reach >= self.floor)).tolist():
            weight = self.weights[rows, q]
            most = weight * tops
            order = [i for i in np.argsort(-most, kind="stable").tolist() if weight[i] > 0]
            left = np.cumsum(most[order][::-1])[::-1]
            places, scores, floor = np.zeros(0, np.int64), np.zeros(0), self.floor[q]
            for j, i in enumerate(order):
                if i not in opened:
                    opened[i] = np.frombuffer(lists[i][0], "<u4").astype(np.int64), np.frombuffer(lists[i][1], "<f8")
                at, impact = opened[i]
                own = impact * weight[i]
                # a little room for rounding; a new chunk needs the terms from here on
                if left[j] + 1e-6 >= floor:
                    every = np.union1d(places, at)
                    sums = np.zeros(len(every))
                    sums[np.searchsorted(every, places)] = scores
                    sums[np.searchsorted(every, at)] += own
                    places, scores = every, sums
                elif len(places):
                    where = np.minimum(np.searchsorted(at, places), len(at) - 1)
                    scores = scores + np.where(at[where] == places, own[where], 0.0)
                if len(places) > self.k:
                    floor = max(floor, float(np.partition(scores, -self.k)[-self.k]))
                rest = left[j + 1] if j + 1 < len(order) else 0.0
                ok = scores + rest + 1e-6 >= floor
                places, scores = places[ok], scores[ok]
            scores = np.round(scores, 9)
            ok = scores >= max(self.floor[q], 1e-9)
            if ok.any():
                yield q, places[ok], scores[ok]


def by_range(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("span", "term", "top", *columns).repartition("span").sortWithinPartitions("span", "term")


def ranges_of(batches: Iterator, lists: bool) -> Iterator[tuple[int, list[str], np.ndarray, list]]:
    """span, terms, tops and lists of each range, from rows that come in the order of ranges."""
    last, terms, tops, held = None, [], [], []
    for b in batches:
        data = zip(b.column("places"), b.column("impacts"), strict=True) if lists else [None] * b.num_rows
        for span, term, top, x in zip(b.column("span").to_pylist(), b.column("term").to_pylist(), b.column("top").to_pylist(), data, strict=True):
            if span != last:
                if terms:
                    yield last, terms, np.array(tops), held
                last, terms, tops, held = span, [], [], []
            terms.append(term)
            tops.append(top)
            if x:
                held.append((x[0].as_buffer(), x[1].as_buffer()))
    if terms:
        yield last, terms, np.array(tops), held


def reachable(blocks: DataFrame, asked: Asked, leading: int | None) -> DataFrame:
    """q, span, bound: the leading ranges of each question in every task; or, without that number, all whose bound reaches its floor."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        asked, found = shared.value, [[] for _ in shared.value.ids]
        for span, terms, tops, _ in ranges_of(batches, False):
            bound = np.round(asked.bounds(terms, tops), 9)
            for q in np.flatnonzero((bound > 0) & (bound >= asked.floor)).tolist():
                found[q].append((-float(bound[q]), span))
                if leading and len(found[q]) > 4 * leading:
                    found[q] = sorted(found[q])[:leading]
        rows = [(q, s, -x) for q, every in enumerate(found) for x, s in (sorted(every)[:leading] if leading else every)]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["q", "span", "bound"])

    return by_range(blocks, []).mapInArrow(run, "q int, span long, bound double")


def scored(blocks: DataFrame, asked: Asked, span: int) -> DataFrame:
    """q, no, score: the k best chunks of each question in every range of blocks that can hold one."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        asked = shared.value
        for at, terms, tops, lists in ranges_of(batches, True):
            for q, places, scores in asked.best(terms, tops, lists):
                order = np.lexsort((places, -scores))[: asked.k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), q, np.int32)), pa.array(at * span + places[order]), pa.array(scores[order])], names=["q", "no", "score"])

    return by_range(blocks, ["places", "impacts"]).mapInArrow(run, "q int, no long, score double")


def k_best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each question; equal scores in the order of numbers."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "no"))).where(F.col("rank") <= k).drop("rank")


def search_block(index: Index, part: list[tuple[str, str, list[str]]], k: int) -> DataFrame | None:
    """query_id, KEY, score of the k best chunks of each question of a block; None where no question names a term."""
    asked = Asked(part, k)
    if not asked.terms:
        return None
    blocks = index.blocks(list(asked.terms))
    if index.scope == "corpus":
        # one row for each term of the block
        asked.weigh({r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}, index.chunks)
    # the leading ranges of each question, at most len(part) * LEADING
    most = Window.partitionBy("q").orderBy(F.desc("bound"), "span")
    lead = sorted({r["span"] for r in reachable(blocks, asked, LEADING).withColumn("r", F.row_number().over(most)).where(F.col("r") <= LEADING).select("span").distinct().collect()})
    first = settled(k_best(scored(blocks.where(F.col("span").isin(lead)), asked, index.span), k))
    floors = {r["q"]: r["low"] for r in first.groupBy("q").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # one row for each question
    for q, low in floors.items():
        asked.floor[q] = low
    spans = settled(reachable(blocks, asked, None).where(~F.col("span").isin(lead)).select("span").distinct())
    rest = scored(blocks.join(small(spans), "span", "left_semi"), asked, index.span)
    best = settled(k_best(first.unionByName(rest), k))
    names = F.broadcast(index.spark.createDataFrame(list(enumerate(asked.ids)), "q int, query_id string"))
    return index.keys(best).join(names, "q").select("query_id", *B.KEY, "score")


def search(index: Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """query_id, KEY, score, rank of the k best chunks of each question (query_id, question) over the whole index."""
    out = None
    for part in B.question_blocks(questions):
        found = search_block(index, part, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        types = {f.name: f.dataType.simpleString() for f in index.spark.read.parquet(f"{index.at}/keys").schema.fields}
        out = index.spark.createDataFrame([], "query_id string, " + ", ".join(f"{c} {types[c]}" for c in B.KEY) + ", score double")
    return ranked(out, k, ["query_id"])


def bm25(index: Index, chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Evidence rows; chunks are read for the texts of what won only."""
    return as_evidence(search(index, questions, k), chunks, "bm25")
