"""Substring deduplication with a log-structured fingerprint index.

The fingerprint of a window of words is the hash of its anchor gram (anchors.py): windows with the same words have the
same fingerprint, and neighbouring windows mostly share theirs, so that an entry (fingerprint, document, first and last
window, place of the anchor) stands for a run of windows. Hashes of single windows would be 16 bytes for every word of
the corpus, several times the input.

The index is a folder: *runs*, tables of entries in the order of the fingerprint that never change, and a manifest,
written anew under the next number, that names the runs in force. ``add`` takes a batch of documents: their entries
become a sorted run; it is merge-joined with the runs of history, which gives the fingerprints that batch and history,
or the batch alone, hold in several documents; the windows under these are verified word by word, in the batch and in
history; then the manifest takes the run in, and when it has ``fanout`` runs they are merged into one. The index keeps
no texts: a caller gives the documents that history came from. It can be opened again by its folder, in another
session, and goes on with the next batch.

A window goes if a document with a smaller id holds the same words; the first document to hold a window keeps it.
``drop_repeated_windows`` loads all its documents in ``batches`` batches, in the order of their ids.

Defined results: null texts have no words; texts shorter than a window lose nothing; a null doc_id is the smallest
id, and so is -2**63; rows with the same id never remove each other's windows, so ties do not arise; a very long text
is read in segments that overlap by a window, and never cut; further columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import anchors
from lodeseek.llm.common import Work, id_key, keyed, mix64

WINDOW, GRAM = 50, 12
#: Batches of a load, in the order of the ids; runs that are merged into one.
BATCHES, FANOUT = 2, 2


class FingerprintIndex:
    """Sorted immutable runs of entries h, __ls_k, __ls_t, lo, hi, a in a folder."""

    def __init__(self, work: Work, fanout: int = FANOUT, window: int = WINDOW, gram: int = GRAM):
        self.work, self.fanout, self.window, self.gram = work, fanout, window, gram
        versions = sorted(int(n.split("-")[1]) for n in work.names() if n.startswith("manifest-"))
        self.version = versions[-1] if versions else 0
        held = json.loads(work.spark.read.text(work.path(f"manifest-{self.version}"), wholetext=True).first()[0]) if versions else {"runs": [], "made": 0, "window": window, "gram": gram}
        if (held["window"], held["gram"]) != (window, gram):
            raise ValueError(f"This index has windows of {held['window']} words and grams of {held['gram']}")
        self.runs: list[str] = held["runs"]
        self.made: int = held["made"]

    @staticmethod
    def open(spark: SparkSession, at: str, **settings) -> FingerprintIndex:
        """The index in a folder, which may be empty yet."""
        return FingerprintIndex(Work(spark, "index", at), **settings)

    def _commit(self, runs: list[str], gone: list[str]) -> None:
        """The next manifest; what it no longer names is removed after it is there."""
        self.runs, self.version = runs, self.version + 1
        self.work.note(f"manifest-{self.version}", json.dumps({"runs": runs, "made": self.made, "window": self.window, "gram": self.gram}))
        self.work.drop(*gone, f"manifest-{self.version - 1}")

    def _sorted(self, rows: DataFrame) -> str:
        self.made += 1
        parts = int(self.work.spark.conf.get("spark.sql.shuffle.partitions"))
        self.work.table(rows.repartitionByRange(parts, "h", "__ls_k").sortWithinPartitions("h"), f"run-{self.made}")
        return f"run-{self.made}"

    def entries(self) -> DataFrame | None:
        out = None
        for name in self.runs:
            one = self.work.read(name)
            out = one if out is None else out.unionByName(one)
        return out

    def add(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Takes in the rows of batch (doc_id, text). Per document with any, of batch or history: __ls_k, __ls_t, spans:
        its windows that go, since a smaller id in batch or history has them.

        history: the rows that the index has already, as they were given.
        """
        scratch = Work(self.work.spark, "batch")
        rows = keyed(batch).withColumn("text", F.col("text").cast("binary"))
        found = scratch.table(anchors.find_runs(rows, self.window, self.gram, words=True), "found")
        run = self._sorted(found)
        scratch.drop("found")
        new, past = self.work.read(run), self.entries()
        counted = lambda df: df.groupBy("h").agg(F.min("__ls_k").alias("low"), F.max("__ls_k").alias("high"), F.count("*").alias("n"))
        if past is None:
            counts = counted(new).where("low < high").select("h", "n")
        else:
            # both sides hold a fingerprint once: a merge join without hot keys
            before = counted(past).select("h", F.col("low").alias("past_low"), F.col("high").alias("past_high"), F.col("n").alias("past_n"))
            both = counted(new).join(before.hint("merge"), "h", "left").where("low < high or past_low <> low or past_high <> low")
            counts = both.select("h", (F.col("n") + F.coalesce("past_n", F.lit(0))).alias("n"))
        counts = scratch.table(counts, "counts")
        scratch.tidy()
        every, texts = new, rows
        if past is not None:
            every = new.unionByName(past)
            texts = rows.unionByName(keyed(history).withColumn("text", F.col("text").cast("binary")))

        window = self.window

        def same(number, k, t, lo, n, off, regions):
            return verify(number, k, t, lo, n, off, regions, window)

        spans = anchors.repeated_windows(texts, every, counts, window, True, same, "smaller", scratch)
        self._commit([*self.runs, run], [])
        scratch.drop("counts")
        if len(self.runs) >= self.fanout:
            self.compact()
        return spans

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            old = self.runs
            self._commit([self._sorted(self.entries())], old)


def verify(number, k, t, lo, n, off, texts, window: int = WINDOW) -> np.ndarray:
    """Flags for each window of the regions: the same words, at the same alignment, under a smaller key."""
    names: dict[bytes, int] = {}
    cut = [x.split() for x in texts]
    units = np.fromiter((names.setdefault(w, len(names)) for words in cut for w in words), np.int64, sum(map(len, cut)))
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    begins = np.cumsum(lengths) - lengths
    region = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
    place = begins[region] + inside
    hasher = anchors.Hasher()
    whole = hasher.grams(hasher.prefix(mix64(units.astype(np.uint64) + np.uint64(1))), window)
    where = number[region].astype(np.uint64) * np.uint64(1 << 32) + (inside - off[region] + (1 << 30)).astype(np.uint64)
    x = mix64(whole[place] ^ mix64(where))
    key = k[region]
    order = np.lexsort((key, x))
    new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    first = order[new][np.cumsum(new) - 1]
    later = key[order] > key[first]
    left, right = order[later], first[later]
    flags = np.zeros(len(region), bool)
    for at in range(0, len(left), 20_000):
        a, b = place[left[at : at + 20_000]], place[right[at : at + 20_000]]
        same = np.ones(len(a), bool)
        for j in range(window):
            same &= units[a + j] == units[b + j]
        flags[left[at : at + 20_000]] = same
        for i in np.flatnonzero(~same).tolist():  # equal hashes of different words: look among all rows of the hash
            one = left[at + i]
            flags[one] = any(key[o] < key[one] and (units[place[o] : place[o] + window] == units[place[one] : place[one] + window]).all() for o in np.flatnonzero(x == x[one]).tolist())
    return flags


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (array of struct<from, to>, in words) for every row of docs."""
    spark = docs.sparkSession
    work = Work(spark, "substring")
    rows = keyed(docs).withColumn("text", F.col("text").cast("binary"))
    index = FingerprintIndex(Work(spark, "index"), fanout, window, gram)
    key = id_key()
    cuts = docs.select(key.alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    every, low = None, None
    for high in [*sorted(set(map(int, cuts))), None]:
        part = docs if low is None else docs.where(key > low)
        spans = index.add(part if high is None else part.where(key <= high), None if low is None else docs.where(key <= low))
        every = spans if every is None else every.unionByName(spans)
        low = high
    # a document of an early batch may be met again by later ones
    spans = every.groupBy("__ls_k", "__ls_t").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    index.work.drop(*index.runs, f"manifest-{index.version}")

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            offsets, fields = anchors.list_column(b.column(2))
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                words = text.as_buffer().to_pybytes().split()
                s, e = offsets[i], offsets[i + 1]
                first = last = np.zeros(0, np.int64)
                kept, n_gone = words, 0
                if s < e:
                    depth = np.zeros(len(words) + 1, np.int32)
                    np.add.at(depth, fields[0][s:e], 1)
                    np.add.at(depth, fields[1][s:e] + window, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    first, last = anchors.intervals(gone)
                    kept, n_gone = [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())
                out.append((doc, len(words), n_gone, hashlib.sha256(b" ".join(kept)).hexdigest(), [{"from": a, "to": z + 1} for a, z in zip(first.tolist(), last.tolist(), strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    got = rows.join(spans.hint("merge"), ["__ls_k", "__ls_t"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    return got.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<from:long,to:long>>")
