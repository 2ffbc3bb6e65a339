"""Repeated byte strings by a suffix structure that is built column by column over many documents at once.

Construction: the strings of a collection are aligned at their anchors and read from the right. Each round inserts
one symbol per string, in front of the suffixes that the rounds before have sorted: the round's symbols, in the order
of the suffixes they precede, are that column of the collection's Burrows-Wheeler transform, a stable sort by them
gives the order of the longer suffixes, and the common prefix of neighbours grows by one where their new symbols
agree (it is the least over the neighbours that lay between them) and starts anew where they differ. Only equal
alignments can hold equal windows, so rounds are kept apart: a round touches the strings, not all suffixes so far,
and the work is linear in the bytes. A 200-byte window is repeated where a suffix has 200 symbols in common with a
neighbour in its column's order.

The collections are the regions around one anchor (anchors.py): windows that might be equal lie in one collection,
so each is built alone; Spark's sorted shuffle files are the external sequential files that feed the rounds. Whole
documents in one collection would need as many rounds as the longest document has bytes, each a pass over all suffixes
so far; README has the figures.

Defined results: null texts are empty; texts shorter than a window lose nothing; matches never cross documents;
copies of a row (same id and text) are separate occurrences, so both lose their repeated bytes; a null doc_id stays
null; a very long text is read in segments that overlap by a window, and never cut; ties do not arise, as all
occurrences go; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import anchors
from lodeseek.llm.common import Work, keyed

WINDOW, GRAM = 200, 48


def column_wise(number: np.ndarray, off: np.ndarray, texts: list[bytes], window: int) -> np.ndarray:
    """For every place of the texts: whether the window that starts there occurs at the same alignment in another text
    of the same collection. number: the collection of each text, ascending; off: the anchor's place in each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(lengths) - lengths + off  # the anchor's place in data
    start, end = -off.astype(np.int64), lengths - 1 - off
    flags = np.zeros(len(data), bool)
    # collections of a single text have nothing to compare
    sizes = np.bincount(number, minlength=int(number[-1]) + 1 if len(number) else 0)
    use = np.flatnonzero(sizes[number] > 1)
    if not len(use):
        return flags
    enter = use[np.argsort(end[use], kind="stable")[::-1]]
    enter_at = end[enter]
    enter_next = 0
    order = np.zeros(0, np.int64)  # texts in the order of their suffixes, collection after collection
    match = np.zeros(0, np.int64)  # the column where the common prefix with the one before ends
    leave = np.sort(start[use])[::-1]
    leave_next = 0
    for c in range(int(end[use].max()), int(start[use].min()) - 1, -1):
        if leave_next < len(leave) and leave[leave_next] > c:
            stay = start[order] <= c
            while leave_next < len(leave) and leave[leave_next] > c:
                leave_next += 1
            at = np.flatnonzero(stay)
            # the common prefix with the last that stays is the least over those between
            match = np.minimum.reduceat(match[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else match[:0]
            order = order[at]
            if len(match):
                match[0] = c + 1
        if enter_next < len(enter) and enter_at[enter_next] >= c:
            stop = enter_next
            while stop < len(enter) and enter_at[stop] >= c:
                stop += 1
            new = np.sort(enter[enter_next:stop])
            enter_next = stop
            # empty suffixes come first in their collection
            place = np.searchsorted(number[order], number[new], "left")
            order, match = np.insert(order, place, new), np.insert(match, place, c + 1)
            follow = place + np.arange(1, len(new) + 1)
            match[follow[follow < len(match)]] = c + 1
        if not len(order):
            continue
        key = number[order] * 256 + data[base[order] + c]
        down = key[1:] < key[:-1]
        if down.any():
            # only collections out of order are sorted anew
            disordered = np.zeros(len(sizes), bool)
            disordered[key[1:][down] >> 8] = True
            sub = np.flatnonzero(disordered[key >> 8])
            moved = sub[np.argsort(key[sub], kind="stable")]
            old = np.arange(len(order))
            old[sub] = moved
            key, order = key[old], order[old]
            before, after = old[:-1], old[1:]
            linked = key[1:] == key[:-1]
            grown = match[after]
            far = np.flatnonzero(linked & (after != before + 1))
            if len(far):
                ends = np.stack([before[far] + 1, after[far] + 1], axis=1).ravel()
                grown[far] = np.minimum.reduceat(np.concatenate([match, [c + 1]]), ends)[::2]
            match = np.concatenate([[c], np.where(linked, grown, c)])
        else:
            match = np.concatenate([[c], np.where(key[1:] == key[:-1], match[1:], c)])
        long = match - c >= window
        if long.any():
            long[:-1] |= long[1:]
            flags[base[order[long]] + c] = True
    return flags


def compare(number, k, t, lo, n, off, texts, window: int = WINDOW) -> np.ndarray:
    flags = column_wise(number, off, texts, window)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths) - lengths
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flags[np.repeat(begins, n) + inside]


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of struct<from, to>) for every row of docs.

    docs has doc_id and text. A byte goes if a window of bytes that covers it also starts anywhere else.
    """
    work = Work(docs.sparkSession, "suffix")
    rows = keyed(docs).withColumn("text", F.col("text").cast("binary"))
    found = work.table(anchors.find_runs(rows, window, gram, words=False), "runs")
    counts = work.table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")

    def same(number, k, t, lo, n, off, texts):
        return compare(number, k, t, lo, n, off, texts, window)

    spans = anchors.repeated_windows(rows, found, counts, window, False, same, "other", work)
    work.drop("runs", "counts")

    def finish(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            offsets, fields = anchors.list_column(b.column(2))
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                data = text.as_buffer()
                s, e = offsets[i], offsets[i + 1]
                if s == e:
                    out.append((doc, len(data), 0, 0, hashlib.sha256(data).hexdigest(), []))
                    continue
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, fields[0][s:e], 1)
                np.add.at(depth, fields[1][s:e] + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                first, last = anchors.intervals(gone)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc, len(data), int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest(), [{"from": a, "to": z + 1} for a, z in zip(first.tolist(), last.tolist(), strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    got = rows.join(spans.hint("merge"), ["__ls_k", "__ls_t"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    return got.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<from:long,to:long>>")
