"""Packing of tokenized documents by local search: exchanges between underfull bins that increase the squared fill.

A document longer than a sequence is cut into pieces of whole sequences; what is left over is its first piece. Full
pieces have a sequence of their own. All others go to groups of about ``GROUP`` pieces by a hash and each group is packed
alone: by best fit in the order in which they come, then by local search. The fullest bin that has room takes from emptier ones: a
piece, one for one of its own, one for two or two for one, whichever fills it best. As the giver is no fuller, every
exchange increases the sum of squared fills; so the search ends, and the emptiest bins run out of pieces. The pieces of
bins that are not full at the end are dealt out again, in fewer groups, until one group holds all that is left; that one is
searched from several starts. Only
lengths, never ids, are shuffled, and a group's size is fixed, so no task grows with the corpus.

Defined results: a null text is an empty document, which still has its end id; rows with the same doc_id (or null)
are separate documents; a doc_id of -2**63 is shown as null; pieces of one length are packed in the order in which they
were written; a very long text is many pieces; an empty table gives an empty result; further columns, whatever their
names, are ignored. A vocabulary whose file has another normaliser or pre-tokenizer is an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import bpe
from lodeseek.llm.common import NULL_ID, Work, crc, id_key
from lodeseek.llm.packing import Known, pack_ids
from lodeseek.llm.token_counts import load, pieces_of

#: Pieces in a group on average; how often the last group is searched again.
GROUP, TRIES = 2_000, 8
#: White space next to white space or to an end of the text; white space but blanks and line feeds.
UNEVEN, OTHER = re.compile(r"\s\s|^\s|\s\Z"), re.compile(r"[^\S \n]")


def uneven(text: str) -> bool:
    """Whether UNEVEN is in a text; most texts hold blanks and line feeds only, which is seen without it."""
    plain = not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else not OTHER.search(text)
    if plain:
        return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(s in text for s in ("  ", " \n", "\n ", "\n\n"))
    return bool(UNEVEN.search(text))


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, for byte-level vocabularies.

    Where every white space stands alone between other characters, pre-tokens never cross a cut before a space or a
    line feed, so each part between cuts has the same ids alone as in the text. Parts are looked up without their space;
    a part that has none before it is marked.
    """

    BARE = "\x00"

    def __init__(self, vocabulary: str, without: frozenset[bytes] = frozenset()):
        import public_tokenizers
        import regex

        self.t, self.known = load(vocabulary), Known(self.encode)
        self.merge, self.split = bpe.encoder(vocabulary, without), regex.compile(public_tokenizers.PATTERN).findall
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]

    def library(self, x: str) -> bytes:
        return pack_ids(self.t.encode(x, add_special_tokens=False).ids)

    def encode(self, key: str) -> bytes:
        if key[:1] == self.BARE:
            x = key[1:]
            word = x[1:] if x[:1] == " " else x
        else:
            x, word = " " + key, key
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):  # one pre-token
            return pack_ids(self.merge(x.encode()))
        if word and word[-1] in ",.;:!?" and word[:-1].isascii() and word[:-1].isalpha():  # two pre-tokens
            return self.known[key[:-1]] + pack_ids(self.merge(word[-1].encode()))
        if not x:
            return b""
        if max(x) >= "Ā" or "\x1b" < min(x) < " ":  # letters and white space that the library may know otherwise
            return self.library(x)
        ids: list[int] = []
        for p in self.split(x):
            ids += self.merge(p.encode())
        return pack_ids(ids)

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.library(text)
        if self.BARE in text or uneven(text):
            parts = [self.BARE + p for p in pieces_of(text)]
        else:
            parts = (self.BARE + text.replace("\n", f" {self.BARE}\n {self.BARE}")).split(" ")
        return b"".join(map(self.known.__getitem__, parts))


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of items: each item, in the given order, into the bin with the least room that takes it."""
    bins, room = [], []
    for i, need in enumerate(lengths.tolist()):
        at = bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > need:
            insort(room, (free - need, b))
    return bins


class Search:
    """Local search over the bins of one group."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], size: int):
        self.length, self.size, self.bins = np.asarray(lengths, np.int64), size, bins
        self.fill = np.array([self.length[np.array(b, np.int64)].sum() for b in bins], np.int64)
        self.bin = np.zeros(len(self.length), np.int64)
        for i, b in enumerate(bins):
            self.bin[b] = i
        self.least = -(-int(self.length.sum()) // size)
        self.gather()

    def used(self) -> int:
        return int((self.fill > 0).sum())

    def gather(self) -> None:
        """The items of bins with room, and the pairs of items that share one, by length; pairs hold until their bin changes."""
        items = np.flatnonzero(self.fill[self.bin] < self.size)
        self.items = items[np.argsort(self.length[items], kind="stable")]
        self.changed = np.zeros(len(self.bins), bool)
        pairs = [np.array(b)[np.array(np.triu_indices(len(b), 1))] for b, f in zip(self.bins, self.fill.tolist(), strict=True) if f < self.size and len(b) > 1]
        pairs = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        self.pairs = pairs[:, np.argsort(self.length[pairs].sum(axis=0), kind="stable")]

    def run(self) -> Search:
        """Exchanges until a sweep over all bins with room finds none, or no fewer bins are possible."""
        found = True
        while found and self.used() > self.least:
            found = False
            self.gather()
            # the fullest first
            for b in np.argsort(-self.fill, kind="stable").tolist():
                while 0 < self.fill[b] < self.size and self.take(b):
                    found = True
        return self

    def take(self, b: int) -> bool:
        """The exchange that fills bin b best, from bins that are no fuller; False if there is none."""
        room, mine = self.size - self.fill[b], np.array(self.bins[b])
        givers = self.bin[self.items]
        ones = self.items[(self.fill[givers] <= self.fill[b]) & (givers != b)][None]
        best = self.closest(ones, np.zeros((0, 1), np.int64), room), self.closest(ones, mine[None], room)
        if max(gain for gain, *_ in best) < room:
            # two for one: two of the bin's own for one, or one of its own for two of another bin
            givers = self.bin[self.pairs[0]]
            twos = self.pairs[:, (self.fill[givers] <= self.fill[b]) & (givers != b) & ~self.changed[givers]]
            best += self.closest(ones, mine[np.array(np.triu_indices(len(mine), 1))], room), self.closest(twos, mine[None], room)
        gain, given, taken = max(best, key=lambda x: x[0])
        if gain < 1:
            return False
        giver = int(self.bin[taken[0]])
        self.bins[b] = [x for x in self.bins[b] if x not in given] + taken
        self.bins[giver] = [x for x in self.bins[giver] if x not in taken] + given
        self.bin[taken], self.bin[given] = b, giver
        self.fill[b] += gain
        self.fill[giver] -= gain
        self.changed[[b, giver]] = True
        return True

    def closest(self, offers: np.ndarray, own: np.ndarray, room: int) -> tuple[int, list[int], list[int]]:
        """(gain, own items, offered items) of the largest gain that has room; a column is a choice, offers are by length."""
        if not offers.shape[1] or not own.shape[1]:
            return 0, [], []
        sizes, mine = self.length[offers].sum(axis=0), self.length[own].sum(axis=0)
        at = np.searchsorted(sizes, mine + room, "right") - 1
        gain = np.where(at >= 0, sizes[at] - mine, 0)
        i = int(np.argmax(gain))
        return int(gain[i]), own[:, i].tolist(), offers[:, at[i]].tolist()


def searched_again(search: Search, tries: int, seed: int = 7) -> Search:
    """Where the search ended above the least number of bins: its bins with room and some full ones are emptied, filled again
    (the longest items first) and searched, up to so many times."""
    draw = np.random.default_rng(seed)
    for _ in range(tries):
        if search.used() <= search.least:
            break
        part, full = (np.flatnonzero(x) for x in ((search.fill > 0) & (search.fill < search.size), search.fill == search.size))
        chosen = np.concatenate([part, draw.permutation(full)[: 4 * len(part)]])
        items = np.concatenate([np.array(search.bins[b]) for b in chosen])
        items = items[np.argsort(-search.length[items], kind="stable")]
        own = Search(search.length[items], best_fit(search.length[items], search.size), search.size).run()
        if own.used() <= len(chosen):
            others = [b for i, b in enumerate(search.bins) if i not in set(chosen.tolist())]
            search = Search(search.length, others + [items[b].tolist() for b in own.bins if b], search.size)
    return search


def pack_lengths(lengths: np.ndarray, size: int, tries: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin, the offset and the free room of the bin of each item. Items are at most size long."""
    search = searched_again(Search(lengths, best_fit(lengths, size), size).run(), tries)
    out = np.zeros((3, len(lengths)), np.int64)
    for b, items in enumerate(search.bins):
        at = 0
        for i in sorted(items):
            out[:, i] = b, at, size - search.fill[b]
            at += int(lengths[i])
    return out[0], out[1], out[2]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, size: int, end: int) -> DataFrame:
    """PIECE (NULL_ID for a null doc_id) for every piece of every row of docs."""
    without = bpe.unreachable(vocabulary)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, tail, kinds = Ids(vocabulary, without), np.array([end], "<u4").tobytes(), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = ids.of(text) + tail
                    n = len(data) // 4
                    edges = [0, *range(n % size or size, n + 1, size)]
                    out += [(doc, i, s, e - s, crc(data[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_key().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", size: int = 2048, end: int = 0, seed: int = 7, group: int = GROUP) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bpe.require(vocabulary, [], [("ByteLevel", None)])
    work = Work(docs.sparkSession, "best-fit")
    cut = work.table(pieces(docs, vocabulary, size, end).withColumn("__ls_n", F.monotonically_increasing_id()), "pieces")
    names = [x.split()[0] for x in PIECE.split(", ")]
    done = cut.where(F.col("length") == size).select(*names, (-1 - F.col("__ls_n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, before, i = cut.where(F.col("length") < size), None, 0

    def placed(rows: DataFrame, tries: int) -> DataFrame:
        return rows.groupBy("__ls_s").applyInPandas(lambda pdf: place(pdf, tries), f"{PIECE}, __ls_n long, sequence_id long, offset long, free long")

    def place(pdf, tries: int):
        # the order of rows from a shuffle is not fixed; a total order makes reruns agree
        pdf = pdf.sort_values("__ls_n")
        bins, offsets, free = pack_lengths(pdf["length"].to_numpy(np.int64), size, tries)
        return pdf[[*names, "__ls_n"]].assign(sequence_id=pdf["__ls_s"].to_numpy(np.int64) + bins, offset=offsets, free=free)

    while True:
        count = loose.count()
        groups = max(1, -(-count // group))
        # rounds, groups and bins have bits of their own in the number of a sequence
        dealt = loose.withColumn("__ls_s", F.pmod(F.xxhash64("__ls_n", F.lit(seed + i)), F.lit(groups)).cast("long") * (1 << 20) + (i << 52))
        packed = work.table(placed(dealt, TRIES if groups == 1 else 0), f"packed-{i}")
        last = groups == 1 or (before is not None and 2 * count > before)
        done = done.unionByName((packed if last else packed.where("free = 0")).select(*names, "sequence_id", "offset"))
        if last:
            return done.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))
        loose, before, i = packed.where("free > 0").select(*names, "__ls_n"), count, i + 1
