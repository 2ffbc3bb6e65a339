"""Packing of tokenized documents into fixed-length sequences: first-fit decreasing over a tournament tree.

A document's ids are cut at multiples of the sequence length. All pieces go to groups by a seeded hash and each group
is packed alone: pieces in decreasing length, each into the first bin with room, found from the root of a tournament
tree whose inner nodes hold the largest free capacity below; a full piece has a bin, and so a sequence, of its own.
Only lengths, never ids, are shuffled, and a group's size is fixed, so no task grows with the corpus.

Defined results: a null text is an empty document, which still has its end id; rows with the same doc_id (or null)
are separate documents; a doc_id of -2**63 is shown as null; a piece of exactly the sequence length is a sequence
without padding; pieces of one length are packed in the order of their keys; a very long text is many pieces; an empty
table gives an empty result; further columns, whatever their names, are ignored. A vocabulary whose file has another
normaliser or pre-tokenizer is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import bpe
from lodeseek.llm.common import NULL_ID, Work, crc, id_key
from lodeseek.llm.token_counts import load

#: White-space separated strings whose ids a task remembers; at the limit it starts anew.
REMEMBERED = 500_000
#: Pieces in a group on average.
GROUP = 2_000


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's normaliser and its pre-token pattern never join what ASCII white space separates, so each
    separated string has the same ids alone as in the text. Strings below U+0100 are in composed form already and
    their lower case goes letter by letter, so their pre-tokens go straight to the merges; all others go through the
    library as a whole.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, vocabulary: str, without: frozenset[bytes] = frozenset()):
        import regex

        self.t, self.known = load(vocabulary), Known(self.encode)
        self.merge, self.split = bpe.encoder(vocabulary, without), regex.compile(self.PATTERN).findall
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]

    def encode(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters only: one pre-token
            return pack_ids(self.merge(w.lower() + bpe.MARK))
        x = w.decode()
        if (w.isascii() or max(x) < "\u0100") and "<|" not in x:
            ids: list[int] = []
            x = x.lower()
            for p in (x,) if x.isalpha() else self.split(x):
                ids += self.merge(p.encode() + bpe.MARK)
            return pack_ids(ids)
        return pack_ids(self.t.encode(x, add_special_tokens=False).ids)

    def of(self, texts: list[bytes]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, x.split())) for x in texts]


class Known(dict):
    """What encode gives for each string, asked once as long as the string is remembered."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, w: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[w] = ids = self.encode(w)
        return ids


#: By number of ids; longer lists are rare.
PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack_ids(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}I", *ids)


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing: the bin and the offset of each item. Items are at most size long.

    Ties in length keep the given order. The tree's leaves are bins; a node holds the largest capacity below it.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [size] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, at = int(lengths[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, size - tree[at]
        tree[at] -= need
        at >>= 1
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at >>= 1
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, size: int, end: int) -> DataFrame:
    """doc_id (NULL_ID for null), start, length, ids_crc32, doc_tokens."""

    without = bpe.unreachable(vocabulary)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, tail = Ids(vocabulary, without), np.array([end], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                texts = [x or b"" for x in part.column(1).to_pylist()]
                for doc, data in zip(part.column(0).to_pylist(), ids.of(texts), strict=True):
                    data += tail
                    n = len(data) // 4
                    out += [(doc, s, min(size, n - s), crc(data[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(id_key().alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = 4096, end: int = 2, seed: int = 7, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bpe.require(vocabulary, ["NFC", "Replace", "Lowercase"], [("Split", Ids.PATTERN), ("ByteLevel", None)])
    work = Work(docs.sparkSession, "pack")
    cut = work.table(pieces(docs, vocabulary, size, end), "pieces")
    groups = max(1, -(-cut.count() // group))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(pdf):
        # the order of rows from a shuffle is not fixed; a total order (up to equal rows) makes reruns agree
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True])
        bins, offsets = pack_lengths(pdf["length"].to_numpy(np.int64), size)
        return pdf[names].assign(sequence_id=pdf["__ls_g"].to_numpy(np.int64) * 2**32 + bins, offset=offsets)

    # a piece's place in the written table enters the hash, so that repeated rows do not gather in one group
    grouped = cut.withColumn("__ls_g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).cast("long"))
    packed = grouped.groupBy("__ls_g").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))
