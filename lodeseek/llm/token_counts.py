"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come back as one token are *proved* whole. In a text,
each pre-token among them counts 1 without any merging; only the rest goes through the tokenizer's merges, once per
distinct string and task memory. Everything is one narrow pass over the documents: no shuffle.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each give
a row; further columns, whatever their names, are ignored; texts of any length are counted whole; ties do not arise; an
empty table gives an empty result. A vocabulary whose file has another normaliser or pre-tokenizer is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import bpe
from lodeseek.llm.common import tokenizer_file
from lodeseek.session import ship

#: Strings whose counts a task remembers; at the limit it starts anew. It bounds memory and changes no result.
REMEMBERED = 400_000


def load(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(vocabulary))
    t.no_truncation()
    t.no_padding()
    return t


def whole_tokens(vocabulary: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and, alone, one token: proved by merging each with the plain rule."""
    import public_tokenizers
    import regex

    split, (ranks, _), bad = regex.compile(public_tokenizers.PATTERN), bpe.parts(vocabulary), bpe.unreachable(vocabulary)
    found = []
    for data in ranks:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if data not in bad and split.findall(text) == [text]:
            found.append(text)
    return frozenset(found)


def pieces_of(text: str) -> list[str]:
    """Parts that tokenize alone as they do in the text: cuts lie before a space that a visible character follows.

    A pre-token takes at most one space before its characters and white-space runs leave that last space to what
    follows, so no pre-token crosses such a cut.
    """
    parts = text.split(" ")
    if "" not in parts and not any(x[0].isspace() for x in parts):
        return [parts[0], *[" " + x for x in parts[1:]]]
    out = [parts[0]]
    for x in parts[1:]:
        if x and not x[0].isspace():
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return [x for x in out if x]


class Counter:
    """Counts the tokens of texts for one task."""

    def __init__(self, vocabulary: str, whole: frozenset[str], without: frozenset[bytes] = frozenset()):
        import public_tokenizers
        import regex

        self.t, self.whole, self.known = load(vocabulary), whole, {}
        self.split, self.merge = regex.compile(public_tokenizers.PATTERN).findall, bpe.encoder(vocabulary, without)
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]

    def learn(self, pieces: set[str]) -> None:
        """Counts of pieces that are not known yet: whole pre-tokens count directly, the rest is merged.

        Pieces below U+0100 are cut here; all others go through the library, whose pattern may know other letters.
        """
        whole, merge, known, rest = self.whole, self.merge, self.known, []
        for p in pieces:
            if p in whole:
                known[p] = 1
            elif max(p) >= "\u0100" or min(p) < " " and "\x1b" < min(p):
                rest.append(p)
            else:
                known[p] = sum(1 if x in whole else len(merge(x.encode())) for x in self.split(p))
        for p, e in zip(rest, self.t.encode_batch(rest, add_special_tokens=False), strict=True):
            known[p] = len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        out, cut, new = [], [pieces_of(x) if not any(s in x for s in self.special) else None for x in texts], set()
        for p in cut:
            new.update(p or ())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
        self.learn(new - self.known.keys())
        get = self.known.__getitem__
        for text, p in zip(texts, cut, strict=True):
            out.append(sum(map(get, p)) if p is not None else len(self.t.encode(text, add_special_tokens=False).ids))
        return out


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    bpe.require(vocabulary, [], [("ByteLevel", None)])
    whole, without = whole_tokens(vocabulary), bpe.unreachable(vocabulary)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(vocabulary, whole, without)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = counter.counts([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
