"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, as groups.

Texts that agree in their lower-cased words are one node. Operator 4 comes first: the nodes' SimHash fingerprints, here
of five-word shingles, are joined with themselves in the binary trie (simhash.py). Its links are stars, so they are only
candidates: the centre of a star may be unlike a node whose true partner is another node of the star, and at 0.8 some 5 to
13 bits differ, where no trie search can prune. So an exact net follows for all that is not linked yet.

All shingles have one order: the rarer first, by hashed counters that all rows have filled (``rarity``), equal ones by their
hash. Of n shingles the n - ceil(0.8 n) + 1 first are a node's prefix. The counters are a fixed number: shingles that share one
look more frequent than they are, which costs time and never a pair. Two nodes at 0.8 share a shingle of their prefixes, and so many of them
that the rest of either set can make up what their sizes ask for (``enough``); both are theorems, whatever the order is, so
the sample decides on costs only. A sketch of each set, its number of shingles in each of 256 parts, bounds what two sets have
in common and drops most pairs that remain (``possible``). Shingles in one prefix only go at once. First each node meets one pivot of each of its
shingles, which is linear. Where many nodes that share shingles are still apart, rounds follow, also linear: each node meets the
centres of each of its shingles, nodes whose shingles are held by most others and that have most links for it, so that large
groups grow together; they end when a round connects little. Then all nodes that share shingles and are not connected meet, but for those
whose ``odd`` bits already differ in more than similar sets can: this is part of the join's condition, so the join makes no row of them. Every link is verified by the
exact Jaccard similarity of the shingle sets. Only the texts of candidates are shuffled for it: a bitmap of fixed size drops most others where they are read (``marked``).

Two nodes meet only at shingles after whose places in either order enough are left (``ahead``). The first shingle that two
similar nodes have in common is such a one, for all that they have in common lies from there on; so this loses no pair, and
of the smaller node it takes the first ninth of the shingles only (``early``).

So the groups are those of all pairs at a similarity of 0.8 or more; none is left out. Pairs are formed only between
nodes that are not connected yet; where many texts are almost, but not quite, similar to many others that no link connects
with them, their number grows with the product of both.

Defined results: a row is its id and text; null texts are empty; texts without words are copies of each other; shorter
texts than a shingle are one shingle; very long texts are taken whole; a group is all that links connect, and its first
row is the one with the smallest (id, text hash), a null id before all others; repeated rows are one row of the result;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Work, column_bytes, keyed
from lodeseek.llm.components import components
from lodeseek.llm.simhash import LOWER, majority, shingle_hashes
from lodeseek.llm.simhash import links as trie_links

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a shingle's hash that choose its counter; counters in a block.
COUNTER_BITS, BLOCK = 24, 1 << 16
#: Parts of a sketch.
PARTS = 256
#: Bits of odd(), a multiple of 64.
ODD = 512
#: Bits of a row's place in the bitmap of candidates.
MARKS = 24
#: Rounds with centres are made while there are so many pairs a row and the last round ended a tenth of them; centres of a shingle in a round.
CROWD, CENTRES = 4, 4


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of all word shingles, sorted; empty without words."""
    return np.unique(shingle_hashes(data, shingle))


def slot(h: np.ndarray, counters: int) -> np.ndarray:
    """The counter of each hash, of a power of two of them."""
    return (h >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def prefix(h: np.ndarray, rare: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct sorted hashes, in the order of all shingles; rare: a class for each counter, the rarest 0."""
    size = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    return h[np.lexsort((h, rare[slot(h, len(rare))]))[:size]] if len(h) else h


def sketch(h: np.ndarray) -> bytes:
    """How many of the hashes lie in each of PARTS parts, one byte each; 255 stands for more, too."""
    return np.minimum(np.bincount((h % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def odd(h: np.ndarray) -> np.ndarray:
    """For each of ODD parts whether an odd number of the hashes lies in it, as bits of longs. Sets that differ in d hashes differ in at most d of these bits."""
    bits = np.bincount((h >> np.uint64(8)).astype(np.int64) % ODD, minlength=ODD) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def near(x: Column, y: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles with x and y as odd() can be similar: similar ones differ in no more shingles than their sizes allow."""
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, ODD // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return differ <= n + m - 2 * needed(n, m, similarity)


def needed(n: Column, m: Column, similarity: float) -> Column:
    """The least number of common shingles of similar sets of n and m."""
    return F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def enough(common: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles whose prefixes share so many can be similar: no further ones than the rest of one of them can be common."""
    rest = F.ceil(similarity * F.greatest(n, m) - 1e-9) - 1
    return common + rest >= needed(n, m, similarity)


def ahead(i: Column, j: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be similar if all that they have in common lies from the places i and j on."""
    return F.least(n - i, m - j) >= needed(n, m, similarity)


def early(at: Column, n: Column, similarity: float) -> Column:
    """Whether ahead() can hold at the place at of a set of n shingles with any set that is as large or larger."""
    return n - at >= needed(n, n, similarity)


def alike(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can be similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def rarity(rows: DataFrame, bits: int = COUNTER_BITS) -> np.ndarray:
    """For each of 2**bits counters one of 256 classes, by the number of rows that hold a shingle of the counter, the fewest first.

    Each task counts the shingles of its rows; the counts meet block by block and are added up as they come. 2 bytes a counter reach the driver.
    """
    counters, parts = 1 << bits, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = min(BLOCK, counters)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = np.zeros(counters, np.uint32)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(held, slot(shingles(t), counters), np.uint32(1))
        for at in range(0, counters, block):
            # a task tells no more than 255 rows apart; what is more frequent comes last anyway
            part = np.minimum(held[at : at + block], 255).astype(np.uint8)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done() -> pa.RecordBatch:
            coded = np.floor(2048 * np.log2(1.0 + np.minimum(total, 2.0**31))).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([coded.tobytes()], pa.binary())], names=["block", "counts"])

        last, total = None, None
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if at != last:
                    if last is not None:
                        yield done()
                    last, total = at, np.zeros(block, np.int64)
                total += np.frombuffer(data.as_buffer(), np.uint8)
        if last is not None:
            yield done()

    each = rows.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "block int, counts binary")
    coded = np.zeros(counters, np.uint16)
    for at, data in each.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary").collect():  # 2**bits numbers
        coded[at * block : (at + 1) * block] = np.frombuffer(bytes(data), "<u2")
    # a class holds the same share of the counters that are in use, or a single number
    uses = np.bincount(coded, minlength=1 << 16)
    uses[0] = 0
    return (np.cumsum(uses) * 255 // max(1, uses.sum())).astype(np.uint8)[coded]


def prints(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """__ls_k, __ls_t, node (a hash of the words), __ls_f (SimHash fingerprint), n (distinct shingles), prefix, sketch and odd for every row of rows."""
    rare = rows.sparkSession.sparkContext.broadcast(rarity(rows))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            nodes, marks, sizes, all_, parts, odds = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, SHINGLE)
                marks.append(majority(h))
                h = np.unique(h)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(t.translate(LOWER).split()), 42))
                sizes.append(len(h))
                all_.append(prefix(h, rare.value, similarity).view(np.int64))
                parts.append(sketch(h))
                odds.append(odd(h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, marks)), pa.array(sizes, pa.int64()), pa.array(all_, pa.list_(pa.int64())), pa.array(parts, pa.binary()), pa.array(odds, pa.list_(pa.int64()))], names=["__ls_k", "__ls_t", "node", "__ls_f", "n", "prefix", "sketch", "odd"])

    return rows.select("__ls_k", "__ls_t", F.col("text").cast("binary").alias("text")).mapInArrow(run, "__ls_k long, __ls_t long, node long, __ls_f long, n long, prefix array<long>, sketch binary, odd array<long>")


def shared_shingles(each: DataFrame) -> DataFrame:
    """token, node, at (the shingle's place in the node's order): the shingles that are in the prefixes of two nodes or more, once for each node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        # the last row so far, and whether it was handed on
        last, done = np.zeros((3, 0), np.int64), False
        for b in batches:
            x = np.concatenate([last, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)])], axis=1)
            x = x[:, np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(axis=0)])] if x.shape[1] else x
            if not x.shape[1]:
                continue
            same = np.concatenate([[False], x[0, 1:] == x[0, :-1], [False]])
            hand = same[1:] | same[:-1]
            if done:
                hand[0] = False
            done = bool(hand[-1]) or (done and x.shape[1] == 1)
            last = x[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(c[hand]) for c in x], names=["token", "node", "at"])

    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = each.select(F.posexplode("prefix").alias("at", "token"), "node").select("token", "node", F.col("at").cast("long").alias("at"))
    return rows.repartition(parts, "token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, at long")


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose (__ls_k, __ls_t) is not in wanted, by a bitmap of 2**MARKS bits, which reaches the driver. Buckets of bits, and bits in Spark's functions, begin with 1."""
    place = F.pmod(F.xxhash64("__ls_k", "__ls_t"), F.lit(1 << MARKS))
    some = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((1 << MARKS) // 8, np.uint8)
    for b, data in some.collect():  # 2**MARKS bits
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(data), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.where(held(place))


def candidate_texts(shared: DataFrame, nodes: DataFrame, rows: DataFrame, work: Work, i: int) -> DataFrame:
    """node and text of the nodes in shared."""
    first = nodes.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.col("first.__ls_k").alias("__ls_k"), F.col("first.__ls_t").alias("__ls_t"))
    first = work.table(first, f"wanted-{i}")
    return marked(rows, first).join(first.hint("merge"), ["__ls_k", "__ls_t"]).select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a").select("a", "b", "x", "y")

    def run(batches: Iterator) -> Iterator:
        last, seen = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, seen = a, shingles(x.as_py())
                keep.append(jaccard(seen, shingles(y.as_py())) >= similarity)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sketches leave room for so many common shingles."""
    end = lambda name, n, x: nodes.select(F.col("node").alias(name), F.col("n").alias(n), F.col("sketch").alias(x)).hint("merge")
    both = pairs.join(end("a", "na", "x"), "a").join(end("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            x, y = (np.frombuffer(column_bytes(batch.column(i))[0], np.uint8).reshape(-1, PARTS) for i in (4, 5))
            need = np.ceil((batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (similarity / (1 + similarity)) - 1e-9)
            keep = (np.minimum(x, y).sum(axis=1, dtype=np.int64) >= need) | (x == 255).any(axis=1) | (y == 255).any(axis=1)
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def trie_pairs(nodes: DataFrame, work: Work) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints operator 4 links: with one fingerprint, or within its bits in the trie; as stars."""
    firsts = work.table(nodes.groupBy("__ls_f").agg(F.min("node").alias("first")), "prints-f")
    same = nodes.select("node", "__ls_f").join(firsts.hint("merge"), "__ls_f").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda name, f: firsts.select(F.col("__ls_f").alias(f), F.col("first").alias(name)).hint("merge")
    near = trie_links(firsts, work).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(end("a", "fa"), "fa").join(end("b", "fb"), "fb").select("a", "b")
    return work.table(same.unionByName(near), "pairs-f")


def end(*names: str) -> list[Column]:
    """node, n, at and root under these names."""
    return [F.col(x).alias(name) for x, name in zip(("node", "n", "at", "root"), names, strict=True)]


def meetings(sides: DataFrame, similarity: float) -> DataFrame:
    """a, na, i, b, nb, j for each shingle that nodes of sides (token, node, n, at, root, odd) share which are not connected and can be similar by odd(); the smaller node, or the first of equal ones, is a."""
    one = sides.where(early(F.col("at"), F.col("n"), similarity)).select("token", *end("a", "na", "i", "ra"), F.col("odd").alias("x"))
    both = one.join(sides.select("token", *end("b", "nb", "j", "rb"), F.col("odd").alias("y")).hint("merge"), "token")
    both = both.where("ra <> rb and (na < nb or na = nb and a < b)")
    return both.where(alike(F.col("na"), F.col("nb"), similarity) & near(F.col("x"), F.col("y"), F.col("na"), F.col("nb"), similarity)).select("a", "na", "i", "b", "nb", "j")


def meeting(both: DataFrame, similarity: float) -> DataFrame:
    """Those rows of both (a, na, i, b, nb, j for a shingle that a and b have in common) that leave room for similar nodes."""
    n, m = F.col("na"), F.col("nb")
    return both.where(alike(n, m, similarity) & ahead(F.col("i"), F.col("j"), n, m, similarity))


def counted(met: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of met, the rows meeting() leaves of all common shingles, that can be similar.

    Where ahead() fails, it fails at all later ones. So the rows are the first common shingles, and all others lie after the last of them in either order.
    """
    n, m = F.col("na"), F.col("nb")
    some = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("x"), F.max("i").alias("i"), F.max("j").alias("j"))
    return some.where(F.col("x") + F.least(n - F.col("i"), m - F.col("j")) - 1 >= needed(n, m, similarity)).select("a", "b")


def torn_apart(rows: DataFrame, roots: DataFrame, work: Work, i: int) -> DataFrame:
    """Those of rows (token, node, at, n) whose shingle is in nodes that are not connected, with root and held, the number of nodes with the shingle."""
    named = rows.join(roots.select("node", "root").hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = work.table(named, "rooted")
    torn = work.table(named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("token", "held"), "torn")
    apart = work.table(named.join(torn.hint("merge"), "token"), f"apart-{i}")
    work.drop("rooted", "torn")
    work.tidy()
    return apart


def crowd(apart: DataFrame, similarity: float) -> tuple[int, int]:
    """The number of rows, and of pairs of a row that is early and another one with its shingle that is not connected with it."""
    c, e = F.col("c"), F.col("e")
    each = apart.groupBy("token", "root").agg(F.count("*").alias("c"), F.count_if(early(F.col("at"), F.col("n"), similarity)).alias("e"))
    each = each.groupBy("token").agg(F.sum(c).alias("c"), (F.sum(c) * F.sum(e) - F.sum(c * e)).alias("pairs"))
    got = each.agg(F.sum("c"), F.sum("pairs")).first()
    return got[0] or 0, got[1] or 0


def centres(apart: DataFrame, tested: list[DataFrame], work: Work, i: int) -> DataFrame:
    """token, node, n, at, root: at most CENTRES nodes for each shingle that were no centres before, whose shingles of apart are held by most nodes."""
    weight = apart.groupBy("node").agg(F.sum("held").alias("weight"))
    for t in tested:
        weight = weight.join(t.select("node").distinct().hint("merge"), "node", "left_anti")
    some = apart.join(weight.hint("merge"), "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(i)), F.lit(CENTRES)))
    best = some.groupBy("token", "part").agg(F.max_by(F.struct("node", "n", "at", "root"), F.struct("weight", "node")).alias("p"))
    return work.table(best.select("token", "p.*"), f"centres-{i}")


def joined(roots: DataFrame, more: DataFrame, work: Work, i: int) -> DataFrame:
    """roots after the links more (a, b): what is linked so far, as stars that need no further rounds, and the rest."""
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), work, f"components-{i}")
    work.tidy()
    return roots


def links(nodes: DataFrame, each: DataFrame, rows: DataFrame, work: Work, similarity: float) -> DataFrame:
    """(node, root) for each node that is linked to a smaller one; each: prints() of all rows, nodes: one row for each node."""
    near = trie_pairs(nodes, work)
    work.tidy()
    shared = work.table(shared_shingles(each).join(nodes.select("node", "n").hint("merge"), "node"), "shared")
    work.tidy()
    # each node with one pivot of each of its shingles; the aggregate combines before its shuffle and is written, so the join has two plain shuffles, which Spark can split
    pivots = work.table(shared.groupBy("token").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("p")), "pivots")
    met = shared.join(pivots.hint("merge"), "token").where("node <> p.node").where(alike(F.col("n"), F.col("p.n"), similarity))
    met = met.groupBy("node", "n", "p").agg(F.count("*").alias("x")).where(enough(F.col("x"), F.col("n"), F.col("p.n"), similarity))
    first = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")))

    def linked(pairs: DataFrame, i: int) -> DataFrame:
        """Those of pairs that are similar."""
        pairs = work.table(possible(pairs, nodes, similarity), f"pairs-{i}")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        texts = work.table(candidate_texts(ends, nodes, rows, work, i), f"texts-{i}")
        work.tidy()
        found = work.table(verified(pairs, texts, similarity), f"found-{i}")
        work.drop(f"texts-{i}", f"wanted-{i}")
        work.tidy()
        return found

    roots = components(linked(first.distinct(), 0), work, "components-0")
    work.drop("prints-f", "pairs-f", "pivots")
    work.tidy()
    apart = torn_apart(shared, roots, work, 0)
    work.drop("shared")
    # while very many pairs are apart: with the centres of each shingle
    i, before, tested = 0, 0, []
    while True:
        count, pairs = crowd(apart, similarity)
        if pairs <= CROWD * count or (before and pairs > 0.9 * before):
            break
        i, before = i + 1, pairs
        tested.append(centres(apart, tested, work, i))
        met = apart.select("token", *end("a", "na", "i", "ra")).join(tested[-1].select("token", *end("b", "nb", "j", "rb")).hint("merge"), "token").where("ra <> rb")
        met = meeting(met, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        roots = joined(roots, linked(met, i), work, i)
        apart = torn_apart(apart.select("token", "node", "at", "n"), roots, work, i)
        work.drop(f"apart-{i - 1}")
    # all others that share shingles and are not connected, the smaller node first
    sides = work.table(apart.join(nodes.select("node", "odd").hint("merge"), "node"), "sides")
    work.drop(f"apart-{i}")
    work.tidy()
    both = meeting(meetings(sides, similarity), similarity)
    more = linked(counted(both, similarity), i + 1)
    return roots if more.isEmpty() else joined(roots, more, work, i + 1)


def first_of_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """__ls_k, __ls_t (of keyed()) of every distinct row of docs (doc_id, text), and first: those of its group's first row."""
    work = Work(docs.sparkSession, "near-copies")
    rows = keyed(docs).select("__ls_k", "__ls_t", "text")
    each = work.table(prints(rows, similarity), "prints")
    nodes = work.table(each.groupBy("node").agg(F.min(F.struct("__ls_k", "__ls_t")).alias("first"), F.any_value("__ls_f").alias("__ls_f"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("odd").alias("odd")), "nodes")
    roots = links(nodes, each, rows, work, similarity)
    member = work.table(nodes.select("node", "first").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "member")
    best = member.groupBy("root").agg(F.min("first").alias("first"))
    named = member.select("node", "root").join(best.hint("merge"), "root").select("node", "first")
    got = work.table(each.select("__ls_k", "__ls_t", "node").distinct().join(named.hint("merge"), "node").select("__ls_k", "__ls_t", "first"), "named")
    work.drop(*(x for x in work.names() if x != "named"))
    work.tidy()
    return got
