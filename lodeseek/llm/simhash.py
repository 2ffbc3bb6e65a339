"""SimHash near-duplicates: a binary trie of fingerprints, joined with itself.

Texts become 64-bit fingerprints; each distinct fingerprint enters once. Two fingerprints that differ in at most 4
bits agree wholly in at least two of six parts of their bits. So the trie is dealt out fifteen times, once for each
pair of parts: fingerprints with one value of the pair are a trie of their own, with their bits in the order of the
fingerprint, and pairs that differ there meet in another dealing. In a trie, pairs of nodes go down together, one bit a step; the
bits in which they differ are added up and a pair over the error budget is dropped, as is a pair whose fingerprints
are all linked already. Before that, neighbours in eight rotated sorts of a group that lie within the budget are linked, which
connects most groups at once; the trie then finds every link that is still missing, so the components are the same with
or without these sorts. Small pairs are compared directly. What a subtrie yields is a star per group, so a group of n
near copies gives n links, not n * n. Subtries over ``most`` fingerprints are cut into chunks and every pair of
chunks is joined by a task of its own. Components of the links are found by large-star and small-star rounds.

Defined results: null and empty texts and texts without words have fingerprint 0, linked like any other; shorter texts
than a shingle are one shingle; a null doc_id is the smallest id (its component_id is null), and so is a doc_id of
-2**63, which is shown as null; repeated rows each give a row; very long texts are taken whole, their bits counted
65,536 shingles at a time; ties cannot arise, as a component has one smallest id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import NULL_ID, Work, id_key
from lodeseek.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Sizes of the six parts, from the highest bit.
PARTS = (11, 11, 11, 11, 10, 10)
MOST = 4096
#: Fingerprints that are joined at a time, in whole subtries.
TOGETHER = 60_000
#: Node pairs that go down together.
FRONT = 400_000


def shingle_hashes(data: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included; of all words, if they are fewer; nothing without words."""
    import xxhash

    words = data.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    cut = map(slice, starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, cut), repeat(seed)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    lanes = h.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(lanes[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(data, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """__ls_k (id_key) and __ls_f (the fingerprint as a signed long) for every row of docs (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            f = np.fromiter((fingerprint(t or b"", shingle, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["__ls_k", "__ls_f"])

    return docs.select(id_key().alias("__ls_k"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "__ls_k long, __ls_f long")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links (a, b): the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def trie_links(group: np.ndarray, bits: np.ndarray, budget: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all fingerprints of one group within budget bits of each other; as stars.

    group and bits (uint64) are sorted by (group, bits); a group is a trie of its own.
    """
    n = len(bits)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # neighbours in the sorted order, for this and for rotated bits: links that most groups need
    a, b = [], []
    for turn in range(0, 64, 8):
        t = np.uint64(turn)
        turned = bits if not turn else (bits << t) | (bits >> np.uint64(64 - turn))
        o = np.lexsort((turned, group))
        for gap in (1, 2):
            p, q = o[:-gap], o[gap:]
            ok = (group[p] == group[q]) & (np.bitwise_count(bits[p] ^ bits[q]) <= budget)
            a.append(p[ok])
            b.append(q[ok])
    a, b = [np.concatenate(a)], [np.concatenate(b)]
    label = least_labels(n, a[0], b[0])
    pending = 0
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    def settle() -> None:
        nonlocal label, changes, pending, a, b
        a, b = [np.concatenate(a)], [np.concatenate(b)]
        label = least_labels(n, a[0], b[0])
        keep = np.flatnonzero(label != np.arange(n))
        a, b, pending = [keep], [label[keep]], 0
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    settle()
    ones: dict[int, np.ndarray] = {}

    def middle(level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum(bits >> np.uint64(63 - level) & np.uint64(1))]).astype(np.int32)
        c = ones[level]
        return high - (c[high] - c[low])

    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    low, high = edges[:-1], edges[1:]
    more = high - low > 1
    low, high = low[more], high[more]
    stack = [(0, low, high, low, high, np.zeros(len(low), np.int8))]
    while stack:
        level, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack += [(level, *(x[:half] for x in (al, ah, bl, bh, err))), (level, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        # pairs whose fingerprints are linked already
        linked = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (label[al] == label[bl])
        al, ah, bl, bh, err = (x[~linked] for x in (al, ah, bl, bh, err))
        small = ((ah - al) * (bh - bl) <= 32) | (level == 64)
        if small.any():
            sal, sbl, w = al[small], bl[small], (bh - bl)[small]
            m = (ah - al)[small] * w
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(w, m)
            p, q = np.repeat(sal, m) + inside // wide, np.repeat(sbl, m) + inside % wide
            ok = (p != q) & (np.bitwise_count(bits[p] ^ bits[q]) <= budget)
            ok &= label[p] != label[q]
            a.append(p[ok])
            b.append(q[ok])
            pending += int(ok.sum())
            if pending > 100_000:
                settle()
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm = middle(level, al, ah), middle(level, bl, bh)
        same = (al == bl) & (ah == bh)
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1)]
        children.append(tuple(x[~same] for x in (am, ah, bl, bm, err + 1)))
        c = [np.concatenate(x) for x in zip(*children, strict=True)]
        ok = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= budget)
        stack.append((level + 1, *(x[ok] for x in c)))
    settle()
    return a[0], b[0]


def links(distinct: DataFrame, work: Work, budget: int = 4, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints __ls_f, enough to connect all within budget bits."""
    spark = distinct.sparkSession
    ends = np.cumsum(PARTS).tolist()
    # a part as a number: shift to the right, then the low bits
    part = [F.shiftrightunsigned(F.col("__ls_f"), 64 - e).bitwiseAND((1 << s) - 1) for e, s in zip(ends, PARTS, strict=True)]
    keys = F.array(*[F.lit(i).cast("long") * (1 << 22) + F.shiftleft(part[x], PARTS[y]) + part[y] for i, (x, y) in enumerate(combinations(range(6), 2))])
    dealt = distinct.select("__ls_f", F.explode(keys).alias("key"))
    hot = work.table(dealt.groupBy("key").count().where(F.col("count") > most), "hot")
    if hot.isEmpty():
        dealt = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        wide = dealt.join(hot, "key", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("count") / most), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("__ls_f", F.lit(3)), F.col("chunks")).cast("int")
        wide = wide.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = wide.select("__ls_f", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def run(key: np.ndarray, f: np.ndarray):
            # the bits in the order of this key: its two parts first; within a group they are all equal
            order = np.lexsort((f, key))
            key, f = key[order], f[order]
            a, b = trie_links(key, f, budget)
            return pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], names=["a", "b"])

        rest: tuple = (np.zeros((0, 3), np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            k, f = np.concatenate([rest[0], k]), np.concatenate([rest[1], batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
            cut = starts[-1] if len(starts) else 0
            if cut >= TOGETHER:
                number = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).any(axis=1)]))
                yield run(number[:cut], f[:cut])
                k, f = k[cut:], f[cut:]
            rest = (k, f)
        k, f = rest
        if len(f):
            yield run(np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).any(axis=1)])), f)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.select("key", "i", "j", "__ls_f").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, budget: int = 4, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text)."""
    work = Work(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, shingle, seed), "prints")
    firsts = work.table(prints.groupBy("__ls_f").agg(F.min("__ls_k").alias("first")), "firsts")
    found = work.table(links(firsts, work, budget, most), "links")
    roots = components(found, work)
    # the smallest id of a component, by its root fingerprint
    member = firsts.join(roots.withColumnRenamed("node", "__ls_f"), "__ls_f", "left").withColumn("root", F.coalesce("root", "__ls_f"))
    member = work.table(member, "member")
    best = member.groupBy("root").agg(F.min("first").alias("best"))
    named = work.table(member.join(best, "root").select("__ls_f", "best"), "named")
    got = prints.join(named, "__ls_f")
    null = F.lit(NULL_ID)
    return got.select(F.nullif("__ls_k", null).alias("doc_id"), F.lower(F.lpad(F.hex("__ls_f"), 16, "0")).alias("fingerprint"), F.nullif("best", null).alias("component_id"))
