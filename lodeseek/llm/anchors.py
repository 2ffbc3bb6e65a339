"""Windows of a fixed number of units (bytes or words), found again anywhere in the corpus by their anchors.

The *anchor* of a window is the leftmost of its grams (runs of ``gram`` units) with the smallest hash. Equal windows
have equal anchors at equal places, so every window can be stored under its anchor's hash, and the windows of a
document that share an anchor form one *run*: (hash, first window, last window, place of the anchor). There is about
one run for every half span of grams, which makes the index a few per cent of the windows.

Windows can only be equal within the rows of one hash: whatever compares them, byte by byte, does so there. Hashes
with more than ``MOST`` runs are not gathered: their windows are told apart by their own bytes, first where they are
read, and of what is still open one of each is dealt out, with its bytes, by a hash of these bytes; there bytes are
compared again. So on either way only equal bytes make windows equal, and hashes only say where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Work, column_bytes, mix64

#: Runs of one hash that a task may gather.
MOST = 4096
#: Units that are hashed at a time.
SEGMENT = 1 << 18
#: Bytes of regions that are compared at a time, in whole groups.
TOGETHER = 6 << 20
#: Windows of hot hashes in a bucket.
BUCKET = 100_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 2**64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hasher:
    """Hashes of runs of units, from prefix sums of a polynomial."""

    def __init__(self):
        self.up, self.down = _powers(1 << 10)
        self.of_byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def prefix(self, units: np.ndarray) -> np.ndarray:
        n = len(units)
        if n + 1 > len(self.up):
            self.up, self.down = _powers(2 * n + 2)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(units * self.up[:n], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mix64((prefix[k:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self.prefix(self.of_byte[data])
        return mix64((p[ends] - p[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def leftmost_min(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the smallest of width values from there on, and how far off the leftmost of them is."""
    m, off, size = h, np.zeros(len(h), np.int32), 1
    while size * 2 <= width:
        take = m[size:] < m[:-size]
        off = np.where(take, off[size:] + np.int32(size), off[:-size])
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n, far = len(h) - width + 1, width - size
    take = m[far : far + n] < m[:n]
    return np.minimum(m[:n], m[far : far + n]), np.where(take, off[far : far + n] + np.int32(far), off[:n])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text."""
    black = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(black[1:] != black[:-1])
    return edge[::2], edge[1::2]


def units_of(hasher: Hasher, data: np.ndarray, words: bool) -> np.ndarray:
    return hasher.words(data, *word_spans(data)) if words else hasher.of_byte[data]


def runs(hasher: Hasher, texts: list[tuple[int, np.ndarray]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, hash, first window, last window, anchor) of every run of the texts, given as units."""
    width, out, part, size = window - gram + 1, [], [], 0

    def flush() -> None:
        nonlocal part, size
        if not part:
            return
        units = np.concatenate([u for _, _, u in part])
        h, off = leftmost_min(hasher.grams(hasher.prefix(units), gram), width)
        lengths = np.array([len(u) for _, _, u in part], np.int64)
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(part)), lengths)[: len(h)]
        at = np.arange(len(h), dtype=np.int64)
        fine = at - begins[owner] <= (lengths - window)[owner]  # the window ends in its own text
        anchor = at + off
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (fine[1:] != fine[:-1])])
        lo = np.flatnonzero(first)
        hi = np.concatenate([lo[1:], [len(h)]]) - 1
        ok = fine[lo]
        lo, hi = lo[ok], hi[ok]
        who = owner[lo]
        number = np.array([i for i, _, _ in part], np.int64)[who]
        shift = np.array([s for _, s, _ in part], np.int64)[who] - begins[who]
        out.append((number, h[lo].view(np.int64), lo + shift, hi + shift, anchor[lo] + shift))
        part, size = [], 0

    for i, units in texts:
        for s in range(0, len(units) - window + 1, SEGMENT):  # a segment's windows reach into the next one
            piece = units[s : s + SEGMENT + window - 1]
            part.append((i, s, piece))
            size += len(piece)
            if size >= SEGMENT:
                flush()
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find_runs(docs: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """__ls_k, __ls_t, h, lo, hi, a for every run of docs (__ls_k, __ls_t, text as binary)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = Hasher()
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                data, offsets = column_bytes(part.column(2))
                at = offsets.tolist()
                texts = ((i, units_of(hasher, data[at[i] : at[i + 1]], words)) for i in range(part.num_rows) if at[i + 1] - at[i] >= window)
                who, h, lo, hi, a = runs(hasher, texts, window, gram)
                k, t = (part.column(c).to_numpy(zero_copy_only=False)[who] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, t, h, lo.astype(np.int32), hi.astype(np.int32), a.astype(np.int32))], names=["__ls_k", "__ls_t", "h", "lo", "hi", "a"])

    return docs.select("__ls_k", "__ls_t", "text").mapInArrow(scan, "__ls_k long, __ls_t long, h long, lo int, hi int, a int")


def intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def list_column(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """An Arrow column of lists of structs as offsets and the structs' fields."""
    offsets = column.offsets.to_numpy()
    values = column.values
    return offsets, [values.field(i).to_numpy(zero_copy_only=False) for i in range(values.type.num_fields)]


def repeated_windows(docs: DataFrame, found: DataFrame, counts: DataFrame, window: int, words: bool, compare: Callable, open_rule: str, work: Work) -> DataFrame:
    """Per document with any: __ls_k, __ls_t, spans (array of struct<lo, hi>): its windows that are to go.

    docs: __ls_k, __ls_t, text (binary). found: the runs. counts: h and n, the hashes whose windows are to be compared.
    compare(number, k, t, lo, n, off, regions): flags for each window of the regions of whole hashes.
    open_rule: "other" (a window goes if it occurs anywhere else) or "smaller" (if it occurs under a smaller key).
    """
    spark = docs.sparkSession
    chosen = found.join(counts.select("h", (F.col("n") > MOST).alias("hot")).hint("merge"), "h")
    per_doc = work.table(chosen.groupBy("__ls_k", "__ls_t").agg(F.collect_set(F.struct("h", "lo", "hi", "a", "hot")).alias("runs")), "per-doc")
    work.tidy()
    n_hot = counts.where(F.col("n") > MOST).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(n_hot) * (window // 2) // BUCKET))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["kind", "h", "__ls_k", "__ls_t", "lo", "n", "off", "region"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

        def rows(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        hot: list[tuple] = []
        n_open = 0

        def settle() -> Iterator:
            """Hot windows: those that this task can decide go out as kind 1, one of each open one, in packed rows, as kind 2."""
            import xxhash

            nonlocal hot, n_open
            if not hot:
                return
            contents = [c for part in hot for c in part[0]]
            k, t, s = (np.concatenate([part[i] for part in hot]) for i in (1, 2, 3))
            hot, n_open = [], 0
            gone, (left, many) = decide(numbers_of(contents), k, t, s, np.zeros(len(contents), bool), open_rule)
            yield rows([(1, 0, kk, tt, ss, n, 0, b"") for kk, tt, ss, n in starts_as_runs(k[gone], t[gone], s[gone])])
            bucket = np.fromiter((xxhash.xxh64_intdigest(contents[i]) % buckets for i in left.tolist()), np.int64, len(left))
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    at = left[part]
                    blob = packed_windows(k[at], t[at], s[at], many[part], [contents[i] for i in at.tolist()])
                    yield rows([(2, int(bucket[part[0]]), 0, 0, 0, len(part), 0, blob)])

        for b in batches:
            offsets, (h, lo, hi, a, is_hot) = list_column(b.column(3))
            ks, ts, out, size = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0
            for i, text in enumerate(b.column(2)):
                data = text.as_buffer().to_pybytes()
                where = range(offsets[i], offsets[i + 1])
                tokens = data.split() if words else []
                cold = [j for j in where if not is_hot[j]]
                for j in cold:
                    first, last = int(lo[j]), int(hi[j])
                    region = b" ".join(tokens[first : last + window]) if words else data[first : last + window]
                    out.append((0, int(h[j]), ks[i], ts[i], first, last - first + 1, int(a[j]) - first, region))
                    size += len(region)
                for j in where if len(cold) < len(where) else ():
                    if is_hot[j]:
                        s = np.arange(int(lo[j]), int(hi[j]) + 1)
                        contents = [b" ".join(tokens[w : w + window]) if words else data[w : w + window] for w in s.tolist()]
                        hot.append((contents, np.full(len(s), ks[i], np.int64), np.full(len(s), ts[i], np.int64), s))
                        n_open += len(s)
                        if n_open >= BUCKET:
                            yield from settle()
                if size >= 4 << 20:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)
        yield from settle()

    regions = docs.select("__ls_k", "__ls_t", "text").join(per_doc.hint("merge"), ["__ls_k", "__ls_t"]).select("__ls_k", "__ls_t", "text", "runs")
    regions = work.table(regions.mapInArrow(cut, "kind int, h long, __ls_k long, __ls_t long, lo int, n int, off int, region binary"), "regions")
    work.tidy()

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        size, last = 0, None

        def run(parts: list) -> pa.RecordBatch:
            h, k, t, lo, n, off = (np.concatenate([p[c] for p in parts]) for c in range(6))
            texts = [x for p in parts for x in p[6]]
            number = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
            flags = compare(number, k, t, lo, n, off, texts)  # one flag for each window, region after region
            begins = np.cumsum(n) - n
            # a place between regions keeps their windows apart
            wide = np.zeros(len(flags) + len(n), bool)
            region = np.repeat(np.arange(len(n)), n)
            wide[np.arange(len(flags)) + region] = flags
            first, end = intervals(wide)
            who = np.searchsorted(begins + np.arange(len(n)), first, "right") - 1
            base = begins[who] + who
            return pa.RecordBatch.from_arrays([pa.array(k[who]), pa.array(t[who]), pa.array((first - base + lo[who]).astype(np.int32)), pa.array((end - base + lo[who]).astype(np.int32))], names=["__ls_k", "__ls_t", "lo", "hi"])

        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            texts = b.column(6).to_pylist()
            h = columns[0]
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            starts = [0, *cuts.tolist(), len(h)]
            for s, e in zip(starts, starts[1:], strict=False):
                if s == e:
                    continue
                if held and h[s] != last and size >= TOGETHER:
                    yield run(held)
                    held, size = [], 0
                held.append([c[s:e] for c in columns] + [texts[s:e]])
                size += sum(map(len, texts[s:e]))
                last = h[s]
        if held:
            yield run(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = regions.where("kind = 0").select("h", "__ls_k", "__ls_t", "lo", "n", "off", "region")
    gone = cold.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(gather, "__ls_k long, __ls_t long, lo int, hi int")
    if n_hot:

        def resolve(pdf):
            import pandas as pd

            held = [unpacked_windows(blob, int(n)) for blob, n in zip(pdf["region"], pdf["n"], strict=True)]
            k, t, s, many = (np.concatenate([x[i] for x in held]) for i in range(4))
            gone, _ = decide(numbers_of([c for x in held for c in x[4]]), k, t, s, many, open_rule)
            gone &= ~many
            # a bucket has windows from all over a document: one row for each document, not for each window
            out: dict[tuple[int, int], list[dict]] = {}
            for kk, tt, ss, n in starts_as_runs(k[gone], t[gone], s[gone]):
                out.setdefault((kk, tt), []).append({"lo": ss, "hi": ss + n - 1})
            return pd.DataFrame({"__ls_k": pd.Series([kk for kk, _ in out], dtype="int64"), "__ls_t": pd.Series([tt for _, tt in out], dtype="int64"), "spans": pd.Series(list(out.values()), dtype="object")})

        opened = regions.where("kind = 2").select("h", "n", "region").groupBy("h").applyInPandas(resolve, "__ls_k long, __ls_t long, spans array<struct<lo:int,hi:int>>")
        near = regions.where("kind = 1").select("__ls_k", "__ls_t", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
        gone = gone.unionByName(near)
    gone = gone.select("__ls_k", "__ls_t", F.array(F.struct("lo", "hi")).alias("spans"))
    gone = gone.unionByName(opened) if n_hot else gone
    spans = work.table(gone.groupBy("__ls_k", "__ls_t").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    work.drop("per-doc", "regions")
    work.tidy()
    return spans


def numbers_of(contents: list[bytes]) -> np.ndarray:
    """A number for each window; windows have one number only if their bytes are equal."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(c, len(names)) for c in contents), np.int64, len(contents))


def packed_windows(k: np.ndarray, t: np.ndarray, s: np.ndarray, many: np.ndarray, contents: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, contents), np.int32, len(contents))
    return b"".join((*(x.astype(np.int64).tobytes() for x in (k, t, s)), many.astype(np.uint8).tobytes(), lengths.tobytes(), *contents))


def unpacked_windows(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    k, t, s = (np.frombuffer(blob, np.int64, n, 8 * n * i) for i in range(3))
    many = np.frombuffer(blob, np.uint8, n, 24 * n).astype(bool)
    ends = (29 * n + np.cumsum(np.frombuffer(blob, np.int32, n, 25 * n), dtype=np.int64)).tolist()
    return k, t, s, many, [blob[a:z] for a, z in zip([29 * n, *ends[:-1]], ends, strict=True)]


def decide(x: np.ndarray, k: np.ndarray, t: np.ndarray, s: np.ndarray, many: np.ndarray, rule: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Windows of number x at (k, t, s): which of them go, and (places, flags) of those that stand for the open ones.

    many marks a row that stands for several windows which went already (rule "other").
    """
    order = np.lexsort((k, x))
    new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    group = np.cumsum(new) - 1
    first = order[new]
    gone = np.zeros(len(x), bool)
    if rule == "other":
        # copies of a row (same key and place) stand for their document's other copies, so they count
        size = np.bincount(group)
        several = size > 1
        gone[order] = several[group]
        return gone, (first, several | many[first])
    least = k[first][group]
    gone[order] = k[order] > least
    left = order[k[order] == least]
    return gone, (left, np.zeros(len(left), bool))


def starts_as_runs(k: np.ndarray, t: np.ndarray, s: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(k, t, first start, number of starts) of consecutive starts."""
    if not len(k):
        return
    order = np.lexsort((s, t, k))
    k, t, s = k[order], t[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)]))
    end = np.concatenate([new[1:], [len(k)]]) - 1
    yield from zip(k[new].tolist(), t[new].tolist(), s[new].tolist(), (s[end] - s[new] + 1).tolist(), strict=True)
