"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Random indexing: every word has a sparse ternary index vector that a hash gives; a word's vector is its own index
vector plus the index vectors of its neighbours in the training texts. Words that training never saw have the vector
of their *shape* (case, punctuation, repetition), learned the same way, so scores need no vocabulary of the corpus.
A document's vector is the mean and the spread of its words' vectors. The network's logits are divided by a
temperature fitted on rows that training left out, so the scores are probabilities.

Training takes a bounded sample of labelled rows (``sample``, the rows with the smallest hash of their id) on the
driver; texts over ``longest`` bytes are left out of training only. Scoring is one narrow pass over whole texts.

Defined results: null and empty texts get the score of a document without words; rows without labels are scored
like all others; null doc_id is never a training row and counts as held out or not by the crc32 of ''; repeated rows
each give a row; without usable labels of both kinds every score is the share of label 1 (0.5 without any); empty
tables give empty results; very long texts are scored whole, 512 rows at a time; equal scores need no order; further
columns, whatever their names, are carried along by scored() and ignored otherwise. A word's shape is taken from its
first 24 characters (the word's own vector, where training knew it, from all of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import ship

SAMPLE, LONGEST, DIM, HIDDEN, WINDOW = 4_000, 30_000, 64, 32, 2
#: Words whose vectors a task remembers; at the limit it starts anew.
REMEMBERED = 200_000


def held_out_column(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def index_vector(word: str, dim: int = DIM) -> np.ndarray:
    """Eight entries of +1 or -1 at places that a hash gives."""
    import xxhash

    v = np.zeros(dim, np.float32)
    h = xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass"))
    for i in range(8):
        v[(h >> (12 * i)) % dim] += 1 if h >> (12 * i + 11) & 1 else -1
    return v


def shape(word: str) -> str:
    """Case and punctuation with runs of equal classes shortened, and a rough length."""
    out = ""
    for c in word[:24]:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return f"\0{out[:8]}:{min(len(word), 12) // 4}"


class Model:
    """Word vectors and network; small and of fixed size: at most ``words`` vectors."""

    def __init__(self, vectors: dict[str, np.ndarray], mean, scale, w1, b1, w2, b2, temperature: float, base: float):
        self.vectors, self.mean, self.scale = vectors, mean, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature, self.base = w1, b1, w2, b2, temperature, base

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.base)
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


class Pool:
    """Documents' vectors: mean and spread of word vectors, the share of repeated words and of distinct words."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.vectors, self.known, self.rows = vectors, {}, np.zeros((1024, DIM), np.float32)

    def number(self, word: str) -> int:
        i = self.known[word] = len(self.known)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        v = self.vectors.get(word)
        if v is None:
            s = shape(word)
            v = self.vectors.get(s)
            v = index_vector(s) if v is None else v
        self.rows[i] = v
        return i

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, np.zeros((1024, DIM), np.float32)
        out = np.zeros((len(texts), 2 * DIM + 3), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            get = self.known.get
            ids = np.fromiter((k if (k := get(w)) is not None else self.number(w) for w in words), np.int64, len(words))
            part = [self.rows[ids[s : s + 50_000]] for s in range(0, len(ids), 50_000)]
            mean = sum(p.sum(axis=0, dtype=np.float64) for p in part) / len(ids)
            square = sum(np.einsum("ij,ij->j", p, p, dtype=np.float64) for p in part) / len(ids)
            out[i, :DIM], out[i, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square - mean**2, 0))
            out[i, 2 * DIM :] = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0, len(np.unique(ids)) / len(ids), np.log1p(len(ids)) / 10
        return out


def word_vectors(texts: list[str], window: int, most: int) -> dict[str, np.ndarray]:
    """Random indexing over the training texts: for words seen in at least three of them, and for every shape."""
    from collections import Counter

    seen: Counter = Counter()
    for t in texts:
        seen.update(set(t.split()))
    keep = [w for w, n in seen.most_common(most) if n >= 3]
    names: dict[str, int] = {w: i for i, w in enumerate(keep)}
    shapes: dict[str, str] = {}
    units: dict[str, int] = {}
    index: list[np.ndarray] = []
    runs = []
    for t in texts:
        ids, own = [], []
        for w in t.split():
            s = shapes.get(w) or shapes.setdefault(w, shape(w))
            names.setdefault(s, len(names))
            unit = w if w in names else s
            if unit not in units:
                units[unit] = len(units)
                index.append(index_vector(unit))
            ids.append(units[unit])
            own.append((names.get(w, -1), names[s]))
        runs.append((ids, own))
    table = np.array(index, np.float32).reshape(-1, DIM)
    total, count = np.zeros((len(names), DIM), np.float32), np.zeros(len(names), np.float32)
    for ids, own in runs:
        if not ids:
            continue
        v = table[ids]
        around = np.zeros_like(v)
        for k in range(1, window + 1):
            around[k:] += v[:-k] if len(v) > k else 0
            around[:-k] += v[k:] if len(v) > k else 0
        pair = np.array(own)
        for c in (0, 1):
            ok = pair[:, c] >= 0
            np.add.at(total, pair[ok, c], around[ok])
            np.add.at(count, pair[ok, c], 1)
    by = list(names)
    return {w: (index_vector(w) + total[i] / max(count[i], 1) / window).astype(np.float32) for w, i in zip(by, range(len(by)), strict=True)}


def fit(rows: list[tuple[str, int]], window: int = WINDOW, most: int = 20_000, epochs: int = 60, seed: int = 11) -> Model:
    """Trains on (text, label) rows: 80 % for the network, 20 % for the temperature."""
    y = np.array([q for _, q in rows], np.float64)
    base = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Model({}, None, None, None, None, None, None, 1.0, base)
    texts = [t for t, _ in rows]
    vectors = word_vectors(texts, window, most)
    x = Pool(vectors).of(texts).astype(np.float64)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    cut = max(1, len(y) // 5)
    test, train = order[:cut], order[cut:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    z, t = (x[train] - mean) / scale, y[train]
    p = [draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for at in np.array_split(draw.permutation(len(t)), max(1, len(t) // 64)):
            a = z[at] @ p[0] + p[1]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[at]) / len(at)
            dh = np.outer(d, p[2]) * (a > 0)
            grads = [z[at].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.maximum((x[test] - mean) / scale @ p[0] + p[1], 0) @ p[2] + p[3]
    grid = np.exp(np.linspace(-1.5, 3, 60))
    loss = [np.mean(np.logaddexp(0, logit / g) - y[test] * logit / g) for g in grid]
    return Model(vectors, mean, scale, *p, float(grid[int(np.argmin(loss))]), base)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, longest: int) -> list[tuple[str, int]]:
    """At most sample labelled rows that are not held out, by the hash of their ids; one row for each id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out_column())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("__ls_q"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    # chosen among the labelled rows that training can take; only their ids are shuffled
    there = texts.select("doc_id").where("doc_id is not null")
    chosen = usable.join(there.hint("merge"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most sample ids: a bounded side
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__ls_q").alias("q"))
    return [(r["text"], r["q"]) for r in sorted(got.collect(), key=lambda r: r["doc_id"])]


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    return fit(training_rows(docs, labels, sample, longest))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs, which has a column text, as one struct) and score, in one narrow pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index("text")

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        pool = Pool(model.vectors)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                x = model.score(pool.of([t or "" for t in part.column(0).field(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.float64())], names=["row", "score"])

    from pyspark.sql import types as T

    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id and quality."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = scored(rows, classify(docs, labels, sample, longest))
    return got.select("row.doc_id", held_out_column("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
