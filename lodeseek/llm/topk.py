"""Exact top-k inner-product search with a KD-tree per shard.

A coarse KD-tree over a bounded sample cuts space into at most ``CELLS`` cells; every vector is routed to its cell, and
a cell's vectors lie in shards of about ``SHARD`` by a hash of their id, so a cell that holds a third of all vectors is
many shards. Each shard builds a KD-tree: median splits on the widest axis, down to small leaves, every node with its
tight bounding box. A query walks a tree best first: for a box the largest possible inner product is the sum over axes
of max(q * low, q * high); a box below the k-th score so far is dropped, equal bounds are kept for ties.

Queries travel in blocks of one cell, in three waves. The first goes to a shard of the block's own cell; the k-th
scores reached there travel with the block to the ``NEXT`` most promising cells, and what was reached there to every
other cell whose box can still hold one of the k best. A block reaches the trees in the order of shards, so a task
holds one tree at a time and each tree is read once a wave. What is broadcast or collected are boxes of cells and
numbers of their shards, at most ``CELLS`` for each length of vectors.

Scores are exact integers. How they are computed is decided once for all vectors of a length, by the largest component:
in float64 where every sum of products is exact there, else in int64 where every sum fits, else as Python integers. A
score beyond a long is shown as the nearest long; its rank follows the exact value.

Defined results: vectors that are null or hold null or non-finite components take no part; rows with a null id take
no part; empty vectors are vectors of length 0, all of whose scores are 0; vectors meet only vectors of the same
length; repeated ids are separate candidates (not of their own id), and a repeated query id is one query, by its
smallest vector; ties go to the smaller id, then to either of two rows of one id; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import Work

SHARD, BLOCK, LEAF = 8192, 256, 64
#: Cells of the coarse tree at most; rows of the sample that it is fitted on; cells that the second wave visits.
CELLS, SAMPLE, NEXT = 1024, 20_000, 4
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1
#: Digits of any sum of products of finite doubles.
WIDTH = 660


def tree_of(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes in arrays: boxes low and high, children (or -1) and the range of rows; rows are in tree order."""
    order, low, high, left, right, span = np.lexsort((ids,)), [], [], [], [], []

    def grow(start: int, end: int) -> int:
        rows = order[start:end]
        part = x[rows]
        at = len(low)
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        left.append(-1)
        right.append(-1)
        span.append((start, end))
        if end - start > leaf and (high[at] > low[at]).any():
            axis, middle = int(np.argmax(high[at] - low[at])), (end - start) // 2
            order[start:end] = rows[np.argpartition(part[:, axis], middle)]
            left[at] = grow(start, start + middle)
            right[at] = grow(start + middle, end)
        return at

    if len(ids):
        grow(0, len(ids))
    return {"ids": ids[order], "x": x[order], "low": np.array(low), "high": np.array(high), "left": left, "right": right, "span": span}


def search(tree: dict, query_id: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of a shard that can still reach floor; ties to smaller ids."""
    if not len(tree["ids"]):
        return []
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = tree["high"] @ up + tree["low"] @ down
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
    queue = [(-bounds[0], 0)]
    while queue:
        bound, at = heapq.heappop(queue)
        least = best[0][0] if len(best) == k else floor
        if least is not None and -bound < least:
            break
        if tree["left"][at] >= 0:
            for child in (tree["left"][at], tree["right"][at]):
                if least is None or bounds[child] >= least:
                    heapq.heappush(queue, (-bounds[child], child))
            continue
        start, end = tree["span"][at]
        scores = tree["x"][start:end] @ q
        for i in np.flatnonzero(scores >= least) if least is not None else range(end - start):
            other = int(tree["ids"][start + i])
            if other == query_id:
                continue
            one = (int(scores[i]), -other)
            if len(best) < k:
                heapq.heappush(best, one)
            elif one > best[0]:
                heapq.heapreplace(best, one)
    return [(s, -i) for s, i in best]


def vectors(table: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, v (array<double>), n: usable rows only."""
    fine = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    return table.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.size(column).alias("n"))


def kind_of(most: float, n: int, scale: int) -> str:
    """float, int or big: what holds every sum of n products of numbers up to scale * most."""
    top = int(most) * scale + scale
    total = top * top * max(1, n)
    return "float" if total <= 2**53 else "int" if total < 2**63 else "big"


def whole(rows, kind: str, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, in the numbers of kind."""
    x = np.array(list(rows), np.float64).reshape(len(rows), -1)
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if kind == "float":
        return y
    if kind == "int":
        return y.astype(np.int64)
    # a product beyond a double is of a whole number
    return np.array([[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(p, q, strict=True)] for p, q in zip(x.tolist(), y.tolist(), strict=True)], object).reshape(x.shape)


def coarse_tree(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """(axis, threshold, left, right) of inner nodes; a child below 0 is cell -child - 1. At most cells cells."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(part: np.ndarray, share: int) -> int:
        nonlocal made
        width = part.max(axis=0) - part.min(axis=0) if len(part) and part.shape[1] else np.zeros(1)
        if share > 1 and len(part) > 1 and width.max() > 0:
            axis = int(np.argmax(width))
            middle = float(np.median(part[:, axis]))
            below = part[:, axis] < middle
            if not below.any():
                below = part[:, axis] <= middle
                middle = float(np.nextafter(middle, np.inf))
            if below.any() and not below.all():
                at = len(nodes)
                nodes.append((axis, middle, 0, 0))
                nodes[at] = (axis, middle, grow(part[below], share // 2), grow(part[~below], share - share // 2))
                return at
        made += 1
        return -made

    grow(x, cells)
    return nodes


def cells_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out = np.zeros(len(x), np.int64)
    stack = [(0, np.arange(len(x)))] if nodes else []
    while stack:
        at, rows = stack.pop()
        axis, threshold, left, right = nodes[at]
        below = x[rows, axis] < threshold
        for child, part in ((left, rows[below]), (right, rows[~below])):
            if child < 0:
                out[part] = -child - 1
            elif len(part):
                stack.append((child, part))
    return out


def shown(score: int) -> int:
    return min(MOST_LONG, max(LEAST_LONG, score))


def finer(score: int) -> str | None:
    """What orders scores that are shown as the same long: a text whose order is theirs."""
    if LEAST_LONG < score < MOST_LONG:
        return None
    return f"1{score:0{WIDTH}d}" if score > 0 else f"0{10**WIDTH + score:0{WIDTH}d}"


def top_k(table: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024, shard: int = SHARD, block: int = BLOCK, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by every, the k best other rows."""
    spark = table.sparkSession
    work = Work(spark, "topk")
    rows = work.table(vectors(table, id_column, column), "rows")
    about = rows.groupBy("n").agg(F.count("*").alias("count"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most"))
    lengths = {r["n"]: (r["count"], r["most"] or 0.0) for r in about.collect()}  # one row for each length of vectors
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kinds = {n: kind_of(most, n, scale) for n, (_, most) in lengths.items()}
    coarse = {}
    for n, (count, _) in lengths.items():
        wanted = min(cells, -(-count // shard))
        part = rows.where(F.col("n") == n).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect() if wanted > 1 else []  # at most sample rows
        coarse[n] = coarse_tree(np.array([r["v"] for r in part], np.float64).reshape(len(part), n), wanted) if part else []

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, v = b.column("n").to_numpy(), b.column("v").to_pylist()
            cell = np.zeros(b.num_rows, np.int64)
            for m in np.unique(n).tolist():
                mine = np.flatnonzero(n == m)
                cell[mine] = cells_of(coarse[m], np.array([v[i] for i in mine.tolist()], np.float64).reshape(len(mine), m))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "v", "n")), pa.array(cell)], names=["id", "v", "n", "cell"])

    routed = work.table(rows.mapInArrow(route, "id long, v array<double>, n int, cell long"), "routed")
    work.drop("rows")
    # at most cells rows for each length
    held = [(r["n"], r["cell"], r["count"]) for r in routed.groupBy("n", "cell").count().collect()]
    n_shards = {(n, c): -(-count // shard) for n, c, count in held}
    numbers = F.broadcast(spark.createDataFrame([(n, c, s) for (n, c), s in n_shards.items()], "n int, cell long, shards int"))
    dealt = routed.join(numbers, ["n", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(key, pdf):
        import pandas as pd

        tree = tree_of(pdf["id"].to_numpy(np.int64), whole(pdf["v"], kinds[key[0]], scale))
        return pd.DataFrame({"n": [key[0]], "cell": [key[1]], "part": [key[2]], "box": [pickle.dumps((tree["low"][0], tree["high"][0]), 5)], "tree": [pickle.dumps(tree, 5)]})

    trees = work.table(dealt.groupBy("n", "cell", "part").applyInPandas(build, "n int, cell long, part int, box binary, tree binary"), "trees")

    def enclose(key, pdf):
        import pandas as pd

        pairs = [pickle.loads(b) for b in pdf["box"]]  # noqa: S301 our own bytes
        return pd.DataFrame({"n": [key[0]], "cell": [key[1]], "box": [pickle.dumps((np.min([p[0] for p in pairs], axis=0), np.max([p[1] for p in pairs], axis=0)), 5)]})

    boxes: dict[int, list] = {}
    for r in trees.select("n", "cell", "box").groupBy("n", "cell").applyInPandas(enclose, "n int, cell long, box binary").orderBy("n", "cell").collect():  # at most cells rows for each length
        boxes.setdefault(r["n"], []).append((r["cell"], *pickle.loads(r["box"])))  # noqa: S301
    bounds_of = {n: ([c for c, _, _ in b], np.array([low for _, low, _ in b]), np.array([high for _, _, high in b])) for n, b in boxes.items()}

    # repeated rows of one id are one query
    asked = routed.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "n", "cell")).alias("q"))
    asked = work.table(asked.select("id", "q.n", "q.v", "q.cell"), "asked")
    n_asked = F.broadcast(asked.groupBy("n", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # at most cells rows for each length
    asked = asked.join(n_asked, ["n", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def gather(key, pdf):
        import pandas as pd

        ids = pdf["id"].tolist()
        return pd.DataFrame({"n": [key[0]], "cell": [key[1]], "block": [key[2]], "queries": [pickle.dumps((ids, whole(pdf["v"], kinds[key[0]], scale), [None] * len(ids)), 5)]})

    blocks = work.table(asked.groupBy("n", "cell", "block").applyInPandas(gather, "n int, cell long, block int, queries binary"), "blocks-0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hit = "n int, cell long, block int, query_id long, score long, finer string, vec_id long"

    def ask(visits: DataFrame, name: str) -> DataFrame:
        """Hits of the blocks in visits (home, block, queries, and n, cell, part: the shard they go to)."""
        both = trees.select("n", "cell", "part", F.lit(-1).alias("home").cast("long"), F.lit(-1).alias("block"), F.col("tree").alias("data"))
        both = both.unionByName(visits.select("n", "cell", "part", "home", "block", F.col("queries").alias("data")))
        stream = both.repartition(parts, "n", "cell", "part").sortWithinPartitions("n", "cell", "part", "home", "block")

        def walk(batches: Iterator) -> Iterator:
            import pyarrow as pa

            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            tree, data = None, None
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i].as_py() for c in ("n", "home", "block", "data")}
                    if row["home"] < 0:
                        tree, data = None, row["data"]
                        continue
                    tree = tree or pickle.loads(data)  # noqa: S301 our own bytes; only trees that are asked
                    out = [(row["n"], row["home"], row["block"], q, shown(s), finer(s), v) for q, x, floor in zip(*pickle.loads(row["data"]), strict=True) for s, v in search(tree, q, x, k, floor)]  # noqa: S301
                    columns = list(zip(*out, strict=True)) or [()] * len(types)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["n", "cell", "block", "query_id", "score", "finer", "vec_id"])

        return work.table(stream.mapInArrow(walk, hit), name)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("finer"), "vec_id")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def raised(blocks: DataFrame, hits: DataFrame, name: str) -> DataFrame:
        """Blocks with the k-th score that each of their queries has reached."""
        # a score below all longs is shown too high to be a floor
        reached = best(hits).where((F.col("rank") == k) & (F.col("score") > LEAST_LONG)).groupBy("n", "cell", "block").agg(F.collect_list(F.struct("query_id", "score")).alias("reached"))

        def put(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                out = []
                for data, got in zip(b.column("queries").to_pylist(), b.column("reached").to_pylist(), strict=True):
                    ids, x, floors = pickle.loads(data)  # noqa: S301
                    new = {g["query_id"]: g["score"] for g in got or ()}
                    out.append(pickle.dumps((ids, x, [new.get(i, f) for i, f in zip(ids, floors, strict=True)]), 5))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("n", "cell", "block")), pa.array(out, pa.binary())], names=["n", "cell", "block", "queries"])

        return work.table(blocks.join(reached.hint("merge"), ["n", "cell", "block"], "left").mapInArrow(put, "n int, cell long, block int, queries binary"), name)

    def visits(blocks: DataFrame, wave: int) -> DataFrame:
        """Where blocks go in waves 1 and 2; cells whose boxes cannot reach a floor of any of their queries are left out."""

        def choose(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                out: list[tuple] = []
                for n, home, number, data in zip(*(b.column(c).to_pylist() for c in ("n", "cell", "block", "queries")), strict=True):
                    _, x, floors = pickle.loads(data)  # noqa: S301
                    names, low, high = bounds_of[n]
                    bounds = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                    can = np.array([[f is None or y >= f for y in row] for row, f in zip(bounds.tolist(), floors, strict=True)], bool).reshape(bounds.shape).any(axis=0)
                    # the order of the second wave is that of the first query's floors: the largest bounds first
                    rank = sorted(range(len(names)), key=lambda c: (names[c] == home, -max(bounds[:, c]), c))
                    for place, c in enumerate(rank):
                        if names[c] == home or not can[c] or (place < NEXT) != (wave == 1):
                            continue
                        out += [(n, names[c], p, home, number, data) for p in range(n_shards[n, names[c]])]
                    if wave == 2:  # the rest of the home cell
                        first = number % n_shards[n, home]
                        out += [(n, home, p, home, number, data) for p in range(n_shards[n, home]) if p != first]
                        # cells that floors had shut out of the second wave stay shut: floors only rise
                    if len(out) >= 64:
                        yield batch(out)
                        out = []
                yield batch(out)

        def batch(out: list[tuple]):
            import pyarrow as pa

            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["n", "cell", "part", "home", "block", "queries"])

        return blocks.mapInArrow(choose, "n int, cell long, part int, home long, block int, queries binary")

    home = blocks.join(numbers, ["n", "cell"]).select("n", "cell", F.pmod("block", "shards").cast("int").alias("part"), F.col("cell").alias("home"), "block", "queries")
    hits = ask(home, "hits-0")
    blocks = raised(blocks, hits, "blocks-1")
    hits = hits.unionByName(ask(visits(blocks, 1), "hits-1"))
    blocks = raised(blocks, hits, "blocks-2")
    hits = hits.unionByName(ask(visits(blocks, 2), "hits-2"))
    work.drop("routed", "asked", "trees", "blocks-0", "blocks-1", "blocks-2")
    return best(hits).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
