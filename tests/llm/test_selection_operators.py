"""Best-fit packing, collocations and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import best_fit, collocations, resampling
from lodeseek.llm.token_counts import load

SCHEMA = "doc_id long, text string, lang string, n long, f long, id long, words string, piece string, segment string, __ls_n string, __ls_k string, `left` string"


def rows_of() -> list[tuple]:
    draw = random.Random(21)
    vocabulary = ["the", "The", "of", "on", "été", "x1", "日本", "a-b", "it's", "ÀB", "42"]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ", ";x "]) for _ in range(n))
    rows = [(i, text(draw.randint(0, 120)), draw.choice(["en", "de", None])) for i in range(60)]
    rows += [(70, "one two three " * 40, "en"), (71, "one two four. " * 15, "en"), (71, "one two four. " * 15, "en"), (None, "nobody knows this", "fr"), (None, None, "en"), (-(2**63), "", "de"), (80, "   \n\t ", "en"), (81, "Then " * 9000, "en"), (82, "a <|endoftext|> b  c", "en"), (83, "x\x00y z\x1cq", "en")]
    return [(*r, *[7] * 3, *["other"] * 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


def by_key(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


# -- best-fit packing


@pytest.mark.parametrize(("group", "over"), [(40, 2), (2000, 0)])
def test_best_fit_packing(docs, group, over):
    got = best_fit.pack(docs, size=256, group=group).collect()
    library, expected, ids = load("byte_bpe_50k.json"), Counter(), Counter()
    for doc, text, *_ in rows_of():
        data = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(data) % 256 or 256
        cut = [data[:first], *(data[at : at + 256] for at in range(first, len(data), 256))]
        doc = None if doc == -(2**63) else doc
        expected.update((doc, i, sum(map(len, cut[:i])), len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for i, p in enumerate(cut))
        ids.update([doc])
    assert Counter(tuple(r)[:5] for r in got) == expected and set(ids) == {r.doc_id for r in got}
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 256
    # the least number of sequences that the tokens allow is 76
    assert len(places) <= -(-sum(r.length for r in got) // 256) + over
    assert best_fit.pack(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("low", "high", "over"), [(1, 300, 0), (100, 900, 1), (200, 1900, 24)])
def test_local_search_only_improves_and_keeps_every_item(low, high, over):
    lengths = np.random.default_rng(low).integers(low, high, 700)
    start = best_fit.best_fit(lengths, 2048)
    search = best_fit.Search(lengths, [list(b) for b in start], 2048)
    before = (search.fill**2).sum()
    search.run()
    assert sorted(i for b in search.bins for i in b) == list(range(700))
    assert all(sum(int(lengths[i]) for i in b) == f <= 2048 for b, f in zip(search.bins, search.fill, strict=True))
    assert (search.fill**2).sum() >= before and search.used() <= len(start) and (search.used() < len(start) or len(start) == search.least)
    bins, offsets, free = best_fit.pack_lengths(lengths, 2048, 16)
    assert len(set(bins.tolist())) <= max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum())) + over
    for b in set(bins.tolist()):
        inside = np.flatnonzero(bins == b)
        assert 2048 - lengths[inside].sum() == free[inside[0]] and (np.cumsum(lengths[inside]) - lengths[inside] == offsets[inside]).all()


def test_exchanges_one_for_one_two_for_one_and_moves():
    # a move, one for one, two for one and one for two: the fill of the first bin, which the second one gives to
    for lengths, bins, filled in (([6, 3, 1], [[0], [1, 2]], 9), ([6, 2, 4], [[0, 1], [2]], 10), ([3, 2, 3, 7], [[0, 1, 2], [3]], 10), ([5, 4, 3, 3], [[0, 1], [2, 3]], 10)):
        s = best_fit.Search(np.array(lengths), [list(b) for b in bins], 10)
        squares = (s.fill**2).sum()
        assert s.take(0) and s.fill[0] == filled and (s.fill**2).sum() > squares
    # two of its own for one of the other: 3 + 2 go for 6
    s = best_fit.Search(np.array([3, 2, 4, 6, 2]), [[0, 1, 2], [3, 4]], 10)
    assert s.take(0) and s.fill.tolist() == [10, 7] and [sorted(b) for b in s.bins] == [[2, 3], [0, 1, 4]]


def test_ids_of_best_fit_equal_the_library():
    ids, draw = best_fit.Ids("byte_bpe_50k.json"), random.Random(4)
    alphabet = [" ", " ", "\n", "\t", "'s", "a", "B", "zz", "1", "23", ".", ",", "é", "ß", "Ω", "日", " ", " ", "\x1c", "\x00", "<|endoftext|>", "!!", "\r\n"]
    for _ in range(4000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 12)))
        found = ids.t.encode(text, add_special_tokens=False).ids
        assert ids.of(text) == struct.pack(f"<{len(found)}I", *found), repr(text)


# -- collocations


def collocations_expected(rows, longest: int, least: int, share: int, top: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * counts[p[i:j]]}
        scored = []
        for p, a in often.items():
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in gone:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return by_key(out)


@pytest.mark.parametrize(("longest", "least", "top", "segment"), [(3, 10, 2000, 2_000_000), (3, 2, 7, 300), (5, 3, 40, 500)])
def test_collocations(spark, docs, monkeypatch, longest, least, top, segment):
    if segment < 1000:  # parts of common words, several rounds of counting, and words that go on in the next batch
        monkeypatch.setattr(collocations, "GROUP", 20)
        monkeypatch.setattr(collocations, "TOGETHER", 30)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = by_key(collocations.collocations(docs, longest, least, 50, top, segment).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = collocations_expected(rows_of(), longest, least, 50, top)
    assert got == expected and len(got) > 10


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("doc_id = 80")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 4 * 10**12 + 9, 3 * 10**12 + 11
    rows = spark.createDataFrame([("en", [b"x", b"y"], 1, a, [left], [right])], "lang string, words array<binary>, id long, f long, heads array<long>, tails array<long>")
    assert collocations.with_scores(rows, 2).first().score == 10**6 * a * a // (left * right)


# -- importance resampling


def resampled_expected(rows, target, percent: int, least: int, longest: int, buckets: int) -> list[tuple]:
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), Counter(zlib.crc32(x.encode()) % buckets for x in runs)

    mine, wanted = [(d, *found(t)) for d, t, *_ in rows], sum((found(t)[1] for t in target), Counter())
    every = sum((c for *_, c in mine), Counter())
    s, t = sum(every.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((every[b] + 1) * (t + buckets)))) for b in range(buckets)}
    scored = []
    for d, n, c in mine:
        d = None if d == -(2**63) else d
        size = sum(c.values())
        weight = sum(gain[b] * x for b, x in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    often = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    rank = [i + 1 if i < percent * len(often) // 100 else None for i in range(len(often))]
    return by_key([(d, size, w, score, r) for (d, _, size, w, score), r in zip(often, rank, strict=True)] + [(d, size, w, score, None) for d, n, size, w, score in scored if n < least])


@pytest.mark.parametrize(("percent", "least", "longest", "buckets"), [(25, 20, 2, 10_000), (60, 5, 3, 100), (100, 0, 1, 100_000)])
def test_resampling(spark, docs, monkeypatch, percent, least, longest, buckets):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 7)
    target = ["the one two of", None, "日本 été on the the", ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, table, percent, least, longest, buckets).collect()
    assert by_key(got) == resampled_expected(rows_of(), target, percent, least, longest, buckets)


def test_resampling_of_and_towards_nothing(spark, docs):
    table = spark.createDataFrame([], "item_id long, text string")
    assert by_key(resampling.resample(docs, table).collect()) == resampled_expected(rows_of(), [], 25, 20, 2, 10_000)
    assert resampling.resample(docs.limit(0), table).collect() == []


def test_rows_of_one_id_and_text_spread_over_the_partitions_of_the_sort(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a word " * 30).alias("text"))
    got = resampling.resample(rows, spark.createDataFrame([("a",)], "text string"))
    assert sorted(r.rank for r in got.collect() if r.rank) == list(range(1, 1001))
    from lodeseek.llm.common import Work

    keys = spark.range(4000).select(F.lit(5).alias("score"), F.col("id").alias("__ls_n"))
    work = Work(spark, "ranks", str(tmp_path))
    resampling.ranked(keys, [F.desc("score"), F.asc("__ls_n")], work)
    assert work.read("sorted").groupBy("__ls_p").count().agg(F.max("count")).first()[0] < 2000
