"""Operators over texts against brute force, on rows with every oddity that the docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import anchors, bpe, decontamination, licenses, line_dedup, packing, simhash, substring_dedup, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, h long, lo int, runs string, __ls_other string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    draw = random.Random(5)
    word = lambda: "".join(draw.choice(["th", "er", "on", "é", "sch", "A"]) for _ in range(draw.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, near = text(70), text(120)
    rows = [(i, text(draw.randint(1, 160))) for i in range(25)]
    rows += [(30 + i, f"{text(draw.randint(0, 30))}\n{shared} {text(draw.randint(0, 30))}") for i in range(6)]
    rows += [(40 + i, near.replace(near.split()[i], "X", 1)) for i in range(6)]
    rows += [(50, near), (51, near), (51, near), (52, "Then " * 200), (53, "Then " * 90 + "end"), (54, ""), (55, None), (56, "   \n\t "), (57, "one"), (None, shared), (58, text(3000))]
    rows += [(60 + i, "same first line\nand a second\nand a third one\n" + text(9)) for i in range(4)]
    return [(d, t, 7, 8, "x", "y") for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row) -> tuple:
    return tuple((x is None, x) for x in row)


def same(df, expected, columns) -> None:
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(expected, key=key)


def smallest(d):
    return -(2**63) if d is None else d


def substring_expected() -> list[tuple]:
    first: dict = {}
    rows = sorted(((d, WORD.findall((t or "").encode())) for d, t, *_ in corpus()), key=lambda r: smallest(r[0]))
    for d, w in rows:
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), smallest(d))
    out = []
    for d, w in rows:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < smallest(d) for j in range(i, i + 50)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def suffix_expected() -> list[tuple]:
    from collections import Counter

    rows = [(d, (t or "").encode()) for d, t, *_ in corpus()]
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_substring_dedup(docs, none, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST", most)  # 2: nearly all hashes are hot
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(substring_dedup.drop_repeated_windows(docs), substring_expected(), columns)
    same(substring_dedup.drop_repeated_windows(none), [], columns)


def test_fingerprint_index_is_incremental(spark, docs, tmp_path):
    """Three batches, the last with the smallest ids, the index opened anew for each: spans as if all had come at once."""
    at = f"{tmp_path}/index"
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = [docs.where((key > 20) & (key <= 45)), docs.where(key > 45), docs.where(key <= 20)]
    gone: dict = {}
    history = None
    for n, part in enumerate(parts, 1):
        index = substring_dedup.FingerprintIndex.open(spark, at, fanout=3)
        assert len(index.runs) == (n - 1)
        for r in index.add(part, history).collect():
            gone.setdefault((r["__ls_k"], r["__ls_t"]), set()).update(w for s in r["spans"] for w in range(s.lo, s.hi + 1))
        history = part if history is None else history.unionByName(part)
    assert len(index.runs) == 1 and index.work.names() == sorted([index.runs[0], f"manifest-{index.version}"])  # compacted
    entries = index.work.read(index.runs[0]).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("h").alias("h")).collect()
    assert all(r.h == sorted(r.h) for r in entries)
    first: dict = {}
    texts = {(smallest(d), t or ""): WORD.findall((t or "").encode()) for d, t, *_ in corpus()}
    for (d, _), w in texts.items():
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    expected = {}
    for (d, _), w in texts.items():
        if lost := {i for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d}:
            expected.setdefault(d, []).append(lost)
    got: dict = {}
    for (d, _), lost in gone.items():
        got.setdefault(d, []).append(lost)
    assert {d: sorted(map(sorted, x)) for d, x in got.items()} == {d: sorted(map(sorted, x)) for d, x in expected.items()}
    with pytest.raises(ValueError, match="windows of 50 words"):
        substring_dedup.FingerprintIndex.open(spark, at, window=40)


def test_a_load_with_production_parameters_compacts_its_runs(docs, monkeypatch):
    seen, commit = [], substring_dedup.FingerprintIndex._commit

    def watched(self, runs, gone):
        commit(self, runs, gone)
        seen.append((self.version, len(runs), len(gone), self.work.names()))

    monkeypatch.setattr(substring_dedup.FingerprintIndex, "_commit", watched)
    same(substring_dedup.drop_repeated_windows(docs), substring_expected(), ["doc_id", "n_words", "n_removed", "kept_sha256"])
    # a manifest for each batch, then one that names the merged run in place of the batches' runs
    assert [(v, n, gone) for v, n, gone, _ in seen] == [(1, 1, 0), (2, 2, 0), (3, 1, 2)]
    assert seen[-1][3] == ["manifest-3", "run-3"]


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(docs, none, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST", most)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same(suffix_dedup.repeated_bytes(docs), suffix_expected(), columns)
    same(suffix_dedup.repeated_bytes(none), [], columns)


def test_hot_windows_are_told_apart_by_their_bytes():
    windows = [b"a b", b"a c", b"a b", b"", b"x" * 300, b"a b"]
    numbers = anchors.numbers_of(windows)
    assert [[a == b for b in numbers] for a in numbers] == [[a == b for b in windows] for a in windows]
    k, t, s, many = np.array([3, 1, 2, 9, 8, -(2**63)]), np.arange(6), np.arange(6) + 7, np.array([True, False, False, True, False, False])
    got = anchors.unpacked_windows(anchors.packed_windows(k, t, s, many, windows), 6)
    assert got[4] == windows and all((a == b).all() for a, b in zip(got, (k, t, s, many), strict=False))
    gone, (left, _) = anchors.decide(numbers, k, t, s, many, "smaller")
    assert gone.tolist() == [True, False, True, False, False, False] and sorted(left.tolist()) == [1, 3, 4, 5]
    gone, (left, several) = anchors.decide(numbers, k, t, s, np.zeros(6, bool), "other")
    assert gone.tolist() == [True, False, True, False, False, True] and several[left.tolist().index(1)] == False  # noqa: E712


@pytest.mark.parametrize("most", [4096, 2])
def test_texts_longer_than_a_segment(spark, monkeypatch, most):
    """Repeats across the borders of segments (2**18 units), for words and for bytes."""
    monkeypatch.setattr(anchors, "MOST", most)
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(120)]
    long = [word() for _ in range(anchors.SEGMENT + 500)]
    long[anchors.SEGMENT - 60 : anchors.SEGMENT + 60] = passage
    rows = [(1, " ".join(passage)), (2, " ".join(long)), (3, " ".join(long[-200:]))]
    got = {r.doc_id: [(x["from"], x["to"]) for x in r.removed] for r in substring_dedup.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(anchors.SEGMENT - 60, anchors.SEGMENT + 60)], 3: [(0, 200)]}
    text = " ".join(long[: anchors.SEGMENT // 5 + 100])
    part = text[anchors.SEGMENT - 300 : anchors.SEGMENT + 300]
    rows = [(1, text), (2, "#" + part + "#")]
    got = {r.doc_id: [(x["from"], x["to"]) for x in r.removed] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(anchors.SEGMENT - 300, anchors.SEGMENT + 300)], 2: [(1, 601)]}


def test_column_wise_construction_against_all_pairs():
    draw = random.Random(3)
    for _ in range(60):
        number, off, texts = [], [], []
        for g in range(draw.randint(1, 4)):
            for _ in range(draw.randint(1, 6)):
                left, right = draw.randint(0, 7), draw.randint(1, 9)
                texts.append(bytes(draw.choice(b"ab") for _ in range(left + right)))
                number.append(g)
                off.append(left)
        got, at = suffix_dedup.column_wise(np.array(number), np.array(off), texts, 4), 0
        for i, x in enumerate(texts):
            for s in range(len(x)):
                c = s - off[i]
                twin = any(j != i and number[j] == number[i] and c + off[j] >= 0 and len(x[s : s + 4]) == 4 and y[c + off[j] : c + off[j] + 4] == x[s : s + 4] for j, y in enumerate(texts))
                assert got[at + s] == twin
            at += len(x)


def test_token_counts(docs, none):
    t = token_counts.load("byte_bpe_50k.json")
    expected = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x, *_ in corpus()]
    same(token_counts.token_counts(docs), expected, ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    assert token_counts.token_counts(none).count() == 0


def test_other_vocabularies_are_refused(spark, tmp_path):
    import json

    for name, run in (("byte_bpe_50k.json", lambda p: token_counts.token_counts(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), p)), ("word_bpe_49k.json", lambda p: packing.pack(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), p))):
        from lodeseek.llm.common import tokenizer_file

        with open(tokenizer_file(name)) as f:
            whole = json.load(f)
        whole["normalizer"] = {"type": "NFKC"}
        at = tmp_path / name
        at.write_text(json.dumps(whole))
        with pytest.raises(ValueError, match="other rules"):
            run(str(at))


def odd_texts() -> list[str]:
    draw, letters = random.Random(1), list("ab cD\n\t'éÉ1²½ß.,!  \x1c\x1d\x1f\x85\xa0日é<|>ΣİſK")
    fixed = ["", " ", "a  b", "a\n\n b", "\n \n x", "it's 'S I'LL", "<|endoftext|>a <|endoftext|>", "x<|startoftext|>Y", "café", "don't 've'll", "a\r\nb", "\x00 \x01a"]
    return fixed + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(3000)]


def test_whole_token_shortcut_and_merges_equal_the_library():
    whole = token_counts.whole_tokens("byte_bpe_50k.json")
    t = token_counts.load("byte_bpe_50k.json")
    assert " the" in whole and all(len(e.ids) == 1 for e in t.encode_batch(sorted(whole)[::25], add_special_tokens=False))
    texts = odd_texts()
    assert token_counts.Counter("byte_bpe_50k.json", whole).counts(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    w = token_counts.load("word_bpe_49k.json")
    got = packing.Ids("word_bpe_49k.json").of([x.encode() for x in texts])
    assert got == [np.array(e.ids, "<u4").tobytes() for e in w.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_vocabulary_string_is_reachable(name):
    assert not bpe.unreachable(name)


def test_packing(docs, none):
    w = token_counts.load("word_bpe_49k.json")
    rows = [tuple(r) for r in packing.pack(docs, size=512, group=8).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    ids = [(d, [*w.encode(x or "", add_special_tokens=False).ids, 2]) for d, x, *_ in corpus()]
    expected = [(d, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(i)) for d, i in ids for s in range(0, len(i), 512) if (p := i[s : s + 512])]
    assert sorted((r[:5] for r in rows), key=key) == sorted(expected, key=key)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[2]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(none).count() == 0


def test_remembered_strings_are_encoded_once_and_a_limit_changes_no_ids(monkeypatch):
    texts = [b"one two three four", b"four three, two one", b"five six seven one two"]
    whole = packing.Ids("word_bpe_49k.json").of(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    ids, asked = packing.Ids("word_bpe_49k.json"), []
    merge = ids.merge
    ids.merge = lambda p: asked.append(p) or merge(p)
    assert ids.of(texts[:1]) == ids.of(texts[:1]) == whole[:1] and len(asked) == 4
    assert ids.of(texts) == whole and len(ids.known) <= 6


def test_first_fit_decreasing():
    draw = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 300):
        lengths = draw.integers(1, 101, n)
        bins, offsets = packing.pack_lengths(lengths, 100)
        free: list[int] = []
        for i in np.argsort(-lengths, kind="stable"):
            b = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= lengths[i]


def simhash_expected() -> list[tuple]:
    import xxhash

    rows = [(d, t) for d, t, *_ in corpus()]
    prints = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().translate(simhash.LOWER))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    component = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    component[i] = component[j] = min(component[i], component[j])
    best: dict = {}
    for i, c in enumerate(component):
        best[c] = min(best.get(c, 2**63), smallest(rows[i][0]))
    return [(d, f"{prints[i]:016x}", None if best[component[i]] == -(2**63) else best[component[i]]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash(docs, none, most):
    columns = ["doc_id", "fingerprint", "component_id"]
    same(simhash.near_duplicates(docs, most=most), simhash_expected(), columns)
    assert simhash.near_duplicates(none).count() == 0


def test_trie_join_links_all_within_the_budget():
    draw = np.random.default_rng(4)
    for n in (2, 40, 700):
        seeds = draw.integers(0, 2**63, max(2, n // 6), dtype=np.uint64)
        flips = np.zeros(n, np.uint64)
        for _ in range(4):
            flips ^= np.uint64(1) << draw.integers(0, 64, n, dtype=np.uint64)
        bits = np.unique(seeds[draw.integers(0, len(seeds), n)] ^ flips)
        a, b = simhash.trie_links(np.zeros(len(bits), np.int64), bits)
        near = np.bitwise_count(bits[:, None] ^ bits) <= 4
        i, j = np.nonzero(near)
        assert (simhash.least_labels(len(bits), a, b) == simhash.least_labels(len(bits), i, j)).all()


def lines_expected(every: int) -> list[tuple]:
    def chunks(t: str) -> list[tuple[int, str]]:
        lines = t.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        roll = [h + 31 * (hashes[i - 1] if i else 0) for i, h in enumerate(hashes)]
        out, begin = [], 0
        for i in range(len(lines)):
            if roll[i] % every == 0 or i == len(lines) - 1:
                out.append((i + 1 - begin, "\n".join(lines[begin : i + 1])))
                begin = i + 1
        return out

    rows = [(d, chunks(t or "")) for d, t, *_ in corpus()]
    first: dict = {}
    for d, cs in rows:
        for i, (n, c) in enumerate(cs):
            if n > 1:
                first[c] = min(first.get(c, (smallest(d), i)), (smallest(d), i))
    out = []
    for d, cs in rows:
        kept = [c for i, (n, c) in enumerate(cs) if n == 1 or first[c] == (smallest(d), i)]
        total = sum(n for n, _ in cs)
        gone = total - sum(n for i, (n, c) in enumerate(cs) if n == 1 or first[c] == (smallest(d), i))
        out.append((d, total, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("every", [3, 1000])
def test_line_dedup(docs, none, every):
    columns = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    same(line_dedup.dedup_lines(docs, every), lines_expected(every), columns)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_runs_no_python(docs):
    assert not re.search("Python|Pandas|Arrow", line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString())


ITEMS = [("a", "ther ON éé. One two three four five six seven eight nine"), ("b", "short item"), ("c", ""), ("d", None), (None, "short item"), ("e", "short item"), ("b", "short item"), ("a", "nine eight nine")]
PARTS = [(1, "x short ITEM! y"), (2, "THER on éé one, two three four five six seven eight nine ten short item"), (3, "ther on éé one two three four five six seven"), (4, None), (5, "..."), (None, "short item short item"), (2, "short item"), (2, "short item"), (6, ""), (7, "item x x short"), (8, "item x short nine"), (9, "ITEM " + "pad " * 5000 + "short eight x eight nine x"), (10, "item")]
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(t) -> list[str]:
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def is_near(w: list[str], v: list[str]) -> bool:
    return any(set(v) <= set(w[s : s + 2 * len(v)]) for s in range(len(w))) if v else False


def decontamination_expected() -> list[tuple]:
    expected = []
    for d, t in PARTS:
        w, hit, found = item_words(t), set(), []
        for item, q in ITEMS:
            v, any_ = item_words(q), False
            for i in range(max(1, len(v) - 9) if v else 0):
                for s in range(len(w) - len(v[i : i + 10]) + 1):
                    if w[s : s + len(v[i : i + 10])] == v[i : i + 10]:
                        hit |= set(range(s, s + len(v[i : i + 10])))
                        any_ = True
            found += [item] * any_
        names = ",".join(sorted(x for x in found if x is not None))
        expected.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit), sum(is_near(w, item_words(q)) for _, q in ITEMS)))
    return expected


@pytest.mark.parametrize(("block", "segment"), [(1_000_000, 1_000_000), (1, 1_000_000), (4, 1), (1_000_000, 20)])
def test_decontamination(spark, none, block, segment):
    docs, items = spark.createDataFrame([(*r, "z", 1) for r in PARTS], "doc_id long, text string, n_words string, segment int").coalesce(2), spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id string, text string, doc_id int")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    same(decontamination.decontaminate(docs, items, block_words=block, segment_words=segment), decontamination_expected(), columns)
    if block == 1:
        assert decontamination.decontaminate(none, items).count() == 0
        assert not decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count()


def test_a_stored_index_holds_every_word_and_answers_other_benchmarks(spark):
    from lodeseek.llm.common import Work

    docs = spark.createDataFrame(PARTS, "doc_id long, text string")
    index = decontamination.PositionalIndex.build(docs, Work(spark, "test"), 8)
    found = {(bytes(r.term), r.n) for r in index.table("postings").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    from collections import Counter

    assert found == set(Counter(w.encode() for _, t in PARTS for w in item_words(t)).items())
    for one in (ITEMS[:1], ITEMS[1:3]):
        got = decontamination.searched(index, spark.createDataFrame(one, "item_id string, text string"))
        assert {r.doc_id for r in got.where("contaminated").collect()} == ({2, 3} if one == ITEMS[:1] else {None, 1, 2})


def test_packed_numbers_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    data, ends = decontamination.packed(x)
    assert decontamination.unpacked(data.tobytes()).tolist() == x.tolist() and ends[-1] == len(data)
    assert not len(decontamination.unpacked(decontamination.packed(x[:0])[0].tobytes()))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 50 + "beta"), (3, "beta gamma alpha"), (4, "alpha"), (4, "beta")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta"), (None, "gamma"), ("j", "alpha gone")], "item_id string, text string")
    assert sorted(tuple(r) for r in decontamination.proximity_matches(docs, items).collect()) == [(1, "i"), (3, "i")]


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "hello\nworld"), (3, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/c/d/y", "some words of prose that come first\nLicensed under CC BY-NC 4.0.\nand more words after it"), (5, "q/z", "none"), (6, None, None), (6, None, None), (None, "a/b/c/d/z", ""),
    (7, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + dict(licenses.TEXTS)["MIT"].replace("restriction, including", "restriction,\nincluding")), (8, "m/src/t.c", "/* x */\nint main;"),
    (9, "g/main.c", "/*\n * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General Public\n * License as published by the Free Software Foundation, either\n * version 3 of the License, or (at your option) any later version.\n */\n\nint main(void) { return 0; }\n" + "x = 1;\n" * 3000),
    (10, "i/one", "isc"), (11, "i/two", "isc license"), (12, "i/many", "the of and to in is license under the"), (13, "same/LICENSE", "Released under the MIT License."), (14, "same/COPYING", "Released under the ISC License."), (15, "same/z", " "),
]


def licenses_expected(threshold: float) -> list[tuple]:
    """The scan by plain cosines under the frequencies of all terms."""
    import math
    from collections import Counter

    rows = [(d, p or "", (t or "").encode()) for d, p, t in FILES]
    df = Counter(w for *_, t in rows for w in set(decontamination.words_of(t)))
    weight = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    vector = lambda words: {w: c * weight(w) for w, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(decontamination.words_of(t))) for name, t in licenses.TEMPLATES + licenses.TEXTS]

    def best(words):
        v = vector(words)
        found = min((-round(sum(x * v.get(w, 0) for w, x in t.items()) / norm(t), 9), name) for name, t in templates)
        score = round(-found[0] / norm(v), 6)
        return (-score, found[1]) if score >= threshold else None

    own, files = [], {}
    for d, p, t in rows:
        hits = [(kind, b) for kind, words in licenses.units_of(t) if (b := best(words))]
        score, name = min((b for _, b in hits), default=(None, None))
        folder, _, base = p.rpartition("/")
        if hits and (any(k == licenses.WHOLE for k, _ in hits) or re.match(licenses.FILE_NAMES, base)):
            files[folder] = min(files.get(folder, (score, name, p)), (score, name, p))
        own.append((d, p, folder, name, None if score is None else -score, sum(k == licenses.LINE for k, _ in hits)))
    out = []
    for d, p, folder, name, score, n in own:
        at = folder
        while at not in files and at:
            at = at.rpartition("/")[0]
        near = files.get(at, (None, None, None))
        out.append((d, p, name, score, n, near[1], near[2], name or near[1]))
    return out


@pytest.mark.parametrize("known", [20_000, 5])
def test_licenses(spark, monkeypatch, known):
    monkeypatch.setattr(licenses, "KNOWN", known)
    monkeypatch.setattr(licenses, "COUNTED", 10)
    columns = ["doc_id", "path", "license", "score", "lines", "inherited", "inherited_from", "effective"]
    files = spark.createDataFrame([(*r, 1, "k", 2) for r in FILES], "doc_id long, path string, text string, n long, kind string, unit int")
    expected = licenses_expected(licenses.THRESHOLD)
    same(licenses.scan(files), expected, columns)
    by = {(r[0], r[1]): r for r in expected}
    assert by[2, "a/b/x.py"][7] == by[7, "m/LICENSE"][2] == by[8, "m/src/t.c"][7] == "MIT" and by[9, "g/main.c"][2] == "GPL-3.0" and by[None, "a/b/c/d/z"][7] == "Apache-2.0" and by[15, "same/z"][5:7] == ("ISC", "same/COPYING")
    assert licenses.scan(files.limit(0)).count() == 0


def test_units_of_a_text():
    text = b"a b\n\n# c\n# d e\n  \n f"
    assert list(licenses.units_of(text)) == [(0, [b"a", b"b"]), (0, [b"c"]), (0, [b"d", b"e"]), (1, [b"c", b"d", b"e"]), (0, [b"f"]), (2, [b"a", b"b", b"c", b"d", b"e", b"f"])]
    assert not list(licenses.units_of(b" \n"))
