"""Single stages of the pipeline against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from lodeseek.llm import near_copies
from lodeseek.llm.common import keyed

SCHEMA = "doc_id long, text string"


def words(draw: random.Random, n: int) -> list[str]:
    return ["".join(draw.choices("abcdefghij", k=5)) for _ in range(n)]


def similarity(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_down_to_a_similarity_of_four_fifths(spark):
    draw, rows = random.Random(5), []
    for i in range(40):
        w = words(draw, 300)
        rows.append((100 * i, " ".join(w)))
        # each changed word takes five shingles of 296: from 0.97 to 0.6
        for c in range(1, 16):
            v = list(w)
            for at in draw.sample(range(300), c):
                v[at] = "other"
            rows.append((100 * i + c, " ".join(v)))
    group = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 : i + 16]:
            if a // 100 == b // 100 and similarity(x, y) >= near_copies.SIMILARITY:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    kept = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, g in group.items() if d == g)


def test_rows_that_share_an_id_are_decided_one_by_one(spark, tmp_path):
    draw = random.Random(6)
    texts = [" ".join(words(draw, 100)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0] + " more"), (None, None), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[2]), (8, texts[4])]
    kept = sorted(map(tuple, corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)
    assert len(kept) == 6
    ids = [d for d, _ in kept]
    assert ids.count(None) == 3 and ids.count(7) == 2 and (8, texts[4]) in kept and (7, texts[2]) in kept and (7, texts[3]) in kept
    spark.createDataFrame([(1, " ".join(texts[5].split()[20:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, texts[5]), (None, texts[0]), (7, texts[1]), (7, f"{texts[2]} {texts[5]}"), (7, None)]
    clean = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(map(tuple, clean), key=str) == sorted([(None, texts[0]), (7, texts[1]), (7, None)], key=str)


CLASHES = ["lines", "kept", "n_lines", "gone", "out", "runs", "row", "score", "__ls_k", "__ls_t", "__ls_r", "__ls_score", "__ls_f", "node", "n", "first", "h", "c", "contaminated"]


def odd_documents(spark):
    """Documents with columns of every internal name; repeated rows, nulls and a long text."""
    draw = random.Random(8)
    texts = ["\n".join(" ".join(words(draw, 12)) for _ in range(6)) for _ in range(8)]
    block = "\n".join(" ".join(words(draw, 9)) for _ in range(9))
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, f"{block}\n{texts[0][:40]}"), (21, f"{block}\n{texts[1][:40]}"), (3, texts[3]), (None, None), (None, ""), (30, " ".join(words(draw, 30_000)))]
    return spark.createDataFrame([(d, t, len(t or ""), *(f"{name} of {d}" for name in CLASHES)) for d, t in rows], ", ".join(["doc_id long, text string, n_chars long", *(f"`{name}` string" for name in CLASHES)]))


def test_stages_keep_columns_whatever_their_names_and_take_empty_tables(spark, tmp_path):
    docs = odd_documents(spark)
    spark.createDataFrame([(1, "no such passage is here at all in any of the documents")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            got = stage(spark, df, str(tmp_path))
            assert got.columns == docs.columns, name
            rows = got.collect()
            for r in rows:
                assert all(r[c] == f"{c} of {r.doc_id}" for c in CLASHES), name
                assert name != "lines" or r.n_chars == len(r.text)
            assert len(rows) == (0 if df is not docs else {"quality": 14, "lines": 14, "simhash": 11, "decontamination": 14}[name]), name
    pieces = corpus_pipeline.packing_stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()} and corpus_pipeline.packing_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_the_trie_of_operator_4_links_first_and_its_links_are_verified(spark):
    from lodeseek.llm.common import Work, keyed

    draw = random.Random(9)
    w = words(draw, 400)
    v = [*w[:399], "other"]
    rows = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(words(draw, 50))), (4, ""), (5, None), (6, "  ")], SCHEMA)
    each = near_copies.prints(keyed(rows).select("__ls_k", "__ls_t", "text"))
    nodes = each.groupBy("node").agg({"__ls_f": "max", "n": "max"}).toDF("node", "__ls_f", "n").select("node", "__ls_f", "n")
    pairs = near_copies.trie_pairs(nodes, Work(spark, "test")).collect()
    by = {r["__ls_k"]: r["node"] for r in each.collect()}
    assert {frozenset((p.a, p.b)) for p in pairs} == {frozenset((by[1], by[2]))}
    first = {r["__ls_k"]: r["first"]["__ls_k"] for r in near_copies.first_of_groups(rows).collect()}
    assert first == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}


def test_no_similar_pair_is_left_out_among_many_that_are_almost_similar(spark):
    draw, base = random.Random(12), words(random.Random(11), 150)
    rows = [(0, " ".join(base))]
    for i in range(1, 501):
        # four changed words: about 0.77 to the base and less to most others; a partner with three more
        v = list(base)
        for at in draw.sample(range(150), 4):
            v[at] = words(draw, 1)[0]
        u = list(v)
        for at in draw.sample(range(150), 3):
            u[at] = words(draw, 1)[0]
        rows += [(10 * i, " ".join(v)), (10 * i + 1, " ".join(u))]
    sets = [(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for d, t in rows for w in [t.split()]]
    group = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            common = len(x & y)
            if common >= near_copies.SIMILARITY * (len(x) + len(y) - common):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert 400 < sum(d != g for d, g in group.items()) < 600
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # so that the rows of a shingle go on in the next batch
    try:
        found = near_copies.first_of_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["__ls_k"]: r["first"]["__ls_k"] for r in found} == group


def test_nodes_of_a_large_group_meet_its_centres_and_not_each_other(spark, monkeypatch):
    draw, base = random.Random(14), words(random.Random(13), 150)
    rows = [(0, " ".join(base))]
    for i in range(1, 401):
        # one or two changed words: similar to the base, hardly to each other; and texts that are similar to none, with a passage of it
        v = list(base)
        for at in draw.sample(range(5, 145), 1 + i % 2):
            v[at] = words(draw, 1)[0]
        rows.append((i, " ".join(v)))
        rows.append((1000 + i, " ".join(base[20:130] + words(draw, 40))))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    assert all(len(x & sets[0]) >= near_copies.SIMILARITY * len(x | sets[0]) for d, x in sets.items() if d <= 400)
    apart = [x for d, x in sets.items() if d > 400]
    assert all(len(x & y) < near_copies.SIMILARITY * len(x | y) for x in apart for y in sets.values() if x is not y)
    compared, possible = [], near_copies.possible

    def counting(pairs, *args):
        compared.append(pairs.count())
        return possible(pairs, *args)

    monkeypatch.setattr(near_copies, "possible", counting)
    found = near_copies.first_of_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["__ls_k"]: r["first"]["__ls_k"] for r in found} == {d: 0 if d <= 400 else d for d, _ in rows}
    # the pairs grow with the nodes, not with their square (some 320,000)
    assert sum(compared) < 12 * len(rows), compared


def test_a_shingle_of_many_rows_enters_no_prefix_and_few_counters_change_no_group(spark, monkeypatch):
    draw = random.Random(15)
    passage, rows = words(draw, 8), []
    for i in range(12_000):
        w = words(draw, 20)
        rows.append((i, " ".join(w[:10] + passage + w[10:] if i % 100 == 0 else w)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    common = set(near_copies.shingles(" ".join(passage).encode()).view("int64").tolist())
    assert len(common) == 4
    for r in near_copies.prints(keyed(docs).select("__ls_k", "__ls_t", "text")).where("__ls_k % 100 = 0").select("prefix").collect():
        assert r.prefix and not common & set(r.prefix)
    # copies with one other word of 40 at the end: 35 of 37 shingles; whatever the counters, the groups are the same
    rows = [(10 * i + c, " ".join([*w[:39], x])) for i in range(60) for w in [words(draw, 40)] for c, x in enumerate(words(draw, 3))]
    for bits in (3, 24):
        monkeypatch.setattr(near_copies.rarity, "__defaults__", (bits,))
        found = near_copies.first_of_groups(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r["__ls_k"]: r["first"]["__ls_k"] for r in found} == {d: d // 10 * 10 for d, _ in rows}


def test_only_the_texts_of_candidates_are_shuffled(spark):
    rows = keyed(spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, None)], SCHEMA))
    wanted = rows.where("doc_id is null or doc_id % 100 = 0").select("__ls_k", "__ls_t")
    kept = {r.doc_id for r in near_copies.marked(rows, wanted).select("doc_id").collect()}
    assert {None, *range(0, 3000, 100)} <= kept and len(kept) < 40
    assert near_copies.marked(rows, wanted.limit(0)).count() == 0


def test_the_join_on_shingles_makes_no_rows_of_pairs_that_are_far_apart(spark):
    draw, passage = random.Random(16), words(random.Random(17), 60)
    # a quarter of each text is one passage; every tenth has a near copy: two words of 240 changed
    rows = []
    for i in range(200):
        w = [*passage, *words(draw, 180)]
        rows.append((10 * i, " ".join(w)))
        if i % 10 == 0:
            rows.append((10 * i + 1, " ".join([*w[:-30], "other", *w[-29:-1], "other"])))
    sets = {d: near_copies.shingles(t.encode()) for d, t in rows}
    few = list(sets.values())[:40]
    for x in few:
        for y in few:
            bits = (near_copies.odd(x) ^ near_copies.odd(y)).view("uint8")
            assert sum(int(b).bit_count() for b in bits) <= len(set(x.tolist()) ^ set(y.tolist()))
    # every node with one shingle that all share, early in all orders
    sides = spark.createDataFrame([(7, d, len(h), 0, d, near_copies.odd(h).tolist()) for d, h in sets.items()], "token long, node long, n long, at long, root long, odd array<long>")
    met = {frozenset((r.a, r.b)) for r in near_copies.meetings(sides, near_copies.SIMILARITY).collect()}
    alike = {frozenset((d, d + 1)) for d in sets if d + 1 in sets}
    assert len(alike) == 20 and alike <= met and len(met) < 40
    found = near_copies.first_of_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["__ls_k"]: r["first"]["__ls_k"] for r in found} == {d: d // 10 * 10 for d in sets}
