"""Versions of the store: readers across writes, two writers, and what is deleted when."""

from __future__ import annotations

from pathlib import Path

import pytest

from lodeseek.sources import store as S

SCHEMA = "document_id string, chunk_id string, text string"


def rows(spark, *documents: str, text: str = "old"):
    return spark.createDataFrame([(d, f"{d}:chunk:{i}", text) for d in documents for i in range(2)], SCHEMA)


def held(df) -> set[tuple[str, str]]:
    return {(r.document_id, r.text) for r in df.collect()}


def test_a_reader_keeps_its_version_across_writes(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    assert not store.exists("profiles")
    with pytest.raises(FileNotFoundError):
        store.load("profiles")
    store.save("profiles", rows(spark, "a", "b", "c"))
    before = store.load("profiles")
    store.save("profiles", rows(spark, "b", text="new"))
    assert held(before) == {("a", "old"), ("b", "old"), ("c", "old")}
    assert held(store.load("profiles")) == {("a", "old"), ("b", "new"), ("c", "old")} and store.load("profiles").count() == 6
    assert held(store.load("profiles", ["b"])) == {("b", "new")} and store.load("profiles", ["nobody"]).count() == 0
    assert [v for v, _ in store.versions("profiles")] == [2, 1] and "bucket" not in store.load("profiles").columns


def test_of_two_writers_one_tries_again(spark, tmp_path, monkeypatch):
    first, second = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    first.save("profiles", rows(spark, "a", "b"))
    commit, tried = S.Store._commit, []

    def meanwhile(self, table, version, files):
        # both have prepared version 2; the other one takes it
        tried.append(version)
        if len(tried) == 1:
            monkeypatch.setattr(S.Store, "_commit", commit)
            second.save("profiles", rows(spark, "b", "d", text="second"))
            monkeypatch.setattr(S.Store, "_commit", meanwhile)
        return commit(self, table, version, files)

    monkeypatch.setattr(S.Store, "_commit", meanwhile)
    first.save("profiles", rows(spark, "b", "c", text="first"))
    assert tried == [2, 3]
    assert held(first.load("profiles")) == {("a", "old"), ("b", "first"), ("c", "first"), ("d", "second")} and first.load("profiles").count() == 8
    monkeypatch.setattr(S.Store, "_commit", lambda *_: False)
    monkeypatch.setattr(S, "CONFLICTS", 2)
    with pytest.raises(RuntimeError, match="took 2 versions"):
        first.save("profiles", rows(spark, "z"))
    assert second.load("profiles").count() == 8


def test_old_versions_and_their_files_go_in_the_end(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path))
    for text in ("1", "2", "3"):
        store.save("profiles", rows(spark, "a", text=text))
    files = lambda: {str(p.relative_to(tmp_path / "profiles" / "data")) for p in Path(tmp_path, "profiles", "data").rglob("part-*.parquet")}
    assert len(store.versions("profiles")) == 3 and len(files()) >= 3
    monkeypatch.setattr(S, "KEPT", -1)
    store.save("profiles", rows(spark, "b", text="4"))
    assert [v for v, _ in store.versions("profiles")] == [4] and files() == set(store.snapshot("profiles")[1])
    assert held(store.load("profiles")) == {("a", "3"), ("b", "4")}
