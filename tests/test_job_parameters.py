"""Jobs keep every parameter of the verb they stand for."""

from __future__ import annotations

import json

import pytest

from lodeseek import cli
from lodeseek.api import Engine


def reader():
    """A factory of OCR engines, by name."""
    return (lambda image: "read", None)


class Watched(Engine):
    def __init__(self, spark, root, **more):
        super().__init__(spark, root, **more)
        self.calls = []

    def ingest(self, path, **given):
        self.calls.append(("ingest", path, given))
        return "d"

    def chunk(self, document, max_words=None, overlap_words=None):
        self.calls.append(("chunk", document, max_words, overlap_words))
        return 3

    def index(self, document, *given):
        self.calls.append(("index", document, *given))
        return ["index_bm25"]


def test_flags_of_the_command_line_reach_the_verbs(spark, tmp_path, capsys):
    root = ["--store", str(tmp_path / "store")]
    for line in (["ingest", "x.png", "--ocr", f"{__name__}:reader", "--mode", "Pure Local", "--dpi", "300", "--async"], ["chunk", "d", "--max-words", "50", "--async"], ["index", "d", "--mode", "visual", "--visual-backend", "colpali", "--visual-compression", "int8", "--colpali-model", "m", "--device", "cpu", "--async"]):
        assert cli.main([*root, *line], spark) == 0
    engine = Watched(spark, str(tmp_path / "store"))
    engine.work().awaitTermination()
    assert {r["status"] for r in engine.queue.states().collect()} == {"completed"}
    assert engine.calls == [("ingest", "x.png", {"engines": reader, "mode": "Pure Local", "dpi": 300}), ("chunk", "d", 50, None), ("index", "d", "visual", "colpali", "int8", "m", "cpu")]
    assert cli.main([*root, "worker", "--once"], spark) == 0
    assert cli.parser().parse_args(["worker"]).once is False
    capsys.readouterr()


def test_parts_of_a_pipeline_job(spark, tmp_path):
    engine = Watched(spark, str(tmp_path / "store"), ocr=reader)
    done = engine.handle("pipeline", {"ingest": {"path": "p.pdf", "ocr": True, "dpi": 90}, "index": {"mode": "bm25", "device": "gpu"}, "max_words": 40})
    assert done == {"document_id": "d", "chunk_count": 3, "indexes": ["index_bm25"]}
    assert engine.calls == [("ingest", "p.pdf", {"engines": reader, "dpi": 90}), ("chunk", "d", 40, None), ("index", "d", "bm25", None, None, None, "gpu")]
    engine.calls.clear()
    engine.handle("pipeline", {"path": "p.md", "mode": "dense"})
    assert engine.calls == [("ingest", "p.md", {}), ("chunk", "d", None, None), ("index", "d", "dense", None, None, None, None)]
    with pytest.raises(ValueError, match="asks for OCR"):
        Watched(spark, str(tmp_path / "store")).handle("ingest", {"path": "p.png", "ocr": True})
    assert json.loads(json.dumps(done)) == done
