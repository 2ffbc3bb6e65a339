"""Sources, store, jobs, the engine's verbs and the command line."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from lodeseek import cli
from lodeseek.api import EncoderUnavailableError, Engine, NotFoundError
from lodeseek.sources import ingest
from lodeseek.sources.config import Settings, read_settings
from lodeseek.streaming.jobs import Queue


def png(path, pixels: np.ndarray) -> None:
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_settings():
    s = read_settings({"RR_TOP_K": "9", "RR_PLANNER_RERANK": "off", "RR_BM25_K1": "bad", "OCR_MIN_DIM": "7"}, "# note\nRR_DPI=99\nexport RR_DEVICE='cpu'\nRR_TOP_K=3")
    assert (s.top_k, s.planner_rerank, s.bm25_k1, s.ocr_min_dim, s.dpi, s.device) == (9, False, 1.5, 7, 99, "cpu")
    assert read_settings({}) == Settings()


def test_text_and_history(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# Head\nbody \xff end")
    page = ingest.ingest(spark, str(tmp_path / "a.md")).first()
    assert page.text == "# Head\nbody � end" and (page.title, page.source_type, page.number) == ("a", ".md", 1)
    assert page.document_id == hashlib.sha1(f"{tmp_path}/a.md".encode() + b"# Head\nbody \xff end").hexdigest()[:16]
    run = {"timestamp": "t", "mode": "m", "results": [{"filename": "f", "pages": [{"page": 1, "glm": "g1", "final": ""}, {"page": 2, "glm": "g2", "final": "x2"}]}, {"filename": "h", "pages": [{"page": 1, "glm": "", "final": ""}]}]}
    (tmp_path / "h.json").write_text(json.dumps(run))
    rows = ingest.ingest(spark, str(tmp_path / "h.json")).orderBy("number").collect()
    assert [(r.number, r.text, r.metadata["source_filename"], r.metadata["source_page"]) for r in rows] == [(1, "g1", "f", "1"), (2, "x2", "f", "2"), (3, "", "h", "1")]
    (tmp_path / "bad.json").write_text("{")
    for name, error in (("bad.json", "Could not read"), ("x.exe", "Unsupported input type"), ("p.pdf", "rasterizer")):
        with pytest.raises(ValueError, match=error):
            ingest.ingest(spark, str(tmp_path / name))


def test_images_and_pdf(spark, tmp_path):
    png(tmp_path / "p.png", np.full((30, 90, 3), 250, np.uint8))
    page = ingest.image_pages(spark, str(tmp_path / "p.png"), engines=lambda: (lambda image: f"{image.shape[1]} wide", None), mode="Pure Local").first()
    assert page.text == "90 wide" and page.metadata["profile"].startswith("layout_visual orientation_landscape") and page.metadata["image_path"].endswith("p.png")
    (tmp_path / "d.pdf").write_bytes(b"one|two|BAD")
    rows = ingest.pdf_pages(spark, str(tmp_path / "d.pdf"), lambda: lambda data, dpi: [None if x == "BAD" else f"{x}@{dpi}" for x in data.decode().split("|")], 99).orderBy("number").collect()
    assert [(r.number, r.text) for r in rows] == [(1, "one@99"), (2, "two@99")]


def brightness(model, device):
    """A page model of two vectors: how bright and how dark a page is; questions ask for either."""
    return (lambda: lambda image: [[float(image.mean()), 0.0], [0.0, 255.0 - float(image.mean())]]), (lambda question: [[1.0, 0.0]] if "bright" in question else [[0.0, 1.0]])


@pytest.mark.parametrize("compression", ["none", "int8"])
def test_page_vectors_as_a_mode(spark, tmp_path, monkeypatch, compression):
    from dataclasses import replace

    from lodeseek import api

    monkeypatch.setattr(api, "settings", lambda: replace(Settings(), visual_backend="colpali"))
    engine = Engine(spark, str(tmp_path / "store"), brightness)
    ids = {}
    for name, level in (("light", 250), ("dark", 5)):
        png(tmp_path / f"{name}.png", np.full((20, 20, 3), level, np.uint8))
        ids[name] = engine.ingest(str(tmp_path / f"{name}.png"))
        assert engine.index(ids[name], "visual", compression=compression) == ["index_visual", "index_vectors"]
    for word, name in (("bright", "light"), ("black", "dark")):
        got = engine.query(f"a {word} page", mode="visual", save=False)["evidence"]
        assert [e["document_id"] for e in got] == [ids[name], ids["dark" if name == "light" else "light"]] and got[0]["retrieval_path"] == "visual"
    with pytest.raises(EncoderUnavailableError):
        Engine(spark, str(tmp_path / "store")).index(ids["dark"], "visual")


def test_html(spark):
    rows = spark.createDataFrame([(1, "u", "<html><head><title>t</title></head><body><h1>Top &amp; all</h1><script>x<y</script><p>One</p><p>Two &lt;3</p></body>")], "page_id long, url string, html string")
    assert ingest.html_pages(rows).first().text.split() == ["#", "Top", "&", "all", "One", "Two", "<3"]


def test_engine(spark, tmp_path, capsys):
    engine = Engine(spark, str(tmp_path / "store"))
    with pytest.raises(NotFoundError):
        engine.query("anything")
    (tmp_path / "a.md").write_text("# 1 Solver\nThe Solver Engine converges, see Table 1.\n# 2 Notes\nTable 1 lists nothing else.")
    (tmp_path / "b.md").write_text("plain words about another matter")
    made = engine.pipeline(str(tmp_path / "a.md"))
    assert made["chunk_count"] == 2 and len(made["indexes"]) == 5
    other = engine.ingest(str(tmp_path / "b.md"))
    assert engine.chunk(other, 20, 0) == 1
    for mode in ("bm25", "dense", "late", "hybrid", "graph", "visual", "planner"):
        got = engine.query("Where does the Solver Engine converge", mode=mode, top_k=2)
        assert got["evidence"][0]["document_id"] == made["document_id"], mode
    assert got["card"]["answerable"] and len(engine.store.runs()) == 7
    kinds = engine.store.load_run(got["run_id"])
    assert set(kinds) == {"evidence_bundle", "knowledge_card", "retrieval_trace"} and kinds["retrieval_trace"].where("path = 'planner'").count() == 1
    rows = {r.document_id: r for r in engine.documents().collect()}
    assert rows[made["document_id"]].has_graph and rows[made["document_id"]].chunk_count == 2 and not rows[other].has_bm25
    assert engine.store.indexes(made["document_id"]) == ["bm25", "dense", "late", "visual", "graph"]
    assert engine.store.load("kg_entities", [made["document_id"]].copy()).where("entity = 'Solver Engine'").count() == 1
    for call, error in ((lambda: engine.query("q", "nope"), NotFoundError), (lambda: engine.query("q", top_k=99), ValueError), (lambda: engine.chunk(other, 5), ValueError), (lambda: engine.query("q", mode="x"), ValueError)):
        with pytest.raises(error):
            call()
    # the second document was never indexed: nothing is built for a question, and the trace tells
    alone = engine.query("plain words", other, mode="bm25")
    assert alone["evidence"] == [] and not alone["card"]["answerable"] and alone["missing_indexes"] == {"bm25": [other]}
    steps = engine.store.load_run(alone["run_id"])["retrieval_trace"].where("path = 'missing_index'").collect()
    assert len(steps) == 1 and json.loads(steps[0].payload)["documents"] == [other]
    both = engine.query("plain Solver words", mode="hybrid")
    assert {e["document_id"] for e in both["evidence"]} == {made["document_id"]} and set(both["missing_indexes"]) == {"bm25", "dense"}
    planned = engine.query("Where does the Solver Engine converge", made["document_id"])
    paths = [r.path for r in engine.store.load_run(planned["run_id"])["retrieval_trace"].orderBy("step").collect()]
    assert paths[0] == "planner" and paths[-1] == "planner_merge" and "planner_route" in paths and planned["missing_indexes"] == {}
    assert planned["evidence"][0]["metadata"]["parent_section"] == "1 Solver" and "routes" in planned["evidence"][0]["metadata"]
    engine.index(other, "bm25")
    assert engine.query("plain words", other, mode="bm25")["evidence"][0]["document_id"] == other
    # newest first, with profiles
    listed = engine.documents().collect()
    assert [r.document_id for r in listed] == [other, made["document_id"]] and listed[1].profile.headings == ["1 Solver", "2 Notes"]
    one = engine.document(made["document_id"])
    assert one["profile"]["page_count"] == 1 and one["knowledge_graph"]["sections"]["count"] == 2 and "Solver Engine" in one["knowledge_graph"]["entities"]["first"]
    # a second write of one document leaves the other
    engine.chunk(other, 20, 0)
    assert engine.store.load("chunks").count() == 3
    engine.chunk(made["document_id"], 20, 0)
    assert engine.store.load("chunks").count() == 3 and engine.store.load("chunks", [other]).count() == 1
    assert len(list((tmp_path / "store" / "raw" / other).glob("b.md"))) == 1
    root = ["--store", str(tmp_path / "store")]
    assert cli.main([*root, "query", "Solver", "--top-k", "1", "--mode", "bm25"], spark) == 0
    assert json.loads(capsys.readouterr().out)["evidence"][0]["rank"] == 1
    assert cli.main([*root, "query", "Solver", "--document-id", "nope"], spark) == 2
    assert cli.main([*root, "job-status", "nope"], spark) == 1


def test_jobs(spark, tmp_path):
    queue = Queue(spark, str(tmp_path / "jobs"))
    assert queue.states().count() == 0
    with pytest.raises(ValueError, match="Unknown job type"):
        queue.submit("dance", {})
    ran = []

    def handler(kind, params):
        ran.append((kind, params["n"]))
        if params["n"] == 2:
            raise RuntimeError("no luck")
        return {"n": params["n"]}

    ids = [queue.submit(kind, {"n": n}) for n, kind in enumerate(("pipeline", "chunk", "ingest"))]
    assert {r.status for r in queue.states().collect()} == {"pending"}
    queue.start(handler).awaitTermination()
    assert ran == [("pipeline", 0), ("chunk", 1), ("ingest", 2)]  # first come, first served, whatever their type
    late = queue.submit("index", {"n": 9})
    states = {r.job_id: r for r in queue.states().collect()}
    assert [states[i].status for i in (*ids, late)] == ["completed", "completed", "failed", "pending"]
    assert states[ids[2]].error == "no luck" and json.loads(states[ids[0]].result) == {"n": 0}
    queue.start(handler).awaitTermination()
    assert ran[-1] == ("index", 9) and len(ran) == 4
    assert [r.job_id for r in queue.jobs("completed", 2).collect()] == [late, ids[1]]
    with pytest.raises(ValueError, match="Unknown job status"):
        queue.jobs("lost")


def test_history_export_is_read_again(spark, tmp_path):
    import zipfile

    pages = ingest.table_pages(spark.createDataFrame([(1, "one", 0), (1, "two", 1)], "d long, t string, n long"), "d", "t", "n")
    again = ingest.run_pages(ingest.history_rows(pages).selectExpr("document_id", "'x' AS title", "'p' AS path", "json"))
    assert [(r.number, r.text) for r in again.orderBy("number").collect()] == [(1, "one"), (2, "two")]
    with zipfile.ZipFile(ingest.export_pages(pages, str(tmp_path / "pages.zip"))) as z:
        assert z.namelist() == ["1_page1.md", "1_page2.md"] and z.read("1_page2.md") == b"two"


def test_log_and_exports(tmp_path, capsys):
    import lodeseek
    from lodeseek import log

    logger = log.set_up("INFO", str(tmp_path / "x.log"))
    log.set_up("INFO", str(tmp_path / "x.log")).info("hello")
    assert (tmp_path / "x.log").read_text().count("hello") == 1 and "hello" in capsys.readouterr().out
    for h in logger.handlers[:]:
        logger.removeHandler(h)
        h.close()
    logger.propagate = True
    assert lodeseek.Engine is Engine and "bm25" in lodeseek.__all__ and all(getattr(lodeseek, n) is not None for n in lodeseek.__all__)
    with pytest.raises(AttributeError):
        lodeseek.nothing  # noqa: B018
