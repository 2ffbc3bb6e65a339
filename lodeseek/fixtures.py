"""Small labelled collections that tune and compare retrieval: texts for the planner, drawn pages, badly read pages. [T1-T3]

Each builder fills an engine's store and gives the manifest that ``Engine.evaluate`` takes. Texts and pages follow
rules, so the same collection comes out everywhere; a page is drawn in numpy and written as PNG.
"""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np

#: Per subject: its full name, what it measures, and what it is compared with.
SUBJECTS = [
    ("Flux Regulator", "pressure drift", "Thermal Governor"), ("Thermal Governor", "heat balance", "Flux Regulator"), ("Packet Router", "queue delay", "Mesh Gateway"),
    ("Mesh Gateway", "link loss", "Packet Router"), ("Grain Sorter", "kernel size", "Seed Counter"), ("Seed Counter", "pod yield", "Grain Sorter"),
]


def write_png(path: Path, pixels: np.ndarray) -> Path:
    """An RGB image (height, width, 3) of bytes as a PNG file."""
    h, w, _ = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    return path


def drawn(kind: str, width: int = 1000, height: int = 800) -> np.ndarray:
    """A page of one kind: table, form, chart, diagram, photo or text."""
    page = np.full((height, width, 3), 255, np.uint8)
    if kind in ("table", "form"):
        rows, columns = (9, 5) if kind == "table" else (6, 2)
        for i in range(rows + 1):
            page[60 + i * 70 : 63 + i * 70, 60 : width - 60] = 0
        for i in range(columns + 1):
            x = 60 + i * (width - 120) // columns
            page[60 : 60 + rows * 70, x : x + 3] = 0
    elif kind == "chart":
        for i, level in enumerate((300, 520, 180, 610, 420, 250)):
            page[height - 60 - level : height - 60, 90 + i * 150 : 190 + i * 150] = (40, 90, 200)
    elif kind == "diagram":
        for i in range(3):
            left = 80 + i * 320
            page[300:480, left : left + 200] = (210, 230, 210)
            page[300:304, left : left + 200] = page[476:480, left : left + 200] = 0
            page[388:392, left + 200 : min(left + 320, width)] = 0
    elif kind == "photo":
        y, x = np.mgrid[0:height, 0:width]
        page[:] = ((np.sin(x / 17) * np.cos(y / 23) + 1) * 110 + (x * 7 + y * 13) % 37).astype(np.uint8)[..., None]
    else:
        for i in range(24):
            page[50 + i * 30 : 58 + i * 30, 70 : width - 70 - (i * 53) % 300] = 60
    return page


def tuning_text(i: int) -> str:
    """The document of a subject: an overview, a method, a table and a comparison that refers to them."""
    name, measure, other = SUBJECTS[i]
    short = "".join(w[0] for w in name.split())
    return f"""# {i + 1} {name}

The {name} ({short}) keeps {measure} within its limits. Its part code is {short}-{4100 + i}.

## {i + 1}.1 Method

Each cycle reads the sensor, filters the signal and corrects {measure}. The method follows Section {i + 1} and is shown in Figure {i + 1}.

## {i + 1}.2 Results

Table {i + 1} lists the totals of {measure} for every run of the {name}.

## {i + 1}.3 Comparison

Compared with the {other}, the {name} reacts sooner but drifts more, as Table {i + 1} shows.
"""


def tuning_corpus(engine, folder: Path, subjects: int = len(SUBJECTS)) -> dict:
    """Texts in chunks of 70 words with 8 in common, all indexes, and a manifest of two questions for each subject with five variants. [T1]"""
    ids, queries = [], []
    for i in range(subjects):
        path = folder / f"subject_{i + 1}.md"
        path.write_text(tuning_text(i), encoding="utf-8")
        ids.append(engine.ingest(str(path)))
        engine.chunk(ids[-1], 70, 8)
        engine.index(ids[-1], "all")
        name, measure, other = SUBJECTS[i]
        short = "".join(w[0] for w in name.split())
        queries += [
            {"query": f"find part {short}-{4100 + i}", "expected_terms": [f"{short}-{4100 + i}"], "expected_pages": [1]},
            {"query": f"How does the {name} compare with the {other} across documents?", "expected_terms": ["reacts sooner"], "expected_pages": [1]},
        ]
    variants = [{"merge_strategy": s, "rerank": r} for s in ("score_max", "route_vote") for r in (False, True)]
    variants.append({"name": "score_rerank_soft", "merge_strategy": "score_max", "rerank": True, "rerank_overlap_weight": 0.05})
    expected = {"expected_entities": [s[0] for s in SUBJECTS[:subjects]], "expected_references": [f"table:{i + 1}" for i in range(subjects)], "expected_sections": [f"{i + 1}.1 method" for i in range(subjects)]}
    return {"document_ids": ids, "planner_rerank": True, "planner_sweep": variants, "queries": queries, **expected}


def visual_benchmark(engine, folder: Path, kinds: tuple[str, ...] = ("table", "form", "chart", "diagram", "photo", "text")) -> dict:
    """A drawn page of each kind, named after it, and questions of one document and of all. [T2]"""
    ids = {}
    for kind in kinds:
        ids[kind] = engine.ingest(str(write_png(folder / f"{kind}_sheet.png", drawn(kind))))
        engine.index(ids[kind], "visual")
    queries = [{"query": f"image of the {kind}_sheet page", "document_id": ids[kind], "expected_pages": [1]} for kind in kinds]
    queries += [{"query": f"page layout of {kind}_sheet", "document_ids": list(ids.values()), "expected_pages": [1]} for kind in kinds[:4]]
    return {"queries": queries}


#: What weak readers make of a table page and a diagram page.
BADLY_READ = {"table": "Tab1e 4 t0tals of the F1ux Regulator\n12 17 l9", "diagram": "f1g 2 signal path of the Mesh Gateway"}


def weak_pages(engine, folder: Path) -> dict:
    """A table and a diagram whose texts come from a weak reader, and three questions. [T3]"""
    ids = {}
    for kind, text in BADLY_READ.items():
        path = write_png(folder / f"weak_{kind}.png", drawn(kind))
        ids[kind] = engine.ingest(str(path), engines=lambda text=text: (lambda image: text, None), mode="Pure Local")
        engine.chunk(ids[kind])
        engine.index(ids[kind], "all")
    return {"document_ids": list(ids.values()), "expected_references": ["table:4", "figure:2"], "queries": [{"query": "show the table page", "expected_pages": [1]}, {"query": "diagram image of the Mesh Gateway", "expected_terms": ["Mesh Gateway"], "expected_pages": [1]}, {"query": "what does the signal path look like", "expected_pages": [1]}]}
