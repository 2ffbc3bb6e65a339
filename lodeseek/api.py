"""The engine's verbs: ingest, chunk, index, query, evaluate and jobs. [Q]"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators import evaluate as evaluation
from lodeseek.operators import evidence as M
from lodeseek.operators import filters
from lodeseek.operators import profile as P
from lodeseek.operators.chunking import chunk_pages
from lodeseek.operators.images import EncoderUnavailableError
from lodeseek.plans import retrieve as R
from lodeseek.plans.planner import plan_query
from lodeseek.session import settled
from lodeseek.sources.config import factory, settings
from lodeseek.sources.ingest import ingest as read_pages
from lodeseek.sources.store import Store
from lodeseek.streaming.jobs import Queue

VERSION = "0.1.0"
log = logging.getLogger("lodeseek")
BOUNDS = {"max_words": (20, 2000), "overlap_words": (0, 500), "top_k": (1, 50), "vote_bonus": (0.0, 1.0), "overlap_weight": (0.0, 1.0)}


class NotFoundError(LookupError):
    """An unknown document, run or job."""


def check(**values) -> None:
    """Bounds of the arguments. [A14]"""
    for name, value in values.items():
        low, high = BOUNDS[name]
        if value is not None and not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")


class Engine:
    """encoders(model, device) gives a page model: the factory of a worker's page encoder, and a function from a question to its vectors.
    ocr: the factory of the OCR engines of jobs that ask for OCR."""

    def __init__(self, spark: SparkSession, root: str | None = None, encoders: Callable | None = None, ocr: Callable | None = None):
        self.spark, self.store, self.encoders, self.ocr = spark, Store(spark, root or settings().data_root), encoders, ocr
        self.queue = Queue(spark, f"{self.store.root}/jobs")

    def health(self) -> dict:
        return {"status": "ok", "service": "lodeseek", "version": VERSION, "spark": self.spark.version, "gemini_configured": bool(settings().gemini_api_key)}

    def _known(self, document: str) -> None:
        if not self.store.has_document(document):
            raise NotFoundError(f"Document not found: {document}")

    def ingest(self, path: str, **engines) -> str:
        """Reads a file into the store, with its profile; returns its id."""
        s = settings()
        pages = read_pages(self.spark, path, **({"mode": s.ocr_mode, "dpi": s.dpi} | engines))
        document = pages.select("document_id").first()[0]
        self.store.save("pages", pages)
        self.store.save_raw(path, document)
        self.store.save("profiles", P.profiles(self.store.load("pages", [document])))
        log.info("ingested %s as %s", path, document)
        return document

    def chunk(self, document: str, max_words: int | None = None, overlap_words: int | None = None) -> int:
        check(max_words=max_words, overlap_words=overlap_words)
        self._known(document)
        s = settings()
        self.store.save("chunks", chunk_pages(self.store.load("pages", [document]), max_words or s.chunk_max_words, s.chunk_overlap_words if overlap_words is None else overlap_words))
        return self.chunks([document]).count()

    def model(self, backend: str | None = None, model: str | None = None, device: str | None = None) -> tuple:
        """Page and question encoder of the backend; none for the baseline."""
        s = settings()
        if (backend or s.visual_backend) == "baseline":
            return None, None
        if self.encoders is None:
            raise EncoderUnavailableError("No page encoder: pass the engine a function of model and device that gives one.")
        return self.encoders(model or s.colpali_model, device or s.device)

    def index(self, document: str, mode: str = "all", backend: str | None = None, compression: str | None = None, model: str | None = None, device: str | None = None) -> list[str]:
        """Writes the indexes of a mode. backend, compression, model and device say how pages are encoded; settings stand in. [Q8]"""
        self._known(document)
        s = settings()
        encoder, _ = self.model(backend, model, device)
        return R.build_indexes(self.store, self.chunks([document]), self.store.load("pages", [document]), mode, s.dense_dimensions, s.late_max_doc_tokens, encoder, compression or s.visual_compression)

    def seal(self) -> None:
        """Orders the BM25 index of all documents by term, so that a question to all reads its own words only."""
        s = settings()
        if not self.store.exists("index_bm25"):
            raise NotFoundError("No document has a BM25 index")
        self.store.seal("document", s.bm25_k1, s.bm25_b)

    def indexes(self, documents: list[str] | None) -> dict:
        """The stored indexes of some documents; of all, with the index by term, if there is one."""
        by_term = self.store.sealed() if documents is None else None
        return self.store.index_tables(documents) | ({"bm25_by_term": by_term} if by_term else {})

    def pipeline(self, path: str, mode: str = "all", max_words: int | None = None, overlap_words: int | None = None, **engines) -> dict:
        document = self.ingest(path, **engines)
        return {"document_id": document, "chunk_count": self.chunk(document, max_words, overlap_words), "indexes": self.index(document, mode)}

    def scope(self, documents: list[str] | str | None) -> list[str] | None:
        """Checked ids; None for all documents. [E3]"""
        ids = [documents] if isinstance(documents, str) else documents
        for d in ids or []:
            self._known(d)
        if not ids and self.store.documents().isEmpty():
            raise NotFoundError("No documents available")
        return ids or None

    def query(self, question: str, documents: list[str] | str | None = None, top_k: int | None = None, mode: str | None = None, save: bool = True, **planning) -> dict:
        """{run_id, evidence, card}: rows of one question."""
        if not question:
            raise ValueError("question must not be empty")
        k, mode = top_k or settings().top_k, mode or settings().retrieval_mode
        check(top_k=k, **{n: planning[n] for n in ("vote_bonus", "overlap_weight") if n in planning})
        R.check_mode(mode)
        ids = self.scope(documents)
        q = R.one_question(self.spark, question)
        found = settled(R.retrieve(mode, self.chunks(ids), self.store.load("pages", ids), q, k, indexes=self.indexes(ids), question_vectors=self.asked_vectors(question), **self.made(), **(self.planning() | planning if mode == "planner" else {})))
        needed = [i for m in (plan_query(question).routes if mode == "planner" else [mode]) for i in R.INDEXES[m]]
        lacking = self.store.lacking(list(dict.fromkeys(needed)), ids)
        for name, gone in lacking.items():
            log.warning("no %s index for %s", name, ", ".join(gone))
        card = M.cards(found, q)
        run = self.store.save_run({"evidence_bundle": found, "knowledge_card": card, "retrieval_trace": R.trace(mode, q, found, k, lacking).withColumn("payload", F.to_json("payload"))}) if save else None
        return {"run_id": run, "evidence": [r.asDict(True) for r in found.orderBy("rank").collect()], "card": card.first().asDict(True), "missing_indexes": lacking}

    def chunks(self, documents: list[str] | None = None) -> DataFrame:
        """Stored chunks; none where no document has any words."""
        return self.store.load("chunks", documents) if self.store.exists("chunks") else chunk_pages(self.store.load("pages", documents)).limit(0)

    def asked_vectors(self, question: str) -> DataFrame | None:
        """The question's vectors by the page model, where there is one."""
        _, encode = self.model() if self.encoders else (None, None)
        return self.spark.createDataFrame([("q", [[float(x) for x in v] for v in encode(question)])], "query_id string, vectors array<array<double>>") if encode else None

    def made(self) -> dict:
        """Settings that say how rows and scores are made."""
        s = settings()
        return {"k1": s.bm25_k1, "b": s.bm25_b, "dense_dimensions": s.dense_dimensions, "late_dimensions": s.late_dimensions}

    def planning(self) -> dict:
        """Settings of the planner's merge."""
        s = settings()
        return {"strategy": s.planner_merge_strategy, "rerank": s.planner_rerank, "vote_bonus": s.route_vote_bonus, "overlap_weight": s.rerank_overlap_weight}

    def evaluate(self, manifest: dict | str, top_k: int = 5, modes: tuple[str, ...] = ("bm25", "dense", "hybrid", "planner"), **planning) -> dict:
        """planning: planner_* entries that go before the manifest's."""
        found = evaluation.load_manifest(manifest) if isinstance(manifest, str) else manifest
        check(top_k=top_k)
        _, encode = self.model() if self.encoders else (None, None)
        vectors = (lambda question: [[float(x) for x in v] for v in encode(question)]) if encode else None
        stored = evaluation.Stored(self.indexes, self.store.lacking, vectors, **self.made())
        return evaluation.run(self.spark, found | planning, self.chunks(), self.store.load("pages"), top_k, modes, stored, self.planning())

    def document(self, document: str) -> dict:
        """Catalog row, profile, and the numbers and names of the knowledge graph of a document. [Q5]"""
        self._known(document)
        out = self.store.catalog().where(F.col("document_id") == document).first().asDict()
        row = self.store.load("profiles", [document]).first() if self.store.exists("profiles") else None
        out["profile"] = row.asDict(True) if row else None
        out["knowledge_graph"] = {}
        for kind, name in (("kg_sections", "section"), ("kg_entities", "entity"), ("kg_references", "ref")):
            rows = self.store.load(kind, [document]) if self.store.exists(kind) else None
            out["knowledge_graph"][kind.removeprefix("kg_")] = {"count": rows.count() if rows is not None else 0, "first": [r[name] for r in rows.orderBy(name).limit(50).collect()] if rows is not None else []}
        stats = self.store.load("kg_stats", [document]).drop("document_id").first() if self.store.exists("kg_stats") else None
        out["knowledge_graph"]["stats"] = stats.asDict(True) if stats else None
        return out

    def graph_rows(self, document: str, kind: str, text: str = "") -> DataFrame:
        """Rows of one part of a document's knowledge graph (sections, entities, references) that hold a text. [E10]"""
        if kind not in ("sections", "entities", "references"):
            raise ValueError(f"Unknown part of a knowledge graph: {kind}")
        self._known(document)
        return filters.holding(self.store.load(f"kg_{kind}", [document]), text)

    def inventory(self, document: str, text: str = "") -> DataFrame:
        """Kinds of references of a document's profile, with those that hold a text. [E10]"""
        self._known(document)
        return filters.inventory(self.store.load("profiles", [document]), text).orderBy("kind")

    def handle(self, kind: str, params: dict) -> dict:
        """One job; its parameters are those of the verb it stands for. A pipeline takes ingest and index parts, or a path and a mode. [N4]"""
        if kind == "ingest":
            return {"document_id": self.ingest(params["path"], **self.reading(params))}
        if kind == "chunk":
            return {"document_id": params["document_id"], "chunk_count": self.chunk(params["document_id"], params.get("max_words"), params.get("overlap_words"))}
        if kind == "index":
            return {"document_id": params["document_id"], "indexes": self.index(params["document_id"], *self.indexing(params))}
        if kind == "pipeline":
            read, indexed = params.get("ingest") or {k: v for k, v in params.items() if k != "mode"}, params.get("index") or params
            document = self.ingest(read["path"], **self.reading(read))
            return {"document_id": document, "chunk_count": self.chunk(document, params.get("max_words"), params.get("overlap_words")), "indexes": self.index(document, *self.indexing(indexed))}
        raise ValueError(f"Unknown job type: {kind}")

    def reading(self, params: dict) -> dict:
        """How a job's file is read: mode, dpi and the OCR engines, by the name of their factory or, if it only asks for OCR, this engine's own."""
        ocr = params.get("ocr")
        if ocr and not isinstance(ocr, str) and self.ocr is None:
            raise ValueError("This job asks for OCR: pass the engine the factory of its OCR engines")
        given = {"engines": factory(ocr) if isinstance(ocr, str) and ocr else self.ocr if ocr else None, "mode": params.get("mode"), "dpi": params.get("dpi")}
        return {k: v for k, v in given.items() if v}

    @staticmethod
    def indexing(params: dict) -> tuple:
        """mode, backend, compression, model and device of a job."""
        return params.get("mode") or "all", *(params.get(k) or None for k in ("visual_backend", "visual_compression", "colpali_model", "device"))

    def work(self, interval: float | None = None):
        """Starts the worker on this engine's store."""
        return self.queue.start(self.handle, interval)

    def job(self, job_id: str) -> dict:
        row = self.queue.states().where(F.col("job_id") == job_id).first()
        if row is None:
            raise NotFoundError(f"Job not found: {job_id}")
        return row.asDict()

    def documents(self) -> DataFrame:
        """The catalog with profiles, newest first. [Q4]"""
        docs = self.store.catalog()
        if self.store.exists("profiles"):
            profile = F.struct("page_count", "text_page_count", "image_page_count", "word_count", "headings", "topics", "entities").alias("profile")
            docs = docs.join(self.store.load("profiles").select("document_id", profile), "document_id", "left").orderBy(F.desc("created_at"), "document_id")
        return docs
