"""The catalog: documents' tables as Parquet, in buckets of the document's id, and the runs. [A7-A11, B1-B4]

A write replaces the rows of the documents it holds and leaves the others: new rows are added as files of their own,
and only files that hold older rows of the same documents are written again without them.

What a table holds is said by numbered manifests, lists of its files. A write ends by renaming its manifest to the next
number, which fails if another writer took that number first; then it looks again which files are outdated, and tries
the next one (``CONFLICTS`` times). So every reader sees one version, before or after a write and never between, and keeps
it for as long as it reads: files that no version of the last ``KEPT`` seconds names are deleted by later writes. A
document's rows are found by its bucket, which is in the files' paths, and by the files' own statistics.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators import postings
from lodeseek.session import settled

BUCKETS = 256
#: Seconds for which a version stays readable after the next one; how often a write gives way to others.
KEPT, CONFLICTS = 3600, 16
TABLES = ("pages", "profiles", "chunks", "index_bm25", "index_dense", "index_late", "index_visual", "index_vectors", "index_graph", "kg_sections", "kg_entities", "kg_references", "kg_stats")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"Unknown table: {table}")
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[tuple[int, float]]:
        """(number, seconds since it was written) of a table's manifests, the last one first."""
        path, fs = self._fs(f"{self.path(table)}/versions")
        found = [(int(x.getPath().getName()), time.time() - x.getModificationTime() / 1000) for x in fs.listStatus(path) if x.getPath().getName().isdigit()] if fs.exists(path) else []
        return sorted(found, reverse=True)

    def manifest(self, table: str, version: int) -> list[str]:
        path, fs = self._fs(f"{self.path(table)}/versions/{version}")
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def snapshot(self, table: str) -> tuple[int, list[str]]:
        """The last version of a table and its files, below data/; 0 and none before the first write."""
        found = self.versions(table)
        return (found[0][0], self.manifest(table, found[0][0])) if found else (0, [])

    def exists(self, table: str) -> bool:
        """Whether the table has rows."""
        return bool(self.snapshot(table)[1])

    def _read(self, table: str, files: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path(table)}/data/{f}" for f in files])

    def _write(self, table: str, df: DataFrame) -> list[str]:
        """Writes rows (with bucket) into a folder of their own; returns its files."""
        name = uuid.uuid4().hex
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path(table)}/data/{name}")
        path, fs = self._fs(f"{self.path(table)}/data/{name}")
        found, out = fs.listFiles(path, True), []
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().startswith("part-"):
                out.append(f"{name}/{at.getParent().getName()}/{at.getName()}")
        return sorted(out)

    def _commit(self, table: str, version: int, files: list[str]) -> bool:
        """Takes a version's number with its manifest, which appears whole; False if another writer has it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        (draft, fs), (to, _) = self._fs(f"{self.path(table)}/versions/_{uuid.uuid4().hex}"), self._fs(f"{self.path(table)}/versions/{version}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        try:
            # unlike FileSystem.rename, this one never replaces a file
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), conf).rename(draft, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            return False
        return True

    def outdated(self, table: str, files: list[str], named: DataFrame) -> list[str]:
        """Those of files that hold rows of named (document_id, bucket)."""
        buckets = {f"bucket={r['bucket']}" for r in named.select("bucket").distinct().collect()}  # at most BUCKETS
        some = [f for f in files if f.split("/")[1] in buckets]
        if not some:
            return []
        held = self._read(table, some).select("document_id", F.col("_metadata.file_path").alias("f")).join(named.select("document_id"), "document_id", "left_semi")
        return sorted(r["f"].rpartition("/data/")[2] for r in held.select("f").distinct().collect())

    def save(self, table: str, df: DataFrame) -> None:
        """Rows of some documents, which replace all they had. [B1]"""
        if table in ("chunks", "index_bm25"):
            self.unseal()
        if table == "pages":
            df = df.withColumn("created_at", F.current_timestamp())
        bucket = F.pmod(F.crc32(F.col("document_id").cast("binary")), F.lit(BUCKETS)).cast("int")
        df = settled(df.withColumn("bucket", bucket))
        named, fresh = df.select("document_id", "bucket").distinct(), self._write(table, df)
        for _ in range(CONFLICTS):
            version, files = self.snapshot(table)
            gone = self.outdated(table, files, named)
            again = []
            if gone:
                others = self._read(table, gone).join(named.select("document_id"), "document_id", "left_anti")
                again = self._write(table, settled(others.withColumn("bucket", bucket)))
            if self._commit(table, version + 1, sorted({*files, *fresh, *again} - set(gone))):
                self.clean(table)
                return
        raise RuntimeError(f"Other writers took {CONFLICTS} versions of {table} one after the other")

    def clean(self, table: str) -> None:
        """Deletes the manifests that were followed by another one more than KEPT seconds ago, and the files that only they name."""
        found = self.versions(table)
        old = [v for (v, _), (_, since) in zip(found[1:], found, strict=False) if since > KEPT]
        if old:
            kept = {f for v, _ in found if v not in old for f in self.manifest(table, v)}
            for f in {f for v in old for f in self.manifest(table, v)} - kept:
                at, fs = self._fs(f"{self.path(table)}/data/{f}")
                fs.delete(at, False)
            for v in old:
                at, fs = self._fs(f"{self.path(table)}/versions/{v}")
                fs.delete(at, False)

    def load(self, table: str, documents: list[str] | None = None) -> DataFrame:
        """One version of a table, pruned to the buckets of some documents; FileNotFoundError when it was never written. [A8]"""
        _, files = self.snapshot(table)
        if not files:
            raise FileNotFoundError(f"No table {table} in {self.root}")
        if documents is None:
            return self._read(table, files)
        wanted = {f"bucket={zlib.crc32(d.encode()) % BUCKETS}" for d in documents}
        return self._read(table, [f for f in files if f.split("/")[1] in wanted] or files[:1]).where(F.col("document_id").isin(documents))

    def documents(self) -> DataFrame:
        """document_id, title, source_type, source_path, created_at, page_count; newest first. [A7, I7]"""
        if not self.exists("pages"):
            return self.spark.createDataFrame([], "document_id string, title string, source_type string, source_path string, created_at timestamp, page_count long")
        first = lambda c: F.first(c).alias(c)  # noqa: E731 the same on all pages of a document
        return self.load("pages").groupBy("document_id").agg(first("title"), first("source_type"), first("source_path"), F.max("created_at").alias("created_at"), F.count("*").alias("page_count")).orderBy(F.desc("created_at"), "document_id")

    def index_tables(self, documents: list[str] | None = None) -> dict[str, DataFrame]:
        """The stored indexes by name, for some documents or all. [A11]"""
        return {t.removeprefix("index_"): self.load(t, documents) for t in TABLES if t.startswith("index_") and self.exists(t)}

    def seal(self, scope: str, k1: float, b: float) -> None:
        """Builds the index by term of all chunks whose documents have a BM25 index; the next write of either ends its use."""
        chunks = self.load("chunks").join(self.load("index_bm25").select("document_id").distinct(), "document_id", "left_semi")
        name = uuid.uuid4().hex
        postings.build(chunks, f"{self.root}/bm25_by_term/{name}", scope, k1, b)
        at, fs = self._fs(f"{self.root}/bm25_by_term/current")
        out = fs.create(at, True)
        out.write(bytearray(name.encode()))
        out.close()

    def unseal(self) -> None:
        at, fs = self._fs(f"{self.root}/bm25_by_term")
        fs.delete(at, True)

    def sealed(self) -> postings.Index | None:
        """The index by term, while it holds what is stored."""
        at, fs = self._fs(f"{self.root}/bm25_by_term/current")
        return postings.Index(self.spark, f"{self.root}/bm25_by_term/{self.spark.read.text(at.toString()).first()[0]}") if fs.exists(at) else None

    def lacking(self, names: list[str], documents: list[str] | None = None) -> dict[str, list[str]]:
        """For each of the indexes, the documents that have none, at most nine of them; only indexes that some document lacks."""
        known = self.load("chunks" if self.exists("chunks") else "pages", documents).select("document_id").distinct()
        out = {}
        for name in names:
            held = self.load(f"index_{name}", documents).select("document_id").distinct() if self.exists(f"index_{name}") else None
            gone = known if held is None else known.join(held, "document_id", "left_anti")
            if found := [r["document_id"] for r in gone.orderBy("document_id").limit(9).collect()]:
                out[name] = found
        return out

    def save_raw(self, path: str, document: str) -> str:
        """The file as it was read, below raw/<document>; a file that lies there already stays as it is. [B2]"""
        at, fs = self._fs(path)
        to, there = self._fs(f"{self.root}/raw/{document}/{at.getName()}")
        if at.toString() != to.toString():
            self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, there, to, False, True, self.spark.sparkContext._jsc.hadoopConfiguration())
        return to.toString()

    def has_document(self, document: str) -> bool:
        return self.exists("pages") and not self.load("pages", [document]).isEmpty()

    def indexes(self, document: str) -> list[str]:
        """Names of the indexes that a document has. [A10]"""
        return [t.removeprefix("index_") for t in TABLES if t.startswith("index_") and self.exists(t) and not self.load(t, [document]).isEmpty()]

    def save_run(self, artifacts: dict[str, DataFrame], run_id: str | None = None) -> str:
        """Each artifact of a run as JSON lines below runs/<id>/. [B4]"""
        run_id = run_id or f"{datetime.now(UTC):%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:6]}"
        for name, df in artifacts.items():
            df.coalesce(1).write.mode("overwrite").json(f"{self.root}/runs/{run_id}/{name}")
        return run_id

    def runs(self) -> list[tuple[str, list[str]]]:
        """(run id, artifact names), newest first. [A9]"""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs")
        fs = top.getFileSystem(conf)
        if not fs.exists(top):
            return []
        names = lambda p: sorted(x.getPath().getName() for x in fs.listStatus(p))
        return [(r, names(jvm.org.apache.hadoop.fs.Path(top, r))) for r in reversed(names(top))]

    def load_run(self, run_id: str) -> dict[str, DataFrame]:
        found = dict(self.runs()).get(run_id)
        if found is None:
            raise FileNotFoundError(f"No run {run_id}")
        return {name: self.spark.read.json(f"{self.root}/runs/{run_id}/{name}") for name in found}

    def catalog(self) -> DataFrame:
        """Documents with what is there for them; what is missing is null, 0 or false. [F12]"""
        docs = self.documents()
        count = lambda t, name: self.load(t).groupBy("document_id").agg(F.count("*").alias(name)) if self.exists(t) else None
        for table, name in (("chunks", "chunk_count"), ("kg_entities", "entity_count")):
            held = count(table, name)
            docs = docs.join(held, "document_id", "left") if held is not None else docs.withColumn(name, F.lit(None).cast("long"))
            docs = docs.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
        for t in TABLES:
            if t.startswith("index_"):
                flag = f"has_{t.removeprefix('index_')}"
                held = self.load(t).select("document_id").distinct().withColumn(flag, F.lit(True)) if self.exists(t) else None
                docs = docs.join(held, "document_id", "left") if held is not None else docs.withColumn(flag, F.lit(False))
                docs = docs.withColumn(flag, F.coalesce(flag, F.lit(False)))
        return docs.orderBy(F.desc("created_at"), "document_id")
