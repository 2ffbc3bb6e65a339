"""Readers: files of many kinds into pages, all through Spark's own sources. [A1-A6]

A page is (document_id, page_id, number, text, title, source_type, source_path, metadata). Reading is lazy and
distributed: a folder of a million files is one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT, IMAGE = (".txt", ".md", ".markdown"), (".png", ".jpg", ".jpeg", ".webp", ".tiff", ".bmp")
PAGE_COLUMNS = ["document_id", "page_id", "number", "text", "title", "source_type", "source_path", "metadata"]
HISTORY = "timestamp string, mode string, results array<struct<filename:string, pages:array<struct<page:int, glm:string, final:string>>>>"


def document_id(path: Column, content: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of the path and the first MiB of the content. [A6]"""
    return F.substring(F.sha1(F.concat(path.cast("binary"), F.substring(content, 1, 1 << 20))), 1, 16)


def page_key(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit(":page:"), number.cast("string"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, content, suffix, title of the files below a path with one of the suffixes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    suffix = F.lower(F.regexp_extract(plain, r"(\.[^./]+)$", 1))
    title = F.regexp_replace(F.regexp_extract(plain, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return rows.select(plain.alias("path"), "content", suffix.alias("suffix"), title.alias("title")).where(F.col("suffix").isin(*suffixes))


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page for each text or markdown file; bytes that are no UTF-8 become replacement characters. [A1]"""
    rows = files(spark, path, TEXT).withColumn("document_id", document_id(F.col("path"), F.col("content")))
    text = F.decode(F.col("content"), "UTF-8") if spark.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else lenient("content")
    return rows.select("document_id", page_key(F.col("document_id"), F.lit(1)).alias("page_id"), F.lit(1).alias("number"), text.alias("text"), "title", F.col("suffix").alias("source_type"), F.col("path").alias("source_path"), F.create_map().cast("map<string,string>").alias("metadata"))


def lenient(column: str) -> Column:
    """UTF-8 with replacement characters for bad bytes."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def history_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of saved OCR runs, numbered through all files of a run; broken files are an error. [A2]"""
    rows = files(spark, path, (".json",)).withColumn("document_id", document_id(F.col("path"), F.col("content")))
    return run_pages(rows.select("document_id", "title", "path", lenient("content").alias("json")))


def run_pages(rows: DataFrame) -> DataFrame:
    """Pages of runs given as document_id, title, path, json."""
    rows = rows.withColumn("run", F.from_json("json", HISTORY, {"mode": "FAILFAST"}))
    rows = rows.select("document_id", "title", "path", F.posexplode("run.results").alias("f", "result")).select("document_id", "title", "path", "f", "result.filename", F.posexplode("result.pages").alias("p", "page"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("f", "p"))
    rows = rows.withColumn("number", number)
    text = F.coalesce(F.nullif(F.col("page.final"), F.lit("")), F.nullif(F.col("page.glm"), F.lit("")), F.lit(""))
    meta = F.create_map(F.lit("source_filename"), F.col("filename"), F.lit("source_page"), F.col("page.page").cast("string"), F.lit("glm_text"), F.coalesce("page.glm", F.lit("")))
    return rows.select("document_id", page_key(F.col("document_id"), F.col("number")).alias("page_id"), "number", text.alias("text"), "title", F.lit("history_json").alias("source_type"), F.col("path").alias("source_path"), meta.alias("metadata"))


def image_pages(spark: SparkSession, path: str, engines: Callable | None = None, mode: str = "Hybrid") -> DataFrame:
    """One page for each image, with its profile, and its text when engines are given. [A3]"""
    from lodeseek.operators import images

    pixels = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select(F.regexp_replace("image.origin", "^file:/*", "/").alias("page_id"), "image")
    profile = images.image_profiles(pixels)
    rows = files(spark, path, IMAGE).withColumn("document_id", document_id(F.col("path"), F.col("content"))).drop("content").join(profile.withColumnRenamed("page_id", "path"), "path", "left")
    text = F.lit("")
    if engines:
        rows = rows.join(images.ocr(pixels, engines, mode).withColumnRenamed("page_id", "path"), "path", "left")
        text = F.coalesce("text", F.lit(""))
    meta = F.create_map(F.lit("image_path"), F.col("path"), F.lit("profile"), F.coalesce("profile", F.lit("layout_unknown")))
    return rows.select("document_id", page_key(F.col("document_id"), F.lit(1)).alias("page_id"), F.lit(1).alias("number"), text.alias("text"), "title", F.col("suffix").alias("source_type"), F.col("path").alias("source_path"), meta.alias("metadata"))


def pdf_pages(spark: SparkSession, path: str, rasterizer: Callable[[], Callable] | None, dpi: int = 150) -> DataFrame:
    """Pages of PDF files. rasterizer() gives a worker a callable from (bytes, dpi) to a list of page texts or None. [A4]

    Pages that fail (None) are left out; a file without pages gives none.
    """
    if rasterizer is None:
        raise ValueError("PDF files need a rasterizer: pass the factory of a callable from (bytes, dpi) to page texts")
    rows = files(spark, path, (".pdf",)).withColumn("document_id", document_id(F.col("path"), F.col("content")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = rasterizer()
        for b in batches:
            found = [(i, n, t) for i, x in enumerate(b.column(1).to_pylist()) for n, t in enumerate(read(x, dpi) or [], 1) if t is not None]
            part = b.take(pa.array([i for i, _, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n, _ in found], pa.int32()), pa.array([t for *_, t in found], pa.string()), part.column(2)], names=["document_id", "number", "text", "path"])

    pages = rows.select("document_id", "content", "path").mapInArrow(run, "document_id string, number int, text string, path string")
    title = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return pages.select("document_id", page_key(F.col("document_id"), F.col("number")).alias("page_id"), "number", "text", title.alias("title"), F.lit(".pdf").alias("source_type"), F.col("path").alias("source_path"), F.create_map().cast("map<string,string>").alias("metadata"))


def ingest(spark: SparkSession, path: str, engines: Callable | None = None, rasterizer: Callable | None = None, mode: str = "Hybrid", dpi: int = 150) -> DataFrame:
    """Pages of a file, by its suffix. [A5]"""
    suffix = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if suffix in TEXT:
        pages = text_pages(spark, path)
    elif suffix == ".json":
        pages = history_pages(spark, path)
    elif suffix in IMAGE:
        pages = image_pages(spark, path, engines, mode)
    elif suffix == ".pdf":
        pages = pdf_pages(spark, path, rasterizer, dpi)
    else:
        raise ValueError(f"Unsupported input type: {suffix}")
    try:
        empty = pages.isEmpty()
    except Exception as e:
        raise ValueError(f"Could not read {path}") from e
    if empty:
        raise ValueError(f"Could not read {path}")
    return pages


def export_pages(pages: DataFrame, at: str) -> str:
    """Markdown of a few documents' pages as a ZIP of <title>_page<number>.md in a local file. [B6]"""
    import zipfile

    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for r in pages.select("title", "number", "text").orderBy("title", "number").toLocalIterator():
            z.writestr(f"{r['title']}_page{r['number']}.md", r["text"] or "")
    return at


def history_rows(pages: DataFrame) -> DataFrame:
    """document_id, json: pages as saved OCR runs, which history_pages reads again. [B6]"""
    page = F.struct("number", F.struct(F.col("number").cast("int").alias("page"), F.coalesce(F.try_element_at("metadata", F.lit("glm_text")), F.col("text")).alias("glm"), F.col("text").alias("final")).alias("page"))
    runs = pages.groupBy("document_id").agg(F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(page)), lambda x: x["page"]).alias("pages"))
    run = F.struct(F.lit("").alias("timestamp"), F.lit("export").alias("mode"), F.array(F.struct(F.col("title").alias("filename"), "pages")).alias("results"))
    return runs.select("document_id", F.to_json(run).alias("json"))


def html_pages(table: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages of raw HTML (key, url, html): scripts, styles and tags go, h1 to h6 become markdown headings."""
    text = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    for n in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n" + "#" * n + " $1\n")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    doc = F.col(key).cast("string")
    return table.select(doc.alias("document_id"), page_key(doc, F.lit(1)).alias("page_id"), F.lit(1).alias("number"), text.alias("text"), F.col("url").alias("title"), F.lit("html").alias("source_type"), F.col("url").alias("source_path"), F.create_map().cast("map<string,string>").alias("metadata"))


def table_pages(table: DataFrame, key: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
    """Pages of a table of texts: one for each row, numbered by a column from 0, or all the first."""
    doc = F.col(key).cast("string")
    n = F.lit(1) if number is None else (F.col(number) + 1).cast("int")
    return table.select(doc.alias("document_id"), page_key(doc, n).alias("page_id"), n.alias("number"), F.coalesce(text, F.lit("")).alias("text"), doc.alias("title"), F.lit("table").alias("source_type"), F.lit("").alias("source_path"), F.create_map().cast("map<string,string>").alias("metadata"))
