"""The registered queries of the engine and their DuckDB counterparts, side by side.

Each query reads whole tables. Texts with headings and references, which the tables lack, are derived from ``part``;
rules are tried on texts that the same expression derives in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions import vectors as V
from lodeseek.operators import evaluate, evidence, filters, graph, lists, merge, page_vectors, postings, profile, sensitive
from lodeseek.operators import retrievers as R
from lodeseek.operators.chunking import chunk_pages, segments
from lodeseek.plans import planner, retrieve
from lodeseek.session import settled, shared_folder, written
from lodeseek.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_pages(spark, sf) -> DataFrame:
    return ingest.table_pages(table(spark, sf, "documents"))


def doc_chunks(spark, sf) -> DataFrame:
    return chunk_pages(doc_pages(spark, sf))


def questions(spark, sf) -> DataFrame:
    """The benchmark items."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))


PART_TEXT = "'# ' || p_size || ' ' || p_brand || chr(10) || p_name || ' see Table ' || p_size || ' and Section ' || (p_size + 1) || chr(10) || '## ' || p_size || '.' || (p_partkey % 3) || ' ' || p_type || chr(10) || 'see page 1 [' || (p_partkey % 9) || '] not ' || p_name"


def part_pages(spark, sf) -> DataFrame:
    """Documents with headings and references: one for each brand, a page for each part."""
    rows = table(spark, sf, "part").selectExpr("p_brand", "p_partkey", f"{PART_TEXT} AS text")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return rows.select(F.col("p_brand").alias("document_id"), n.alias("number"), F.concat("p_brand", F.lit(":page:"), n.cast("string")).alias("page_id"), "text")


def part_chunks(spark, sf) -> DataFrame:
    return chunk_pages(part_pages(spark, sf), 12, 4)


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


CHUNKS = r"""w AS (SELECT doc_id::VARCHAR AS document_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0),
chunks AS (SELECT document_id, k AS chunk_index, document_id || ':chunk:' || k AS chunk_id, k * 180 AS word_start, least(k * 180 + 220, n) AS word_end,
  array_to_string(w[k * 180 + 1 : least(k * 180 + 220, n)], ' ') AS text FROM n, LATERAL (SELECT unnest(range(0, CASE WHEN n <= 220 THEN 1 ELSE ceil((n - 220) / 180.0)::BIGINT + 1 END)) AS k))"""
ASKED = "q AS (SELECT item_id::VARCHAR AS query_id, text AS question FROM benchmark)"
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+'), lambda x: lower(x))"
TERMS = f"""qt AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({TOKENS.format("question")}) AS term FROM q) GROUP BY ALL),
tok AS (SELECT document_id, chunk_id, chunk_index, unnest({TOKENS.format("text")}) AS term FROM chunks),
tf AS (SELECT document_id, chunk_id, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL)"""
NUM = "('0x' || substr(sha1({0}), {1}, {2}))::BIGINT"
WEIGHT = f"(0.75 + {NUM.format('term', 1, 2)} / 255.0)"


def bm25_sql(per: str) -> str:
    part = f"PARTITION BY {per}" if per else ""
    on = f"USING ({per}, term)" if per else "USING (term)"
    return f"""size AS (SELECT document_id, chunk_id, len({TOKENS.format("text")}) AS len FROM chunks),
stat AS (SELECT *, count(*) OVER ({part}) AS n, avg(len) OVER ({part}) AS avgdl FROM size),
df AS (SELECT {per + ", " if per else ""}term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT query_id, tf.document_id, tf.chunk_id, tf.chunk_index, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len, 1) / (CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END)))), 9) AS score
  FROM tf JOIN qt USING (term) JOIN df {on} JOIN stat ON stat.chunk_id = tf.chunk_id GROUP BY ALL HAVING score > 0)"""


DENSE = f"""dv AS (SELECT chunk_id, document_id, chunk_index, {NUM.format("term", 1, 8)} % 384 AS b, sum((CASE WHEN {NUM.format("term", 9, 2)} % 2 = 0 THEN 1 ELSE -1 END) * {WEIGHT} * tf) AS v FROM tf GROUP BY ALL),
dn AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS u FROM dv WHERE v <> 0),
qv AS (SELECT query_id, {NUM.format("term", 1, 8)} % 384 AS b, sum((CASE WHEN {NUM.format("term", 9, 2)} % 2 = 0 THEN 1 ELSE -1 END) * {WEIGHT} * m) AS v FROM qt GROUP BY ALL),
qn AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS u FROM qv WHERE v <> 0),
de AS (SELECT query_id, document_id, chunk_id, chunk_index, round(sum(dn.u * qn.u), 9) AS score FROM dn JOIN qn USING (b) GROUP BY ALL HAVING score > 0)"""


def best_sql(name: str, k: int = 5) -> str:
    """The k best per document, then of all."""
    return f"""r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index, chunk_id) AS r FROM {name}),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index, chunk_id) AS rank FROM r1 WHERE r <= {k})
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r2 WHERE rank <= {k}"""


# --- chunks ---------------------------------------------------------------------------------------------------
@query(f"WITH {CHUNKS} SELECT chunk_id, document_id, chunk_index, word_start, word_end, text FROM chunks")
def c3_chunks(spark, sf):
    return doc_chunks(spark, sf).select("chunk_id", "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("word_start").cast("bigint").alias("word_start"), F.col("word_end").cast("bigint").alias("word_end"), "text")


PARTS = f"""p AS (SELECT p_brand AS document_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number, {PART_TEXT} AS text FROM part),
l AS (SELECT document_id, number, string_split(text, chr(10)) AS l FROM p),
s AS (SELECT document_id, number, 0 AS segment, trim(l[1][2:]) AS section, l[1] || ' ' || l[2] AS t FROM l UNION ALL SELECT document_id, number, 1, trim(l[3][3:]), l[3] || ' ' || l[4] FROM l)"""


@query(f"WITH {PARTS} SELECT document_id, number, segment, section, len(regexp_extract_all(t, '\\S+')) AS n_words FROM s")
def c2_sections(spark, sf):
    return segments(part_pages(spark, sf)).select("document_id", F.col("number").cast("bigint").alias("number"), F.row_number().over(Window.partitionBy("page_id").orderBy("segment")).cast("bigint").alias("s"), "section", F.size("words").cast("bigint").alias("n_words")).select("document_id", "number", (F.col("s") - 1).alias("segment"), "section", "n_words")


PART_CHUNKS = f"""{PARTS}, pw AS (SELECT document_id, number, segment, section, regexp_extract_all(t, '\\S+') AS w FROM s), pn AS (SELECT *, len(w) AS n FROM pw),
pk AS (SELECT document_id, number, segment, section, k, array_to_string(w[k * 8 + 1 : least(k * 8 + 12, n)], ' ') AS text FROM pn, LATERAL (SELECT unnest(range(0, CASE WHEN n <= 12 THEN 1 ELSE ceil((n - 12) / 8.0)::BIGINT + 1 END)) AS k)),
pc AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY number, segment, k) - 1 AS chunk_index FROM pk), chunks AS (SELECT *, document_id || ':chunk:' || chunk_index AS chunk_id FROM pc)"""


@query(f"WITH {PART_CHUNKS} SELECT chunk_id, number AS page, section, text FROM chunks")
def c3_section_chunks(spark, sf):
    return part_chunks(spark, sf).select("chunk_id", F.get("page_numbers", F.lit(0)).cast("bigint").alias("page"), F.col("parent_section").alias("section"), "text")


# --- functions ------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents")
def d1_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens("text")).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(T.tokens("text"))).cast("bigint").alias("n_distinct"))


SET = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"


@query(f"""WITH t AS (SELECT doc_id, {SET.format('text')} AS s FROM documents), p AS (SELECT a.doc_id, a.s AS x, b.s AS y FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""")
def d3_jaccard_pairs(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.token_set("text").alias("s"))
    return t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("z")), "doc_id").select("doc_id", F.round(T.jaccard(F.col("s"), F.col("z")), 6).alias("jaccard"))


@query(f"SELECT conv_id, turn, len(list_intersect({SET.format('text')}, ['not', 'no', 'without', 'never', 'none'])) > 0 AS negated FROM conversations")
def d4_negation(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.has_negation("text").alias("negated"))


@query(f"WITH t AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS term FROM benchmark) SELECT term, round({WEIGHT}, 6) AS weight FROM t")
def d5_term_weight(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(T.tokens("text")).alias("term")).distinct().select("term", F.round(V.term_weight(F.col("term")), 6).alias("weight"))


@query(f"""WITH t AS (SELECT item_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
v AS (SELECT item_id, {NUM.format('term', 1, 8)} % 384 AS bucket, sum((CASE WHEN {NUM.format('term', 9, 2)} % 2 = 0 THEN 1 ELSE -1 END) * {WEIGHT}) AS v FROM t GROUP BY ALL)
SELECT item_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS v FROM v""")
def d6_hashed_embedding(spark, sf):
    return R.dense_vectors(table(spark, sf, "benchmark"), ["item_id"]).select("item_id", "bucket", F.round("v", 6).alias("v"))


@query(f"""WITH t AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS term FROM benchmark), o AS (SELECT unnest([1, 9, 17]) AS o),
e AS (SELECT term, ('0x' || substr(sha1(term), o, 8))::BIGINT % 128 AS bucket, sum(CASE WHEN ('0x' || substr(sha1(term), o, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM t, o GROUP BY ALL),
n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY term)) AS n FROM e) SELECT term, bucket, round(v / n, 6) AS v FROM n WHERE n > 0""")
def d8_token_vectors(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.explode(T.tokens("text")).alias("term")).distinct()
    return R.token_vectors(terms).select("term", "bucket", F.round("v", 6).alias("v"))


def parts(spark, sf, text: str) -> DataFrame:
    """p_partkey and a text that an expression derives from each row of part; the same expression stands in the SQL."""
    return table(spark, sf, "part").selectExpr("p_partkey", f"{text} AS t")


def pick(words: list[str], by: str = "p_partkey") -> str:
    """One of the words for each row, as SQL of both engines."""
    return "CASE " + " ".join(f"WHEN {by} % {len(words)} = {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def listed(df: DataFrame, value) -> DataFrame:
    return df.select("p_partkey", F.explode(value).alias("value"))


WRONG = ["sectlon", "chapler", "appendlx", "f1g", "tab1e", "equat1on", "arx1v", "sec tlon", "fiqures", "tahle"]
RIGHT = ["section", "chapter", "appendix", "figure", "table", "equation", "arXiv", "section", "figure", "table"]


@query(f"SELECT p_partkey, 'see ' || {pick(RIGHT)} || ' ' || p_size || ' of the ' || p_name AS value FROM part")
def d10_misreadings(spark, sf):
    return parts(spark, sf, f"'see ' || {pick(WRONG)} || ' ' || p_size || ' of the ' || p_name").select("p_partkey", T.undo_misreadings("t").alias("value"))


ENTITY_STOPS = ", ".join(f"'{w}'" for w in T.ENTITY_STOPWORDS)
_RUN = r"\b(?:[A-Z][A-Za-z0-9&.-]*|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z0-9&.-]*|[A-Z]{2,})){0,3}\b"
_FULL, _SHORT = r"[A-Z][A-Za-z0-9&.-]+(?:\s+[A-Z][A-Za-z0-9&.-]+){1,6}", r"[A-Z][A-Z0-9-]{1,12}"
_QUOTED = "[\"''`]([A-Za-z][A-Za-z0-9&./_-]+(?:\\s+[A-Za-z0-9&./_-]+){1,5})[\"''`]"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS t FROM documents),
c AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{_RUN}'), lambda x: trim(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || '.,;:()[]{{}}'), '\s+', ' ', 'g'))) AS runs,
  list_transform(list_concat(list_concat(regexp_extract_all(t, '\b({_FULL})\s*\(({_SHORT})\)', 1), regexp_extract_all(t, '\b({_FULL})\s*\(({_SHORT})\)', 2)), list_concat(list_concat(regexp_extract_all(t, '\b({_SHORT})\s*\(({_FULL})\)', 1), regexp_extract_all(t, '\b({_SHORT})\s*\(({_FULL})\)', 2)), regexp_extract_all(t, '{_QUOTED}', 1))),
    lambda x: trim(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || '.,;:()[]{{}}'), '\s+', ' ', 'g'))) AS named FROM t),
f AS (SELECT doc_id, list_filter(runs, lambda x: length(x) >= 3 AND lower(x) NOT IN ({ENTITY_STOPS.lower()})) AS runs, list_filter(named, lambda x: length(x) >= 3 AND lower(x) NOT IN ({ENTITY_STOPS.lower()})) AS named FROM c),
r AS (SELECT doc_id, unnest(runs) AS run FROM f), w AS (SELECT doc_id, string_split(run, ' ') AS p FROM r), a AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS s FROM w), b AS (SELECT doc_id, p, s, unnest([0, 1, 2]) AS n FROM a),
g AS (SELECT doc_id, array_to_string(p[s:s + n], ' ') AS value FROM b WHERE s + n <= len(p))
SELECT doc_id, value FROM g WHERE length(value) >= 3 AND value NOT IN ({ENTITY_STOPS}) UNION SELECT doc_id, run FROM r UNION SELECT doc_id, unnest(named) FROM f""")
def d12_entities(spark, sf):
    """Over documents in which every character beyond ASCII is an underscore, as the SQL's classes know ASCII only."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, sf, "documents").select("doc_id", F.explode(T.entities(plain)).alias("value"))


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 5 AS m FROM part)
SELECT p_partkey, unnest(range(a, a + m + 1))::VARCHAR AS value FROM p UNION SELECT p_partkey, 'b' || unnest(range(m, m + 3)) FROM p UNION SELECT p_partkey, p_partkey || '.' || m FROM p""")
def d13_number_ranges(spark, sf):
    return listed(parts(spark, sf, "p_size || '-' || (p_size + p_partkey % 5) || ', B' || (p_partkey % 5) || ' to B' || (p_partkey % 5 + 2) || '; ' || p_partkey || '.' || (p_partkey % 5)"), T.number_values("t"))


@query("""WITH p AS (SELECT p_partkey, p_size || '.' || (p_partkey % 3) || '.' || (p_partkey % 7) AS n, lower(p_type) AS t FROM part)
SELECT p_partkey, unnest([n || ' ' || t, n, string_split(n, '.')[1], string_split(n, '.')[1] || '.' || string_split(n, '.')[2], t]) AS value FROM p""")
def d15_section_aliases(spark, sf):
    return listed(parts(spark, sf, "' ' || p_size || '.' || (p_partkey % 3) || '.' || (p_partkey % 7) || '   ' || p_type || ': '"), T.section_aliases("t"))


@query("""SELECT DISTINCT p_partkey, unnest(['figure:' || (p_size % 4 + 1), 'figure:' || (p_size % 4 + 2), 'figure:' || (p_size % 4 + 3), 'table:' || p_size, 'citation:' || (p_partkey % 90), 'doi:10.1234/ab.' || p_partkey, 'arxiv:2401.' || (10000 + p_partkey) || 'v2',
  'url:https://example.org/' || p_partkey, 'section:' || p_size || '.1', 'section:' || p_size, 'page:7', 'equation:2']) AS value FROM part""")
def d16_references(spark, sf):
    text = "'see Figures ' || (p_size % 4 + 1) || '-' || (p_size % 4 + 3) || ' and tab1e ' || p_size || ' as [' || (p_partkey % 90) || '] in 10.1234/AB.' || p_partkey || ', arXiv: 2401.' || (10000 + p_partkey) || 'v2 at https://example.org/' || p_partkey || ', sectlon ' || p_size || '.1, page 7 with equat1on 2'"
    # rows that share a key may repeat a value
    return listed(parts(spark, sf, text), T.references("t")).distinct()


def stem_sql(words: str) -> str:
    """The words of a list, and what is left of them without a suffix."""
    cut = ", ".join(f"CASE WHEN ends_with(t, '{x}') AND length(t) > {len(x) + 2} THEN t[1:length(t) - {len(x)}] END" for x in T.STEM_SUFFIXES)
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda t: [t, {cut}, CASE WHEN ends_with(t, 'ies') AND length(t) > 5 THEN t[1:length(t) - 3] || 'y' END])), lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, len({stem_sql(SET.format('text'))}) AS n, array_to_string(list_sort({stem_sql(SET.format('text'))}), ' ') AS stems FROM documents")
def d18_stems(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.stems(T.token_set("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_join("s", " ").alias("stems"))


KEYED = "CASE p_partkey % 8 WHEN 0 THEN 'find 10.1234/ab' || p_partkey WHEN 1 THEN 'what is AB-' || (10 + p_partkey) WHEN 2 THEN 'release v1.' || p_size || '.3' WHEN 3 THEN 'invoice ' || (100 + p_partkey) WHEN 4 THEN 'total of the ' || p_name WHEN 5 THEN 'code ' || p_name WHEN 6 THEN 'license key ' || p_size WHEN 7 THEN 'tokens ab12cd of ' || p_name END"
HINTS = ", ".join(f"'{h}'" for h in T.IDENTIFIER_HINTS)


def identifier_sql(question: str, stems: str) -> str:
    q = lambda p: f"regexp_matches({question}, '{p}')"
    mixed = f"len(list_filter({stems}, lambda t: length(t) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]'))) > 0"
    return rf"({q(r'(?i)\b(?:10\.\d{4,9}/[^\s]+|[\w.-]+@[\w.-]+)\b')} OR {q(r'\b[A-Z]{2,}[-_ ]?\d{2,}\b')} OR {q(r'\bv?\d+[.]\d+[.]\d+\b')} OR (list_has_any({stems}, [{HINTS}]) AND ({mixed} OR {q(r'\b\d{3,}\b')})))"


@query(f"WITH q AS (SELECT p_partkey, {KEYED} AS t FROM part), s AS (SELECT *, {stem_sql(SET.format('t'))} AS s FROM q) SELECT p_partkey, {identifier_sql('t', 's')} AS value FROM s")
def d19_identifiers(spark, sf):
    return parts(spark, sf, KEYED).select("p_partkey", T.is_identifier("t", T.stems(T.token_set("t"))).alias("value"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) / 127.0 AS scale FROM v)
SELECT vec_id, round(scale, 6) AS scale, list_sum(list_transform(e, lambda x: round_even(x / scale, 0)))::BIGINT AS total, list_max(list_transform(e, lambda x: round_even(x / scale, 0)))::BIGINT AS top FROM s""")
def d20_int8(spark, sf):
    q = table(spark, sf, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 6).alias("scale"), F.aggregate("q.values", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_max("q.values").cast("bigint").alias("top"))


@query("WITH s AS (SELECT doc_id, replace(trim(text, ' \n\t\r'), chr(10), ' ') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 500 THEN s ELSE rtrim(s[1:497], ' \n\t\r') || '...' END AS snippet FROM s")
def d21_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query(r"""SELECT conv_id, turn, CASE WHEN contains(t, '|---') OR contains(t, chr(9)) OR contains(t, ' table ') OR contains(t, ' row ') OR contains(t, ' column ') THEN 'table_or_form' WHEN image AND trim(text) = '' THEN 'image_only' WHEN image THEN 'image_with_text' ELSE 'text' END AS page_type
FROM (SELECT conv_id, turn, text, ' ' || lower(text) || ' ' AS t, turn % 2 = 0 AS image FROM conversations)""")
def d24_page_type(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.page_type("text", F.col("turn") % 2 == 0).alias("page_type"))


# --- indexes and retrievers -----------------------------------------------------------------------------------
@query(f"WITH {CHUNKS}, {ASKED}, {TERMS} SELECT chunk_id, sum(tf)::BIGINT AS tokens, count(*) AS terms, max(tf)::BIGINT AS most FROM tf GROUP BY ALL")
def g1_term_frequency(spark, sf):
    return R.postings(doc_chunks(spark, sf)).where("term is not null").groupBy("chunk_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("terms"), F.max("tf").alias("most"))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS} SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL")
def g2_document_frequency(spark, sf):
    return lists.document_terms(doc_chunks(spark, sf))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, {best_sql('bm')}")
def k1_bm25_batch(spark, sf):
    return shown(R.bm25(doc_chunks(spark, sf), questions(spark, sf), 5))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('')}, {best_sql('bm')}")
def k1_bm25_corpus(spark, sf):
    return shown(R.bm25(doc_chunks(spark, sf), questions(spark, sf), 5, scope="corpus"))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('')}, {best_sql('bm')}")
def k1_bm25_stored(spark, sf):
    """The same through an index that is built, written and read by term."""
    index = postings.build(doc_chunks(spark, sf), f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    return shown(postings.bm25(index, doc_chunks(spark, sf), questions(spark, sf), 5))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {DENSE}, {best_sql('de')}")
def k2_dense(spark, sf):
    return shown(R.dense(doc_chunks(spark, sf), questions(spark, sf), 5))


LATE = f"""lt AS (SELECT DISTINCT document_id, chunk_id, chunk_index, unnest(({TOKENS.format("text")})[1:256]) AS term FROM chunks), ls AS (SELECT chunk_id, count(*) AS size FROM lt GROUP BY ALL), o AS (SELECT unnest([1, 9, 17]) AS o),
le AS (SELECT term, ('0x' || substr(sha1(term), o, 8))::BIGINT % 128 AS b, sum(CASE WHEN ('0x' || substr(sha1(term), o, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM (SELECT DISTINCT term FROM lt UNION SELECT term FROM qt), o GROUP BY ALL),
ln AS (SELECT term, b, v / n AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY term)) AS n FROM le) WHERE n > 0),
lp AS (SELECT a.term AS q, d.term, sum(a.v * d.v) AS dot FROM ln a JOIN ln d USING (b) WHERE a.term IN (SELECT term FROM qt) GROUP BY ALL),
lb AS (SELECT document_id, chunk_id, chunk_index, q, max(dot) AS mx, count(*) AS shared FROM lt JOIN lp USING (term) GROUP BY ALL),
lx AS (SELECT lb.*, CASE WHEN shared = size THEN mx ELSE greatest(mx, 0) END AS best FROM lb JOIN ls USING (chunk_id)), qs AS (SELECT query_id, sum(m) AS n FROM qt GROUP BY ALL),
la AS (SELECT query_id, document_id, chunk_id, chunk_index, round(sum(best * m) / max(n), 9) AS score FROM lx JOIN qt ON qt.term = lx.q JOIN qs USING (query_id) GROUP BY ALL HAVING score > 0)"""


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {LATE}, {best_sql('la')}")
def k3_late(spark, sf):
    return shown(R.late(doc_chunks(spark, sf), questions(spark, sf), 5))


def fused_sql(per: str, k: int = 5) -> str:
    rank = lambda t, s: f"SELECT query_id, document_id, chunk_id, chunk_index, {s} AS side, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, document_id, chunk_index, chunk_id) AS r FROM {t} QUALIFY r <= 10"
    return f"""fu AS ({rank('bm', 0)} UNION ALL {rank('de', 1)}), fs AS (SELECT query_id, document_id, chunk_id, chunk_index, round(sum(1.0 / (60 + r)), 9) AS score, min(side * 1000000 + r) AS seen FROM fu GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, seen, document_id, chunk_index) AS fr FROM fs),
fx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, seen, chunk_index) AS rank FROM fr WHERE fr <= {k}) SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM fx WHERE rank <= {k}"""


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, {DENSE}, {fused_sql('query_id, document_id')}")
def k5_hybrid(spark, sf):
    return shown(R.hybrid(doc_chunks(spark, sf), questions(spark, sf), 5))


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('')}, {DENSE}, {fused_sql('query_id')}")
def k4_rank_fusion_corpus(spark, sf):
    return shown(R.hybrid(doc_chunks(spark, sf), questions(spark, sf), 5, scope="corpus"))


@query(f"""WITH {ASKED}, chunks AS (SELECT conv_id::VARCHAR AS document_id, conv_id || ':page:' || (turn + 1) AS chunk_id, turn + 1 AS chunk_index, turn % 2 = 0 AS image,
  conv_id || ' ' || text || ' page document' || (CASE WHEN turn % 2 = 0 THEN ' page image visual layout scan figure diagram' ELSE '' END) || ' table layout_unknown' AS text FROM conversations),
{TERMS}, {DENSE}, bo AS (SELECT de.query_id, de.document_id, de.chunk_id, de.chunk_index, round(score + CASE WHEN image AND regexp_matches(lower(question), 'page|image|figure|diagram|visual') THEN 0.05 ELSE 0 END, 9) AS score FROM de JOIN chunks USING (chunk_id) JOIN q USING (query_id)), {best_sql('bo')}""")
def k6_visual_text(spark, sf):
    pages = ingest.table_pages(table(spark, sf, "conversations"), "conv_id", "text", "turn")
    meta = F.when((F.col("number") - 1) % 2 == 0, F.create_map(F.lit("image_path"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    return shown(R.visual(retrieve.visual_pages(pages.withColumn("metadata", meta)), questions(spark, sf), 5))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS item_id, round(list_dot_product(list_transform(e, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM q, embeddings)
SELECT query_id, item_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""")
def emb_dot_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return page_vectors.nearest(e, e.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), 5, 6).select("query_id", "item_id", "rank", "score")


@query("""WITH d AS (SELECT vec_id // 25 AS item_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings), a AS (SELECT item_id AS query_id, vec_id, d AS a FROM d WHERE vec_id % 20 = 0),
m AS (SELECT query_id, item_id, a.vec_id, max(list_dot_product(a, d)) AS m FROM a, d GROUP BY ALL) SELECT query_id, item_id, round(sum(m), 6) AS score FROM m GROUP BY ALL""")
def k9_multi_vector(spark, sf):
    """Items of 25 vectors each; the vectors with an id divisible by 20 ask, item by item; every item's score for each."""
    e = table(spark, sf, "embeddings").withColumn("item_id", F.expr("vec_id div 25"))
    gathered = lambda df, name: df.groupBy(F.col("item_id").alias(name)).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))), lambda x: x["embedding"]).alias("vectors"))
    found = page_vectors.every_score(gathered(e, "item_id"), gathered(e.where("vec_id % 20 = 0"), "query_id"))
    return found.withColumn("score", F.round("score", 6))


# --- graph ----------------------------------------------------------------------------------------------------
LINEAR = f"""WITH {PART_CHUNKS}, e AS (SELECT chunk_id AS src, lead(chunk_id) OVER w AS dst FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)),
t AS (SELECT chunk_id, lower(section) AS section, lag(chunk_id) OVER w AS before, lag(lower(section)) OVER w AS f FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))"""


# of a document's sections with the same leading number, the last to begin owns that number; 'p.q ...' is a child of 'p ...'
SECTIONS = r"""fs AS (SELECT document_id, lower(section) AS section, min(chunk_index) AS b FROM chunks GROUP BY ALL), fp AS (SELECT *, regexp_extract(section, '^(\d+(\.\d+)*)', 1) AS prefix FROM fs),
ow AS (SELECT document_id, prefix, arg_max(section, b) AS parent, max(b) AS pb FROM fp GROUP BY ALL), kin AS (SELECT c.document_id, c.section, c.b, ow.pb FROM fp c JOIN ow ON ow.document_id = c.document_id AND ow.prefix = regexp_extract(c.prefix, '^(.*)\.\d+$', 1) AND ow.parent <> c.section),
ke AS (SELECT document_id || ':chunk:' || pb AS parent, document_id || ':chunk:' || b AS child FROM kin WHERE pb <> b)"""


@query(f"""{LINEAR}, {SECTIONS} SELECT src, dst, 'next_chunk' AS relation, 0.4::DOUBLE AS weight FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'previous_chunk', 0.4 FROM e WHERE dst IS NOT NULL
UNION ALL SELECT before, chunk_id, 'next_section', 0.52 FROM t WHERE f <> section UNION ALL SELECT chunk_id, before, 'previous_section', 0.48 FROM t WHERE f <> section
UNION ALL SELECT parent, child, 'child_section', 0.56 FROM ke UNION ALL SELECT child, parent, 'parent_section', 0.56 FROM ke""")
def h2_section_navigation(spark, sf):
    rows = graph.linear_edges(graph.nodes(part_chunks(spark, sf)))
    return rows.select("src", "dst", "relation", "weight").distinct()


@query(f"""{LINEAR}, {SECTIONS}, c AS (SELECT document_id, number, count(*) AS m FROM chunks GROUP BY ALL), d AS (SELECT document_id, lower(section) AS section, count(*) AS m FROM chunks GROUP BY ALL),
u AS (SELECT DISTINCT split_part(before, ':', 1) AS document_id, before, chunk_id FROM t WHERE f <> section), h AS (SELECT DISTINCT document_id, parent, child FROM ke JOIN chunks ON chunk_id = child)
SELECT document_id, 'same_page' AS relation, sum(m * (m - 1))::BIGINT AS n FROM c GROUP BY ALL HAVING n > 0 UNION ALL SELECT document_id, 'same_section', sum(m * (m - 1))::BIGINT FROM d GROUP BY ALL HAVING sum(m * (m - 1)) > 0
UNION ALL SELECT document_id, unnest(['next_chunk', 'previous_chunk']), n FROM (SELECT document_id, count(*) - 1 AS n FROM chunks GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT document_id, unnest(['next_section', 'previous_section']), n FROM (SELECT document_id, count(*) AS n FROM u GROUP BY 1) UNION ALL SELECT document_id, unnest(['child_section', 'parent_section']), n FROM (SELECT document_id, count(*) AS n FROM h GROUP BY 1)""")
def k10_relation_counts(spark, sf):
    """The eight relations of place and section; k10_reference_edges has the three of what texts say."""
    rows = graph.relation_counts(part_chunks(spark, sf)).where(~F.col("relation").isin("same_entity", "reference", "referenced_by"))
    return rows.select(F.col("scope").alias("document_id"), "relation", F.col("n").cast("bigint").alias("n"))


@query(f"WITH {PART_CHUNKS} SELECT a.chunk_id AS src, b.chunk_id AS dst, 'same_section' AS relation FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND lower(a.section) = lower(b.section) AND a.chunk_id <> b.chunk_id")
def k10_same_section_edges(spark, sf):
    return graph.related(part_chunks(spark, sf), ["same_section"]).drop("weight")


SAID = "'it uses Solver' || (p_partkey % 7) || ' as table ' || (p_partkey % 5) || ' shows'"
SAYING = f"s AS (SELECT p_brand AS document_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS chunk_index FROM part), g AS (SELECT *, document_id || ':chunk:' || chunk_index AS chunk_id, p_partkey % 7 AS a, p_partkey % 5 AS b FROM s)"


def graph_chunks(spark, sf) -> DataFrame:
    """A chunk and a page for each part, by brand; each names one of seven entities and one of five tables."""
    rows = table(spark, sf, "part").selectExpr("p_brand AS document_id", "p_partkey", f"{SAID} AS text")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("p_partkey")) - 1
    rows = rows.withColumn("chunk_index", n)
    return rows.select(F.concat("document_id", F.lit(":chunk:"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", F.array(F.col("chunk_index") + 1).alias("page_numbers"), "text", "chunk_index", F.lit(None).cast("string").alias("parent_section"))


@query(f"""WITH {SAYING}, p AS (SELECT x.chunk_id AS src, y.chunk_id AS dst, x.a = y.a AS e, x.b = y.b AS r FROM g x JOIN g y ON x.document_id = y.document_id AND x.chunk_id <> y.chunk_id)
SELECT src, dst, 'same_entity' AS relation, 0.65::DOUBLE AS weight FROM p WHERE e UNION ALL SELECT src, dst, 'reference', 0.75 FROM p WHERE r UNION ALL SELECT src, dst, 'referenced_by', 0.35 FROM p WHERE r""")
def k10_reference_edges(spark, sf):
    return graph.related(graph_chunks(spark, sf), ["same_entity", "reference", "referenced_by"])


# a question names one entity and one table, its words are those two and the table's number; twelve seeds, then one hop in a single order of all chunks
@query(f"""WITH {SAYING}, q AS (SELECT a, b, a || ':' || b AS query_id FROM range(7) x(a), range(5) y(b)), o AS (SELECT *, row_number() OVER (ORDER BY chunk_index, document_id, chunk_id) AS place FROM g),
own AS (SELECT query_id, o.*, round((1 + (q.a = o.a)::INT + (q.b = o.b)::INT) / 3.0 + 0.3 * (q.a = o.a)::INT + 0.4 * (q.b = o.b)::INT, 9) AS score FROM q, o),
seed AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index, chunk_id) <= 12),
hop AS (SELECT s.query_id, o.chunk_id, round(s.score * greatest(CASE WHEN abs(o.place - s.place) = 1 THEN 0.4 ELSE 0 END, CASE WHEN o.chunk_index = s.chunk_index THEN 0.3 ELSE 0 END, CASE WHEN o.a = s.a THEN 0.65 ELSE 0 END, CASE WHEN o.b = s.b THEN 0.75 ELSE 0 END), 9) AS score
  FROM seed s JOIN o ON s.chunk_id <> o.chunk_id AND (abs(o.place - s.place) = 1 OR o.chunk_index = s.chunk_index OR o.a = s.a OR o.b = s.b)),
f AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM seed UNION ALL SELECT * FROM hop) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index, f.chunk_id) AS rank FROM f JOIN g USING (chunk_id)) WHERE rank <= 12""")
def k11_graph_search(spark, sf):
    c = spark.range(35).selectExpr("CAST(id DIV 5 AS STRING) AS a", "CAST(id % 5 AS STRING) AS b")
    q = c.selectExpr("a || ':' || b AS query_id", "'Solver' || a || ' table ' || b AS question")
    found = graph.graph(graph_chunks(spark, sf), q, 12, "corpus")
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {SAYING}, m AS (SELECT document_id, b, count(*) AS m, string_agg(chunk_id, ',' ORDER BY chunk_id) AS ids FROM g GROUP BY ALL)
SELECT document_id AS scope, 'table:' || b AS ref, ids AS sources, CASE WHEN m > 1 THEN ids ELSE '' END AS targets, document_id AS documents FROM m""")
def k12_references(spark, sf):
    rows = graph.knowledge_references(graph_chunks(spark, sf), "document")
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    return rows.select("scope", "ref", joined("source_chunk_ids", "sources"), joined("target_chunk_ids", "targets"), joined("document_ids", "documents"))


@query(f"WITH {SAYING} SELECT document_id AS scope, 'table:' || b AS ref, count(*) AS sources FROM g WHERE b = 3 GROUP BY ALL")
def e10_graph_rows(spark, sf):
    """Rows of the knowledge graph that hold a text, as a viewer looks for them."""
    rows = filters.holding(graph.knowledge_references(graph_chunks(spark, sf), "document"), "  Table:3 ")
    return rows.select("scope", "ref", F.size("source_chunk_ids").cast("bigint").alias("sources"))


@query(f"WITH {SAYING} SELECT document_id AS scope, 'same_entity' AS relation, sum(m * (m - 1))::BIGINT AS n FROM (SELECT document_id, a, count(*) AS m FROM g GROUP BY ALL) GROUP BY ALL ORDER BY scope LIMIT 8")
def i8_first_rows(spark, sf):
    """The first eight documents' numbers of one relation."""
    rows = filters.of_relation(graph.relation_counts(graph_chunks(spark, sf)), "same_entity")
    return filters.first_rows(rows, "scope").select("scope", "relation", F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {SAYING}, c AS (SELECT document_id AS scope, count(*) AS chunks, count(DISTINCT a) AS entities, count(DISTINCT b) AS refs FROM g GROUP BY 1),
e AS (SELECT scope, sum(m * (m - 1)) AS n FROM (SELECT document_id AS scope, count(*) AS m FROM g GROUP BY document_id, a) GROUP BY 1), r AS (SELECT scope, sum(m * (m - 1)) AS n FROM (SELECT document_id AS scope, count(*) AS m FROM g GROUP BY document_id, b) GROUP BY 1)
SELECT scope, chunks, 1::BIGINT AS documents, 0::BIGINT AS sections, entities, refs AS "references", (2 * (chunks - 1) + e.n + 2 * r.n)::BIGINT AS edges, r.n::BIGINT AS "referring" FROM c JOIN e USING (scope) JOIN r USING (scope)""")
def k12_graph_stats(spark, sf):
    rows = graph.knowledge_stats(graph_chunks(spark, sf), "document")
    return rows.withColumn("referring", F.coalesce(F.try_element_at("relations", F.lit("reference")), F.lit(0).cast("long"))).drop("relations")


# --- planner, merge, cards ------------------------------------------------------------------------------------
TALK = ["show the diagram of", "figure", "compare the totals in the tables of", "which rows hold the", "compare related sections on", "what does the appendix cite on", "what is common to both", "why is there a", "invoice 4711 for", "summaries across documents on", "page layout of the form for", "states of matter in"]


def ladder_sql(q: str) -> str:
    """query_id, query_type, routes of the questions in q (query_id, question)."""
    has = lambda name: f"list_has_any(st, [{', '.join(repr(w) for w in planner.GROUPS[name])}])"
    every = ", ".join(repr(w) for g in planner.GROUPS.values() for w in g)
    return f"""ls AS (SELECT *, {stem_sql(SET.format('question'))} AS st FROM {q}), lf AS (SELECT query_id, {has('visual')} AS v, {has('table')} AS t, {has('multihop')} AS m, {has('graph')} AS g, {identifier_sql('question', 'st')} AS i, len(list_filter(st, lambda x: NOT list_contains([{every}], x))) > 0 AS p FROM ls),
plans AS (SELECT query_id, CASE WHEN i THEN 'exact_lookup|bm25' WHEN v AND p THEN 'visual|visual,hybrid' WHEN v THEN 'visual|visual' WHEN t AND m THEN 'multi_hop|hybrid,late,bm25' WHEN t THEN 'table_or_form|late,hybrid' WHEN g AND m THEN 'multi_hop|graph,hybrid' WHEN g THEN 'graph_nav|graph,hybrid' WHEN m THEN 'multi_hop|hybrid,dense' ELSE 'semantic|dense,bm25' END AS plan FROM lf)"""


@query(f"WITH q AS (SELECT p_partkey::VARCHAR AS query_id, {pick(TALK)} || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END AS question FROM part), {ladder_sql('q')} SELECT query_id, split_part(plan, '|', 1) AS query_type, split_part(plan, '|', 2) AS routes FROM plans")
def l1_plan_batch(spark, sf):
    asked = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS query_id", f"{pick(TALK)} || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END AS question")
    return planner.plan_batch(asked).select("query_id", "query_type", F.array_join("routes", ",").alias("routes"))


def hits(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Twenty hits of BM25 and twenty dense ones of each question."""
    asked = questions(spark, sf)
    found = R.bm25_and_dense(doc_chunks(spark, sf), asked, asked, 20)
    return found.withColumn("ord", F.col("rank").cast("long") + F.when(F.col("retrieval_path") == "dense", 10_000).otherwise(0)).drop("rank"), asked


def ranked_sql(source: str, name: str, k: int) -> str:
    """name: the k best rows of each question by score, with rank and all nine places of the score."""
    return f"{name} AS (SELECT query_id, document_id, chunk_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index, chunk_id) AS rank FROM {source} QUALIFY rank <= {k})"


def merged_sql(hit: str, value: str, k: int = 5, name: str = "mg") -> str:
    """name: hits (query_id, chunk_id, document_id, score, path, ord) merged; value adds to the best score, from votes and jac."""
    return f"""{name}b AS (SELECT query_id, chunk_id, any_value(document_id) AS document_id, max(score) AS best, arg_max(path, score * 1e9 - ord / 1e6) AS path, count(DISTINCT path) AS votes, min(ord) AS ord FROM ({hit}) GROUP BY ALL),
{name}j AS (SELECT b.*, question, {SET.format('question')} AS qs, {SET.format('text')} AS s FROM {name}b b JOIN q USING (query_id) JOIN chunks USING (chunk_id)),
{name}v AS (SELECT *, CASE WHEN len(qs) = 0 OR len(s) = 0 THEN 0.0 ELSE len(list_intersect(qs, s)) * 1.0 / len(list_distinct(list_concat(qs, s))) END AS jac FROM {name}j), {name}s AS (SELECT *, round(best + {value}, 9) AS value FROM {name}v),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, ord, document_id, chunk_id) AS r FROM {name}s), {name}n AS (SELECT * FROM {name}r WHERE r <= {max(k, 8)}),
{name}p AS (SELECT a.query_id, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))) END, 9) AS overlap,
  (len(list_intersect(a.s, ['not', 'no', 'without', 'never', 'none'])) > 0) <> (len(list_intersect(b.s, ['not', 'no', 'without', 'never', 'none'])) > 0) AS differ FROM {name}n a JOIN {name}n b ON a.query_id = b.query_id AND a.r < b.r),
{name} AS (SELECT query_id, chunk_id, document_id, value AS score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, 'planner:' || path AS retrieval_path FROM {name}r x WHERE NOT EXISTS (SELECT 1 FROM {name}p p WHERE p.query_id = x.query_id AND p.chunk_id_b = x.chunk_id AND p.overlap >= 0.72) QUALIFY rank <= {k})"""


TWENTY = f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, {DENSE}, {ranked_sql('bm', 'hb', 20)}, {ranked_sql('de', 'hd', 20)}"
BOTH = "SELECT *, 'bm25' AS path, rank AS ord FROM hb UNION ALL SELECT *, 'dense', rank + 10000 FROM hd"
MERGED = "SELECT query_id, chunk_id, round(score, 6) AS score, rank, retrieval_path FROM mg"


def merged(spark, sf, **settings) -> DataFrame:
    return merge.merged(*hits(spark, sf), 5, **settings).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "retrieval_path")


@query(f"{TWENTY}, {merged_sql(BOTH, '0')} {MERGED}")
def l4_score_max(spark, sf):
    return merged(spark, sf)


@query(f"{TWENTY}, {merged_sql(BOTH, '0.08 * (votes - 1)')} {MERGED}")
def l4_route_vote(spark, sf):
    return merged(spark, sf, strategy="route_vote")


@query(f"{TWENTY}, {merged_sql(BOTH, '0.10 * jac')} {MERGED}")
def l4_rerank(spark, sf):
    return merged(spark, sf, rerank=True)


@query(f"{TWENTY}, {merged_sql(BOTH, '0')} SELECT query_id, chunk_id_a, chunk_id_b, round(overlap, 6) AS overlap, overlap >= 0.72 AS redundant, overlap >= 0.28 AND overlap < 0.72 AND differ AS conflict FROM mgp WHERE overlap >= 0.72 OR (overlap >= 0.28 AND differ)")
def l5_conflicts(spark, sf):
    return merge.pairs(merge.scored(*hits(spark, sf)), 5).select("query_id", "chunk_id_a", "chunk_id_b", F.round("overlap", 6).alias("overlap"), "redundant", "conflict")


@query(f"""WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, i AS ({'WITH ' + best_sql('bm', 20)}), t AS (SELECT i.query_id, i.rank, i.chunk_id, i.score, {SET.format('text')} AS s FROM i JOIN chunks USING (chunk_id)),
x AS (SELECT DISTINCT a.query_id, b.chunk_id FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank < b.rank AND a.rank <= 8 AND b.rank <= 8 WHERE len(list_intersect(a.s, b.s)) * 1.0 / len(list_distinct(list_concat(a.s, b.s))) >= 0.72)
SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = t.query_id AND x.chunk_id = t.chunk_id)) WHERE rank <= 5""")
def l5_dedupe(spark, sf):
    asked = questions(spark, sf)
    found = R.bm25(doc_chunks(spark, sf), asked, 20).withColumn("ord", F.col("rank").cast("long"))
    return merge.merged(found, asked, 5).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


# the plan is that of the ladder; the SQL has the routes of semantic plans, so a question of another kind would show as missing
PLANNER = f"""{ladder_sql('q')}, {ranked_sql('bm', 'pb', 10)}, {ranked_sql('de', 'pd', 10)}, {merged_sql("SELECT pd.*, 'dense' AS path, rank AS ord FROM pd SEMI JOIN (SELECT query_id FROM plans WHERE plan = 'semantic|dense,bm25') USING (query_id) UNION ALL SELECT pb.*, 'bm25', rank + 10000 FROM pb SEMI JOIN (SELECT query_id FROM plans WHERE plan = 'semantic|dense,bm25') USING (query_id)", '0.10 * jac')}"""


@query(f"WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, {DENSE}, {PLANNER} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM mg")
def l7_planner_corpus(spark, sf):
    return shown(retrieve.plan_and_merge(doc_chunks(spark, sf), doc_pages(spark, sf), questions(spark, sf), 5))


CARD = f"""WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, i AS ({'WITH ' + best_sql('bm')}), t AS (SELECT i.*, document_id, replace(trim(text), chr(10), ' ') AS s FROM i JOIN chunks USING (chunk_id)),
u AS (SELECT *, CASE WHEN length(s) <= 500 THEN s ELSE rtrim(s[1:497]) || '...' END AS short FROM t)"""


@query(f"""{CARD}, v AS (SELECT query_id, 'Query: ' || question || chr(10) || chr(10) || 'Grounded answer:' || chr(10) || string_agg('- ' || short || ' [C' || rank || ': ' || document_id || '/' || chunk_id || ', page(s) 1]', chr(10) ORDER BY rank) AS answer,
  round(avg(CASE WHEN rank <= 3 THEN least(1, greatest(0, score)) END), 6) AS confidence, count(DISTINCT document_id) AS docs FROM u JOIN q USING (query_id) GROUP BY query_id, question)
SELECT q.query_id, coalesce(answer, 'No evidence found for this query.') AS answer, answer IS NOT NULL AS answerable, coalesce(confidence, 0.0) AS confidence FROM q LEFT JOIN v USING (query_id)""")
def m1_cards(spark, sf):
    asked = questions(spark, sf)
    return evidence.cards(R.bm25(doc_chunks(spark, sf), asked, 5), asked).select("query_id", "answer", "answerable", F.round("confidence", 6).alias("confidence"))


@query(f"{CARD} SELECT query_id, 'C' || rank AS citation_id, chunk_id, document_id, score FROM u")
def m1_citations(spark, sf):
    asked = questions(spark, sf)
    cards = evidence.cards(R.bm25(doc_chunks(spark, sf), asked, 5), asked)
    return cards.select("query_id", F.explode("citations").alias("c")).select("query_id", F.col("c.id").alias("citation_id"), "c.chunk_id", "c.document_id", F.round("c.score", 6).alias("score"))


@query(f"""{CARD}, v AS (SELECT query_id, avg(CASE WHEN rank <= 3 THEN least(1, greatest(0, score)) END) AS c, count(DISTINCT document_id) AS d, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS gap, count(*) AS n FROM u GROUP BY ALL)
SELECT query_id, (CASE WHEN c < 0.35 THEN 1 ELSE 0 END + CASE WHEN d > 1 THEN 1 ELSE 0 END + CASE WHEN n > 1 AND abs(gap) < 0.05 THEN 1 ELSE 0 END)::BIGINT AS notes, d > 1 AS many FROM v""")
def m2_ambiguity(spark, sf):
    asked = questions(spark, sf)
    cards = evidence.cards(R.bm25(doc_chunks(spark, sf), asked, 5), asked).where("answerable")
    return cards.select("query_id", F.size("ambiguity").cast("bigint").alias("notes"), F.array_contains("ambiguity", evidence.MANY_NOTE).alias("many"))


@query(f"WITH {ASKED} SELECT query_id, true AS supported FROM q WHERE query_id IN (SELECT query_id FROM ({CARD} SELECT DISTINCT query_id FROM u))")
def e8_citation_support(spark, sf):
    asked = questions(spark, sf)
    return evidence.supported(evidence.cards(R.bm25(doc_chunks(spark, sf), asked, 5), asked)).where("supported")


# --- profiles, evaluation -------------------------------------------------------------------------------------
@query(r"""SELECT conv_id::VARCHAR AS document_id, count(*) AS page_count, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END)::BIGINT AS text_page_count, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS word_count, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END)::BIGINT AS empty_pages FROM conversations GROUP BY 1""")
def g10_profile(spark, sf):
    pages = ingest.table_pages(table(spark, sf, "conversations"), "conv_id", "text", "turn")
    return profile.profiles(pages).select("document_id", "page_count", "text_page_count", "word_count", "empty_pages")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]*') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS value, generate_subscripts(w, 1) AS pos FROM t),
c AS (SELECT doc_id, lower(value) AS value, count(*) AS n, min(pos) AS first FROM u WHERE length(value) > 4 AND lower(value) NOT IN ('about', 'after', 'also', 'because', 'before', 'between', 'document', 'from', 'into', 'more', 'retrieval', 'that', 'their', 'there', 'these', 'this', 'with', 'would') GROUP BY ALL)
SELECT doc_id::VARCHAR AS document_id, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 12""")
def g11_topics(spark, sf):
    return profile.topics(doc_pages(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*){0,3}\b') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS value, generate_subscripts(w, 1) AS pos FROM t),
c AS (SELECT doc_id, value, count(*) AS n, min(pos) AS first FROM u WHERE length(value) >= 3 AND lower(value) NOT IN ('about', 'after', 'also', 'because', 'before', 'between', 'document', 'from', 'into', 'more', 'retrieval', 'that', 'their', 'there', 'these', 'this', 'with', 'would') GROUP BY ALL)
SELECT doc_id::VARCHAR AS document_id, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 20""")
def g11_entities(spark, sf):
    return profile.frequent_entities(doc_pages(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH p AS (SELECT DISTINCT p_brand AS document_id, kind, ref FROM part, LATERAL (VALUES ('table', 'table:' || p_size), ('section', 'section:' || (p_size + 1)), ('page', 'page:1'), ('citation', 'citation:' || (p_partkey % 9))) t(kind, ref))
SELECT document_id, kind, count(*) AS n FROM p GROUP BY ALL""")
def g12_inventory(spark, sf):
    return profile.inventory(part_pages(spark, sf)).select("document_id", "kind", F.size("refs").cast("bigint").alias("n"))


@query("SELECT doc_id::VARCHAR AS document_id, CASE quality WHEN 1 THEN 'clean' WHEN 0 THEN 'noisy' ELSE 'unlabeled' END AS tier FROM documents LEFT JOIN labels USING (doc_id)")
def f14_tiers(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.create_map(F.lit("quality_tier"), F.when(F.col("quality") == 1, "clean").otherwise("noisy")).alias("metadata"))
    docs = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return evaluate.tiers(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata")))


@query("""WITH f AS (SELECT CASE quality WHEN 1 THEN 'clean' ELSE 'noisy' END AS tier, doc_id, lang, source FROM documents JOIN labels USING (doc_id))
SELECT coalesce(tier, 'all') AS tier, count(DISTINCT doc_id) AS documents, count(DISTINCT lang) AS distinct_entity, count(DISTINCT source) AS distinct_reference, count(*) AS entity_mentions FROM f GROUP BY ROLLUP (tier)""")
def g19_tier_rollup(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "clean").otherwise("noisy").alias("tier"), "lang", "source")
    facts = d.select(F.col("doc_id").alias("document_id"), "tier", F.inline(F.array(F.struct(F.lit("entity").alias("kind"), F.col("lang").alias("name")), F.struct(F.lit("reference").alias("kind"), F.col("source").alias("name")))))
    return evaluate.tier_rollup(facts).select(F.coalesce("tier", F.lit("all")).alias("tier"), "documents", "distinct_entity", "distinct_reference", "entity_mentions")


MODES = ("bm25", "dense", "planner")


def judged_cases(asked: DataFrame) -> DataFrame:
    """Expected terms: the question's third word; expected pages: the first, for items with an even id."""
    term = F.get(F.split("question", " "), F.lit(2))
    pages = F.when(F.col("query_id").cast("bigint") % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    return asked.select(F.col("query_id").alias("case_id"), F.col("question").alias("query"), F.array(term).alias("expected_terms"), pages.alias("expected_pages"))


def judged(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, and evidence and cards of three modes."""
    asked = questions(spark, sf)
    cases = judged_cases(asked)
    # each mode reads the chunks
    chunks, e, c = written(doc_chunks(spark, sf)), None, None
    for mode in MODES:
        rows = settled(retrieve.retrieve(mode, chunks, doc_pages(spark, sf), asked, 5))
        card = evidence.cards(rows, asked)
        one = card.join(evidence.supported(card), "query_id").select(F.col("query_id").alias("case_id"), "answerable", "supported", "confidence", F.lit(mode).alias("mode"))
        rows = rows.withColumnRenamed("query_id", "case_id").withColumn("mode", F.lit(mode))
        e, c = (rows, one) if e is None else (e.unionByName(rows), c.unionByName(one))
    return cases, e, c


METRICS = f"""WITH {CHUNKS}, {ASKED}, {TERMS}, {bm25_sql('document_id')}, {DENSE}, {PLANNER}, {ranked_sql('bm', 'xb', 5)}, {ranked_sql('de', 'xd', 5)},
m AS (SELECT 'bm25' AS mode, query_id, chunk_id, rank, score FROM xb UNION ALL SELECT 'dense', query_id, chunk_id, rank, score FROM xd UNION ALL SELECT 'planner', query_id, chunk_id, rank, score FROM mg),
t AS (SELECT m.*, text, string_split(question, ' ')[3] AS term, query_id::BIGINT % 2 = 0 AS paged FROM m JOIN chunks USING (chunk_id) JOIN q USING (query_id)),
v AS (SELECT mode, query_id, bool_or(contains(lower(text), lower(term))) AS term_hit, bool_or(paged) AS page_hit, avg(CASE WHEN rank <= 3 THEN least(1, greatest(0, score)) END) AS confidence, 1.0 / min(CASE WHEN paged OR contains(lower(text), lower(term)) THEN rank END) AS rr FROM t GROUP BY ALL), md AS (SELECT unnest(['bm25', 'dense', 'planner']) AS mode),
x AS (SELECT md.mode, q.query_id, coalesce(term_hit, false) AS term_hit, coalesce(page_hit, false) AS page_hit, coalesce(confidence, 0) AS confidence, v.query_id IS NOT NULL AS answerable, coalesce(rr, 0) AS rr FROM md CROSS JOIN q LEFT JOIN v ON v.mode = md.mode AND v.query_id = q.query_id),
g AS (SELECT mode, count(*) AS cases, avg(term_hit::INT) AS term_hit_rate, avg(page_hit::INT) AS page_hit_rate, avg(answerable::INT) AS answerable_rate, avg(confidence) AS average_confidence, avg(rr) AS mrr FROM x GROUP BY mode)"""


@query(f"{METRICS} SELECT mode, cases, round(term_hit_rate, 6) AS term_hit_rate, round(page_hit_rate, 6) AS page_hit_rate, round(answerable_rate, 6) AS answerable_rate, round(average_confidence, 4) AS average_confidence, round(mrr, 6) AS mrr FROM g")
def g14_mode_metrics(spark, sf):
    m = evaluate.mode_metrics(evaluate.case_metrics(*judged(spark, sf)))
    return m.select("mode", "cases", F.round("term_hit_rate", 6).alias("term_hit_rate"), F.round("page_hit_rate", 6).alias("page_hit_rate"), F.round("answerable_rate", 6).alias("answerable_rate"), F.round("average_confidence", 4).alias("average_confidence"), F.round("mrr", 6).alias("mrr"))


@query(f"""{METRICS}, gw AS (SELECT mode, unnest(['term_hit_rate', 'mrr', 'answerable_rate']) AS metric, unnest([round(term_hit_rate, 9), round(mrr, 9), round(answerable_rate, 9)]) AS value FROM g), gp AS (SELECT metric, value AS planner FROM gw WHERE mode = 'planner')
SELECT metric, round(planner, 6) AS planner, round(avg(value), 6) AS static_mean, coalesce(string_agg(CASE WHEN planner > value THEN mode END, ',' ORDER BY mode), '') AS wins, coalesce(string_agg(CASE WHEN planner < value THEN mode END, ',' ORDER BY mode), '') AS losses FROM gw JOIN gp USING (metric) WHERE mode <> 'planner' GROUP BY metric, planner""")
def g15_planner_vs_static(spark, sf):
    m = evaluate.mode_metrics(evaluate.case_metrics(*judged(spark, sf)))
    rows = evaluate.planner_against_static(m, ("term_hit_rate", "mrr", "answerable_rate"))
    return rows.select("metric", F.round("planner", 6).alias("planner"), F.round("static_mean", 6).alias("static_mean"), F.array_join("wins", ",").alias("wins"), F.array_join("losses", ",").alias("losses"))


@query("SELECT arg_max(s_name, (s_nationkey * 1.0, -s_suppkey)) AS best_by_mrr, arg_max(s_name, (s_suppkey % 10 * 0.1, -s_suppkey)) AS best_by_confidence FROM supplier")
def g16_sweep(spark, sf):
    """Suppliers stand for variants: many ties, which go to the first."""
    return evaluate.sweep_best(table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS INT) AS ordinal", "s_name AS variant", "s_nationkey * 1.0D AS mrr", "s_suppkey % 10 * 0.1D AS average_confidence"))


@query("""WITH w AS (SELECT DISTINCT p_type AS kind, p_name AS name, lower(p_name) AS key FROM part), h AS (SELECT DISTINCT p_type AS kind, lower(p_name) AS key FROM part WHERE p_size > 45)
SELECT kind, count(*) AS expected, count(h.key) AS found, round(count(h.key) / count(*), 6) AS recall, coalesce(string_agg(CASE WHEN h.key IS NULL THEN name END, ',' ORDER BY name), '') AS missing FROM w LEFT JOIN h USING (kind, key) GROUP BY kind""")
def f17_recall(spark, sf):
    """Names of parts by type, of which those of large parts are found, in capitals."""
    part = table(spark, sf, "part")
    want = part.select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    have = part.where("p_size > 45").select(F.col("p_type").alias("kind"), F.upper("p_name").alias("name"))
    return evaluate.recall(want, have).select("kind", "expected", "found", F.round("recall", 6).alias("recall"), F.array_join("missing", ",").alias("missing"))


BY_VARIANT = "(CASE WHEN query_id[1] IN ('2', '3') THEN 0.08 * (votes - 1) ELSE 0 END + CASE WHEN query_id[1] IN ('1', '3') THEN 0.10 * jac ELSE 0 END)"
SWEPT = merged_sql(f"SELECT v || ':' || query_id AS query_id, * EXCLUDE (query_id, v) FROM ({BOTH}), range(4) r(v)", BY_VARIANT).replace("JOIN q USING", "JOIN vq USING")


@query(f"""{TWENTY}, vq AS (SELECT v || ':' || query_id AS query_id, question FROM q, range(4) r(v)), {SWEPT},
t AS (SELECT query_id[1]::INT AS ordinal, query_id[3:] AS case_id, rank, score, text, string_split(question, ' ')[3] AS term, query_id[3:]::BIGINT % 2 = 0 AS paged FROM mg JOIN chunks USING (chunk_id) JOIN vq USING (query_id)),
v AS (SELECT ordinal, case_id, bool_or(contains(lower(text), lower(term))) AS term_hit, bool_or(paged) AS page_hit, avg(CASE WHEN rank <= 3 THEN least(1, greatest(0, score)) END) AS confidence, 1.0 / min(CASE WHEN paged OR contains(lower(text), lower(term)) THEN rank END) AS rr FROM t GROUP BY ALL),
x AS (SELECT r.v::INT AS ordinal, q.query_id AS case_id, coalesce(term_hit, false) AS term_hit, coalesce(page_hit, false) AS page_hit, coalesce(confidence, 0) AS confidence, coalesce(rr, 0) AS rr FROM q, range(4) r(v) LEFT JOIN v ON v.ordinal = r.v AND v.case_id = q.query_id)
SELECT ordinal, count(*) AS cases, round(avg(term_hit::INT), 6) AS term_hit_rate, round(avg(page_hit::INT), 6) AS page_hit_rate, round(avg(confidence), 4) AS average_confidence, round(avg(rr), 6) AS mrr FROM x GROUP BY ordinal""")
def p3_sweep(spark, sf):
    """The four variants of a sweep over all benchmark items, as rows of one plan."""
    found, asked = hits(spark, sf)
    got = evaluate.swept(settled(found), evaluate.sweep_variants(True), judged_cases(asked), 5)
    return got.select("ordinal", "cases", F.round("term_hit_rate", 6).alias("term_hit_rate"), F.round("page_hit_rate", 6).alias("page_hit_rate"), F.round("average_confidence", 4).alias("average_confidence"), F.round("mrr", 6).alias("mrr"))


@query("""WITH o AS (SELECT p_brand AS tier, p_type AS kind, lower(p_name) AS key FROM part WHERE p_size > 25), w AS (SELECT DISTINCT CASE WHEN p_size % 3 > 0 THEN p_brand END AS tier, p_type AS kind, p_name AS name, lower(p_name) AS key FROM part WHERE p_size % 2 = 0),
s AS (SELECT w.*, EXISTS (SELECT 1 FROM o WHERE (w.tier IS NULL OR o.tier = w.tier) AND o.kind = w.kind AND o.key = w.key) AS seen FROM w)
SELECT coalesce(tier, 'all') AS tier, kind, count(*) AS expected, count(*) FILTER (seen) AS found, round(count(*) FILTER (seen) / count(*), 6) AS recall, coalesce(string_agg(CASE WHEN NOT seen THEN name END, ',' ORDER BY name), '') AS missing FROM s GROUP BY s.tier, kind""")
def g20_recall_by_tier(spark, sf):
    """Names of parts by type, expected of their brand or of all; names of large parts are seen, in capitals."""
    part = table(spark, sf, "part")
    want = part.where("p_size % 2 = 0").select(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("tier"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    have = part.where("p_size > 25").select(F.col("p_brand").alias("tier"), F.col("p_type").alias("kind"), F.upper("p_name").alias("name"))
    rows = evaluate.recall_by_tier(want, have)
    return rows.select(F.coalesce("tier", F.lit("all")).alias("tier"), "kind", "expected", "found", F.round("recall", 6).alias("recall"), F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {SAYING}, d AS (SELECT document_id, count(*) AS nodes, count(DISTINCT a) AS entities, count(DISTINCT b) AS refs FROM g GROUP BY 1), t AS (SELECT d.*, CASE WHEN right(document_id, 1) IN ('1', '3') THEN 'odd' ELSE 'even' END AS tier,
  2 * (nodes - 1) + (SELECT sum(m * (m - 1)) FROM (SELECT count(*) AS m FROM g WHERE g.document_id = d.document_id GROUP BY a)) + 2 * (SELECT sum(m * (m - 1)) FROM (SELECT count(*) AS m FROM g WHERE g.document_id = d.document_id GROUP BY b)) AS edges FROM d)
SELECT coalesce(tier, 'all') AS tier, count(*) AS documents, sum(nodes)::BIGINT AS nodes, sum(entities)::BIGINT AS entities, sum(refs)::BIGINT AS "references", sum(edges)::BIGINT AS edges, round(avg(nodes), 6) AS average_nodes, round(avg(edges), 6) AS average_edges FROM t GROUP BY ROLLUP (tier)""")
def p4_extraction_by_tier(spark, sf):
    chunks = graph_chunks(spark, sf)
    tier = F.when(F.right("document_id", F.lit(1)).isin("1", "3"), "odd").otherwise("even")
    of = chunks.select("document_id", tier.alias("tier")).distinct()
    counts = graph.relation_counts(chunks).withColumnRenamed("scope", "document_id").join(of, "document_id").select("document_id", "tier", "relation", "n")
    rows = evaluate.extraction_by_tier(evaluate.extraction_facts(graph.nodes(chunks), of), counts)
    return rows.select(F.coalesce("tier", F.lit("all")).alias("tier"), "documents", "nodes", "entities", "references", "edges", F.round("average_nodes", 6).alias("average_nodes"), F.round("average_edges", 6).alias("average_edges"))


# --- sources, catalog, jobs, scanner --------------------------------------------------------------------------
@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS final, text AS glm FROM conversations) SELECT conv_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, coalesce(nullif(final, ''), nullif(glm, ''), '') AS text FROM r""")
def a2_history_explode(spark, sf):
    """Saved OCR runs, written from the conversations and read back by the reader."""
    pages = ingest.table_pages(table(spark, sf, "conversations"), "conv_id", "text", "turn")
    pages = pages.withColumn("metadata", F.create_map(F.lit("glm_text"), F.col("text"))).withColumn("text", F.when((F.col("number") - 1) % 3 == 0, "").otherwise(F.col("text")))
    runs = ingest.history_rows(pages).select("document_id", F.lit("t").alias("title"), F.lit("p").alias("path"), "json")
    return ingest.run_pages(runs).select("document_id", F.col("number").cast("bigint").alias("number"), "text")


@query("SELECT doc_id, substr(sha1(encode('docs/' || doc_id || '.txt') || encode(text)), 1, 16) AS document_id FROM documents")
def a6_document_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ingest.document_id(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text").cast("binary")).alias("document_id"))


@query(f"WITH {CHUNKS}, c AS (SELECT document_id, count(*) AS chunk_count, max(len({TOKENS.format('text')})) > 0 AS words FROM chunks GROUP BY 1) SELECT doc_id::VARCHAR AS document_id, 1::BIGINT AS page_count, coalesce(chunk_count, 0) AS chunk_count, 0::BIGINT AS entity_count, coalesce(doc_id % 2 = 0 AND words, false) AS has_late, false AS has_bm25 FROM documents LEFT JOIN c ON c.document_id = doc_id::VARCHAR")
def f12_catalog_left_join(spark, sf):
    """The catalog of a store that holds all documents as pages, their chunks, and the late index of those with an even id."""
    from lodeseek.operators.blocks import late_rows
    from lodeseek.session import shared_folder
    from lodeseek.sources.store import Store

    store = Store(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    chunks = settled(doc_chunks(spark, sf))
    store.save("pages", doc_pages(spark, sf))
    store.save("chunks", chunks)
    store.save("index_late", late_rows(chunks.where("CAST(document_id AS BIGINT) % 2 = 0"), 256))
    return store.catalog().select("document_id", "page_count", "chunk_count", "entity_count", "has_late", "has_bm25")


@query("SELECT user_id::VARCHAR AS job_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def n_job_state(spark, sf):
    from lodeseek.streaming.jobs import latest

    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return latest(e).select("job_id", "status")


SCANNED = sensitive.SECRETS + sensitive.PERSONAL


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) " + " UNION ALL ".join("SELECT doc_id, line_number, '{}' AS label FROM l WHERE regexp_matches(line, '{}')".format(label, p.replace("(?iu)", "(?i)").replace("'", "''")) for label, p in SCANNED))
def r1_sensitive_scan(spark, sf):
    rows = sensitive.findings(table(spark, sf, "documents"))
    return rows.select("doc_id", F.col("line_number").cast("bigint").alias("line_number"), "label")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, BM25 over every document, and a card for each question."""
    return m1_cards(spark, sf)
