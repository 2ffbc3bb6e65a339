"""DuckDB SQL for the queries of this subpackage that SQL can express; plain restatements, for tables of moderate size.

There is none for tokenizers (2, 3, 11), XXH64 (4), trained models (10) and CRC-32 (13).
"""

from __future__ import annotations

from lodeseek.llm.licenses import TEMPLATES, TEXTS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A window of 50 words goes if a document with a smaller id has it, too.
SUBSTRING_DEDUP = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM starts),
first AS (SELECT t, min(doc_id) AS least_id FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN first USING (t) WHERE doc_id > least_id),
per_doc AS (SELECT doc_id, list(i) AS is_gone, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN is_gone IS NULL THEN w
         ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(is_gone, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN per_doc USING (doc_id)
"""

#: A byte goes if a 200-byte string over it starts anywhere else, too.
SUFFIX_DEDUP = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM doc WHERE octet_length(b) >= 200),
win AS (SELECT doc_id, i, array_slice(b, i, i + 199) AS t FROM starts),
again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
starting AS (SELECT doc_id, i FROM win SEMI JOIN again USING (t)),
mark AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, 0) AS opens FROM starting),
number AS (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM mark),
span AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS z FROM number GROUP BY doc_id, s),
per_doc AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS la, list(z ORDER BY a) AS lz FROM span GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN la IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(la) + 2),
         lambda k: array_slice(b, CASE WHEN k = 1 THEN 1 ELSE lz[k - 1] END, CASE WHEN k > len(la) THEN octet_length(b) ELSE la[k] - 1 END)), lambda x, y: x || y) END) AS kept_sha256
FROM doc LEFT JOIN per_doc USING (doc_id)
"""

#: Chunks end where the rolling hash over the hashes of two lines says so; of equal chunks of two or more lines the first stays.
LINE_DEDUP = """
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
hashed AS (SELECT doc_id, l, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM doc),
cut AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (h[i] + 31 * CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) % 3 = 0) AS e FROM hashed),
numbered AS (SELECT doc_id, l, e, unnest(range(1, len(e) + 1)) AS c FROM cut),
chunk AS (SELECT doc_id, l, c, CASE WHEN c = 1 THEN 1 ELSE e[c - 1] + 1 END AS a, e[c] AS z FROM numbered),
texts AS (SELECT doc_id, c, a, z, array_to_string(l[a:z], chr(10)) AS t FROM chunk WHERE z > a),
gone AS (SELECT doc_id, a, z FROM texts QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, c) > 1),
per_doc AS (SELECT doc_id, list(i) AS g FROM (SELECT doc_id, unnest(range(a, z + 1)) AS i FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, len(l) AS n, CASE WHEN g IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda x: NOT list_contains(g, x)), lambda x: l[x]) END AS k FROM doc LEFT JOIN per_doc USING (doc_id)),
joined AS (SELECT *, CASE WHEN len(k) = 0 THEN '' ELSE array_to_string(k, chr(10)) END AS t FROM kept)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(t) AS kept_sha256, CAST(octet_length(encode(t)) AS BIGINT) AS kept_bytes FROM joined
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of 10 words, or whole shorter items, in the documents; and items whose words all lie in a stretch of twice their length.
DECONTAMINATION = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM item_at),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n),
doc_win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM doc_at),
hit AS (SELECT doc_id, item_id, n, i FROM doc_win JOIN win USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
item_word AS (SELECT item_id, 2 * len(w) AS span, len(list_distinct(w)) AS m, unnest(list_distinct(w)) AS x FROM item WHERE len(w) > 0),
doc_word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM doc),
holding AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, x FROM doc_word) JOIN item_word USING (x) GROUP BY doc_id, item_id HAVING count(*) = min(m)),
place AS (SELECT doc_id, item_id, x, i, m, span FROM holding JOIN item_word USING (item_id) JOIN doc_word USING (doc_id, x)),
cover AS (SELECT a.doc_id, a.item_id FROM place a JOIN place b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.doc_id, a.item_id, a.i HAVING count(DISTINCT b.x) = min(a.m)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM cover GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES + TEXTS))
_IDF = "(ln((1 + (SELECT count(*) FROM documents)) / (1.0 + coalesce(df, 0))) + 1)"

#: Lines, runs of lines with words and whole texts against the templates, every term by its document frequency.
LICENSES = rf"""
WITH lines AS (SELECT doc_id, i, {_WORDS.replace("coalesce(text, '')", "line")} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
worded AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines WHERE len(w) > 0),
unit AS (SELECT doc_id, 0 AS kind, i AS u, w FROM worded UNION ALL SELECT doc_id, 1, g, flatten(list(w ORDER BY i)) FROM worded GROUP BY doc_id, g HAVING count(*) > 1 UNION ALL SELECT doc_id, 2, 0, flatten(list(w ORDER BY i)) FROM worded GROUP BY doc_id),
df AS (SELECT x, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS x FROM worded) GROUP BY x),
template AS (SELECT i, name, unnest({_WORDS.replace("coalesce(text, '')", "text")}) AS x FROM (VALUES {_TEMPLATES}) t(i, name, text)),
tv AS (SELECT i, name, x, count(*) * any_value({_IDF}) AS v FROM template LEFT JOIN df USING (x) GROUP BY i, name, x), tn AS (SELECT i, name, x, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM tv),
uv AS (SELECT doc_id, kind, u, x, count(*) * any_value({_IDF}) AS v FROM (SELECT doc_id, kind, u, unnest(w) AS x FROM unit) JOIN df USING (x) GROUP BY doc_id, kind, u, x),
norm AS (SELECT doc_id, kind, u, sqrt(sum(v * v)) AS norm FROM uv GROUP BY doc_id, kind, u),
dot AS (SELECT doc_id, kind, u, i, name, sum(uv.v * tn.v) AS dot FROM uv JOIN tn USING (x) GROUP BY doc_id, kind, u, i, name),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, u ORDER BY round(dot, 9) DESC, name) AS r FROM dot),
hit AS (SELECT doc_id, kind, name, round(dot / norm, 6) AS score FROM best JOIN norm USING (doc_id, kind, u) WHERE r = 1 AND round(dot / norm, 6) >= 0.75),
one AS (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS r, sum((kind = 0)::INT) OVER (PARTITION BY doc_id) AS n, bool_or(kind = 2) OVER (PARTITION BY doc_id) AS whole FROM hit)
SELECT doc_id, 'documents/' || doc_id || '/text' AS path, name AS license, score, coalesce(n, 0)::BIGINT AS lines, CASE WHEN whole THEN name END AS inherited, CASE WHEN whole THEN 'documents/' || doc_id || '/text' END AS inherited_from, name AS effective
FROM documents LEFT JOIN (SELECT * FROM one WHERE r = 1) USING (doc_id)
"""

#: Phrases of two and three words by their weakest cut; a pair goes if a frequent triple holds half of its occurrences.
COLLOCATIONS = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, (VALUES (1), (2), (3)) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY lang, m, phrase),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cut AS (SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM f, (VALUES (1), (2)) t(k) WHERE m > k AND f >= 10),
scored AS (SELECT cut.lang, cut.m, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.m = k AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.m = cut.m - k AND y.phrase = tail),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(f) AS most FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE m = 3 AND f >= 10) GROUP BY lang, part),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside ON w.m = 2 AND inside.lang = w.lang AND inside.part = w.phrase WHERE most IS NULL OR 100::HUGEINT * most < 50::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN size USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op6_topk": TOP_K,
    "op7_line_dedup": LINE_DEDUP,
    "op8_licenses": LICENSES,
    "op9_decontamination": DECONTAMINATION,
    "op12_collocations": COLLOCATIONS,
}
