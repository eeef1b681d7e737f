"""The queries of this subpackage over the synthetic tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, mixing, neardup, packing, pii, quality, tokencount, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(rows.unionByName(extra)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.spans_of(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_exact_topk": op4_exact_topk,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_personal_data": op10_personal_data,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_decontaminate": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
gr AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS gram
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT g.doc_id, g.s, g.m, win.item_id FROM gr g JOIN win ON g.m = win.m AND g.gram = win.gram),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op2_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '</?(p|br|h1)>', ' ', 'g') AS h FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(h, '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM t),
o AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM o""",
    "op3_mixing": r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM s GROUP BY source),
wt AS (SELECT source, ss, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
f AS (SELECT *, sum(ss) OVER () - coalesce(sum(3 * ss) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
      FROM wt WINDOW b AS (ORDER BY 3.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT rest, left_w FROM f WHERE CAST(rest AS DOUBLE) / left_w <= 3.0 * ss / w ORDER BY 3.0 * ss / w, source LIMIT 1),
t AS (SELECT wt.source, ss, CASE WHEN 3 * ss < w * (CAST(rest AS DOUBLE) / CAST(left_w AS DOUBLE)) THEN CAST(3 * ss AS DOUBLE)
             ELSE CAST(w * rest AS DOUBLE) / CAST(left_w AS DOUBLE) END AS target FROM wt, lam),
b AS (SELECT source, ss, target, CASE WHEN ss > 0 THEN least(CAST(floor(target / ss) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
c AS (SELECT s.doc_id, s.size, b.ss, b.target, b.whole, b.target - b.whole * b.ss AS budget, s.h,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(s.size) OVER (PARTITION BY s.source, s.h) AS here
      FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, ss AS source_size, target,
       CAST(size * (whole + CASE WHEN budget > 0 AND (upto < budget OR (upto - here < budget AND upto - budget <= budget - (upto - here))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c""",
    "op4_exact_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM p q JOIN p c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_near_duplicates": rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
one AS (SELECT doc_id, n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM sh JOIN n USING (doc_id) GROUP BY doc_id, n),
cls AS (SELECT k, min(doc_id) AS doc_id, any_value(n) AS n FROM one GROUP BY k),
cs AS (SELECT sh.doc_id, g FROM sh JOIN cls USING (doc_id)),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM cs x JOIN cs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pr JOIN cls p ON a = p.doc_id JOIN cls q ON b = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
ed AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk UNION SELECT cls.doc_id, one.doc_id FROM one JOIN cls USING (k) UNION SELECT one.doc_id, cls.doc_id FROM one JOIN cls USING (k)),
reach(a, b) AS (SELECT a, b FROM ed UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT dw.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, dw.doc_id) AS component_id, coalesce(component_id, dw.doc_id) = dw.doc_id AS kept
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    "op7_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || replace(text, '<|', '<||') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}
