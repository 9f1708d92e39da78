"""The registered queries of this subpackage, each with its SQL where SQL can express it."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from . import align, bpe, calls, decontaminate, grace, jaccard, langid, lines, merkle, quality, substrings, toxicity, urls
from .common import table

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_quality_gam")
def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("content", 256).alias("kept_sha256"))


@query("op3_bpe_tokens")
def op3_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_decontamination", f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' '))) AS g FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: list_aggregate(w[i:i + n - 1], 'string_agg', ' '))) AS g FROM d, s WHERE len(w) >= n),
h AS (SELECT doc_id, i, g.n AS n, item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op5_toxicity_ftrl")
def op5_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op6_url_filter", r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS own FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
n AS (SELECT u.*, rule, own, CASE WHEN host != '' THEN host || regexp_replace(path, '/+$', '') || coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '') END AS alias FROM u LEFT JOIN m USING (k)),
c AS (SELECT alias FROM n WHERE own IS NOT NULL AND alias IS NOT NULL GROUP BY alias HAVING bool_or(own = 'block') AND NOT bool_or(own = 'allow'))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN c.alias IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, n.alias AS alias
FROM n LEFT JOIN c ON n.alias = c.alias
""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op7_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM i WHERE 100 * c >= 90 * (na + nb - c)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = s.doc_id
""")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_groups(table(spark, sf_dir, "documents"))


TOOL_FIELDS = [
    ("lookup", "text", "string", True), ("lookup", "turn", "integer", True), ("lookup", "size", "integer", True), ("lookup", "topic", "string", False),
    ("instruct", "text", "string", True), ("instruct", "turn", "string", True), ("instruct", "strict", "boolean", True),
]
#: A text below so many letters is left out of a call's arguments; sizes that this divides are given as texts.
SHORT, ODD = 60, 3


@query("op9_call_linking", """
WITH m0 AS (SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT *, '{"size":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || ',"turn":' || turn || CASE WHEN n < 60 THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || '}' AS raw FROM m0),
c AS (SELECT conv_id, turn, role, text, n, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE role WHEN 'user' THEN 'lookup' ELSE 'instruct' END, raw) AS r FROM m WHERE role IN ('user', 'system')),
a AS (SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS content, count(*) AS n_results FROM m WHERE role = 'assistant' GROUP BY ALL),
k AS (SELECT * FROM c WHERE r = 1),
s AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) * 2 AS run FROM k),
l AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS INTEGER) AS step FROM s),
j AS (SELECT coalesce(k.conv_id, a.conv_id) AS conv_id, coalesce(k.turn, a.turn) AS t, k.turn AS own, role, text, n, n_calls, content, n_results FROM k FULL JOIN a ON k.conv_id = a.conv_id AND k.turn = a.turn)
SELECT j.conv_id, CAST(t AS VARCHAR) AS call_id, coalesce(own, t + 1) AS turn, step, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       coalesce(role = 'user' AND n >= 60 AND n % 3 <> 0, false) AS valid,
       CASE WHEN role IS NULL THEN 'no call' WHEN role = 'system' THEN 'missing:strict' || CASE WHEN n < 60 THEN ',missing:text' ELSE '' END || ',type:turn,unknown:size'
         ELSE concat_ws(',', CASE WHEN n < 60 THEN 'missing:text' END, CASE WHEN n % 3 = 0 THEN 'type:size' END) END AS errors,
       '{"arguments":' || CASE WHEN role IS NULL THEN 'null' ELSE '{"size":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || CASE WHEN n < 60 THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || ',"turn":' || t || '}' END || ',"call_id":"' || t || '","name":'
         || CASE role WHEN 'user' THEN '"lookup"' WHEN 'system' THEN '"instruct"' ELSE 'null' END || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM j LEFT JOIN l ON j.conv_id = l.conv_id AND j.own = l.turn
""")
def op9_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user or system turn is a call whose result is the assistant turn after it; a call needs the one two turns before.

    Arguments come from the row, and break the schemas in several ways: short texts are left out, some sizes are
    texts, and instructions have an unknown size, a turn of another type and no ``strict``.
    """
    messages = table(spark, sf_dir, "conversations")
    asked = messages.filter(F.col("role").isin("user", "system") & F.col("turn").isNotNull())
    n = F.char_length(F.coalesce("text", F.lit("")))
    size = F.when(n % ODD == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    rest = F.to_json(F.struct("turn", F.when(n >= SHORT, F.col("text")).alias("text")))  # nulls are left out
    arguments = F.concat(F.lit('{"size":'), size, F.lit(","), F.substring(rest, 2, 1 << 30))
    asked = asked.select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), F.when(F.col("role") == "user", "lookup").otherwise("instruct").alias("name"),
        arguments.alias("arguments"), "turn", F.lit(0).alias("place"))
    told = messages.filter((F.col("role") == "assistant") & F.col("turn").isNotNull())
    told = told.select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"), "turn")
    written_calls, written_results = calls.message_calls(messages)
    needs = asked.select("conv_id", "call_id", (F.col("turn") - 2).cast("string").alias("needed"))
    tools = spark.createDataFrame(TOOL_FIELDS, "name string, field string, type string, required boolean")
    linked = calls.link_calls(asked.unionByName(written_calls), told.unionByName(written_results), tools, needs)
    return linked.withColumn("errors", F.array_join("errors", ","))


@query("op10_line_dedup", f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') AS key FROM p),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY k.doc_id
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.without_lines(docs, lines.drop_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _row_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Unsigned crc32 of the decimal id: eight shifts for each byte.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))"""


@query("op11_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS t, {_row_sql("text")} AS leaf,
  CASE WHEN {_CRC32} % 2 = 0 THEN {_row_sql("replace(text, chr(10), '')")} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
up(t, k, i, n, h) AS (SELECT t, 0, i, n, leaf FROM l UNION ALL SELECT t, k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY t, k, n, i // 3),
sub AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(k, i, n, h) AS (SELECT 0, i, n, h FROM sub UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, n, i // 3),
runs AS (SELECT t, k, i // 3 AS r, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT k, i // 3 AS r, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL),
way(doc_id, t, leaf, k, i, n, proof, h) AS (SELECT doc_id, t, leaf, 0, i, n, '', coalesce(other, leaf) FROM l
  UNION ALL SELECT doc_id, w.t, leaf, w.k + 1, i // 3, (n + 2) // 3, proof || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], ''),
    sha256(array_to_string(hs[:i % 3], '') || w.h || array_to_string(hs[i % 3 + 2:], '')) FROM way w JOIN runs ON w.t = runs.t AND w.k = runs.k AND i // 3 = r),
way2(doc_id, t, leaf, subroot, k, i, n, proof, h) AS (SELECT doc_id, w.t, leaf, sub.h, 0, sub.i, sub.n, proof, w.h FROM way w JOIN sub USING (t) WHERE w.n = 1
  UNION ALL SELECT doc_id, t, leaf, subroot, w.k + 1, i // 3, (n + 2) // 3, proof || array_to_string(hs[:i % 3], '') || array_to_string(hs[i % 3 + 2:], ''),
    sha256(array_to_string(hs[:i % 3], '') || h || array_to_string(hs[i % 3 + 2:], '')) FROM way2 w JOIN top_runs ON w.k = top_runs.k AND i // 3 = r)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified FROM way2 WHERE n = 1
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository, above this package

    return corpus_pipeline.run(spark, sf_dir)
