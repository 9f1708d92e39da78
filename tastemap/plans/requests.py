"""Model inputs, batch requests and results, and profile answers over events, documents and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonrepair, text as T
from ..operators import context as cx
from ..schemas import DOMAINS
from ..session import load, shared_folder
from ..sources import files, readers
from ..streaming.incremental import gated_and_masked, pending_requests
from .adapters import CUES, POST, REC, events, pick, posts, sql_list
from .gate import GATED
from .privacy import _mask_sql
from .registry import query


@query("input_modes", f"""WITH {POST} SELECT post_id, CASE m WHEN 'text_image_captions_timestamps' THEN strftime(created_at, '%Y-%m-%d') ELSE '' END AS created_at, CASE m WHEN 'image_captions_only' THEN '' ELSE md5(text) END AS text_md5, CASE m WHEN 'image_captions_only' THEN NULL ELSE language END AS language, m AS mode
FROM post, (SELECT unnest(['text_only', 'image_captions_only', 'text_image_captions', 'text_image_captions_timestamps']) AS m)""")
def input_modes(spark, sf):
    p = posts(spark, sf).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))
    out = None
    for mode in cx.INPUT_MODES:
        rows = cx.for_input_mode(p, mode).select("post_id", "created_at", F.when(F.col("text") == "", "").otherwise(F.md5("text")).alias("text_md5"), "language", F.lit(mode).alias("mode"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _images(spark, sf):
    p = posts(spark, sf).withColumn("posts_dir", F.concat(F.lit("/data/"), "user_id"))
    files = p.filter("post_id % 3 = 0").select(F.explode("media").alias("m"), "posts_dir").select(F.concat("posts_dir", F.lit("/"), "m.storage_uri").alias("path")).filter("path is not null")
    return p, files


IMAGES = f"""{POST}, im AS (SELECT *, 1 AS i, CASE WHEN n_images = 1 THEN alt_text END AS alt FROM post WHERE n_images >= 1 UNION ALL SELECT *, 2, alt_text FROM post WHERE n_images = 2),
src AS (SELECT *, CASE WHEN post_id % 3 = 0 THEN '/data/' || user_id || '/media/' || post_id || '.jpg' END AS local FROM im)"""


@query("post_images", f"""WITH {IMAGES} SELECT user_id, post_id, post_index, CAST(i AS INTEGER) AS post_image_index, coalesce(alt, 'Image available at ' || source_url, 'Image ' || i) AS caption, coalesce(local, source_url) AS local_first, coalesce(source_url, local) AS remote_first FROM src""")
def post_images(spark, sf):
    p, files = _images(spark, sf)
    a = cx.post_images(p, files).withColumnRenamed("source", "local_first")
    b = cx.post_images(p, files, "remote_first").select("post_id", "post_image_index", F.col("source").alias("remote_first"))
    return a.join(b, ["post_id", "post_image_index"])


def _texted(spark, sf):
    p, files = _images(spark, sf)
    images = cx.post_images(p, files)
    cache = images.filter("source is not null and post_id % 5 != 2").select("source", F.when(F.col("post_id") % 20 == 0, " ").otherwise(F.concat(F.lit("seen "), "post_id")).alias("image_text")).distinct()
    return p, cx.with_cached_text(images.filter("source is not null"), cache)


@query("cached_image_texts", f"""WITH {IMAGES} SELECT user_id, count(*) AS images, count(*) FILTER (post_id % 5 = 2) AS missing, count(*) FILTER (post_id % 5 <> 2 AND post_id % 20 = 0) AS unreadable FROM src WHERE coalesce(local, source_url) IS NOT NULL GROUP BY 1""")
def cached_image_texts(spark, sf):
    _, (_, counts) = _texted(spark, sf)
    return counts


@query("context_counts", f"""WITH {IMAGES}, c AS (SELECT post_id, count(*) AS n, count(*) FILTER (post_id % 5 <> 2) AS t FROM src WHERE coalesce(local, source_url) IS NOT NULL GROUP BY 1)
SELECT user_id, count(*) AS posts_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS image_count, count(n) AS image_post_count, CAST(coalesce(sum(t), 0) AS BIGINT) AS image_text_count, count(*) FILTER (t > 0) AS image_text_post_count FROM post LEFT JOIN c USING (post_id) GROUP BY 1""")
def context_counts(spark, sf):
    p, (images, _) = _texted(spark, sf)
    return cx.context_counts(cx.post_payload(p.withColumn("created_at", T.iso_utc(F.col("created_at"))), images))


@query("visual_modes", f"WITH {IMAGES} SELECT post_id, CAST(i AS INTEGER) AS post_image_index, m AS mode, m = 'native' AND coalesce(local, source_url) IS NOT NULL AS has_source, m = 'text_image' AS has_text FROM src, (SELECT unnest(['native', 'text_image', 'wo_text_image']) AS m)")
def visual_modes(spark, sf):
    p, files = _images(spark, sf)
    images = cx.post_images(p, files).withColumn("image_text", F.lit("t"))
    out = None
    for mode in cx.VISUAL_MODES:
        rows = cx.for_visual_mode(images, mode).select("post_id", "post_image_index", F.lit(mode).alias("mode"), F.col("source").isNotNull().alias("has_source"), F.col("image_text").isNotNull().alias("has_text"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("image_limits", f"WITH {POST} SELECT post_id, CAST(n_images + n_videos AS INTEGER) AS unlimited, CAST(least(1, n_images + n_videos) AS INTEGER) AS one, 0 AS none FROM post")
def image_limits(spark, sf):
    return posts(spark, sf).select("post_id", *[F.size(cx.limited(F.col("media"), n)).alias(name) for n, name in ((-1, "unlimited"), (1, "one"), (0, "none"))])


@query("retry_payloads", r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS u FROM documents)
SELECT doc_id, CAST(least(280, length(t)) AS INTEGER) AS n_text, doc_id % 2 = 0 AS has_tags, false AS redacted_has_tags, CAST(least(140, length(u)) AS INTEGER) AS n_image_text FROM s""")
def retry_payloads(spark, sf):
    d = F.col("doc_id")
    tags = F.when(d % 2 == 0, F.array(F.lit("#A"), F.lit("#a "), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    args = (F.lit("2024"), d, F.col("text"), tags, F.array(F.col("text"), F.lit(" ")))
    rows = load(spark, sf, "documents").select("doc_id", cx.retry_payload(*args).alias("a"), cx.retry_payload(*args, redact=True).alias("b"))
    body = F.from_json("a", "t string, h array<string>, img array<string>")
    return rows.select("doc_id", F.coalesce(F.length(body["t"]), F.lit(0)).alias("n_text"), (F.coalesce(F.size(body["h"]), F.lit(0)) == 1).alias("has_tags"), (F.coalesce(F.size(F.from_json("b", "h array<string>")["h"]), F.lit(0)) > 0).alias("redacted_has_tags"), F.coalesce(F.length(body["img"][0]), F.lit(0)).alias("n_image_text"))


@query("trimmed_contexts", r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT doc_id, '[Post index=0] ' || t AS one, '[Post index=1] ' || t AS two FROM s)
SELECT doc_id, md5(rtrim(left(one || chr(10) || chr(10) || two, 500), chr(10) || ' ')) AS context_md5, md5(one) AS one_md5 FROM b""")
def trimmed_contexts(spark, sf):
    t = T.squeeze(F.col("text"))
    c = load(spark, sf, "documents").select("doc_id", F.concat(F.lit("[Post index=0] "), t, F.lit("\n\n[Post index=1] "), t).alias("context"))
    a = cx.trimmed_context(c, 10, 500).select("doc_id", F.md5("context").alias("context_md5"))
    b = cx.trimmed_context(c, 1, 0).select("doc_id", F.md5("context").alias("one_md5"))
    return a.join(b, "doc_id")


@query("image_text_renders", f"""WITH {REC} SELECT post_id, CASE WHEN k % 5 = 0 THEN '{cx.NO_SUMMARY}' ELSE 'sum ' || k END || CASE WHEN k % 2 = 0 THEN ' | visible_text=A ' || k || '; B' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' | tags=x, y' ELSE '' END AS rendered FROM ev""")
def image_text_renders(spark, sf):
    k = F.col("k")
    payload = F.struct(
        F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" sum  "), k)).alias("summary"), F.when(k % 2 == 0, F.array(F.concat(F.lit("A "), k), F.concat(F.lit(" a  "), k), F.lit("B"))).alias("visible_text"),
        F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("X"))).alias("tags"),
    )
    return events(spark, sf).select("post_id", cx.image_text(payload)[1].alias("rendered"))


ANSWERS = ['{"a": 1}', '<think>hm {</think> {"a": 2}', '```json\n{"a": 3}\n```', 'Sure: {"a": "4 } x"} done', '{"a": 5, "b": [1, 2', "no object here", '{"a": 7,}']


@query("recovered_json", f"""WITH {REC} SELECT post_id, CASE k % 7 WHEN 3 THEN '4 }} x' WHEN 5 THEN NULL ELSE CAST(k % 7 + 1 AS VARCHAR) END AS a FROM ev""")
def recovered_json(spark, sf):
    rows = events(spark, sf).select("post_id", jsonrepair.json_object(pick(ANSWERS, F.col("k") % 7)).alias("j"))
    return rows.select("post_id", F.get_json_object("j", "$.a").alias("a"))


SHELLS = ['{}', '{"schema_version": "v", "domain": "x"}', '{"schema_version": "v", "domain": "x", "user_id": 1, "stable_interests": []}', '{"schema_version": "v", "a": 1, "b": 2, "c": 3}', '{"a": 1}']


@query("suspicious_answers", f"WITH {REC} SELECT post_id, k % 5 <= 2 AS suspicious FROM ev")
def suspicious_answers(spark, sf):
    return events(spark, sf).select("post_id", jsonrepair.is_suspicious(pick(SHELLS, F.col("k") % 5)).alias("suspicious"))


@query("batch_requests", """SELECT 'doc_' || doc_id AS custom_id, false AS too_large, md5(text) AS prompt_md5, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_images FROM documents""")
def batch_requests(spark, sf):
    d = F.col("doc_id")
    rows = load(spark, sf, "documents").select(F.concat(F.lit("doc_"), d).alias("custom_id"), F.lit('Be "brief"').alias("system_prompt"), F.col("text").alias("user_prompt"), F.when(d % 3 == 0, F.array(F.lit("https://a/1"), F.lit("https://a/2"))).otherwise(F.array().cast("array<string>")).alias("image_urls"))
    out = cx.chat_requests(rows, "m1", force_json=True)
    content = F.get_json_object("request", "$.body.messages[1].content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.size("image_urls") > 0
    return out.select(F.get_json_object("request", "$.custom_id").alias("custom_id"), "too_large", F.md5(F.when(listed, parts[0]["text"]).otherwise(content)).alias("prompt_md5"), F.when(listed, F.size(F.filter(parts, lambda p: p["type"] == "image_url"))).otherwise(0).alias("n_images"))


@query("duplicate_request_ids", "SELECT o_custkey::VARCHAR AS custom_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_request_ids(spark, sf):
    return cx.duplicate_ids(load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("custom_id")))


@query("message_texts", "SELECT doc_id, md5(trim(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(10) || 'more' END, chr(32))) AS text_md5 FROM documents")
def message_texts(spark, sf):
    many = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"))))
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.md5(cx.message_text(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(many))).alias("text_md5"))


def _output(spark, sf):
    """Raw output lines: some with a status, an answer without JSON, a broken line, or an unknown id."""
    k, n = F.col("k"), F.col("post_id")
    answer = F.when(n % 11 == 0, "sorry").otherwise(F.concat(F.lit('text {"k": '), k, F.lit("}")))
    response = F.struct(F.array(F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = F.to_json(F.struct(F.concat(F.when(n % 17 == 0, "x").otherwise("t"), n).alias("custom_id"), F.when(n % 7 == 0, "boom").otherwise("").alias("status"), response.alias("response")))
    e = events(spark, sf)
    out = e.filter("post_id % 13 != 0").select(F.when(n % 19 == 0, F.concat(F.lit("{"), n)).otherwise(line).alias("value"), F.concat(F.lit("part-"), n % 3).alias("path"))
    return e.select(F.concat(F.lit("t"), n).alias("custom_id")), out


OUT = f"{REC}, o AS (SELECT post_id AS n, k, post_id % 13 = 0 OR post_id % 17 = 0 OR post_id % 19 = 0 AS gone, post_id % 7 = 0 AS st, post_id % 11 = 0 AS np FROM ev)"


@query("reconciled_results", f"WITH {OUT} SELECT 't' || n AS custom_id, CASE WHEN NOT gone AND NOT st AND NOT np THEN k::VARCHAR END AS k, CASE WHEN gone THEN 'missing_prediction_row' WHEN st THEN 'batch_status_error: boom' WHEN np THEN 'parse_failed' END AS error FROM o")
def reconciled_results(spark, sf):
    r = cx.reconciled(*_output(spark, sf))
    return r.select("custom_id", F.get_json_object("content", "$.k").alias("k"), "error")


@query("unknown_output_lines", f"WITH {OUT} SELECT CASE WHEN n % 19 = 0 THEN 'invalid_json_line' ELSE 'unknown_custom_id' END AS error, count(*) AS n FROM o WHERE n % 13 <> 0 AND (n % 19 = 0 OR n % 17 = 0) GROUP BY 1")
def unknown_output_lines(spark, sf):
    return cx.unknown_lines(*_output(spark, sf)).groupBy("error").agg(F.count("*").alias("n"))


@query("output_audit", f"WITH {OUT} SELECT 3::BIGINT AS n_files, count(*) AS n_rows_total, count(*) FILTER (n % 19 <> 0 AND NOT st) AS n_rows_success, count(*) FILTER (n % 19 = 0 OR st) AS n_rows_failed FROM o WHERE n % 13 <> 0")
def output_audit(spark, sf):
    return cx.output_audit(_output(spark, sf)[1])


@query("batch_results", f"WITH {REC} SELECT post_id AS custom_id, CASE WHEN k % 4 <= 1 THEN 'ok' END AS content, CASE k % 4 WHEN 2 THEN 'denied' WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'expired' ELSE 'missing result row' END END AS error FROM ev")
def batch_results(spark, sf):
    k = F.col("k")
    e = events(spark, sf).withColumnRenamed("post_id", "custom_id")
    results = e.filter(k % 4 != 3).select("custom_id", F.when(k % 4 <= 1, "ok").alias("content"), F.when(k % 4 == 2, "denied").alias("error"))
    errors = e.filter((k % 4 == 3) & (k % 3 == 0)).select("custom_id", F.lit("expired").alias("error"))
    return cx.batch_results(e.select("custom_id"), results, errors)


def _profile_answers(spark, sf):
    """Profile answers as JSON: users' domains by number, listed, flagged or only with interests."""
    u = F.col("user_id")
    users = events(spark, sf).select("user_id").distinct()
    item = F.struct(F.concat(F.lit("Tag "), u).alias("tag"), F.array(F.lit("nothing"), (u % 7).cast("string"), F.lit("100000"), F.lit("1")).alias("evidence_post_ids"))
    again = F.struct(F.concat(F.lit("tag "), u).alias("tag"), F.array(F.lit("0")).alias("evidence_post_ids"))
    profile = F.create_map(
        F.lit("gaming"), F.struct(F.lit(None).cast("boolean").alias("active"), F.array(item, again).alias("stable_interests")),
        F.lit("pets"), F.struct((u % 2 == 0).alias("active"), F.array().cast("array<struct<tag:string,evidence_post_ids:array<string>>>").alias("stable_interests")),
    )
    content = F.to_json(F.struct(F.array(F.when(u % 3 == 0, "food_drink").otherwise("x")).alias("active_domains"), profile.alias("profile")))
    return users, users.filter(u % 5 != 0).select("user_id", content.alias("content"))


PROFILES = f"""{REC}, u AS (SELECT DISTINCT user_id FROM ev), dm AS (SELECT unnest({sql_list(DOMAINS)}) AS domain), fp AS (SELECT user_id, domain, domain = 'gaming' OR (domain = 'pets' AND user_id % 2 = 0) OR (domain = 'food_drink' AND user_id % 3 = 0) AS active FROM u, dm WHERE user_id % 5 <> 0)"""


@query("final_profile_domains", f"WITH {PROFILES} SELECT * FROM fp")
def final_profile_domains(spark, sf):
    return cx.final_profiles(_profile_answers(spark, sf)[1]).select("user_id", "domain", "active")


@query("profile_answer_tasks", f"WITH {PROFILES} SELECT u.user_id, dm.domain, CASE WHEN fp.active THEN 'active' ELSE 'inactive' END AS pred_status, CASE WHEN u.user_id % 10 = 0 THEN 'missing_domain: ' || dm.domain || '; final_profile_failed: timeout' ELSE '' END AS error FROM u CROSS JOIN dm LEFT JOIN fp ON fp.user_id = u.user_id AND fp.domain = dm.domain")
def profile_answer_tasks(spark, sf):
    users, answers = _profile_answers(spark, sf)
    tasks = users.withColumn("domain", F.explode(F.array(*[F.lit(d) for d in DOMAINS])))
    failed = users.filter("user_id % 10 = 0").withColumn("error", F.lit("timeout"))
    return cx.answered_tasks(tasks, cx.final_profiles(answers), failed).select("user_id", "domain", "pred_status", "error")


@query("profile_anchor_indices", f"""WITH {POST}, us AS (SELECT DISTINCT e.user_id FROM events e WHERE e.user_id % 5 <> 0), n AS (SELECT user_id, max(post_index) AS m FROM post GROUP BY 1),
c AS (SELECT us.user_id, unnest([us.user_id % 7, 1]) AS raw, unnest([1, 2]) AS pos FROM us), j AS (SELECT c.user_id, c.pos, coalesce((SELECT p.post_index FROM post p WHERE p.user_id = c.user_id AND p.post_id = c.raw), CASE WHEN c.raw <= m THEN c.raw END) AS post_index FROM c JOIN n USING (user_id)),
f AS (SELECT user_id, post_index, min(pos) AS pos FROM j WHERE post_index IS NOT NULL GROUP BY ALL) SELECT user_id, 'gaming' AS domain, 'Tag ' || user_id AS label, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS nth, post_index FROM f""")
def profile_anchor_indices(spark, sf):
    anchors = cx.profile_anchors(cx.final_profiles(_profile_answers(spark, sf)[1]), "stable")
    return cx.cited_indices(anchors, posts(spark, sf)).join(anchors, ["user_id", "domain", "item"]).select("user_id", "domain", "label", "nth", "post_index")


@query("selected_posts", f"""WITH {POST}, s AS (SELECT p_partkey % 50 AS user_id, p_type AS domain, p_partkey % 50 + 50 * (p_size % 30) AS post_id, p_partkey AS ord FROM part), f AS (SELECT user_id, domain, post_id, min(ord) AS ord FROM s GROUP BY ALL)
SELECT f.user_id, f.domain, f.post_id::VARCHAR AS post_id, CAST(row_number() OVER (PARTITION BY f.user_id, f.domain ORDER BY ord) AS INTEGER) AS nth FROM f JOIN post p ON p.user_id = f.user_id AND p.post_id = f.post_id QUALIFY nth <= 3""")
def selected_posts(spark, sf):
    k = F.col("p_partkey")
    s = load(spark, sf, "part").select((k % 50).alias("user_id"), F.col("p_type").alias("domain"), (k % 50 + 50 * (F.col("p_size") % 30)).alias("post_id"), k.alias("ord"))
    return cx.selected_posts(s, posts(spark, sf).select("user_id", "post_id", "text"), 3).select("user_id", "domain", "post_id", "nth")


@query("restored_media_sources", f"WITH {IMAGES} SELECT post_id, CAST(i - 1 AS INTEGER) AS media_position, coalesce(CASE WHEN post_id % 2 = 0 THEN source_url END, 'file://x') AS source_url FROM src")
def restored_media_sources(spark, sf):
    p, _ = _images(spark, sf)
    media = p.select("posts_dir", "post_index", "post_id", F.posexplode("media").alias("media_position", "m")).filter("m.media_type = 'image'")
    originals = media.select("posts_dir", "post_index", "media_position", F.when(F.col("post_id") % 2 == 0, F.col("m.source_url")).otherwise("ftp://y").alias("source_url"))
    return cx.restored_sources(media.select("posts_dir", "post_index", "media_position", "post_id", F.lit("file://x").alias("source_url")), originals).select("post_id", "media_position", "source_url")


@query("rendered_prompts", "SELECT doc_id, md5('User ' || doc_id % 50 || ': ' || text || ' {end}') AS prompt_md5 FROM documents")
def rendered_prompts(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.md5(cx.rendered("User {user}: {text} {end}", user=F.col("doc_id") % 50, text=F.col("text"))).alias("prompt_md5"))


def _timeline_files(spark, sf):
    """Documents as timeline files, one a user, with broken and blank lines in between; the files' folder."""
    n = F.col("doc_id")
    line = F.to_json(F.struct((n % 50).cast("string").alias("user_id"), n.cast("string").alias("post_id"), F.lit("2024-01-05T00:00:00Z").alias("created_at"), F.col("text").alias("text")))
    rows = load(spark, sf, "documents").select(
        (n % 50).cast("string").alias("u"), n.alias("n"), F.when(n % 9 == 4, "{broken").when(n % 9 == 5, "  ").otherwise(line).alias("value"))
    folder = shared_folder(spark)
    rows.repartition("u").sortWithinPartitions("u", "n").select("u", "value").write.partitionBy("u").option("lineSep", "\n").text(folder)
    return folder


@query("indexed_post_lines", "SELECT 'u=' || doc_id % 50 AS directory, doc_id // 50 AS post_index, doc_id::VARCHAR AS post_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 9 NOT IN (4, 5)")
def indexed_post_lines(spark, sf):
    lines = files.numbered_lines(spark, _timeline_files(spark, sf))
    return readers.indexed_posts(lines).select("directory", "post_index", "post_id", F.md5("text").alias("text_md5"))


@query("discovered_timelines", """WITH l AS (SELECT doc_id % 50 AS u, min(doc_id) FILTER (doc_id % 9 <> 5) AS f FROM documents GROUP BY 1) SELECT 'u=' || u AS user_id, 'u=' || u AS directory FROM l UNION ALL SELECT u::VARCHAR, 'u=' || u FROM l WHERE f % 9 <> 4""")
def discovered_timelines(spark, sf):
    found = readers.discovered_users(files.first_lines(spark, _timeline_files(spark, sf)))
    return found.select("user_id", readers.directory_of(F.col("path")).alias("directory"))


@query("release_manifest", """WITH l AS (SELECT doc_id, doc_id % 50 AS u, CASE WHEN doc_id % 9 = 5 THEN '  ' ELSE text END AS line FROM documents),
f AS (SELECT u, sha256(string_agg(replace(line, chr(10), ' ') || chr(10), '' ORDER BY doc_id)) AS h, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM l GROUP BY u),
w AS (SELECT 'u=' || u AS folder, h AS sha256, bytes, CASE WHEN u % 10 = 3 THEN NULL WHEN u % 10 = 4 THEN repeat('0', 64) ELSE h END AS listed FROM f)
SELECT folder, sha256, bytes, CASE WHEN listed IS NULL THEN 'Manifest file set mismatch' WHEN listed <> sha256 THEN 'Checksum mismatch' END AS issue FROM w
UNION ALL SELECT 'u=gone', NULL, NULL, 'Manifest file set mismatch'""")
def release_manifest(spark, sf):
    """Digests of written files, compared with a manifest that leaves out, alters and adds some entries."""
    n = F.col("doc_id")
    rows = load(spark, sf, "documents").select((n % 50).cast("string").alias("u"), n.alias("n"), F.when(n % 9 == 5, "  ").otherwise(F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    folder = shared_folder(spark)
    rows.repartition("u").sortWithinPartitions("u", "n").select("u", "value").write.partitionBy("u").option("lineSep", "\n").text(folder)
    found = files.checksums(spark, folder, "_SUCCESS")
    u = F.regexp_extract("path", r"^u=(\d+)/", 1).cast("int")
    listed = found.filter(u % 10 != 3).select(F.lit("v1").alias("release_variant"), "path", F.when(u % 10 == 4, "0" * 64).otherwise(F.col("sha256")).alias("sha256"))
    listed = listed.unionByName(spark.range(1).select(F.lit("v1").alias("release_variant"), F.lit("u=gone/x").alias("path"), F.lit("0").alias("sha256")))
    issues = files.manifest_problems(found, listed, "v1")
    both = found.join(issues, "path", "full_outer")
    return both.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("folder"), "sha256", "bytes", "issue")


@query("user_media_summaries", f"WITH {POST} SELECT user_id, count(*) AS post_count, CAST(sum(n_images) AS BIGINT) AS images, CAST(sum(n_videos) AS BIGINT) AS videos, CAST(sum(n_images) AS BIGINT) AS local_media, 0::BIGINT AS remote_media FROM post GROUP BY 1")
def user_media_summaries(spark, sf):
    return readers.media_summary(posts(spark, sf))


@query("user_languages", "SELECT doc_id % 50 AS user_id, lang AS language, count(*) AS n FROM documents GROUP BY ALL")
def user_languages(spark, sf):
    return posts(spark, sf).groupBy("user_id", "language").agg(F.count("*").alias("n"))


def _reviews(spark, sf):
    e = events(spark, sf)
    return e.select("user_id", F.lit("").alias("username"), (F.col("user_id") * 2).alias("user_index"), pick(["qualified", "rejected", "skip"], F.col("k") % 3).alias("label"), F.lit("").alias("notes"), F.col("post_id").alias("annotated_at"), F.lit(0).cast("long").alias("post_count")).filter("user_id % 4 != 1")


REVIEW = f"{REC}, lt AS (SELECT user_id, list_extract(['qualified', 'rejected', 'skip'], 1 + k % 3) AS label, post_id FROM ev WHERE user_id % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY post_id DESC) = 1)"


@query("latest_review_labels", f"WITH {REVIEW} SELECT user_id, label, post_id AS annotated_at FROM lt")
def latest_review_labels(spark, sf):
    return readers.latest_labels(_reviews(spark, sf)).select("user_id", "label", "annotated_at")


@query("review_progress", f"WITH {REVIEW} SELECT label, count(*) AS n FROM lt GROUP BY 1")
def review_progress(spark, sf):
    return readers.latest_labels(_reviews(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query("review_export", f"WITH {REVIEW} SELECT lt.user_id, 'name' || lt.user_id AS username, lt.user_id * 2 AS user_index, label, (SELECT count(*) FROM ev WHERE ev.user_id = lt.user_id) AS post_count FROM lt")
def review_export(spark, sf):
    users = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("post_count")).withColumn("username", F.concat(F.lit("name"), "user_id"))
    return readers.review_csv(readers.latest_labels(_reviews(spark, sf)), users).select("user_id", "username", "user_index", "label", "post_count")


@query("next_unreviewed_user", f"WITH {REVIEW} SELECT coalesce(min(user_id * 2) FILTER (user_id * 2 >= 100), min(user_id * 2)) AS next_index FROM ev WHERE user_id % 4 = 1")
def next_unreviewed_user(spark, sf):
    users = events(spark, sf).select("user_id", (F.col("user_id") * 2).alias("user_index")).distinct()
    return readers.next_unreviewed(users, readers.latest_labels(_reviews(spark, sf)), 100)


@query("gated_and_masked", f"WITH {GATED} SELECT post_id, is_noise, md5({_mask_sql('text')}) AS masked_md5 FROM gated")
def gated_and_masked_posts(spark, sf):
    rows = gated_and_masked(posts(spark, sf), CUES)
    return rows.select("post_id", "is_noise", F.md5("masked_text").alias("masked_md5"))


@query("pending_requests", "SELECT doc_id AS request_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_request_keys(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("request_key"))
    return pending_requests(d.union(d), load(spark, sf, "labels").select(F.col("doc_id").alias("request_key")))
