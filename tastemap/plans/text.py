"""Text functions over whole documents, events and parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import load
from .adapters import REC, events, records
from .registry import query

LEMMA = """CASE WHEN length(s) <= 3 THEN s WHEN s LIKE '%ies' AND length(s) > 4 THEN left(s, length(s) - 3) || 'y'
  WHEN s LIKE '%ses' AND length(s) > 4 THEN left(s, length(s) - 2) WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END"""
STEM = "CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2) ELSE w END"
FREE = r"""trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"""
TOKENS = rf"""norm AS (SELECT doc_id, {FREE} AS free FROM documents
), tok AS (SELECT doc_id, unnest(regexp_extract_all(free, '[\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(free, '[\p{{L}}\p{{N}}_]+'), 1) AS i FROM norm
), stem AS (SELECT doc_id, i, w, {STEM} AS s FROM tok
), lem AS (SELECT doc_id, i, w, {LEMMA} AS lemma FROM stem)"""


@query("free_text", f"SELECT doc_id, md5({FREE}) AS free_text_md5, length({FREE}) AS n FROM documents")
def free_text(spark, sf):
    free = T.free_text(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", free.alias("free")).select("doc_id", F.md5("free").alias("free_text_md5"), F.length("free").cast("long").alias("n"))


@query("word_lemmas", f"WITH {TOKENS} SELECT w AS word, lemma, count(*) AS n FROM lem GROUP BY ALL")
def word_lemmas(spark, sf):
    word = F.explode(T.words(T.free_text(F.col("text")))).alias("word")
    counted = load(spark, sf, "documents").select(word).groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", T.lemma(F.col("word")).alias("lemma"), "n")


@query("duplicate_tokens", f"WITH {TOKENS} SELECT d.doc_id, count(lemma) AS n_tokens, count(DISTINCT lemma) AS n_distinct, md5(coalesce(string_agg(lemma, ' ' ORDER BY i), '')) AS tokens_md5 FROM documents d LEFT JOIN lem USING (doc_id) GROUP BY 1")
def duplicate_tokens(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", T.duplicate_tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


@query("token_bags", f"WITH {TOKENS} SELECT doc_id, lemma AS token, count(*) AS n FROM lem GROUP BY ALL")
def token_bags(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", F.explode(T.duplicate_tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("tag_forms", f"""WITH x AS (SELECT DISTINCT p_name || ' ' || p_type || 's' AS tag FROM part), t AS (SELECT tag, unnest(string_split(replace(lower(tag), ' ', '_'), '_')) AS w, generate_subscripts(string_split(replace(lower(tag), ' ', '_'), '_'), 1) AS i FROM x
), stem AS (SELECT tag, i, {STEM} AS s FROM t WHERE w <> ''), lem AS (SELECT tag, i, {LEMMA} AS lemma FROM stem)
SELECT tag, string_agg(lemma, '_' ORDER BY i) AS tag_form FROM lem GROUP BY tag""")
def tag_forms(spark, sf):
    names = load(spark, sf, "part").select(F.concat("p_name", F.lit(" "), "p_type", F.lit("s")).alias("tag")).distinct()
    return names.select("tag", T.tag_form(F.col("tag")).alias("tag_form"))


@query("token_jaccard", f"""WITH {TOKENS}, sets AS (SELECT doc_id, list(DISTINCT lemma) AS t FROM lem GROUP BY 1)
SELECT a.doc_id AS doc_id, round(CASE WHEN len(coalesce(s.t, [])) = 0 OR len(coalesce(r.t, [])) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s.t, r.t))::DOUBLE / len(list_distinct(list_concat(s.t, r.t))) END + 1e-10, 6) AS jaccard
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 50 LEFT JOIN sets s ON s.doc_id = a.doc_id LEFT JOIN sets r ON r.doc_id = b.doc_id""")
def token_jaccard(spark, sf):
    """Overlap of each post with the next one of the same user."""
    t = load(spark, sf, "documents").select("doc_id", F.array_distinct(T.duplicate_tokens(F.col("text"))).alias("t"))
    later = t.select((F.col("doc_id") - 50).alias("doc_id"), F.col("t").alias("u"))
    return t.join(later, "doc_id").select("doc_id", T.round6(T.jaccard(F.col("t"), F.col("u"))).alias("jaccard"))


@query("token_cosine", f"""WITH {TOKENS}, bag AS (SELECT doc_id, lemma, count(*) AS n FROM lem GROUP BY ALL), norms AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM bag GROUP BY 1
), dots AS (SELECT a.doc_id, CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM bag a JOIN bag b ON b.doc_id = a.doc_id + 50 AND a.lemma = b.lemma GROUP BY 1)
SELECT a.doc_id, round(coalesce(dot / (x.norm * y.norm), 0.0::DOUBLE) + 1e-10, 6) AS cosine FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 50
LEFT JOIN norms x ON x.doc_id = a.doc_id LEFT JOIN norms y ON y.doc_id = b.doc_id LEFT JOIN dots d ON d.doc_id = a.doc_id""")
def token_cosine(spark, sf):
    """Each document's tokens go to two pairs, its own and that of the document 50 ids before; one shuffle by pair serves all counts."""
    docs = load(spark, sf, "documents")
    tokens = docs.select("doc_id", T.duplicate_tokens(F.col("text")).alias("t")).select("doc_id", F.when(F.size("t") > 0, F.array_join("t", " ")).alias("t")).filter("t is not null")
    sides = F.array(F.struct(F.col("doc_id").alias("pair"), F.lit(True).alias("first")), F.struct((F.col("doc_id") - 50).alias("pair"), F.lit(False).alias("first")))
    moved = tokens.filter("doc_id is not null").select("t", F.inline(sides)).repartition("pair")
    words = moved.select("pair", "first", F.explode(F.split("t", " ")).alias("token"))
    count = lambda side: F.sum(side.cast("long"))
    bag = words.groupBy("pair", "token").agg(count(F.col("first")).alias("n"), count(~F.col("first")).alias("m"))
    sums = bag.groupBy("pair").agg(*[F.sum(F.col(x) * F.col(y)).alias(name) for x, y, name in (("n", "m", "dot"), ("n", "n", "nn"), ("m", "m", "mm"))])
    cosine = F.when(F.col("dot") > 0, F.col("dot") / (F.sqrt("nn") * F.sqrt("mm")))
    pairs = docs.select("doc_id").join(docs.select((F.col("doc_id") - 50).alias("doc_id")), "doc_id")
    joined = pairs.join(sums.select(F.col("pair").alias("doc_id"), cosine.alias("c")), "doc_id", "left")
    return joined.select("doc_id", T.round6(F.coalesce("c", F.lit(0.0))).alias("cosine"))


@query("label_forms", r"""SELECT doc_id, md5(coalesce(nullif(trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', ' ', 'g')), ''), '-')) AS match_md5,
  md5(coalesce(nullif(trim(regexp_replace(replace(lower(trim(text)), '_', ' '), '\s+', ' ', 'g')), ''), '-')) AS dialogue_md5,
  md5(array_to_string(regexp_extract_all(replace(lower(trim(text)), '_', ' '), '[a-z0-9]+'), ' ')) AS response_md5,
  md5(trim(regexp_replace(replace(replace(lower(text), '_', ' '), '-', ' '), '\s+', ' ', 'g'))) AS interest_md5,
  md5(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model')) AS slug_md5 FROM documents""")
def label_forms(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(F.coalesce(T.match_label(t), F.lit("-"))).alias("match_md5"), F.md5(F.coalesce(T.dialogue_label(t), F.lit("-"))).alias("dialogue_md5"),
        F.md5(T.response_form(t)).alias("response_md5"), F.md5(T.interest_form(t)).alias("interest_md5"), F.md5(T.slug(t)).alias("slug_md5"),
    )


@query("display_labels", f"""WITH {REC} SELECT tag, min(raw_tag) FILTER (regexp_matches(trim(raw_tag), '_|\\S\\s+\\S')) AS phrase,
  CASE tag WHEN 'retro_gam' THEN 'retro gaming' WHEN 'craft_beer' THEN 'craft beer' ELSE coalesce(replace(min(raw_tag) FILTER (regexp_matches(trim(raw_tag), '_|\\S\\s+\\S')), '_', ' '), replace(tag, '_', ' ')) END AS display_label FROM rec GROUP BY tag""")
def display_labels(spark, sf):
    r = records(spark, sf)
    member = F.when(T.is_phrase(F.col("raw_tag")), F.col("raw_tag"))
    firsts = r.groupBy("raw_tag").agg(F.first(member).alias("m")).withColumn("tag", T.tag_form(F.col("raw_tag"))).groupBy("tag").agg(F.min("m").alias("phrase"))
    return firsts.select("tag", "phrase", T.display_label(F.col("tag"), F.col("phrase")).alias("display_label"))


@query("timestamp_texts", """SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN printf('relative day %07d', event_id % 365) ELSE '' END ELSE strftime(ts, '%Y-%m-%d') END AS timestamp_text,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || 'Z' AS iso_text FROM events""")
def timestamp_texts(spark, sf):
    e = events(spark, sf)
    absent = F.col("post_type") == "error"
    created = F.when(absent, " ").otherwise(F.date_format("created_at", "yyyy-MM-dd"))
    day = F.when(absent, F.when(F.col("post_id") % 2 == 0, F.col("post_id") % 365).otherwise(-1))
    return e.select(F.col("post_id").alias("event_id"), T.timestamp_text(created, day).alias("timestamp_text"), T.iso_utc(F.col("created_at")).alias("iso_text"))


@query("distinct_indices", r"""WITH p AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda x: TRY_CAST(CASE WHEN regexp_matches(x, '^-?[0-9]{1,15}$') THEN x END AS BIGINT)) AS v FROM documents),
o AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p) WHERE x IS NOT NULL GROUP BY doc_id, x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o)
SELECT d.doc_id, coalesce(string_agg(x::VARCHAR, ',' ORDER BY n) FILTER (n <= 4), '') AS first_four, coalesce(string_agg(x::VARCHAR, ',' ORDER BY n) FILTER (x >= 0), '') AS not_negative
FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def distinct_indices(spark, sf):
    """Integers among the blank-separated pieces of each text."""
    pieces = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: x.rlike("^-?[0-9]{1,15}$"))
    d = load(spark, sf, "documents").select("doc_id", pieces.alias("p"))
    return d.select("doc_id", F.array_join(T.distinct_ints(F.col("p"), 4), ",").alias("first_four"), F.array_join(T.distinct_ints(F.col("p"), drop_negative=True), ",").alias("not_negative"))


@query("distinct_short_items", r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents), c AS (SELECT doc_id, trim(regexp_replace(unnest(v), '\s+', ' ', 'g')) AS x, generate_subscripts(v, 1) AS i FROM p),
f AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM c WHERE x <> '' GROUP BY doc_id, lower(x)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(left(x, 40), '|' ORDER BY n) FILTER (n <= 5), '') AS items FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def distinct_short_items(spark, sf):
    lines = F.split("text", "\n")
    return load(spark, sf, "documents").select("doc_id", F.array_join(T.distinct_short(lines, 5, 40), "|").alias("items"))


@query("content_digests", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS digest FROM part""")
def content_digests(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", T.digest(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("digest"))
