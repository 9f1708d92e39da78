"""Scrubbing, releases and reviews over documents, conversations and parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import privacy, release
from ..schemas import BUCKETS, CAPTION_MODELS, DOMAINS
from ..session import cut_lineage, load, spread
from .adapters import POST, pick, posts, sql_list
from .registry import query

# Appended to the documents, so that every identifier pattern occurs.
SUFFIXES = [
    " Mail a.b+c@ex-ample.org now", " see https://x.example/p?q=1 ok", " by @handle.x, ok", " at 12.3456, -98.76543 ok", " on 2024-01-05, and 5/6/2024 ok",
    " call (555) 123-4567 ok", " id 12345678901 ok", " at 12 North Main Street Apt 4b ok", " #[PERSON] met [PET]@x, ok",
]
MASKED = [
    " Mail [EMAIL] now", " see [URL] ok", " by [ACCOUNT], ok", " at [COORDINATES] ok", " on [DATE], and [DATE] ok",
    " call [PHONE] ok", " id [IDENTIFIER] ok", " at [ADDRESS] ok", " [PERSON] met [PET][ACCOUNT], ok",
]
DATES = [" on Jan 5, 2024 ok", " on 01022020 ok", " on 3/4/24 ok", " in /home/bob/x ok", " at [010123] ok", " on 27 dresses ok", " on 5th March 2020 ok"]
DATES_MASKED = [" on [DATE] ok", " on [DATE] ok", " on [DATE] ok", " in [PATH] ok", " at [DATE] ok", " on 27 dresses ok", " on [DATE] ok"]


def _around(x, core, mark, lead=r"[^\p{L}\p{N}_]", trail=r"[^\p{L}\p{N}_]", flags="g"):
    # No lookaround in this SQL dialect: keep the neighbours, and run twice as they may be shared.
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|{lead})(?:{core})($|{trail})', '\\1{mark}\\2', '{flags}')"
    return x


def _mask_sql(x):
    x = rf"regexp_replace({x}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g')"
    x = rf"regexp_replace({x}, '(?:https?://|www\.)[^\s<>\[\]]+', '[URL]', 'gi')"
    x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_.]+', '\1[ACCOUNT]', 'g')"
    x = _around(x, r"-?[0-9]{1,2}\.[0-9]{4,}\s*,\s*-?[0-9]{1,3}\.[0-9]{4,}", "[COORDINATES]", r"[^\p{L}\p{N}_.]", "[^0-9]")
    x = _around(x, "[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}", "[DATE]", "[^0-9]", "[^0-9]")
    x = _around(x, r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "[PHONE]")
    x = _around(x, r"\+?[0-9]{10,}|[a-fA-F0-9]{32,64}", "[IDENTIFIER]")
    return x


SCRUBBED = f"""{POST}, sc AS (SELECT *, {_mask_sql("text")} || list_extract({sql_list(MASKED)}, 1 + post_id % 9) AS plain,
  list_extract({sql_list(DATES_MASKED)}, 1 + post_id % 7) AS dated FROM post)"""


def _with_identifiers(spark, sf, dates=False):
    p = posts(spark, sf)
    parts = ["text", pick(SUFFIXES, F.col("post_id") % 9)] + ([pick(DATES, F.col("post_id") % 7)] if dates else [])
    return p.withColumn("text", F.concat(*parts))


@query("masked_identifiers", f"WITH {SCRUBBED} SELECT post_id, md5(plain) AS masked_md5, right(plain, 30) AS tail FROM sc")
def masked_identifiers(spark, sf):
    m = _with_identifiers(spark, sf).withColumn("m", privacy.masked(F.col("text")))
    return m.select("post_id", F.md5("m").alias("masked_md5"), F.substring("m", -30, 30).alias("tail"))


@query("placeholder_counts", f"""WITH {SCRUBBED}, n AS (SELECT post_id, plain, CASE post_id % 9 WHEN 8 THEN '[PERSON][PET]' ELSE '' END AS before FROM sc)
SELECT CAST(sum(len(string_split(plain, '[EMAIL]')) - 1) AS BIGINT) AS email, CAST(sum(len(string_split(plain, '[URL]')) - 1) AS BIGINT) AS url, CAST(sum(len(string_split(plain, '[ACCOUNT]')) - 1) AS BIGINT) AS account,
  CAST(sum(len(string_split(plain, '[DATE]')) - 1) AS BIGINT) AS date, CAST(sum(len(string_split(plain, '[PHONE]')) - 1) AS BIGINT) AS phone, CAST(sum(len(string_split(plain, '[IDENTIFIER]')) - 1) AS BIGINT) AS identifier,
  CAST(sum(len(string_split(plain, '[PERSON]')) - 1 - (len(string_split(before, '[PERSON]')) - 1)) AS BIGINT) AS person FROM n""")
def placeholder_counts(spark, sf):
    m = _with_identifiers(spark, sf).withColumn("m", privacy.masked(F.col("text")))
    names = ["EMAIL", "URL", "ACCOUNT", "DATE", "PHONE", "IDENTIFIER", "PERSON"]
    hits = m.select(*privacy.placeholder_hits(F.col("text"), F.col("m"), names))
    return hits.agg(*[F.sum(n.lower()).alias(n.lower()) for n in names])


@query("masked_calendar", f"WITH {SCRUBBED} SELECT post_id, md5(plain || dated) AS masked_md5, right(plain || dated, 40) AS tail FROM sc")
def masked_calendar(spark, sf):
    m = _with_identifiers(spark, sf, dates=True).withColumn("m", privacy.masked(F.col("text"), calendar=True))
    return m.select("post_id", F.md5("m").alias("masked_md5"), F.substring("m", -40, 40).alias("tail"))


RULES = [
    (None, "replace", "the", "[PERSON]"), (None, "replace", "la", "[LOCATION]"), (None, "replace", "main street", "[ADDRESS]"), ("7", "replace", "the", "[PET]"), ("9", "replace", "und", "[ORGANIZATION]"), ("9", "replace", "la", "[ORGANIZATION]"),
]


@query("scrubbed_posts", rf"""WITH {SCRUBBED}, t AS (SELECT post_id, user_id, plain, dated FROM sc),
r AS (SELECT post_id, {_around(_around(_around("plain", "the", "#T#", flags="gi"), "und", "[ACCOUNT]", flags="gi"), "la", "#L#", flags="gi")} AS x, user_id, dated FROM t),
s AS (SELECT post_id, replace(replace(x, '#L#', CASE WHEN user_id = 9 THEN '[ORGANIZATION]' ELSE '[LOCATION]' END), '#T#', CASE WHEN user_id = 7 THEN '[PET]' ELSE '[PERSON]' END) AS x, dated FROM r)
SELECT post_id, md5(x || dated) AS scrubbed_md5, post_id % 100 = 3 AS was_rewritten FROM s WHERE post_id % 100 <> 3 UNION ALL SELECT post_id, md5('A quiet note by [ACCOUNT]') , true FROM s WHERE post_id % 100 = 3""")
def scrubbed_posts(spark, sf):
    """Terms for all and for single users, a handle, one term for each part (none occurs), and every hundredth text rewritten as a whole."""
    rows = _with_identifiers(spark, sf, dates=True).withColumn("user_id", F.col("user_id").cast("string"))
    rules = spark.createDataFrame(RULES, "scope string, kind string, term string, replacement string")
    rewrites = rows.filter(F.col("post_id") % 100 == 3).select(
        F.when(F.col("post_id") % 200 == 3, F.col("user_id")).alias("scope"), F.lit("rewrite").alias("kind"),
        privacy.masked(F.col("text")).alias("term"), F.lit("A quiet note by @someone").alias("replacement"),
    ).distinct()
    unseen = load(spark, sf, "part").select(F.lit(None).cast("string").alias("scope"), F.lit("replace").alias("kind"), F.concat(F.lit("part"), "p_partkey", F.lit("of")).alias("term"), F.lit("[IDENTIFIER]").alias("replacement"))
    out = privacy.scrub(rows, rules.unionByName(rewrites).unionByName(unseen), ["und"])
    return out.select("post_id", F.md5("scrubbed").alias("scrubbed_md5"), "was_rewritten")


@query("residual_patterns", f"""WITH {SCRUBBED} SELECT post_id, list_extract(['email', 'url', 'account', 'coordinates', 'date', 'phone', 'identifier', 'address', 'account'], 1 + post_id % 9) AS residual FROM sc UNION ALL SELECT post_id, 'private_path' FROM sc WHERE post_id % 9 = 1""")
def residual_patterns(spark, sf):
    """Patterns found again when masked texts get identifiers appended."""
    tail = pick(SUFFIXES, F.col("post_id") % 9)
    m = posts(spark, sf).withColumn("m", F.concat(privacy.masked(F.col("text")), tail))
    return m.select("post_id", F.explode(privacy.residual_patterns(F.col("m"))).alias("residual"))


def _uid(c):
    return F.concat(F.lit("src_"), c.cast("string"))


def release_posts(spark, sf):
    return _with_identifiers(spark, sf, dates=True).withColumn("user_id", _uid(F.col("user_id")))


def release_interests(spark, sf):
    """Parts as interests of the fifty users; evidence ids are right, indices sometimes are not."""
    k, j = F.col("p_partkey"), F.col("p_partkey") % 4
    u = k % 50
    ids = F.when(k % 6 != 0, F.array(u + 50 * j, u + 50 * ((j + 1) % 4))).otherwise(F.array().cast("array<bigint>"))
    wrong = F.when(k % 5 == 0, F.array(j)).otherwise(F.array(j, (j + 1) % 4))
    place = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("  "), pick(["@cafe.one", "@bar.two"], k % 2))).otherwise(F.concat("p_name", F.lit(" "), pick(["hiking", "board games", "coffee", "museum", "camera", "cats"], k % 6)))
    return spread(load(spark, sf, "part")).select(
        _uid(u).alias("user_id"), F.floor(k / 50).alias("interest_index"), pick(DOMAINS, k % 7).alias("domain"), F.when(k % 3 == 0, "inactive").otherwise("active").alias("status"),
        pick(BUCKETS, F.col("p_size") % 3).alias("bucket"), place.alias("label"), ids.alias("evidence_post_ids"), wrong.alias("evidence_post_indices"),
    )


def release_captions(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select(
        _uid(F.col("conv_id") % 50).alias("user_id"), F.concat(F.lit("img"), "conv_id").alias("image_id"), F.col("conv_id").alias("image_index"),
        pick(CAPTION_MODELS, F.col("turn") % 6).alias("model"), F.concat("text", F.lit(" in a forest with dogs")).alias("summary"),
    )


def mapping(spark, sf):
    users = posts(spark, sf).select("user_id").distinct()
    return users.select(_uid(F.col("user_id")).alias("source_id"), F.format_string("participant_%03d", F.col("user_id") + 1).alias("public_id"))


INT = f"""{POST}, it AS (
  SELECT p_partkey AS k, p_partkey % 50 AS u, p_partkey % 4 AS j, 'src_' || p_partkey % 50 AS user_id, p_partkey // 50 AS interest_index, list_extract({sql_list(DOMAINS)}, 1 + p_partkey % 7) AS domain,
    list_extract({sql_list(BUCKETS)}, 1 + p_size % 3) AS bucket, p_size % 11 = 0 AS place,
    CASE WHEN p_size % 11 = 0 THEN '  ' || list_extract(['@cafe.one', '@bar.two'], 1 + p_partkey % 2) ELSE p_name || ' ' || list_extract(['hiking', 'board games', 'coffee', 'museum', 'camera', 'cats'], 1 + p_partkey % 6) END AS label FROM part
), evi AS (
  SELECT DISTINCT user_id, interest_index, k, u, p AS post_index FROM (SELECT user_id, interest_index, k, u, unnest(CASE WHEN k % 6 = 0 AND k % 5 = 0 THEN [j] ELSE [j, (j + 1) % 4] END) AS p FROM it)
)"""


@query("candidate_posts", f"""WITH {SCRUBBED}, first_day AS (SELECT user_id, min(CAST(created_at AS DATE)) AS d FROM sc GROUP BY 1)
SELECT post_id, printf('participant_%03d', user_id + 1) AS public_user_id, printf('participant_%03d_post_%04d', user_id + 1, post_index + 1) AS public_post_id,
  CAST(date_diff('day', d, CAST(created_at AS DATE)) AS INTEGER) AS relative_day, post_type, language, md5(plain || dated) AS text_md5 FROM sc JOIN first_day USING (user_id)""")
def candidate_posts(spark, sf):
    rows = release.candidate_posts(release_posts(spark, sf), mapping(spark, sf))
    return rows.select("post_id", "public_user_id", "public_post_id", "relative_day", "post_type", "language", F.md5("scrubbed").alias("text_md5"))


@query("resolved_evidence", f"WITH {INT} SELECT user_id, interest_index, post_index, printf('participant_%03d_post_%04d', u + 1, post_index + 1) AS public_post_id FROM evi")
def resolved_evidence(spark, sf):
    found = release.resolved_evidence(release_interests(spark, sf), release_posts(spark, sf))
    return release.candidate_evidence(found, mapping(spark, sf))


@query("repaired_evidence", f"WITH {INT} SELECT user_id, interest_index FROM it WHERE k % 6 <> 0 AND k % 5 = 0")
def repaired_evidence(spark, sf):
    interests = release_interests(spark, sf)
    return release.repaired_interests(interests, release.resolved_evidence(interests, release_posts(spark, sf)))


@query("local_area_labels", f"""WITH {INT}, pl AS (SELECT user_id, label, min(interest_index) AS f FROM it WHERE place AND domain = 'travel_city_exploration' GROUP BY ALL), nb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS area FROM pl)
SELECT it.user_id, interest_index, CASE WHEN area IS NOT NULL THEN 'exploring local area ' || area WHEN place THEN '  [LOCATION]' ELSE it.label END AS public_label
FROM it LEFT JOIN nb ON nb.user_id = it.user_id AND nb.label = it.label AND place AND domain = 'travel_city_exploration'""")
def local_area_labels(spark, sf):
    """Two reviewed place names become locations; travel interests number them per user."""
    rules = spark.createDataFrame([(None, "rewrite", "  [ACCOUNT]", "  [LOCATION]")], "scope string, kind string, term string, replacement string")
    rows = release.candidate_interests(release_interests(spark, sf), rules)
    return rows.select("user_id", "interest_index", "public_label")


@query("candidate_captions", f"""WITH c AS (SELECT conv_id, conv_id % 50 AS u, turn, {_mask_sql("text")} || ' in a forest with dogs' AS x FROM conversations), im AS (SELECT DISTINCT u, conv_id FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY conv_id) AS s FROM im)
SELECT printf('participant_%03d', u + 1) AS public_user_id, printf('image_%05d', s) AS image_id, list_extract({sql_list(CAPTION_MODELS)}, 1 + turn % 6) AS model, md5(x) AS summary_md5 FROM c JOIN n USING (u, conv_id)""")
def candidate_captions(spark, sf):
    rows = release.candidate_captions(release_captions(spark, sf), mapping(spark, sf))
    return rows.select("public_user_id", "image_id", "model", F.md5("summary").alias("summary_md5"))


def _added(name, mark, texts):
    """How many placeholders of one name the scrub put into the texts of (before, after) rows."""
    return f"(SELECT CAST(coalesce(sum(len(string_split(after, '[{mark}]')) - len(string_split(before, '[{mark}]'))), 0) AS BIGINT) FROM {texts}) AS {name}"


# Before and after of every string; the two reviewed places of labels are handles as well.
STRINGS = f"""srcp AS (SELECT text || list_extract({sql_list(SUFFIXES)}, 1 + post_id % 9) || list_extract({sql_list(DATES)}, 1 + post_id % 7) AS before, {_mask_sql("text")} || list_extract({sql_list(MASKED)}, 1 + post_id % 9) || list_extract({sql_list(DATES_MASKED)}, 1 + post_id % 7) AS after FROM post),
srcl AS (SELECT label AS before, CASE WHEN place THEN '  [ACCOUNT]' ELSE label END AS after FROM it),
srcc AS (SELECT text || ' in a forest with dogs' AS before, {_mask_sql("text")} || ' in a forest with dogs' AS after FROM conversations),
strs AS (SELECT * FROM srcp UNION ALL SELECT * FROM srcl UNION ALL SELECT * FROM srcc)"""


@query("release_counts", f"""WITH {INT}, {STRINGS} SELECT (SELECT count(DISTINCT user_id) FROM post) AS users, (SELECT count(*) FROM post) AS posts,
  (SELECT count(*) FROM it) AS interest_entries, (SELECT count(*) FROM it WHERE place) AS changed_labels, (SELECT count(*) FROM conversations) AS captions, (SELECT count(DISTINCT conv_id) FROM conversations) AS images, (SELECT count(*) FROM it WHERE k % 6 <> 0 AND k % 5 = 0) AS repaired_evidence_indices,
  (SELECT count(*) FROM strs) AS strings, (SELECT count(*) FROM strs WHERE before <> after) AS changed_strings, {", ".join(_added(n, m, "strs") for n, m in privacy.COUNTED.items())}, (SELECT count(*) FROM it WHERE place) * 0 AS keyword, 0::BIGINT AS reviewed_rewrite""")
def release_counts(spark, sf):
    p, i, m = release_posts(spark, sf), release_interests(spark, sf), mapping(spark, sf)
    repaired = release.repaired_interests(i, release.resolved_evidence(i, p))
    return release.release_counts(release.candidate_posts(p, m), release.candidate_interests(i), release.candidate_captions(release_captions(spark, sf), m), repaired)


@query("scrub_counts", rf"""WITH {SCRUBBED}, t AS (SELECT post_id, {_around("plain", "the", "#T#", flags="gi")} AS x FROM sc),
u AS (SELECT post_id, len(string_split(x, '#T#')) - 1 AS the, {_around("x", "la", "#L#", flags="gi")} AS y FROM t)
SELECT post_id, CASE WHEN post_id % 100 = 3 THEN 0 ELSE the + len(string_split(y, '#L#')) - 1 END AS keyword, CAST(post_id % 100 = 3 AS BIGINT) AS reviewed_rewrite, CAST(post_id % 9 = 0 AS BIGINT) + email_in AS email, 1::BIGINT AS changed
FROM u JOIN (SELECT post_id, len(string_split({_mask_sql("text")}, '[EMAIL]')) - len(string_split(text, '[EMAIL]')) AS email_in FROM post) USING (post_id)""")
def scrub_counts(spark, sf):
    """Counters of each text under shared terms and rewrites; the suffixes make every text change."""
    rows = _with_identifiers(spark, sf, dates=True).withColumn("user_id", F.col("user_id").cast("string")).filter("true")
    rules = spark.createDataFrame([(None, "replace", "the", "[PERSON]"), (None, "replace", "la", "[LOCATION]")], "scope string, kind string, term string, replacement string")
    rewrites = rows.filter(F.col("post_id") % 100 == 3).select(F.lit(None).cast("string").alias("scope"), F.lit("rewrite").alias("kind"), privacy.masked(F.col("text")).alias("term"), F.lit("A quiet note by @someone").alias("replacement")).distinct()
    out = privacy.scrub(rows, rules.unionByName(rewrites), counts=True)
    return out.select("post_id", "hits.keyword", "hits.reviewed_rewrite", "hits.email", "hits.changed")


@query("source_counts", f"""WITH {INT} SELECT (SELECT count(DISTINCT user_id) FROM post) AS source_users, (SELECT count(*) FROM post) AS source_posts, (SELECT count(*) FROM post WHERE regexp_matches(text, '@[\\p{{L}}\\p{{N}}_]')) AS posts_with_mentions,
  (SELECT count(*) FROM post WHERE regexp_matches(text, '#[\\p{{L}}\\p{{N}}_]')) AS posts_with_hashtags, (SELECT count(*) FROM post) AS exact_timestamps_removed, (SELECT CAST(sum(CASE WHEN post_id % 4 = 0 THEN n_images ELSE 0 END) AS BIGINT) FROM post) AS media_hashes_removed,
  (SELECT count(*) FROM conversations) AS source_captions, (SELECT count(DISTINCT conv_id) FROM conversations) AS source_images, (SELECT count(*) FROM it) AS source_interest_labels""")
def source_counts(spark, sf):
    hashed = F.transform("media", lambda m: F.struct(F.when(m["media_type"] == "image", F.sha2(m["source_url"], 256)).alias("sha256")))
    p = release_posts_plain(spark, sf).withColumn("media", hashed)
    return release.source_counts(p, release_captions(spark, sf), release_interests(spark, sf))


def release_posts_plain(spark, sf):
    return posts(spark, sf).withColumn("user_id", _uid(F.col("user_id")))


WORDS = r"[\p{L}\p{N}_]"
def _topic_list(x, domain=None):
    """Topics found in a text; the patterns are constants, so that each is compiled once."""
    rows = [(t, p) for d, v in release.VOCABULARY.items() for t, p in v.items() if domain in (None, d)]
    hits = [f"CASE WHEN regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{p.replace(chr(92) + 'w', WORDS)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{t}' END" for t, p in rows]
    return f"list_filter([{', '.join(hits)}], lambda v: v IS NOT NULL)"


def _label_topics(x):
    return "CASE domain " + " ".join(f"WHEN '{d}' THEN {_topic_list(x, d)}" for d in release.VOCABULARY) + " END"


def _bare(x):
    return rf"regexp_replace({x}, 'https?://\S+|www\.\S+|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}|[@#][\p{{L}}\p{{N}}_]+|\[[^\]]*\]', ' ', 'gi')"


HINTS = [" hiking and coffee", " my cats, a movie", " pizza street", " photography", ""]
MENTIONS = f"""{INT}, ph AS (
  SELECT user_id, post_id, post_index, created_at, {_bare("text || list_extract(" + sql_list(HINTS) + ", 1 + post_id % 5)")} AS x,
    least(3, ((row_number() OVER (PARTITION BY user_id ORDER BY created_at, post_index) - 1) * 4) // count(*) OVER (PARTITION BY user_id)) AS phase FROM post
), cap AS (SELECT conv_id % 50 AS user_id, list_extract({sql_list(CAPTION_MODELS)}, 1 + turn % 6) AS model, {_bare("text || ' in a forest with dogs'")} AS x FROM conversations
), bl AS (SELECT *, {_bare("label")} AS x FROM it), lt AS (SELECT * EXCLUDE (x), {_label_topics("x")} AS ts FROM bl
), men AS (
  SELECT 'src_' || user_id AS user_id, 'phase' AS source, phase::VARCHAR AS part, unnest({_topic_list("x")}) AS topic FROM ph
  UNION ALL SELECT 'src_' || user_id, 'model', model, unnest({_topic_list("x")}) FROM cap
  UNION ALL SELECT user_id, 'label', domain, unnest(ts) FROM lt
), allowed AS (SELECT topic, count(DISTINCT user_id) AS n_users FROM men GROUP BY 1 HAVING count(DISTINCT user_id) >= 5)"""


def _hinted_posts(spark, sf):
    p = posts(spark, sf)
    return p.withColumn("text", F.concat("text", pick(HINTS, F.col("post_id") % 5))).withColumn("user_id", _uid(F.col("user_id")))


def _mentions(spark, sf):
    return release.topic_mentions(_hinted_posts(spark, sf), release_captions(spark, sf), release_interests(spark, sf))


@query("topic_mentions", f"WITH {MENTIONS} SELECT user_id, source, part, topic, count(*) AS n FROM men GROUP BY ALL")
def topic_mentions(spark, sf):
    return _mentions(spark, sf).groupBy("user_id", "source", "part", "topic").agg(F.count("*").alias("n"))


@query("allowed_topics", f"WITH {MENTIONS} SELECT * FROM allowed")
def allowed_topics(spark, sf):
    return release.allowed_topics(_mentions(spark, sf))


@query("selected_topics", f"""WITH {MENTIONS}, c AS (SELECT user_id, source, part, topic, count(*) AS n FROM men SEMI JOIN allowed USING (topic) WHERE source <> 'label' GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, source, part ORDER BY n DESC, topic) AS r FROM c QUALIFY r <= 5), l AS (SELECT user_id, source, part, string_agg(topic, '; ' ORDER BY topic) AS topics FROM r GROUP BY ALL
), us AS (SELECT DISTINCT 'src_' || user_id AS user_id FROM post), parts AS (SELECT user_id, 'phase' AS source, p AS part FROM us, (VALUES ('0'), ('1'), ('2'), ('3')) x(p) UNION ALL SELECT user_id, 'model', m FROM us, (SELECT unnest({sql_list(CAPTION_MODELS)}) AS m))
SELECT p.user_id, p.source, p.part, 'Generalized ' || CASE p.source WHEN 'phase' THEN 'text' ELSE 'visual' END || ' topics: ' || coalesce(topics, 'content withheld') || '.' AS summary FROM parts p LEFT JOIN l USING (user_id, source, part)""")
def selected_topics(spark, sf):
    m = _mentions(spark, sf)
    return _parts(spark, sf, m, release.allowed_topics(m)).select("user_id", "source", "part", "summary")


def _parts(spark, sf, mentions, allowed):
    users = posts(spark, sf).select(_uid(F.col("user_id")).alias("user_id")).distinct()
    slots = F.array(*[F.struct(F.lit("phase").alias("source"), F.lit(str(p)).alias("part")) for p in range(4)], *[F.struct(F.lit("model").alias("source"), F.lit(m).alias("part")) for m in CAPTION_MODELS])
    parts = users.select("user_id", F.explode(slots).alias("s")).select("user_id", "s.source", "s.part")
    return release.selected_topics(mentions.filter("source != 'label'"), allowed, parts)


def _topic_labels(spark, sf, allowed):
    interests = release_interests(spark, sf)
    phased = release.phases(_hinted_posts(spark, sf))
    return release.released_topics(release.generalized_labels(interests, allowed), release.resolved_phases(interests, phased))


@query("released_topics", f"""WITH {MENTIONS}, ex AS (SELECT user_id, interest_index, domain, bucket, unnest(ts) AS topic FROM lt), t AS (SELECT lt.user_id, lt.interest_index, lt.domain, lt.bucket, v.topic FROM lt LEFT JOIN (SELECT ex.* FROM ex SEMI JOIN allowed USING (topic)) v USING (user_id, interest_index)
), lab AS (SELECT user_id, interest_index, domain, bucket, coalesce(topic, replace(domain, '_', ' ') || ' interests') AS label FROM t
), ep AS (SELECT DISTINCT e.user_id, interest_index, phase FROM evi e JOIN ph ON ph.user_id = e.u AND ph.post_index = e.post_index)
SELECT l.user_id, domain, bucket, label, string_agg(DISTINCT phase::VARCHAR, ',' ORDER BY phase::VARCHAR) AS phases FROM lab l LEFT JOIN ep USING (user_id, interest_index) GROUP BY ALL""")
def released_topics(spark, sf):
    rows = _topic_labels(spark, sf, release.allowed_topics(_mentions(spark, sf)))
    return rows.select("user_id", "domain", "bucket", "label", F.array_join(F.col("evidence_post_indices").cast("array<string>"), ",").alias("phases"))


@query("evidence_audit", f"""WITH {MENTIONS}, a AS (SELECT x.user_id, interest_index, list_sort(list(DISTINCT phase)) AS pa FROM (SELECT it.user_id, interest_index, it.u, unnest(CASE WHEN k % 6 = 0 THEN [] ELSE [j, (j + 1) % 4] END) AS p FROM it) x JOIN ph ON ph.user_id = x.u AND ph.post_index = x.p GROUP BY ALL
), b AS (SELECT x.user_id, interest_index, list_sort(list(DISTINCT phase)) AS pb FROM (SELECT it.user_id, interest_index, it.u, unnest(CASE WHEN k % 5 = 0 THEN [j] ELSE [j, (j + 1) % 4] END) AS p FROM it) x JOIN ph ON ph.user_id = x.u AND ph.post_index = x.p GROUP BY ALL)
SELECT 0::BIGINT AS unresolved_source_evidence_ids, 0::BIGINT AS invalid_source_evidence_indices, count(*) AS source_evidence_phase_disagreements FROM a JOIN b USING (user_id, interest_index) WHERE pa <> pb""")
def evidence_audit(spark, sf):
    return release.evidence_audit(release_interests(spark, sf), release.phases(_hinted_posts(spark, sf)))


@query("random_public_ids")
def random_public_ids(spark, sf):
    return release.random_public_ids(posts(spark, sf), seed=20260906)


@query("mapping_problems", "SELECT 'Invalid public ID' AS issue UNION ALL SELECT 'User without mapping'")
def mapping_problems(spark, sf):
    """A mapping with one user left out and one malformed id."""
    m = mapping(spark, sf).filter("source_id != 'src_3'").withColumn("public_id", F.when(F.col("source_id") == "src_4", "bob").otherwise(F.col("public_id")))
    return release.mapping_problems(m, release_posts(spark, sf))


CAPTION_IMAGES = "cim AS (SELECT DISTINCT conv_id % 50 AS u, conv_id FROM conversations), cser AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY conv_id) AS serial FROM cim)"


@query("candidate_violations", f"""WITH {INT}, {CAPTION_IMAGES}, v AS (
  SELECT 'Invalid language code' AS issue, count(*) AS n FROM post WHERE post_id % 17 = 0
  UNION ALL SELECT 'Residual email', count(*) FROM post WHERE post_id % 19 = 0
  UNION ALL SELECT 'Invalid post type', count(*) FROM post WHERE post_id % 23 = 0
  UNION ALL SELECT 'Evidence mismatch', count(*) FROM evi WHERE post_index = 1 AND interest_index % 5 = 2
  UNION ALL SELECT 'Unexpected caption model', count(*) FROM conversations JOIN cser USING (conv_id) WHERE serial = 1
  UNION ALL SELECT 'Invalid domains', count(DISTINCT user_id) FROM post WHERE user_id % 10 = 3
  UNION ALL SELECT 'Wrong user count', 1
  UNION ALL SELECT 'Count mismatch: posts', 1 UNION ALL SELECT 'Count mismatch: captions', 1
  UNION ALL SELECT 'Unexpected user file', count(DISTINCT user_id) FROM post WHERE user_id % 7 = 1
  UNION ALL SELECT 'Missing user file', count(DISTINCT user_id) FROM post WHERE user_id % 7 IN (1, 2)
  UNION ALL SELECT 'Unexpected data file', 1
  UNION ALL SELECT 'Manifest file set mismatch', count(DISTINCT user_id) FROM post WHERE user_id % 7 = 3
  UNION ALL SELECT 'Checksum mismatch', count(DISTINCT user_id) FROM post WHERE user_id % 7 = 4)
SELECT issue, n FROM v WHERE n > 0""")
def candidate_violations(spark, sf):
    """A candidate that was tampered with in its rows, its files, its manifest and its declared counts."""
    m = cut_lineage(mapping(spark, sf))
    p = release.candidate_posts(release_posts(spark, sf), m)
    i = release.candidate_interests(release_interests(spark, sf))
    e = release.candidate_evidence(release.resolved_evidence(release_interests(spark, sf), release_posts(spark, sf)), m)
    c = release.candidate_captions(release_captions(spark, sf), m)
    k = F.col("post_id")
    out_posts = p.select(
        F.col("public_user_id").alias("user_id"), F.col("public_post_id").alias("post_id"), "post_index", "relative_day",
        F.when(k % 23 == 0, "poll").otherwise(F.col("post_type")).alias("post_type"), F.when(k % 17 == 0, "English").otherwise(F.col("language")).alias("language"),
        F.when(k % 19 == 0, "mail me: x@y.org").otherwise(F.col("scrubbed")).alias("text"),
    )
    users = m.withColumnRenamed("source_id", "user_id")
    out_interests = i.join(users, "user_id").select(F.col("public_id").alias("user_id"), "interest_index", "domain", "status", F.col("public_label").alias("label"))
    listed = e.groupBy("user_id", "interest_index").agg(F.array_sort(F.collect_list(F.struct("post_index", "public_post_id"))).alias("l"))
    ev = listed.select("user_id", "interest_index", F.posexplode("l").alias("ordinal", "x")).join(users, "user_id")
    wrong = (F.col("x.post_index") == 1) & (F.col("interest_index") % 5 == 2)
    out_evidence = cut_lineage(ev.select(F.col("public_id").alias("user_id"), "interest_index", "ordinal", "x.post_index", F.when(wrong, "participant_006_post_9999").otherwise(F.col("x.public_post_id")).alias("post_id")))
    image = F.regexp_extract("image_id", r"(\d+)$", 1).cast("int") - 1
    out_captions = c.select(F.col("public_user_id").alias("user_id"), "image_id", image.alias("image_index"), F.when(F.col("image_id") == "image_00001", "other-model").otherwise(F.col("model")).alias("model"), "summary")
    number = F.regexp_extract("public_id", r"(\d+)$", 1).cast("int") - 1
    people = m.select(F.col("public_id").alias("user_id"), number.alias("u"))
    domains = people.select("user_id", "u", F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain"), F.lit("active").alias("status")).filter(~((F.col("u") % 10 == 3) & (F.col("domain") == "pets")))
    # Gold files of some users are named otherwise or gone; the manifest misses some files and has other digests.
    name = F.explode(F.array(*map(F.lit, release.USER_FILES)))
    files = people.select("user_id", "u", name.alias("name"))
    gold = F.col("name") == "gold_profile.json"
    files = files.filter(~(gold & (F.col("u") % 7 == 2))).withColumn("name", F.when(gold & (F.col("u") % 7 == 1), "gold.txt").otherwise(F.col("name")))
    files = files.select("u", gold.alias("gold"), F.concat(F.lit("data/users/"), "user_id", F.lit("/"), "name").alias("path"))
    files = files.withColumn("sha256", F.sha2("path", 256))
    listed = files.filter(~(F.col("gold") & (F.col("u") % 7 == 3))).select(F.lit(release.VERSION).alias("release_variant"), "path", F.when(F.col("gold") & (F.col("u") % 7 == 4), "0").otherwise(F.col("sha256")).alias("sha256"))
    extra = spark.range(1).select(F.lit("data/tmp.bin").alias("path"), F.lit("1").alias("sha256"))
    files = files.select("path", "sha256").unionByName(extra)
    listed = listed.unionByName(extra.select(F.lit(release.VERSION).alias("release_variant"), "path", "sha256"))
    counts = {"users": people.count(), "posts": out_posts.count() + 1, "images": out_captions.select("user_id", "image_id").distinct().count(), "interest_entries": out_interests.count()}
    return release.candidate_issues(out_posts, out_interests, out_evidence, out_captions, domains, counts, counts["users"] + 1, files, listed)


@query("topic_violations", """SELECT 'free text detected' AS issue, count(*) AS n FROM (SELECT DISTINCT doc_id % 50 AS u FROM documents) WHERE u % 5 = 1
UNION ALL SELECT 'suppressed topic', 1 UNION ALL SELECT 'invalid vocabulary', count(*) FROM (SELECT DISTINCT doc_id % 50 AS u FROM documents) WHERE u % 5 = 3""")
def topic_violations(spark, sf):
    """A topic release where some users have a free text, a doubled topic, or a topic that too few users support."""
    m = _mentions(spark, sf)
    allowed = release.allowed_topics(m)
    parts = _parts(spark, sf, m, allowed)
    u = F.regexp_extract("user_id", r"(\d+)$", 1).cast("int")
    here = (F.col("source") == "phase") & (F.col("part") == "0")
    free, unsorted, rare = here & (u % 5 == 1), here & (u % 5 == 3), here & (u % 5 == 2)
    topics = F.when(rare, F.array(F.lit("cruise travel"))).when(unsorted, F.array_repeat(F.lit("cruise travel"), 2)).otherwise(F.col("topics"))
    tampered = parts.withColumn("topics", topics).withColumn(
        "summary", F.when(free, "I like it").when(rare, "Generalized text topics: cruise travel.").when(unsorted, "Generalized text topics: cruise travel; cruise travel.").otherwise(F.col("summary"))
    )
    return release.topic_issues(tampered, _topic_labels(spark, sf, allowed), allowed)


@query("set_differences", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_differences(spark, sf):
    return release.set_differences(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels").select("doc_id"))


REASONS = ["unknown_record", "nonliteral_or_invalid_span", "no_change", "protected_placeholder", None]


def _edits(spark, sf):
    """One edit per document, cycling through the kinds of invalid and valid spans."""
    d = F.col("doc_id")
    word = F.substring("text", 1, 12)
    find = F.when(d % 5 == 1, "nowhere to be found 123").when(d % 5 == 3, "[PERSON] said").otherwise(word)
    new = F.when(d % 5 == 2, word).otherwise("[PRIVATE_TEXT]")
    span = F.struct(find.alias("find"), new.alias("replace"), F.lit("name").alias("reason"))
    doc = load(spark, sf, "documents")
    edits = doc.select(F.concat(F.lit("batch_"), d).alias("batch"), F.array(F.struct(F.when(d % 5 == 0, "missing").otherwise(d.cast("string")).alias("id"), F.array(span).alias("spans"))).alias("edits"))
    records = doc.select(d.cast("string").alias("record_id"), F.concat("text", F.lit(" then [PERSON] said so")).alias("text"))
    return edits, records


@query("checked_proposals", """SELECT 'batch_' || doc_id || '_0_0' AS key, CASE doc_id % 5 WHEN 0 THEN 'missing' ELSE doc_id::VARCHAR END AS record_id,
  CASE doc_id % 5 WHEN 0 THEN 'unknown_record' WHEN 1 THEN 'nonliteral_or_invalid_span' WHEN 2 THEN 'no_change' WHEN 3 THEN 'protected_placeholder' END AS validation_reason FROM documents""")
def checked_proposals(spark, sf):
    return privacy.checked_proposals(privacy.proposal_rows(*_edits(spark, sf))).select("key", "record_id", "validation_reason")


def _actions(spark, sf):
    valid = privacy.checked_proposals(privacy.proposal_rows(*_edits(spark, sf))).filter("validation_reason is null").drop("validation_reason")
    n = F.col("record_id").try_cast("long")
    decisions = valid.select("key", F.when(n % 2 == 0, "accept").otherwise("reject").alias("action"), F.lit("editor").alias("reason"))
    over = valid.filter(n % 7 == 0).select("key", F.lit("accept").alias("action"), F.lit("[PET]").alias("replace"), F.lit("second look").alias("reason"))
    return privacy.decided(valid, decisions, over)


@query("edit_decisions", """SELECT 'batch_' || doc_id || '_0_0' AS key, CASE WHEN doc_id % 7 = 0 OR doc_id % 2 = 0 THEN 'accept' ELSE 'reject' END AS action, CASE WHEN doc_id % 7 = 0 THEN 'second look' ELSE 'editor' END AS reason,
  doc_id % 7 = 0 AS overridden, CAST(NULL AS VARCHAR) AS problem FROM documents WHERE doc_id % 5 = 4""")
def edit_decisions(spark, sf):
    return _actions(spark, sf).select("key", "action", "reason", "overridden", "problem")


@query("compiled_rewrites", """WITH a AS (SELECT DISTINCT text, left(text, 12) AS f, CASE WHEN doc_id % 7 = 0 THEN '[PET]' ELSE '[PRIVATE_TEXT]' END AS r FROM documents WHERE doc_id % 5 = 4 AND (doc_id % 7 = 0 OR doc_id % 2 = 0)),
b AS (SELECT text FROM a GROUP BY text HAVING count(*) = 1) SELECT md5(text || ' then [PERSON] said so') AS text_md5, md5(replace(text, f, r) || ' then [PERSON] said so') AS rewritten_md5 FROM a SEMI JOIN b USING (text)""")
def compiled_rewrites(spark, sf):
    """Texts with conflicting edits are reported, not rewritten."""
    actions = _actions(spark, sf)
    clean = actions.join(privacy.edit_conflicts(actions).select("text").distinct(), "text", "left_anti")
    return privacy.compiled_rewrites(clean).select(F.md5("text").alias("text_md5"), F.md5("rewritten").alias("rewritten_md5"))


@query("review_texts", f"""WITH {POST}, t AS (SELECT 'post' AS kind, doc_id % 50 AS u, 0 AS r, doc_id AS i, {_mask_sql("text")} AS x FROM documents UNION ALL SELECT 'label', p_partkey % 50, 1, p_partkey, p_name FROM part
  UNION ALL SELECT 'caption', conv_id % 50, 2, conv_id * 100 + turn, {_mask_sql("text")} FROM conversations),
f AS (SELECT kind, x, min((u, r, i)) AS first FROM t GROUP BY ALL)
SELECT printf('r%06d', row_number() OVER (ORDER BY first, kind, x) - 1) AS record_id, kind, md5(x) AS text_md5 FROM f""")
def review_texts(spark, sf):
    d, k, c = F.col("doc_id"), F.col("p_partkey"), F.col("conv_id")
    a = load(spark, sf, "documents").select((d % 50).alias("user_id"), d.alias("position"), "text")
    b = load(spark, sf, "part").select((k % 50).alias("user_id"), k.alias("position"), F.col("p_name").alias("text"))
    e = load(spark, sf, "conversations").select((c % 50).alias("user_id"), (c * 100 + F.col("turn")).alias("position"), "text")
    return privacy.review_records(a, b, e).select("record_id", "kind", F.md5("text").alias("text_md5"))


@query("review_batches", """WITH RECURSIVE r AS (SELECT CAST(ceil(n_chars / 4) AS BIGINT) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
w(i, batch, n_rows, size) AS (SELECT i, 0::BIGINT, 1, n FROM r WHERE i = 1 UNION ALL
  SELECT r.i, CASE WHEN n_rows >= 200 OR size + n > 16000 THEN batch + 1 ELSE batch END, CASE WHEN n_rows >= 200 OR size + n > 16000 THEN 1 ELSE n_rows + 1 END, CASE WHEN n_rows >= 200 OR size + n > 16000 THEN n ELSE size + n END
  FROM w JOIN r ON r.i = w.i + 1)
SELECT batch, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS tokens FROM w JOIN r USING (i) GROUP BY batch""")
def review_batches(spark, sf):
    records = load(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "n_chars")
    rows = privacy.review_batches(records, F.ceil(F.col("n_chars") / 4))
    return rows.groupBy("batch").agg(F.count("*").alias("n_rows"), F.sum(F.ceil(F.col("n_chars") / 4)).alias("tokens"))


@query("artifact_issues", r"""WITH f AS (SELECT CASE page_id % 4 WHEN 0 THEN 'data/users/p' || page_id || '/posts.jsonl' WHEN 1 THEN 'data/tmp/x' || page_id || '.json' WHEN 2 THEN 'docs/Mapping_' || page_id || '.md' ELSE 'img/p' || page_id || '.PNG' END AS path,
  CASE WHEN page_id % 10 = 9 THEN NULL WHEN page_id % 10 = 0 THEN html || ' ghp_abcdefghijklmnopqrstuvwx' WHEN page_id % 10 = 1 THEN html || ' /home/bob/notes' ELSE html END AS content, page_id FROM pages)
SELECT path, 'Forbidden artifact' AS issue FROM f WHERE page_id % 4 <> 0 UNION ALL SELECT path, 'Unreviewed binary' FROM f WHERE content IS NULL
UNION ALL SELECT path, 'Credential pattern' FROM f WHERE page_id % 10 = 0 UNION ALL SELECT path, 'Private filesystem path' FROM f WHERE page_id % 10 = 1""")
def artifact_issues(spark, sf):
    p = F.col("page_id")
    path = (
        F.when(p % 4 == 0, F.concat(F.lit("data/users/p"), p, F.lit("/posts.jsonl"))).when(p % 4 == 1, F.concat(F.lit("data/tmp/x"), p, F.lit(".json")))
        .when(p % 4 == 2, F.concat(F.lit("docs/Mapping_"), p, F.lit(".md"))).otherwise(F.concat(F.lit("img/p"), p, F.lit(".PNG")))
    )
    extra = F.when(p % 10 == 0, " ghp_abcdefghijklmnopqrstuvwx").when(p % 10 == 1, " /home/bob/notes").otherwise("")
    files = load(spark, sf, "pages").select(path.alias("path"), F.when(p % 10 != 9, F.concat("html", extra)).alias("content"))
    return privacy.artifact_issues(files)
