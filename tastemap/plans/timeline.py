"""Observation windows, domain and interest scores, chunks, phases, representatives."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import month_range, tag_form
from ..operators import release, scoring, timeline
from ..operators.ranking import index_buckets, with_position
from .adapters import ORDER_REC, REC, order_records, posts, records
from .registry import query

FLAGS = """fl AS (
  SELECT r.*, s.window_days, s.observed_end,
    confidence >= 0.60 AS support, confidence >= 0.45 AND confidence < 0.60 AS weak,
    confidence >= 0.60 AND created_at >= observed_end - INTERVAL 90 DAY AS in90,
    confidence >= 0.60 AND created_at >= observed_end - INTERVAL 30 DAY AS in30,
    CASE WHEN confidence >= 0.60 THEN CASE WHEN window_days >= 180 THEN strftime(created_at, '%Y-%m') ELSE strftime(created_at, '%G-W%V') END END AS bin
  FROM rec r JOIN span s USING (user_id)
)"""
REQUIRED = "CASE WHEN window_days < 90 THEN 2 WHEN window_days < 365 THEN 3 ELSE 4 END"

DOMAIN_AGG = f"""agg AS (
  SELECT user_id, domain, window_days, count(*) FILTER (support) AS n_support, count(*) FILTER (weak) AS n_weak,
    coalesce(sum(dup_weight) FILTER (support), 0) AS eff, coalesce(avg(confidence) FILTER (support), 0) AS mean_conf,
    count(DISTINCT bin) AS bins, coalesce(sum(dup_weight) FILTER (in90), 0) AS r90,
    coalesce(sum(dup_weight) FILTER (in30), 0) AS r30, coalesce(avg(confidence) FILTER (in90), 0) AS r90_mean
  FROM fl GROUP BY user_id, domain, window_days
), sc AS (
  SELECT *, round(0.45::DOUBLE * least(1.0::DOUBLE, eff / 8) + 0.35::DOUBLE * least(1.0::DOUBLE, bins / ({REQUIRED})) + 0.20::DOUBLE * mean_conf + 1e-10, 6) AS stable_score,
    round(0.50::DOUBLE * least(1.0::DOUBLE, r90 / 5) + 0.20::DOUBLE * least(1.0::DOUBLE, r30 / 3) + 0.30::DOUBLE * r90_mean + 1e-10, 6) AS recent_score
  FROM agg
), dom AS (
  SELECT user_id, domain, n_support, n_weak, round(eff + 1e-10, 6) AS effective_support_posts, round(mean_conf + 1e-10, 6) AS mean_confidence,
    bins AS distinct_time_bins, round(r90 + 1e-10, 6) AS recent_90_support, round(r30 + 1e-10, 6) AS recent_30_support,
    round(r90_mean + 1e-10, 6) AS recent_90_mean_confidence, stable_score, recent_score,
    CASE WHEN stable_score >= 0.65 AND recent_score >= 0.65 THEN 'stable_with_recent_surge' WHEN stable_score >= 0.65 THEN 'stable'
         WHEN recent_score >= 0.65 THEN 'recent' WHEN n_support + n_weak > 0 THEN 'weak_signal' ELSE 'absent' END AS status
  FROM sc
)"""

INTEREST_AGG = f"""iagg AS (
  SELECT user_id, domain, interest, window_days, count(DISTINCT post_id) FILTER (support) AS n_support,
    count(DISTINCT post_id) FILTER (in90) AS n_recent, count(DISTINCT bin) AS bins,
    coalesce(sum(dup_weight) FILTER (support), 0) AS eff, coalesce(avg(confidence) FILTER (support), 0) AS mean_conf,
    coalesce(sum(dup_weight) FILTER (in90), 0) AS r90, coalesce(avg(confidence) FILTER (in90), 0) AS r90_mean
  FROM fl GROUP BY user_id, domain, interest, window_days
), isc AS (
  SELECT *, round(0.65::DOUBLE * least(1.0::DOUBLE, r90 / 2) + 0.35::DOUBLE * r90_mean + 1e-10, 6) AS recent_score,
    round(0.60::DOUBLE * least(1.0::DOUBLE, eff / 3) + 0.20::DOUBLE * least(1.0::DOUBLE, bins / greatest(2, ({REQUIRED}) - 1)) + 0.20::DOUBLE * mean_conf + 1e-10, 6) AS stable_score
  FROM iagg
), interest_row AS (
  SELECT user_id, domain, interest, n_support, round(eff + 1e-10, 6) AS effective_support_posts, round(mean_conf + 1e-10, 6) AS mean_confidence,
    bins AS distinct_time_bins, round(r90 + 1e-10, 6) AS recent_90_support, recent_score, stable_score,
    CASE WHEN stable_score >= 0.62 AND n_support >= 3 AND bins >= 2 THEN 'stable'
         WHEN recent_score >= 0.60 AND n_recent >= 2 THEN 'recent' ELSE 'weak_signal' END AS status
  FROM isc
)"""


@query("observation_windows", f"""WITH {REC}
SELECT user_id, posts AS post_count_total, epoch_us(observed_start) AS observed_start, epoch_us(observed_end) AS observed_end, window_days FROM span""")
def observation_windows(spark, sf):
    w = scoring.observation_window(records(spark, sf))
    return w.select(
        "user_id", "post_count_total", F.unix_micros("observed_start").alias("observed_start"),
        F.unix_micros("observed_end").alias("observed_end"), "window_days",
    )


@query("domain_stats", f"WITH {REC}, {FLAGS}, {DOMAIN_AGG} SELECT * FROM dom")
def domain_stats(spark, sf):
    rec = records(spark, sf)
    return scoring.domain_stats(rec, scoring.observation_window(rec))


@query("domain_stats_monthly", f"WITH {ORDER_REC}, {FLAGS}, {DOMAIN_AGG} SELECT * FROM dom")
def domain_stats_monthly(spark, sf):
    rec = order_records(spark, sf)
    return scoring.domain_stats(rec, scoring.observation_window(rec))


@query("domain_evidence", f"""WITH {REC}
SELECT DISTINCT user_id, domain, post_id, CASE WHEN confidence >= 0.60 THEN 'support' ELSE 'weak' END AS evidence FROM rec WHERE confidence >= 0.45""")
def domain_evidence(spark, sf):
    return scoring.domain_evidence(records(spark, sf))


@query("required_time_bins", f"WITH {ORDER_REC} SELECT user_id, window_days, {REQUIRED} AS required_bins FROM span")
def required_time_bins(spark, sf):
    w = scoring.observation_window(order_records(spark, sf))
    return w.select("user_id", "window_days", scoring.required_bins(F.col("window_days")).alias("required_bins"))


@query("distinct_time_bins", f"""WITH {REC}, {FLAGS} SELECT user_id, domain, bin AS time_bin, count(*) AS n_posts FROM fl WHERE bin IS NOT NULL GROUP BY user_id, domain, bin""")
def distinct_time_bins(spark, sf):
    rec = records(spark, sf)
    w = scoring.observation_window(rec).select("user_id", "window_days")
    binned = rec.filter(F.col("confidence") >= scoring.SUPPORT).join(w, "user_id")
    binned = binned.withColumn("time_bin", scoring.time_bin(F.col("created_at"), F.col("window_days")))
    return binned.groupBy("user_id", "domain", "time_bin").agg(F.count("*").alias("n_posts"))


@query("interest_stats", f"""WITH {REC.replace("AS tag,", "AS interest,")}, {FLAGS}, {INTEREST_AGG}
SELECT * FROM interest_row""")
def interest_stats(spark, sf):
    rec = records(spark, sf)
    tagged = rec.withColumn("interest", tag_form(F.col("raw_tag")))
    return scoring.interest_stats(tagged, scoring.observation_window(rec))


@query("duplicate_weights", f"""WITH {REC}, c AS (SELECT user_id, post_id, concat('dup_', k) AS cluster_id FROM rec)
SELECT user_id, cluster_id, post_id, count(*) OVER (PARTITION BY user_id, cluster_id) AS duplicate_cluster_size,
  1.0::DOUBLE / count(*) OVER (PARTITION BY user_id, cluster_id) AS dup_weight FROM c""")
def duplicate_weights(spark, sf):
    clusters = records(spark, sf).select("user_id", F.concat(F.lit("dup_"), "k").alias("cluster_id"), "post_id")
    return scoring.duplicate_weights(clusters)


def tagged_records(spark, sf):
    """Records with their normalised tag as the only canonical tag (untagged where k < 7)."""
    tag = F.when(F.col("k") >= 7, tag_form(F.col("raw_tag")))
    rec = records(spark, sf).withColumn("first_tag", tag)
    return rec.withColumn("canonical_tags", F.when(tag.isNull(), F.array().cast("array<string>")).otherwise(F.array(tag)))


TAGGED = "tr AS (SELECT *, CASE WHEN k >= 7 THEN tag END AS first_tag, coalesce(CASE WHEN k >= 7 THEN tag END, '__untagged__') AS gtag, -(confidence * post_signal_strength) AS s FROM rec)"

REPRESENTATIVES = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, domain, gtag ORDER BY s, created_at, post_id) AS in_tag FROM tr
), cover AS (SELECT *, 0 AS phase, gtag AS ptag, 0::BIGINT AS nth FROM ranked WHERE in_tag = 1
), ntags AS (SELECT user_id, domain, count(*) AS tags FROM cover GROUP BY ALL
), fill AS (
  SELECT f.* FROM (SELECT *, 1 AS phase, '' AS ptag, row_number() OVER (PARTITION BY user_id, domain ORDER BY s, created_at, post_id) AS nth FROM ranked WHERE in_tag > 1) f
  JOIN ntags USING (user_id, domain) WHERE nth <= greatest({limit} - tags, 1)
), picks AS (SELECT * FROM cover UNION ALL SELECT * FROM fill
), timed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY created_at, phase, ptag, nth) - 1 AS t, count(*) OVER (PARTITION BY user_id, domain) AS p FROM picks
), sect AS (
  SELECT *, CASE WHEN p <= {limit} OR t < {third} THEN 0 WHEN t >= greatest(0, p // 2 - {sixth}) AND t < greatest(0, p // 2 - {sixth}) + {third} THEN 1 WHEN t >= p - {tail} THEN 2 END AS section FROM timed
), rep AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY section, CASE WHEN p <= {limit} THEN phase END, CASE WHEN p <= {limit} THEN ptag END, CASE WHEN p <= {limit} THEN nth END, t) AS pick_order
  FROM sect WHERE section IS NOT NULL QUALIFY pick_order <= {limit}
)"""


def _representatives_sql(limit):
    parts = dict(limit=limit, third=max(1, limit // 3), sixth=max(1, limit // 6), tail=max(1, limit - 2 * max(1, limit // 3)))
    return f"WITH {REC}, {TAGGED}, {REPRESENTATIVES.format(**parts)} SELECT user_id, domain, post_id, CAST(pick_order AS INTEGER) AS pick_order, first_tag FROM rep"


def _representatives(spark, sf, limit):
    reps = timeline.representative_posts(tagged_records(spark, sf), limit)
    return reps.select("user_id", "domain", "post_id", "pick_order", F.nullif("first_tag", F.lit(timeline.UNTAGGED)).alias("first_tag"))


@query("representative_posts", _representatives_sql(15))
def representative_posts(spark, sf):
    return _representatives(spark, sf, 15)


@query("representative_posts_thinned", _representatives_sql(4))
def representative_posts_thinned(spark, sf):
    """A low limit, so that the thinning to early, middle and late picks takes place."""
    return _representatives(spark, sf, 4)


CHUNKS = """ch AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id, domain ORDER BY created_at, post_id) - 1) // 30 AS chunk_index FROM tr
)"""


@query("chronological_chunks", f"""WITH {REC}, {TAGGED}, {CHUNKS}, ends AS (
  SELECT user_id, domain, chunk_index, arg_min(post_id, (created_at, post_id)) AS start_post_id, arg_max(post_id, (created_at, post_id)) AS end_post_id, count(*) AS n_posts FROM ch GROUP BY ALL
), cnt AS (SELECT user_id, domain, chunk_index, first_tag, count(*) AS n FROM ch WHERE first_tag IS NOT NULL GROUP BY ALL
), top5 AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain, chunk_index ORDER BY n DESC, first_tag) AS r FROM cnt QUALIFY r <= 5
), tags AS (SELECT user_id, domain, chunk_index, string_agg(first_tag, ', ' ORDER BY r) AS top_tags, string_agg(first_tag, ', ' ORDER BY r) FILTER (r <= 3) AS top3 FROM top5 GROUP BY ALL)
SELECT user_id, domain, chunk_index, start_post_id, end_post_id, n_posts, coalesce(top_tags, '') AS top_tags,
  'Chunk contains ' || n_posts || ' posts' || CASE WHEN top3 IS NULL THEN ' with limited recurring tags.' ELSE ', with top recurring tags: ' || top3 || '.' END AS summary
FROM ends LEFT JOIN tags USING (user_id, domain, chunk_index)""")
def chronological_chunks(spark, sf):
    rows = timeline.chunk_rows(timeline.chunked(tagged_records(spark, sf)))
    return rows.select(
        "user_id", "domain", "chunk_index", "start_post_id", "end_post_id", "n_posts",
        F.array_join("top_tags", ", ").alias("top_tags"),
        timeline.chunk_text(F.col("top_tags"), F.col("n_posts")).alias("summary"),
    )


BUCKET = "CASE modality_code WHEN 0 THEN 'text_only' WHEN 1 THEN 'visual_only' WHEN 2 THEN 'mixed' ELSE 'unknown' END"


@query("source_summary_modalities", f"""WITH {REC}, m AS (
  SELECT user_id, domain, post_id, CASE WHEN modality_code = 1 THEN 'visual' ELSE 'text' END AS modality, CASE WHEN modality_code = 2 THEN 1 ELSE 0 END AS i FROM rec WHERE modality_code < 3
  UNION ALL SELECT user_id, domain, post_id, 'visual', 0 FROM rec WHERE modality_code = 2
), f AS (SELECT user_id, domain, modality, min((post_id, i)) AS first_at FROM m GROUP BY ALL)
SELECT user_id, domain, string_agg(modality, ',' ORDER BY first_at) AS modalities FROM f GROUP BY user_id, domain""")
def source_summary_modalities(spark, sf):
    rows = timeline.modality_order(records(spark, sf), ["user_id", "domain"], "post_id")
    return rows.withColumn("modalities", F.array_join("modalities", ","))


@query("source_summary_posts", f"WITH {REC} SELECT user_id, domain, {BUCKET} AS bucket, post_id, min(post_id) AS first_position FROM rec GROUP BY ALL")
def source_summary_posts(spark, sf):
    rows = records(spark, sf).withColumn("position", F.col("post_id"))
    return timeline.modality_posts(rows, ["user_id", "domain"], "position")


@query("post_signal_sources", f"""WITH {REC}, first_row AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain, k ORDER BY post_id) AS r FROM rec QUALIFY r = 1)
SELECT user_id, domain, k AS post_id, {BUCKET} AS evidence_modality, round(confidence + 1e-10, 6) AS confidence FROM first_row""")
def post_signal_sources(spark, sf):
    """Several records share a post here (its number k), so that the first one matters."""
    rec = records(spark, sf).withColumn("position", F.col("post_id")).withColumn("post_id", F.col("k"))
    rows = timeline.post_signal_sources(rec, "position")
    return rows.select("user_id", "domain", "post_id", "evidence_modality", F.round(F.col("confidence") + 1e-10, 6).alias("confidence"))


@query("time_phases", f"""WITH {REC} SELECT user_id, post_id,
  CAST(least(3, ((row_number() OVER (PARTITION BY user_id ORDER BY created_at, post_id) - 1) * 4) // count(*) OVER (PARTITION BY user_id)) AS INTEGER) AS phase FROM rec""")
def time_phases(spark, sf):
    return timeline.phases(records(spark, sf), tie="post_id").select("user_id", "post_id", "phase")


@query("relative_days", f"""WITH {REC} SELECT user_id, post_id,
  CAST(date_diff('day', CAST(min(created_at) OVER (PARTITION BY user_id) AS DATE), CAST(created_at AS DATE)) AS INTEGER) AS relative_day FROM rec""")
def relative_days(spark, sf):
    return timeline.relative_days(records(spark, sf)).select("user_id", "post_id", "relative_day")


@query("public_post_ids", """SELECT doc_id AS post_id, printf('participant_%03d_post_%04d', doc_id % 50, doc_id // 50 + 1) AS public_post_id FROM documents""")
def public_post_ids(spark, sf):
    return posts(spark, sf).select("post_id", release.public_post_id(F.format_string("participant_%03d", F.col("user_id").cast("int")), F.col("post_index")).alias("public_post_id"))


RECENT = """tl AS (SELECT user_id, post_id AS post_index, CASE WHEN post_type = 'error' THEN '' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM rec
), last_rows AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, post_index DESC) AS r FROM tl QUALIFY r <= 50
), win AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, post_index) - 1 AS row_index FROM last_rows)"""


def _recent(spark, sf):
    stamp = F.when(F.col("post_type") == "error", "").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = records(spark, sf).select("user_id", F.col("post_id").alias("post_index"), stamp.alias("timestamp"))
    return timeline.recent_window(rows, 50)


@query("recent_window", f"WITH {REC}, {RECENT} SELECT user_id, post_index, ts AS timestamp, CAST(row_index AS INTEGER) AS row_index FROM win")
def recent_window(spark, sf):
    return _recent(spark, sf)


@query("request_chunks", f"""WITH {REC}, {RECENT} SELECT user_id, printf('%d_chunk_%03d', user_id, row_index // 20 + 1) AS chunk_id, count(*) AS n_posts,
  coalesce(arg_min(ts, row_index) FILTER (ts <> ''), '') AS span_start, coalesce(arg_max(ts, row_index) FILTER (ts <> ''), '') AS span_end
FROM win GROUP BY user_id, row_index // 20""")
def request_chunks(spark, sf):
    return timeline.request_chunks(_recent(spark, sf))


@query("growing_user_batches", f"""WITH {REC}, u AS (SELECT user_id, count(*) AS n_posts FROM rec GROUP BY 1), p AS (
  SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM u)
SELECT user_id, CAST(least((i // 10 + 1) * 10, n) AS BIGINT) AS batch_end FROM p""")
def growing_user_batches(spark, sf):
    users = records(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_posts"))
    placed = with_position(users, [], ["user_id"], index_buckets("user_id"), "user_position", "n_users")
    return timeline.growing_prefixes(placed, 10).select("user_id", "batch_end")


@query("recency_labels", f"""WITH {REC}, d AS (SELECT *, floor((epoch_us(observed_end) - epoch_us(created_at)) / 86400000000) AS days FROM rec JOIN span USING (user_id))
SELECT user_id, post_id, CASE WHEN days <= 30 THEN 'last_30_days' WHEN days <= 90 THEN 'last_90_days' ELSE 'older' END AS relative_recency,
  CASE WHEN confidence >= 0.8 AND days <= 90 THEN 'high_confidence_recent_post' WHEN days > 90 THEN 'older_supporting_post' WHEN confidence >= 0.8 THEN 'high_confidence_supporting_post' ELSE 'representative_supporting_post' END AS why_selected
FROM d""")
def recency_labels(spark, sf):
    rec = records(spark, sf)
    return _recency(rec)


@query("recency_labels_long_window", f"""WITH {ORDER_REC}, d AS (SELECT *, floor((epoch_us(observed_end) - epoch_us(created_at)) / 86400000000) AS days FROM rec JOIN span USING (user_id))
SELECT user_id, post_id, CASE WHEN days <= 30 THEN 'last_30_days' WHEN days <= 90 THEN 'last_90_days' ELSE 'older' END AS relative_recency,
  CASE WHEN confidence >= 0.8 AND days <= 90 THEN 'high_confidence_recent_post' WHEN days > 90 THEN 'older_supporting_post' WHEN confidence >= 0.8 THEN 'high_confidence_supporting_post' ELSE 'representative_supporting_post' END AS why_selected
FROM d""")
def recency_labels_long_window(spark, sf):
    return _recency(order_records(spark, sf))


def _recency(rec):
    joined = rec.join(scoring.observation_window(rec).select("user_id", "observed_end"), "user_id")
    at, end = F.col("created_at"), F.col("observed_end")
    return joined.select(
        "user_id", "post_id", timeline.recency_label(at, end).alias("relative_recency"),
        timeline.why_selected(F.col("confidence"), at, end).alias("why_selected"),
    )


@query("tag_first_last_seen", f"""WITH {REC} SELECT user_id, domain, tag, strftime(min(created_at), '%Y-%m') AS first_seen, strftime(max(created_at), '%Y-%m') AS last_seen,
  strftime(min(created_at), '%Y-%m') || ' to ' || strftime(max(created_at), '%Y-%m') AS month_range FROM rec GROUP BY ALL""")
def tag_first_last_seen(spark, sf):
    seen = records(spark, sf).groupBy("user_id", "domain", "raw_tag").agg(F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    seen = seen.groupBy("user_id", "domain", tag_form(F.col("raw_tag")).alias("tag")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return seen.select(
        "user_id", "domain", "tag", F.date_format("a", "yyyy-MM").alias("first_seen"), F.date_format("b", "yyyy-MM").alias("last_seen"),
        month_range(F.col("a"), F.col("b")).alias("month_range"),
    )
