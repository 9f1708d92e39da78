"""Content gate, extraction rules and record explosion over documents and events."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import gate
from .adapters import CUES, POST, REC, RAW_TAGS, TAG_FORMS, events, posts, sql_list
from .registry import query


def _like(column, words):
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


CUE_SQL = ",\n    ".join(
    f"CASE WHEN {_like('cue', ks)} OR list_has_any(tags, {sql_list(hs)}) THEN '{d}' END" for d, (ks, hs) in CUES.items()
)
GATED = rf"""{POST}, g0 AS (
  SELECT *, n_images > 0 AS has_image,
    array_to_string(list_filter([text, CASE WHEN n_images = 2 THEN NULL WHEN n_images = 1 THEN alt_text END, CASE WHEN n_images = 2 THEN alt_text END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS cue_raw,
    list_transform(hashtags, lambda h: regexp_replace(lower(h), '^#+', '')) AS tags,
    len(regexp_extract_all(regexp_replace(trim(text), 'https?://\S+', ' ', 'gi'), '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_#@'']*[\p{{L}}\p{{N}}_])?'))
      + len(list_filter(hashtags, lambda h: trim(h) <> '')) + n_videos AS units
  FROM post
), g1 AS (
  SELECT *, lower(cue_raw) AS cue,
    has_image AND regexp_matches(cue_raw, '(?i)\b(meme|reaction image|shitpost|template|starter pack|me irl|when you|nobody:|bro visited|caption this)\b') AS is_meme
  FROM g0
), g2 AS (
  SELECT *, list_filter([{CUE_SQL}], lambda d: d IS NOT NULL) AS domains FROM g1
), g3 AS (
  SELECT *, CASE WHEN has_image AND NOT is_meme THEN NULL WHEN has_image AND units < 3 THEN 'meme_image_only' WHEN units < 3 THEN 'too_little_content' END AS noise_reason,
    list_filter([CASE WHEN has_image THEN 'has_image' END, CASE WHEN is_meme THEN 'meme_image' END, CASE WHEN len(domains) > 0 THEN 'domain_cues' END, CASE WHEN units >= 3 THEN 'enough_textual_content' END], lambda r: r IS NOT NULL) AS listed
  FROM g2
), gated AS (
  SELECT *, noise_reason IS NOT NULL AS is_noise, CASE WHEN len(listed) > 0 THEN listed ELSE [noise_reason] END AS reasons FROM g3
)"""


@query("content_units", f"WITH {GATED} SELECT post_id, CAST(units AS INTEGER) AS content_units FROM gated")
def content_units(spark, sf):
    p = posts(spark, sf)
    return p.select("post_id", gate.content_units(F.col("text"), F.col("hashtags"), F.col("media")).alias("content_units"))


@query("meme_images", f"WITH {GATED} SELECT post_id, has_image, is_meme AS is_meme_image FROM gated")
def meme_images(spark, sf):
    p = posts(spark, sf)
    return p.select("post_id", gate.has_image(F.col("media")).alias("has_image"), gate.is_meme_image(F.col("text"), F.col("media")).alias("is_meme_image"))


@query("candidate_domains", f"WITH {GATED} SELECT post_id, array_to_string(domains, ',') AS candidate_domains FROM gated")
def candidate_domains(spark, sf):
    p = posts(spark, sf)
    domains = gate.candidate_domains(F.col("text"), F.col("hashtags"), F.col("media"), CUES)
    return p.select("post_id", F.array_join(domains, ",").alias("candidate_domains"))


@query("gate_verdicts", f"""WITH {GATED} SELECT post_id, is_noise, NOT is_noise AS should_send_to_ai, noise_reason, has_image, is_meme AS is_meme_image,
  CAST(units AS INTEGER) AS content_units, array_to_string(reasons, ',') AS gate_reason, array_to_string(domains, ',') AS candidate_domains FROM gated""")
def gate_verdicts(spark, sf):
    g = gate.gate(posts(spark, sf), CUES)
    return g.select(
        "post_id", "is_noise", "should_send_to_ai", "noise_reason", "has_image", "is_meme_image", "content_units",
        F.array_join("gate_reason", ",").alias("gate_reason"), F.array_join("candidate_domains", ",").alias("candidate_domains"),
    )


@query("early_out_profiles", f"""WITH {GATED} SELECT post_id,
  CASE WHEN is_noise THEN 'Skipped by narrow gate.' WHEN NOT (source_url IS NOT NULL AND has_image) THEN 'Visual-only ablation: no usable image evidence was available for this post.' END AS uncertainty_note,
  NOT is_noise AND source_url IS NOT NULL AND has_image AS needs_extraction FROM gated""")
def early_out_profiles(spark, sf):
    usable = F.exists("media", lambda m: (m["media_type"] == "image") & m["source_url"].isNotNull())
    return gate.early_out(gate.gate(posts(spark, sf), CUES), usable, visual_only=True).select("post_id", "uncertainty_note", "needs_extraction")


@query("guarded_profiles", f"""WITH {GATED}, x AS (SELECT *, CAST(n_chars % 7 - 1 AS DOUBLE) / 4 AS strength, post_id % 4 = 0 AS noise, CASE WHEN post_id % 4 = 0 THEN 'too_little_content' END AS reason, has_image AND NOT is_meme AS plain FROM gated)
SELECT post_id, CASE WHEN plain THEN false ELSE noise END AS is_noise, CASE WHEN plain AND reason = 'too_little_content' THEN NULL ELSE reason END AS noise_reason,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN plain AND strength <= 0 THEN 0.15::DOUBLE ELSE strength END) * (CASE WHEN post_type = 'original' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END))) + 1e-10, 6) AS post_signal_strength FROM x""")
def guarded_profiles(spark, sf):
    g = gate.gate(posts(spark, sf), CUES)
    noise = F.col("post_id") % 4 == 0
    flag, reason, strength = gate.guarded_profile(
        ((F.col("n_chars") % 7 - 1) / 4).cast("double"), noise, F.when(noise, "too_little_content"), F.col("post_type"), F.col("has_image"), F.col("is_meme_image")
    )
    return g.select("post_id", flag.alias("is_noise"), reason.alias("noise_reason"), round6(strength).alias("post_signal_strength"))


@query("fallback_profiles", f"""WITH {GATED}, r AS (SELECT doc_id, quality, toxic FROM labels)
SELECT post_id, CASE WHEN quality IS NULL OR toxic = 1 THEN is_noise ELSE quality = 0 END AS profile_is_noise,
  CASE WHEN quality IS NULL OR toxic = 1 THEN false ELSE quality = 1 END AS should_use_for_profile,
  CASE WHEN quality IS NULL OR toxic = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS post_signal_strength,
  CASE WHEN is_noise AND (quality IS NULL OR toxic = 1) THEN 'Skipped by narrow gate.' WHEN toxic = 1 THEN 'single_post_analysis_failed: blocked' WHEN quality IS NULL THEN 'single_post_analysis_failed: missing response' END AS uncertainty_note
FROM gated LEFT JOIN r ON doc_id = post_id""")
def fallback_profiles(spark, sf):
    """Labels play the extraction responses: toxic ones are errors, unlabelled posts are missing."""
    from ..session import load

    good = F.struct(
        (F.col("quality") == 0).alias("is_noise"), (F.col("quality") == 1).alias("should_use_for_profile"), F.lit(0.5).alias("post_signal_strength")
    )
    responses = load(spark, sf, "labels").select(
        (F.col("doc_id") % 50).alias("user_id"), F.col("doc_id").alias("post_id"),
        F.when(F.col("toxic") == 0, good).alias("profile"), F.when(F.col("toxic") == 1, "blocked").alias("error"),
    )
    rows = gate.with_fallback(gate.gate(posts(spark, sf), CUES), responses)
    return rows.select("post_id", "profile_is_noise", "should_use_for_profile", "post_signal_strength", "uncertainty_note")


@query("visual_redaction", f"""WITH {GATED} SELECT post_id, '' AS text, 0 AS n_hashtags, CAST(n_images + n_videos AS INTEGER) AS n_media, 0 AS n_alt_texts,
  array_to_string(list_filter(reasons, lambda r: r IN ('has_image', 'meme_image')), ',') AS gate_reason, 0 AS content_units, 0 AS n_domains FROM gated""")
def visual_redaction(spark, sf):
    g = gate.redact_gate(gate.redact_for_visual(gate.gate(posts(spark, sf), CUES)))
    return g.select(
        "post_id", "text", F.size("hashtags").alias("n_hashtags"), F.size("media").alias("n_media"),
        F.size(F.filter("media", lambda m: m["alt_text"].isNotNull() | m["source_url"].isNotNull() | m["storage_uri"].isNotNull())).alias("n_alt_texts"),
        F.array_join("gate_reason", ",").alias("gate_reason"), "content_units", F.size("candidate_domains").alias("n_domains"),
    )


SOURCES = ["OCR", "photo of a cat", "Caption", "user bio", "media-text", " ", "hashtags", "Screenshot"]
SOURCE_MODALITY = ["visual", "visual", "text", "text", "visual", "text", "text", "visual"]


@query("evidence_modalities", f"""WITH {REC}, s AS (SELECT post_id, k, list_extract({sql_list(SOURCE_MODALITY)}, 1 + k % 8) AS a, list_extract({sql_list(SOURCE_MODALITY)}, 1 + (k // 8) % 8) AS b FROM ev),
c AS (SELECT *, CAST((a = 'text')::INT + (b = 'text')::INT AS INTEGER) AS n_text, CAST((a = 'visual')::INT + (b = 'visual')::INT AS INTEGER) AS n_visual FROM s)
SELECT post_id, a AS first_modality,
  CASE WHEN k % 5 = 0 THEN 'visual' WHEN n_text > 0 AND n_visual > 0 THEN 'text,visual' WHEN n_text > 0 THEN 'text' ELSE 'visual' END AS modalities,
  CASE WHEN k % 5 = 1 THEN 0 ELSE n_text END AS n_text, CASE WHEN k % 5 = 1 THEN 3 ELSE n_visual END AS n_visual FROM c""")
def evidence_modalities(spark, sf):
    """Evidence sources named after the events' numbers; every fifth row brings its own metadata."""
    from .adapters import pick

    k = F.col("k")
    e = events(spark, sf).withColumn(
        "evidence", F.array(F.struct(pick(SOURCES, k % 8).alias("source")), F.struct(pick(SOURCES, F.floor(k / 8) % 8).alias("source")))
    )
    given = F.when(k % 5 == 0, F.array(F.lit("visual"), F.lit("sound")))
    counts = F.when(k % 5 == 1, F.create_map(F.lit("visual"), F.lit(3), F.lit("sound"), F.lit(2)))
    modalities, breakdown = gate.evidence_metadata(F.col("evidence"), given, counts)
    return e.select(
        "post_id", gate.evidence_modality(F.col("evidence")[0]["source"]).alias("first_modality"), F.array_join(modalities, ",").alias("modalities"),
        F.coalesce(breakdown["text"], F.lit(0)).alias("n_text"), F.coalesce(breakdown["visual"], F.lit(0)).alias("n_visual"),
    )


def _profiles(spark, sf):
    return events(spark, sf).select("user_id", "post_id", (F.col("post_type") == "error").alias("is_noise"), (F.col("value") >= 5).alias("should_use_for_profile"), "k", "value")


@query("kept_posts", f"WITH {REC} SELECT user_id, post_id, epoch_us(created_at) AS created_us, k FROM ev WHERE post_type <> 'error' AND value >= 5")
def kept_posts(spark, sf):
    e = events(spark, sf).select("user_id", "post_id", "created_at")
    e = e.unionByName(e.withColumn("created_at", F.col("created_at") - F.expr("INTERVAL 1 DAY")))  # an earlier row of the same id
    return gate.kept_posts(e, _profiles(spark, sf)).select("user_id", "post_id", F.unix_micros("created_at").alias("created_us"), "k")


def _kept_with_domains(spark, sf):
    """Profiles with two domains each, the second one at half the confidence."""
    from ..schemas import DOMAINS
    from .adapters import pick

    k = F.col("k")
    conf = F.least(F.lit(1.0), F.col("value") / 100)

    def part(shift, factor, modalities):
        return F.struct(
            pick(DOMAINS, (k + shift) % 7).alias("domain"), (conf * factor).alias("confidence"), modalities.alias("evidence_modalities"),
            F.array(F.struct(pick(RAW_TAGS, (k + shift) % 15).alias("tag"), (conf * factor).alias("confidence"))).alias("tags"),
        )

    domains = F.array(part(0, 1.0, F.array(F.lit("visual"), F.lit("text"), F.lit("text"))), part(3, 0.5, F.array(F.lit("text"))))
    e = events(spark, sf).select("user_id", "post_id", "created_at")
    kept = gate.kept_posts(e, _profiles(spark, sf))
    return kept.withColumn("domains", domains).withColumn("dup_weight", 1.0 / (1 + k % 3)).withColumn("post_signal_strength", k / 100.0)


KEPT = f"""{REC}, two AS (
  SELECT user_id, post_id, 0 AS shift, 1.0::DOUBLE AS factor, k, value FROM ev WHERE post_type <> 'error' AND value >= 5
  UNION ALL SELECT user_id, post_id, 3, 0.5::DOUBLE, k, value FROM ev WHERE post_type <> 'error' AND value >= 5)"""


@query("domain_records", f"""WITH {KEPT} SELECT user_id, post_id, list_extract(['sports_outdoor', 'entertainment', 'gaming', 'food_drink', 'travel_city_exploration', 'photography_creation', 'pets'], 1 + (k + shift) % 7) AS domain,
  round(least(1.0::DOUBLE, value / 100) * factor + 1e-10, 6) AS confidence, CASE WHEN shift = 0 THEN 'text,visual' ELSE 'text' END AS evidence_modalities FROM two""")
def domain_records(spark, sf):
    rows = gate.domain_records(_kept_with_domains(spark, sf))
    return rows.select("user_id", "post_id", "domain", round6(F.col("confidence")).alias("confidence"), F.array_join("evidence_modalities", ",").alias("evidence_modalities"))


@query("tag_observations", f"""WITH {KEPT}, o AS (SELECT user_id, post_id, list_extract(['sports_outdoor', 'entertainment', 'gaming', 'food_drink', 'travel_city_exploration', 'photography_creation', 'pets'], 1 + (k + shift) % 7) AS domain,
  list_extract({sql_list(RAW_TAGS)}, 1 + (k + shift) % 15) AS raw_tag, list_extract({sql_list(TAG_FORMS)}, 1 + (k + shift) % 15) AS form, round(least(1.0::DOUBLE, value / 100) * factor + 1e-10, 6) AS confidence FROM two)
SELECT user_id, post_id, domain, raw_tag, CASE WHEN domain = 'pets' AND form = 'hike' THEN 'dog_walk' WHEN domain = 'gaming' AND form = 'hik' THEN 'hike' ELSE form END AS tag, confidence FROM o""")
def tag_observations(spark, sf):
    from ..operators import tags

    aliases = {"pets": {"hike": "dog_walk"}, "gaming": {"hik": "hike"}}
    obs = tags.observations(gate.domain_records(_kept_with_domains(spark, sf)), aliases)
    return obs.select("user_id", "post_id", "domain", "raw_tag", "tag", round6(F.col("confidence")).alias("confidence"))
