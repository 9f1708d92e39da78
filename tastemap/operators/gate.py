"""Content gate over raw posts, and the rules around per-post extraction results.

Posts carry ``text, hashtags array<string>, media array<struct<media_type, alt_text, ...>>``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import URL, WORD_WITH_MARKS, blank
from ..schemas import DOMAINS

MIN_CONTENT_UNITS = 3

# Phrases that mark an image as a meme.
MEME = r"(?i)\b(meme|reaction image|shitpost|template|starter pack|me irl|when you|nobody:|bro visited|caption this)\b"
# Modality names of evidence sources, exact and as parts of longer names.
VISUAL_SOURCES = ["visual", "image", "photo", "picture", "frame", "screenshot", "media", "ocr"]
TEXT_SOURCES = ["text", "caption", "hashtags", "hashtag", "mention", "mentions", "url", "urls"]
VISUAL_PARTS = "image|visual|photo|picture|frame|screenshot|media"
# End of fixed values.


def has_image(media: Column) -> Column:
    return F.coalesce(F.exists(media, lambda m: m["media_type"] == "image"), F.lit(False))


def cue_text(text: Column, media: Column) -> Column:
    """Post text and alternative texts, joined by blanks without empty parts."""
    alts = F.transform(F.coalesce(media, F.array()), lambda m: m["alt_text"])
    parts = F.concat(F.array(text), alts)
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def is_meme_image(text: Column, media: Column) -> Column:
    return has_image(media) & cue_text(text, media).rlike(MEME)


def content_units(text: Column, hashtags: Column, media: Column) -> Column:
    """Word tokens outside links, hashtags that are not blank, and videos or gifs."""
    bare = F.regexp_replace(F.trim(blank(text)), URL, " ")
    tags = F.size(F.filter(F.coalesce(hashtags, F.array()), lambda h: F.trim(h) != ""))
    clips = F.size(F.filter(F.coalesce(media, F.array()), lambda m: m["media_type"].isin("video", "gif")))
    return F.size(F.regexp_extract_all(bare, F.lit(WORD_WITH_MARKS), F.lit(0))) + tags + clips


def candidate_domains(text: Column, hashtags: Column, media: Column, cues: dict[str, tuple[list[str], list[str]]]) -> Column:
    """Domains with a cue: a keyword inside the lower-case text or a matching hashtag.

    ``cues`` is the reviewed configuration (a few keywords per domain), so it becomes part
    of the expression and costs no join.
    """
    lowered = F.lower(cue_text(text, media))
    tags = F.transform(F.coalesce(hashtags, F.array()), lambda h: F.regexp_replace(F.lower(h), "^#+", ""))
    hits = []
    for domain, (keywords, seeds) in cues.items():
        if domain not in DOMAINS:
            raise ValueError(f"unknown domain {domain}")
        hit = F.lit(False)
        for word in keywords:
            hit = hit | lowered.contains(word.strip().lower())
        if seeds:
            hit = hit | F.arrays_overlap(tags, F.array(*[F.lit(s.strip().lower().lstrip("#")) for s in seeds]))
        hits.append(F.when(hit, F.lit(domain)))
    return F.array_compact(F.array(*hits))


def gate(posts: DataFrame, cues: dict, min_units: int = MIN_CONTENT_UNITS) -> DataFrame:
    """Add the gate verdict. An image that is no meme always passes; little content does not."""
    few = F.col("content_units") < min_units
    plain_image = F.col("has_image") & ~F.col("is_meme_image")
    reason = F.when(plain_image, None).when(F.col("has_image") & few, "meme_image_only").when(few, "too_little_content")
    listed = F.array_compact(
        F.array(
            F.when(F.col("has_image"), "has_image"),
            F.when(F.col("is_meme_image"), "meme_image"),
            F.when(F.size("candidate_domains") > 0, "domain_cues"),
            F.when(~few, "enough_textual_content"),
        )
    )
    text, tags, media = F.col("text"), F.col("hashtags"), F.col("media")
    return (
        posts.withColumn("has_image", has_image(media))
        .withColumn("is_meme_image", is_meme_image(text, media))
        .withColumn("content_units", content_units(text, tags, media))
        .withColumn("candidate_domains", candidate_domains(text, tags, media, cues))
        .withColumn("noise_reason", reason)
        .withColumn("is_noise", F.col("noise_reason").isNotNull())
        .withColumn("should_send_to_ai", ~F.col("is_noise"))
        .withColumn("gate_reason", F.when(F.size(listed) > 0, listed).otherwise(F.array("noise_reason")))
    )


def early_out(gated: DataFrame, has_usable_image: Column, visual_only: bool = False) -> DataFrame:
    """Profiles known without extraction: noise, or no image in a visual-only run (else null note)."""
    note = F.when(F.col("is_noise"), "Skipped by narrow gate.")
    if visual_only:
        note = note.when(
            ~has_usable_image, "Visual-only ablation: no usable image evidence was available for this post."
        )
    return gated.withColumn("uncertainty_note", note).withColumn("needs_extraction", F.col("uncertainty_note").isNull())


def guarded_profile(strength: Column, is_noise: Column, noise_reason: Column, post_type: Column, image: Column, meme: Column):
    """Guardrails over an extracted profile: noise flag, reason and weighted strength."""
    plain = image & ~meme
    base = F.when(plain & (strength <= 0), 0.15).otherwise(strength)
    original = F.lower(F.trim(blank(post_type))) == "original"
    weighted = F.when(original, base).otherwise(base * 0.8)
    return (
        F.when(plain, False).otherwise(is_noise),
        F.when(plain & (noise_reason == "too_little_content"), None).otherwise(noise_reason),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted)),
    )


def with_fallback(gated: DataFrame, responses: DataFrame) -> DataFrame:
    """Extraction responses ``(user_id, post_id, profile, error)`` joined to the gated posts.

    Posts without a usable response get an unusable profile that names the reason.
    """
    joined = gated.join(responses, ["user_id", "post_id"], "left")
    failed = F.col("profile").isNull()
    reason = F.coalesce(F.col("error"), F.lit("missing response"))
    note = F.when(F.col("is_noise"), "Skipped by narrow gate.").otherwise(F.concat(F.lit("single_post_analysis_failed: "), reason))
    kept = F.col("profile")
    return joined.select(
        *gated.columns,
        F.when(failed, F.col("is_noise")).otherwise(kept["is_noise"]).alias("profile_is_noise"),
        F.when(failed, False).otherwise(kept["should_use_for_profile"]).alias("should_use_for_profile"),
        F.when(failed, 0.0).otherwise(kept["post_signal_strength"]).alias("post_signal_strength"),
        F.when(failed, note).alias("uncertainty_note"),
    )


def redact_for_visual(posts: DataFrame) -> DataFrame:
    """Posts without any textual evidence: only media types stay."""
    none = F.array().cast("array<string>")
    hidden = ("storage_uri", "source_url", "alt_text")

    def bare(m):
        for field in hidden:
            m = m.withField(field, F.lit(None).cast("string"))
        return m

    out = posts.withColumn("text", F.lit("")).withColumn("media", F.transform("media", bare))
    for c in ("hashtags", "mentions", "urls"):
        if c in posts.columns:
            out = out.withColumn(c, none)
    return out


def redact_gate(gated: DataFrame) -> DataFrame:
    """Gate results without textual hints."""
    return (
        gated.withColumn("candidate_domains", F.array().cast("array<string>"))
        .withColumn("gate_reason", F.filter("gate_reason", lambda r: r.isin("has_image", "meme_image")))
        .withColumn("content_units", F.lit(0))
    )


def evidence_modality(source: Column) -> Column:
    """Modality of a named evidence source; visual names are tested first, text is the default."""
    s = F.lower(F.trim(blank(source)))
    return F.when(s.isin(*VISUAL_SOURCES), "visual").when(s.isin(*TEXT_SOURCES), "text").when(s.rlike(VISUAL_PARTS), "visual").otherwise("text")


def evidence_metadata(evidence: Column, given: Column, given_counts: Column):
    """Modalities and counts of a domain result: supplied ones restricted to the known two, else counted."""

    def n(modality):
        return F.size(F.filter(F.coalesce(evidence, F.array()), lambda e: evidence_modality(e["source"]) == modality))

    known = F.array(F.lit("text"), F.lit("visual"))
    counted = F.filter(known, lambda m: F.when(m == "text", n("text")).otherwise(n("visual")) > 0)
    modalities = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, F.filter(known, lambda m: F.array_contains(given, m))).otherwise(counted)
    fresh = F.map_from_arrays(known, F.array(n("text"), n("visual")))
    chosen = F.when(F.coalesce(F.size(given_counts), F.lit(0)) > 0, given_counts).otherwise(fresh)
    pairs = F.map_from_arrays(known, F.transform(known, lambda m: F.coalesce(chosen[m], F.lit(0))))
    return modalities, F.map_filter(pairs, lambda _, v: v > 0)


def last_posts(posts: DataFrame, order: str = "created_at") -> DataFrame:
    """One row per (user, post): the last one in ``order``, where an id occurs again."""
    rest = [c for c in posts.columns if c not in ("user_id", "post_id")]
    last = posts.groupBy("user_id", "post_id").agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select("user_id", "post_id", *[F.col("_last")[c].alias(c) for c in rest])


def kept_posts(posts: DataFrame, profiles: DataFrame, order: str = "created_at") -> DataFrame:
    """Posts with a profile that is neither noise nor unusable; of a repeated id the last post counts."""
    usable = profiles.filter(~F.col("is_noise") & F.col("should_use_for_profile"))
    return last_posts(posts, order).join(usable, ["user_id", "post_id"])


def domain_records(kept: DataFrame) -> DataFrame:
    """One row per (post, domain) of the kept profiles."""
    return kept.select(
        "user_id", "post_id", "created_at", "dup_weight", "post_signal_strength", F.explode("domains").alias("d")
    ).select(
        "user_id", "post_id", "created_at", "dup_weight", "post_signal_strength",
        F.col("d.domain").alias("domain"), F.col("d.confidence").alias("confidence"),
        F.array_sort(F.array_distinct("d.evidence_modalities")).alias("evidence_modalities"),
        F.col("d.tags").alias("tags"),
    )
