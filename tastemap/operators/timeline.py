"""Timeline operators: representatives, chunks, phases, relative days, source summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import first_rows, time_buckets, top_rows, with_position

UNTAGGED = "__untagged__"


def representative_posts(records: DataFrame, limit: int = 15, tie: str = "post_id") -> DataFrame:
    """Up to ``limit`` posts per (user, domain): one per first tag, then the strongest others.

    Needs ``confidence, post_signal_strength, created_at, first_tag`` (null when untagged).
    When the tags alone fill the limit, one more post is still added before thinning to the
    earliest, middle and latest picks; that is the documented behaviour, not an accident.
    """
    keys = ["user_id", "domain"]
    strength = -(F.coalesce("confidence", F.lit(0.0)) * F.coalesce("post_signal_strength", F.lit(0.0)))
    marked = records.withColumn("first_tag", F.coalesce("first_tag", F.lit(UNTAGGED))).withColumn("_s", strength)
    order = ["_s", "created_at", tie]
    # The strongest limit+1 posts per tag hold every possible pick; Spark limits before the shuffle.
    # The pool and the picks are read several times, so each is ranked once and written.
    pool = cut_lineage(top_rows(marked, keys + ["first_tag"], order, limit + 1, "_in_tag"))
    cover = pool.filter("_in_tag = 1").withColumn("_phase", F.lit(0)).withColumn("_nth", F.lit(0))
    n_tags = cover.groupBy(*keys).agg(F.count("*").alias("_tags"))
    fill = top_rows(pool.filter("_in_tag > 1"), keys, order, limit, "_nth").withColumn("_phase", F.lit(1))
    fill = fill.join(n_tags, keys).filter(F.col("_nth") <= F.greatest(F.lit(limit) - F.col("_tags"), F.lit(1)))
    picks = cover.unionByName(fill.drop("_tags"))
    # The pick order: tags in name order, then the fill.
    pick_tag = F.when(F.col("_phase") == 0, F.col("first_tag")).otherwise(F.lit(""))
    picks = cut_lineage(picks.withColumn("_pick", F.struct(F.col("_phase"), pick_tag.alias("tag"), F.col("_nth"))))
    # Only groups above the limit are thinned by time. The others keep the pick order and need no places.
    scope = F.struct(*keys).alias("_scope")  # structs compare equal on null fields
    over = picks.groupBy(scope).agg(F.count("*").alias("_p")).filter(F.col("_p") > limit).select("_scope")
    over = cut_lineage(over)
    marked = picks.withColumn("_scope", scope)
    few = marked.join(over, "_scope", "left_anti").drop("_scope")
    few = few.withColumns({"_section": F.lit(0), "_small": F.col("_pick"), "_t": F.lit(None).cast("long")})
    many = marked.join(over, "_scope", "left_semi").drop("_scope")
    timed = with_position(many, keys, ["created_at", "_pick"], time_buckets(), "_t", "_p")
    third, sixth = max(1, limit // 3), max(1, limit // 6)
    middle = F.greatest(F.lit(0), F.floor(F.col("_p") / 2) - sixth)
    t, p = F.col("_t"), F.col("_p")
    section = F.when(t < third, 0).when((t >= middle) & (t < middle + third), 1).when(t >= p - max(1, limit - 2 * third), 2)
    thinned = timed.withColumn("_section", section).filter("_section is not null").drop("_p")
    thinned = thinned.withColumn("_small", F.lit(None).cast(picks.schema["_pick"].dataType))
    ranked = top_rows(few.unionByName(thinned), keys, ["_section", "_small", "_t"], limit, "pick_order")
    return ranked.drop("_s", "_in_tag", "_phase", "_nth", "_pick", "_t", "_section", "_small")


def chunked(records: DataFrame, size: int = 30, tie: str = "post_id") -> DataFrame:
    """Chronological chunks of ``size`` records per (user, domain)."""
    placed = with_position(records, ["user_id", "domain"], ["created_at", tie], time_buckets(), "_at")
    return placed.withColumn("chunk_index", F.floor(F.col("_at") / size)).withColumn("chunk_position", F.col("_at") % size).drop("_at")


def chunk_rows(chunks: DataFrame, tag_column: str = "canonical_tags", top: int = 5) -> DataFrame:
    """One row per chunk: first and last post, size and the five most frequent tags."""
    keys = ["user_id", "domain", "chunk_index"]
    ends = chunks.groupBy(*keys).agg(
        F.min_by("post_id", "chunk_position").alias("start_post_id"),
        F.max_by("post_id", "chunk_position").alias("end_post_id"),
        F.min("created_at").alias("start_at"),
        F.max("created_at").alias("end_at"),
        F.count("*").alias("n_posts"),
    )
    counted = chunks.select(*keys, F.explode(tag_column).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    best = top_rows(counted, keys, [F.desc("n"), "tag"], top, "_r").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda s: s["tag"]).alias("top_tags")
    )
    return ends.join(best, keys, "left").withColumn("top_tags", F.coalesce("top_tags", F.array().cast("array<string>")))


def chunk_text(top_tags: Column, n_posts: Column) -> Column:
    head = F.concat(F.lit("Chunk contains "), n_posts, F.lit(" posts"))
    tags = F.array_join(F.slice(top_tags, 1, 3), ", ")
    return F.when(F.size(top_tags) > 0, F.concat(head, F.lit(", with top recurring tags: "), tags, F.lit("."))).otherwise(
        F.concat(head, F.lit(" with limited recurring tags."))
    )


def modality_bucket(modalities: Column) -> Column:
    """text_only, visual_only, mixed, or unknown without any."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform(modalities, F.trim), lambda m: m != "")))
    return (
        F.when(F.coalesce(F.size(known), F.lit(0)) <= 0, "unknown")
        .when(known == F.array(F.lit("text")), "text_only")
        .when(known == F.array(F.lit("visual")), "visual_only")
        .otherwise("mixed")
    )


def modality_order(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Modalities of each group in the order they are first seen."""
    seen = records.select(*keys, position, F.posexplode("evidence_modalities").alias("_i", "modality"))
    firsts = seen.groupBy(*keys, "modality").agg(F.min(F.struct(position, "_i")).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "modality")))
    return firsts.groupBy(*keys).agg(F.transform(ordered, lambda s: s["modality"]).alias("modalities"))


def modality_posts(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Posts of each group by modality bucket, one row each, with the place they are first seen."""
    return (
        records.withColumn("bucket", modality_bucket(F.col("evidence_modalities")))
        .groupBy(*keys, "bucket", "post_id")
        .agg(F.min(position).alias("first_position"))
    )


def post_signal_sources(records: DataFrame, position: str) -> DataFrame:
    """The first record of each (user, domain, post)."""
    picked = first_rows(records, ["user_id", "domain", "post_id"], F.col(position), ["evidence_modalities", "confidence"])
    return picked.withColumn("evidence_modality", modality_bucket(F.col("evidence_modalities"))).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.0))
    )


def phases(posts: DataFrame, n: int = 4, tie: str = "post_index") -> DataFrame:
    """Equal time phases per user: rank times n over count. (``ntile`` would fill early phases first.)"""
    placed = with_position(posts, ["user_id"], ["created_at", tie], time_buckets(), "_at", "_n")
    phase = F.least(F.lit(n - 1), F.floor(F.col("_at") * n / F.col("_n"))).cast("int")
    return placed.withColumn("phase", phase).drop("_at", "_n")


def relative_days(posts: DataFrame) -> DataFrame:
    """Days since the user's first post."""
    # Written, its size is known: where the users are few, their texts are not shuffled.
    first = cut_lineage(posts.groupBy("user_id").agg(F.min(F.to_date("created_at")).alias("_first")))
    return posts.join(first, "user_id").withColumn("relative_day", F.datediff(F.to_date("created_at"), "_first")).drop("_first")


def recent_window(timeline: DataFrame, max_posts: int = 200) -> DataFrame:
    """The last ``max_posts`` rows of each timeline, numbered in time order from 0."""
    last = top_rows(timeline, ["user_id"], [F.desc("timestamp"), F.desc("post_index")], max_posts, "_r")
    forward = W.partitionBy("user_id").orderBy("timestamp", "post_index")  # at most max_posts rows
    return last.withColumn("row_index", F.row_number().over(forward) - 1).drop("_r")


def request_chunks(window_rows: DataFrame, size: int = 20) -> DataFrame:
    """Chunks of a recent window: id, size, and first and last non-empty timestamps."""
    chunk = F.floor(F.col("row_index") / size)
    filled = F.when(F.trim("timestamp") != "", F.struct("row_index", "timestamp"))
    return (
        window_rows.groupBy("user_id", chunk.alias("_c"))
        .agg(
            F.count("*").alias("n_posts"),
            F.coalesce(F.min(filled)["timestamp"], F.lit("")).alias("span_start"),
            F.coalesce(F.max(filled)["timestamp"], F.lit("")).alias("span_end"),
        )
        .select(
            "user_id",
            F.format_string("%s_chunk_%03d", F.col("user_id").cast("string"), F.col("_c") + 1).alias("chunk_id"),
            "n_posts",
            "span_start",
            "span_end",
        )
    )


def growing_prefixes(users: DataFrame, batch_size: int, index: str = "user_position", total: str = "n_users") -> DataFrame:
    """Endpoints of growing user batches. Each user is listed once, under the first batch that holds it;
    a batch consists of the users listed under it and under the batches before it."""
    end = F.least(F.ceil((F.col(index) + 1) / batch_size) * batch_size, F.col(total))
    return users.withColumn("batch_end", end.cast("long"))


def recency_label(created_at: Column, observed_end: Column) -> Column:
    """Whole days before the end of the window, in three classes."""
    days = F.floor((F.unix_micros(observed_end) - F.unix_micros(created_at)) / 86400000000)
    return F.when(days <= 30, "last_30_days").when(days <= 90, "last_90_days").when(days.isNotNull(), "older")


def why_selected(confidence: Column, created_at: Column, observed_end: Column) -> Column:
    days = F.floor((F.unix_micros(observed_end) - F.unix_micros(created_at)) / 86400000000)
    return (
        F.when((confidence >= 0.8) & (days <= 90), "high_confidence_recent_post")
        .when(days > 90, "older_supporting_post")
        .when(confidence >= 0.8, "high_confidence_supporting_post")
        .otherwise("representative_supporting_post")
    )
