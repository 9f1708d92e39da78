"""Domain packs: everything known about a (user, domain) before it is summarised."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_label, is_phrase
from ..schemas import DOMAIN_DEFINITIONS, DOMAINS
from .ranking import top_rows

SCOPE = ["user_id", "domain"]


def all_domains(users: DataFrame, stats: DataFrame) -> DataFrame:
    """Seven rows per user; domains without a statistics row get the absent default."""
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d).alias("domain"), F.lit(DOMAIN_DEFINITIONS[d]).alias("definition")) for i, d in enumerate(DOMAINS)])
    rows = users.select("user_id").distinct().withColumn("d", F.explode(listed)).select("user_id", "d.ord", "d.domain", F.col("d.definition").alias("domain_definition"))
    joined = rows.join(stats, SCOPE, "left")
    for c, t in stats.dtypes:
        if c not in SCOPE:
            joined = joined.withColumn(c, F.coalesce(c, F.lit("absent" if c == "status" else 0).cast(t)))
    return joined.withColumn("domain_present", F.col("status") != "absent")


def cluster_entries(clusters: DataFrame, stats: DataFrame, members: DataFrame, evidence: DataFrame, posts: DataFrame) -> DataFrame:
    """Tag clusters with display label, interest scores (else weak with zero scores) and months seen."""
    key = [*SCOPE, "canonical_tag"]
    phrase = members.groupBy(*key).agg(F.min(F.when(is_phrase(F.col("member")), F.trim("member"))).alias("_phrase"))
    seen = evidence.join(posts.select("user_id", "post_id", "created_at"), ["user_id", "post_id"]).groupBy(*key).agg(
        F.date_format(F.min("created_at"), "yyyy-MM").alias("first_seen"), F.date_format(F.max("created_at"), "yyyy-MM").alias("last_seen")
    )
    scored = stats.select(*SCOPE, F.col("interest").alias("canonical_tag"), "stable_score", "recent_score", "status")
    out = clusters.join(phrase, key, "left").join(scored, key, "left").join(seen, key, "left")
    out = out.withColumn("display_label", display_label(F.col("canonical_tag"), F.col("_phrase"))).drop("_phrase")
    return out.fillna({"stable_score": 0.0, "recent_score": 0.0, "status": "weak_signal"})


def evidence_examples(evidence: DataFrame, posts: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` evidence posts of each cluster by id, with their text."""
    first = top_rows(evidence, [*SCOPE, "canonical_tag"], ["post_id"], k, "example")
    return first.join(posts.select("user_id", "post_id", "created_at", "text"), ["user_id", "post_id"])


def summary_requests(packs: DataFrame, clusters: DataFrame, representatives: DataFrame, pass_one: DataFrame | None = None, max_images: int = 12) -> DataFrame:
    """Request rows of a summary stage; the second stage carries the first stage's answer, where one came back."""
    tags = clusters.groupBy(*SCOPE).agg(F.array_sort(F.collect_list(F.struct("canonical_tag", "display_label", "n_posts", "weighted_support", "status"))).alias("tag_clusters"))
    reps = representatives.groupBy(*SCOPE).agg(
        F.array_sort(F.collect_list(F.struct("pick_order", "post_id", "text"))).alias("representative_posts"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("image_url").isNotNull(), F.struct("pick_order", "image_url")))), 1, max_images).alias("images"),
    )
    rows = packs.join(tags, SCOPE, "left").join(reps, SCOPE, "left")
    body = ["domain", "domain_definition", "status", "stable_score", "recent_score", "tag_clusters", "representative_posts"]
    if pass_one is not None:
        rows = rows.join(pass_one.select(*SCOPE, F.col("content").alias("evidence_first_result")), SCOPE, "left")
        body.append("evidence_first_result")
    key = F.concat_ws("__", F.lit("summary"), F.col("user_id").cast("string"), F.col("domain"), F.lit("2" if pass_one is not None else "1"))
    return rows.select(*SCOPE, key.alias("request_key"), F.to_json(F.struct(*body)).alias("user_prompt"), F.transform("images", lambda s: s["image_url"]).alias("image_urls"))


def atomic_summary(domain: Column, status: Column, long: Column, short: Column) -> Column:
    """One template sentence or two about the exported interests."""
    nothing = F.concat(F.lit("In "), domain, F.lit(", no reliable interest can be established from the observed posts."))
    ls, ss = F.array_join(long, ", "), F.array_join(short, ", ")
    head = F.concat(F.lit("In "), domain, F.lit(", the user shows a long-term interest in "), ls, F.lit("."))
    return (
        F.when(status == "inactive", nothing)
        .when((F.size(long) > 0) & (F.size(short) > 0), F.concat(head, F.lit(" Recent or emerging interests include "), ss, F.lit(".")))
        .when(F.size(long) > 0, head)
        .when(F.size(short) > 0, F.concat(F.lit("In "), domain, F.lit(", the strongest identifiable signal is a recent or emerging interest in "), ss, F.lit(".")))
        .otherwise(nothing)
    )
