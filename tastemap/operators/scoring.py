"""Observation windows and time-aware scores of domains and interests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round6

SUPPORT = 0.60
WEAK = 0.45


def observation_window(posts: DataFrame) -> DataFrame:
    """Per user: number of posts, first and last time, and whole days between (at least 1)."""
    seconds = F.unix_micros(F.col("observed_end")) - F.unix_micros(F.col("observed_start"))
    return (
        posts.groupBy("user_id")
        .agg(
            F.count("*").alias("post_count_total"),
            F.min("created_at").alias("observed_start"),
            F.max("created_at").alias("observed_end"),
        )
        .withColumn("window_days", F.greatest(F.lit(1), F.floor(seconds / 86400000000)).cast("long"))
    )


def required_bins(window_days: Column) -> Column:
    return F.when(window_days < 90, 2).when(window_days < 365, 3).otherwise(4)


def time_bin(ts: Column, window_days: Column) -> Column:
    """Month for long windows, else ISO week with its own year."""
    week = F.format_string("%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    return F.when(window_days >= 180, F.date_format(ts, "yyyy-MM")).otherwise(week)


def duplicate_weights(clusters: DataFrame) -> DataFrame:
    """Weight of each member of a duplicate cluster: one over the cluster size."""
    sizes = clusters.groupBy("user_id", "cluster_id").agg(F.count("*").alias("duplicate_cluster_size"))
    return clusters.join(sizes, ["user_id", "cluster_id"]).withColumn("dup_weight", 1.0 / F.col("duplicate_cluster_size"))


def _flags(records: DataFrame, windows: DataFrame) -> DataFrame:
    joined = records.join(windows.select("user_id", "observed_end", "window_days"), "user_id")
    support = F.col("confidence") >= SUPPORT
    return (
        joined.withColumn("support", support)
        .withColumn("weak", (F.col("confidence") >= WEAK) & ~support)
        .withColumn("in90", support & (F.col("created_at") >= F.col("observed_end") - F.expr("INTERVAL 90 DAYS")))
        .withColumn("in30", support & (F.col("created_at") >= F.col("observed_end") - F.expr("INTERVAL 30 DAYS")))
        .withColumn("bin", F.when(support, time_bin(F.col("created_at"), F.col("window_days"))))
    )


def _sum_if(flag: str, value: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(flag), F.col(value))), F.lit(0.0))


def _avg_if(flag: str, value: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(flag), F.col(value))), F.lit(0.0))


def domain_status(stable: Column, recent: Column, any_evidence: Column) -> Column:
    return (
        F.when((stable >= 0.65) & (recent >= 0.65), "stable_with_recent_surge")
        .when(stable >= 0.65, "stable")
        .when(recent >= 0.65, "recent")
        .when(any_evidence, "weak_signal")
        .otherwise("absent")
    )


def domain_stats(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Support, scores and status per (user, domain). Evidence posts stay rows of ``domain_evidence``."""
    agg = _flags(records, windows).groupBy("user_id", "domain").agg(
        F.first("window_days").alias("window_days"),
        F.sum(F.col("support").cast("long")).alias("n_support"),
        F.sum(F.col("weak").cast("long")).alias("n_weak"),
        _sum_if("support", "dup_weight").alias("eff"),
        _avg_if("support", "confidence").alias("mean_conf"),
        F.countDistinct("bin").alias("distinct_time_bins"),
        _sum_if("in90", "dup_weight").alias("r90"),
        _sum_if("in30", "dup_weight").alias("r30"),
        _avg_if("in90", "confidence").alias("r90_mean"),
    )
    stable = round6(
        0.45 * F.least(F.lit(1.0), F.col("eff") / 8.0)
        + 0.35 * F.least(F.lit(1.0), F.col("distinct_time_bins") / required_bins(F.col("window_days")))
        + 0.20 * F.col("mean_conf")
    )
    recent = round6(
        0.50 * F.least(F.lit(1.0), F.col("r90") / 5.0)
        + 0.20 * F.least(F.lit(1.0), F.col("r30") / 3.0)
        + 0.30 * F.col("r90_mean")
    )
    return (
        agg.withColumn("stable_score", stable)
        .withColumn("recent_score", recent)
        .select(
            "user_id",
            "domain",
            "n_support",
            "n_weak",
            round6(F.col("eff")).alias("effective_support_posts"),
            round6(F.col("mean_conf")).alias("mean_confidence"),
            "distinct_time_bins",
            round6(F.col("r90")).alias("recent_90_support"),
            round6(F.col("r30")).alias("recent_30_support"),
            round6(F.col("r90_mean")).alias("recent_90_mean_confidence"),
            "stable_score",
            "recent_score",
            domain_status(F.col("stable_score"), F.col("recent_score"), (F.col("n_support") + F.col("n_weak")) > 0).alias("status"),
        )
    )


def domain_evidence(records: DataFrame) -> DataFrame:
    """Support and weak posts of each (user, domain), one row each."""
    kind = F.when(F.col("confidence") >= SUPPORT, "support").when(F.col("confidence") >= WEAK, "weak")
    return records.select("user_id", "domain", "post_id", kind.alias("evidence")).filter("evidence is not null").distinct()


def interest_stats(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Scores and status per (user, domain, interest)."""
    flagged = (
        _flags(records, windows)
        .withColumn("support_post", F.when(F.col("support"), F.col("post_id")))
        .withColumn("recent_post", F.when(F.col("in90"), F.col("post_id")))
    )
    agg = flagged.groupBy("user_id", "domain", "interest").agg(
        F.first("window_days").alias("window_days"),
        F.countDistinct("support_post").alias("n_support"),
        F.countDistinct("recent_post").alias("n_recent"),
        F.countDistinct("bin").alias("distinct_time_bins"),
        _sum_if("support", "dup_weight").alias("eff"),
        _avg_if("support", "confidence").alias("mean_conf"),
        _sum_if("in90", "dup_weight").alias("r90"),
        _avg_if("in90", "confidence").alias("r90_mean"),
    )
    recent = round6(0.65 * F.least(F.lit(1.0), F.col("r90") / 2.0) + 0.35 * F.col("r90_mean"))
    stable = round6(
        0.60 * F.least(F.lit(1.0), F.col("eff") / 3.0)
        + 0.20
        * F.least(
            F.lit(1.0),
            F.col("distinct_time_bins") / F.greatest(F.lit(2), required_bins(F.col("window_days")) - 1),
        )
        + 0.20 * F.col("mean_conf")
    )
    status = (
        F.when(
            (F.col("stable_score") >= 0.62) & (F.col("n_support") >= 3) & (F.col("distinct_time_bins") >= 2), "stable"
        )
        .when((F.col("recent_score") >= 0.60) & (F.col("n_recent") >= 2), "recent")
        .otherwise("weak_signal")
    )
    return (
        agg.withColumn("recent_score", recent)
        .withColumn("stable_score", stable)
        .select(
            "user_id",
            "domain",
            "interest",
            "n_support",
            round6(F.col("eff")).alias("effective_support_posts"),
            round6(F.col("mean_conf")).alias("mean_confidence"),
            "distinct_time_bins",
            round6(F.col("r90")).alias("recent_90_support"),
            "recent_score",
            "stable_score",
            status.alias("status"),
        )
    )
