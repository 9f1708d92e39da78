"""Controlled interventions: job grid, wrong-profile control, score summaries, bootstraps."""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import digest, ratio, round6
from ..session import cut_lineage
from .ranking import nth_row, with_position

# Conditions, intents, contrasts, resamples and seed of the experiment.
CONDITIONS = ["no_context", "timeline", "predicted_profile", "gold_profile", "wrong_profile"]
INTENTS = ["stable", "recent"]
CONTRASTS = [
    ("gold_profile", "predicted_profile"), ("gold_profile", "wrong_profile"), ("predicted_profile", "no_context"), ("predicted_profile", "timeline"),
]
RESAMPLES, SEED = 5000, 20260906
PROTOCOL, TEMPORAL_PROTOCOL = "profile_intervention_v1", "hash_order_v2"
DIMENSIONS = ["coverage", "concreteness", "fluency"]
# End of fixed values.

#: Hash buckets of the clustered bootstrap, whatever the number of users, and cells of one array of draws.
BUCKETS, DRAW_CELLS = 64, 4_000_000


def domain_profiles(interests: DataFrame) -> DataFrame:
    """Stable and recent labels per (user, domain), in order."""

    def labels(bucket):
        rows = F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("rank", "label"))))
        return F.transform(rows, lambda s: s["label"])

    return interests.groupBy("user_id", "domain").agg(labels("long_term").alias("stable"), labels("short_term").alias("recent"))


def profile_cost(domains_a: Column, domains_b: Column, size_a: Column, size_b: Column) -> Column:
    """Distance of two profiles: domain overlap and relative size."""
    overlap = F.size(F.array_intersect(domains_a, domains_b)) / F.greatest(F.lit(1), F.size(F.array_union(domains_a, domains_b)))
    return 3 * (1 - overlap) + F.abs(size_a - size_b) / F.greatest(F.lit(1), size_a, size_b)


def wrong_profiles(profiles: DataFrame) -> DataFrame:
    """A different user's profile for everyone: one to one, never one's own.

    Users with the same active domains are lined up by size and each gets the next one's
    profile, the last gets the first one's. Users alone with their domains form a line of
    their own; a single one left over joins another line.
    """
    has = (F.size("stable") > 0) | (F.size("recent") > 0)
    users = profiles.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(has, F.col("domain")))), ",").alias("line"), F.sum(F.size("stable") + F.size("recent")).alias("profile_size")
    )
    sizes = users.groupBy("line").agg(F.count("*").alias("n"))
    one = sizes.agg(F.sum((F.col("n") == 1).cast("int")).alias("alone"), F.min(F.when(F.col("n") > 1, F.col("line"))).alias("home")).first()
    lone = F.lit(one["home"] if one["alone"] == 1 and one["home"] is not None else "(alone)")
    placed = users.join(sizes, "line")
    placed = placed.withColumn("line", F.when(F.col("n") == 1, lone).otherwise(F.col("line"))).select("user_id", "line", "profile_size")
    spread = F.pmod(F.xxhash64("user_id"), F.lit(1 << 20))
    keyed = placed.withColumn("_h", spread)
    lined = with_position(keyed, ["line"], ["profile_size", "_h", "user_id"], [F.col("profile_size"), F.shiftright("_h", 8)], "_at", "_n")
    following = lined.select("line", F.col("_at").alias("_next"), F.col("user_id").alias("wrong_user_id"))
    out = lined.withColumn("_next", (F.col("_at") + 1) % F.col("_n")).join(following, ["line", "_next"])
    return out.select("user_id", "wrong_user_id")


def job_grid(users: DataFrame, models: list[str]) -> DataFrame:
    """Dialogue jobs (user, model, condition, intent) and temporal jobs (user, model)."""

    def each(values):
        return F.explode(F.array(*[F.lit(v) for v in values]))

    pairs = users.select("user_id").distinct().withColumn("model", each(models))
    talk = pairs.withColumn("condition", each(CONDITIONS)).withColumn("intent", each(INTENTS)).withColumn("stage", F.lit("dialogue"))
    return talk.unionByName(pairs.withColumn("stage", F.lit("temporal")), allowMissingColumns=True)


def condition_context(condition: Column, timeline: Column, predicted: Column, gold: Column, wrong: Column) -> Column:
    """What the generator sees under a condition; nothing under no_context."""
    return (
        F.when(condition == "timeline", timeline).when(condition == "predicted_profile", predicted)
        .when(condition == "gold_profile", gold).when(condition == "wrong_profile", wrong)
    )


def estimate(n_chars: Column, n_messages: int, price_in: Column, price_out: Column, max_out: Column) -> tuple[Column, Column]:
    """Token estimate (a quarter of the characters) and the reserved cost."""
    tokens = 16 + 4 * n_messages + F.ceil(n_chars / 4)
    return tokens, (F.ceil(tokens * 1.25 + 128) * price_in + max_out * price_out) / 1000


def pilot_users(users: DataFrame, length: str) -> DataFrame:
    """Shortest, median and longest timeline, ties in the order of ids."""
    users = cut_lineage(users)
    n = users.count()
    rows = [nth_row(users, [length, "user_id"], k) for k in sorted({0, n // 2, n - 1}) if n]
    return functools.reduce(DataFrame.unionByName, rows) if rows else users


def eligible(profiles: DataFrame, intent: str) -> DataFrame:
    """Users with any label in the intent's bucket."""
    return profiles.groupBy("user_id").agg(F.max((F.size(intent) > 0)).alias("target_eligible"))


def valid_scores(coverage: Column, concreteness: Column, fluency: Column, rationale: Column, target_eligible: Column) -> Column:
    """Whole scores 0..5; coverage is missing exactly when there is no target. Values are JSON texts."""

    def whole(c):
        return F.coalesce(c.rlike("^[0-5]$"), F.lit(False))

    cover = F.when(target_eligible, whole(coverage)).otherwise(coverage.isNull() | (coverage == "null"))
    return rationale.isNotNull() & cover & whole(concreteness) & whole(fluency)


def accepted_models(responses: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Responses whose returned model is allowed for the requested one (itself by default)."""
    ok = F.col("returned_model") == F.col("model")
    for model, names in allowed.items():
        ok = F.when(F.col("model") == model, F.col("returned_model").isin(*names)).otherwise(ok)
    return responses.filter(ok)


def current_results(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Results of this protocol whose input hash is the user's present one."""
    live = results.filter((F.col("protocol") == PROTOCOL) & ((F.col("stage") == "dialogue") | (F.col("temporal_protocol") == TEMPORAL_PROTOCOL)))
    return live.join(inputs.select("user_id", "input_hash"), ["user_id", "input_hash"], "left_semi")


def condition_means(scores: DataFrame) -> DataFrame:
    """Mean and count per (model, condition, intent) and dimension; missing scores do not count."""
    aggs = [F.count("*").alias("n_responses")]
    for d in DIMENSIONS:
        aggs += [round6(F.avg(d)).alias(d), F.count(d).alias(f"n_{d}")]
    return scores.groupBy("model", "condition", "intent").agg(*aggs)


def paired_differences(scores: DataFrame, contrasts: list[tuple[str, str]] = CONTRASTS) -> DataFrame:
    """Coverage difference of each contrast per user with both scores."""
    s = scores.filter("coverage is not null").select("model", "intent", "user_id", "condition", "coverage")
    sides = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), F.lit(c).alias("condition"), F.lit(sign).alias("sign")) for a, b in contrasts for c, sign in ((a, 1), (b, -1))])
    rows = s.withColumn("x", F.explode(F.filter(sides, lambda x: x["condition"] == F.col("condition")))).select("model", "intent", "user_id", "x.contrast", (F.col("coverage") * F.col("x.sign")).alias("v"))
    both = rows.groupBy("model", "intent", "contrast", "user_id").agg(F.sum("v").alias("delta"), F.count("*").alias("n"))
    return both.filter("n = 2").drop("n")


#: Cells of the histogram a bootstrap draws from.
CELLS = 1024


@pandas_udf(T.ArrayType(T.DoubleType()))
def bootstrap_interval(values: pd.Series, counts: pd.Series, variances: pd.Series) -> pd.Series:
    """95% interval of the mean over resamples, from a histogram: mean, count and variance of each cell.

    Drawing n users with replacement and drawing the histogram cells multinomially are the same experiment, so the
    work does not grow with the users. What varies inside the cells is added as one normal draw a resample.
    """

    def interval(v, c, var):
        v, c, var = (np.asarray(x, dtype=float) for x in (v, c, var))
        n, rng = int(c.sum()), np.random.default_rng(SEED)
        drawn = rng.multinomial(n, c / n, size=RESAMPLES)
        means = drawn @ v / n
        if var.any():
            means = means + rng.normal(size=RESAMPLES) * np.sqrt(drawn @ var) / n
        return [float(q) for q in np.quantile(means, [0.025, 0.975])]

    return pd.Series([interval(*x) for x in zip(values, counts, variances)])


def paired_bootstrap(differences: DataFrame, cells: int = CELLS) -> DataFrame:
    """Mean difference and bootstrap interval per contrast.

    The differences of a contrast fall into at most ``cells`` cells of equal width. Whole scores have a cell for each
    value, and cells of fractional ones keep their mean and variance, so scores of any precision take the same room.
    """
    keys = ["model", "intent", "contrast"]
    ends = differences.groupBy(*keys).agg(F.min("delta").cast("double").alias("low"), F.max("delta").cast("double").alias("high"))
    d = F.col("delta").cast("double")
    cell = F.when(F.col("high") > F.col("low"), F.least(F.lit(cells - 1), F.floor((d - F.col("low")) / (F.col("high") - F.col("low")) * cells))).otherwise(0)
    hist = differences.join(ends, keys).groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("c"), F.avg(d).alias("v"), F.var_pop(d).alias("var"))
    rows = hist.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "v", "c", "var"))).alias("h"), F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    part = lambda name: F.transform("h", lambda x: x[name].cast("double"))
    ci = bootstrap_interval(part("v"), part("c"), part("var"))
    out = rows.withColumn("ci", ci)
    return out.select(*keys, "n", round6(F.col("s") / F.col("n")).alias("mean"), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


# ------------------------------------------------------------------ temporal classification


def blind_items(items: DataFrame) -> DataFrame:
    """Items renumbered by content hash, so that ids carry no hint of the bucket."""
    hashed = items.withColumn("_d", digest(F.col("domain"), F.col("interest"), F.array_sort("supporting_posts").alias("supporting_posts")))
    placed = with_position(hashed, ["user_id"], ["_d", "item_id"], [F.substring("_d", 1, 2), F.substring("_d", 1, 4)], "_at")
    return placed.withColumn("blind_id", F.format_string("I%03d", "_at")).drop("_d", "_at")


def rule_assignments(evidence: DataFrame) -> DataFrame:
    """Stable with at least three posts in at least two months, else recent.

    ``evidence``: one row per (user, item, supporting post) with its timestamp text.
    """
    agg = evidence.groupBy("user_id", "item_id").agg(F.countDistinct("post_id").alias("n"), F.countDistinct(F.substring("timestamp", 1, 7)).alias("m"))
    return agg.select("user_id", "item_id", F.when((F.col("n") >= 3) & (F.col("m") >= 2), "stable").otherwise("recent").alias("bucket"))


def assignment_problems(targets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Unknown items or buckets and double assignments, which make an answer unusable."""
    unknown = assignments.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select("model", "user_id", F.lit("unknown_item").alias("problem"))
    bucket = assignments.filter(~F.coalesce(F.col("bucket").isin("stable", "recent"), F.lit(False))).select("model", "user_id", F.lit("unknown_bucket").alias("problem"))
    double = assignments.groupBy("model", "user_id", "item_id").agg(F.count("*").alias("n")).filter("n > 1").select("model", "user_id", F.lit("duplicate").alias("problem"))
    return unknown.union(bucket).union(double).distinct()


def scored_assignments(targets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every target of an answering (model, user); items left out count as invalid."""
    answered = assignments.select("model", "user_id").distinct().join(targets.withColumnRenamed("bucket", "truth"), "user_id")
    joined = answered.join(assignments.select("model", "user_id", "item_id", F.col("bucket").alias("predicted")), ["model", "user_id", "item_id"], "left")
    return joined.withColumn("predicted", F.coalesce("predicted", F.lit("invalid")))


CELLS = [(t, p) for t in ("stable", "recent") for p in ("stable", "recent", "invalid")]


def user_confusion(scored: DataFrame) -> DataFrame:
    """Confusion counts per (model, user)."""
    cells = [F.sum(((F.col("truth") == t) & (F.col("predicted") == p)).cast("long")).alias(f"{t}_{p}") for t, p in CELLS]
    return scored.groupBy("model", "user_id").agg(*cells)


def temporal_confusion(per_user: DataFrame) -> DataFrame:
    """Confusion matrix, recalls and balanced accuracy (mean of the defined recalls) per model."""
    names = [f"{t}_{p}" for t, p in CELLS]
    agg = per_user.groupBy("model").agg(F.count("*").alias("n_users"), *[F.sum(c).alias(c) for c in names])
    for t in ("stable", "recent"):
        total = F.col(f"{t}_stable") + F.col(f"{t}_recent") + F.col(f"{t}_invalid")
        agg = agg.withColumn(f"{t}_recall", F.when(total > 0, F.col(f"{t}_{t}") / total))
    known = F.array_compact(F.array("stable_recall", "recent_recall"))
    agg = agg.withColumn("balanced_accuracy", ratio(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))
    for c in ("stable_recall", "recent_recall", "balanced_accuracy"):
        agg = agg.withColumn(c, round6(F.col(c)))
    return agg


def cluster_bootstrap(per_user: DataFrame) -> DataFrame:
    """95% interval of balanced accuracy over resampled users.

    Users with equal count vectors are counted together. The distinct vectors lie in a fixed
    number of hash buckets, so that the draws do not depend on how many there are. How many draws fall into each bucket is itself multinomial; each
    task draws that split from the same seed, then its own vectors, and gives partial sums.
    """
    names = [f"{t}_{p}" for t, p in CELLS]
    vectors = per_user.groupBy("model", *names).agg(F.count("*").alias("users"))
    placed = vectors.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int"))
    totals = placed.groupBy("model", "bucket").agg(F.sum("users").alias("t")).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("bucket", "t"))).alias("split"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        model, bucket = pdf["model"].iloc[0], pdf["bucket"].iloc[0]
        split = [(s["bucket"], s["t"]) for s in pdf["split"].iloc[0]]
        at = [b for b, _ in split].index(bucket)
        sizes = np.asarray([t for _, t in split], dtype=float)
        n = int(sizes.sum())
        mine = np.random.default_rng(SEED).multinomial(n, sizes / n, size=RESAMPLES)[:, at]
        x = pdf.sort_values(names)
        p = x["users"].to_numpy(dtype=float)
        rng = np.random.default_rng([SEED, int(bucket)])
        table = x[names].to_numpy(dtype=np.int64)
        step = max(1, DRAW_CELLS // len(x))
        sums = np.concatenate([rng.multinomial(mine[i : i + step], p / p.sum()) @ table for i in range(0, RESAMPLES, step)])
        return pd.DataFrame(sums, columns=names).assign(model=model, resample=range(RESAMPLES))

    schema = "model string, resample int, " + ", ".join(f"{c} long" for c in names)
    parts = placed.join(totals, "model").groupBy("model", "bucket").applyInPandas(lambda pdf: draw(pdf)[["model", "resample", *names]], schema)
    sums = parts.groupBy("model", "resample").agg(*[F.sum(c).alias(c) for c in names])
    recall = [F.col(f"{t}_{t}") / F.greatest(F.lit(1), F.col(f"{t}_stable") + F.col(f"{t}_recent") + F.col(f"{t}_invalid")) for t in ("stable", "recent")]
    q = sums.groupBy("model").agg(F.percentile((recall[0] + recall[1]) / 2, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("model", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


# ------------------------------------------------------------------ inputs and budget


def complete_predictions(predictions: DataFrame, metadata: dict[str, str], n_domains: int = 7) -> DataFrame:
    """Check of a prediction snapshot per user: rejected rows, errors, doubled domains, completeness."""
    same = F.lit(True)
    for k, v in metadata.items():
        same = same & F.coalesce(F.col(k) == v, F.lit(False))
    rows = predictions.withColumn("_same", same)
    failed = F.col("_same") & (F.coalesce(F.trim("error"), F.lit("")) != "")
    return rows.groupBy("user_id").agg(
        F.sum((~F.col("_same")).cast("long")).alias("n_rejected"), F.sum(failed.cast("long")).alias("n_errors"),
        (F.sum(F.col("_same").cast("long")) - F.countDistinct(F.when(F.col("_same"), F.col("domain")))).alias("n_duplicates"),
        (F.countDistinct(F.when(F.col("_same"), F.col("domain"))) == n_domains).alias("complete"),
    )


def cached_captions(cache: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Captions by (user directory, file name) for one model and prompt; conflicts are flagged."""
    path = F.split(F.translate("source", "\\", "/"), "/")
    rows = cache.filter((F.col("model_name") == model) & (F.col("prompt_version") == prompt_version) & (F.size(path) >= 3))
    rows = rows.filter(F.element_at(path, -2) == "media").select(F.element_at(path, -3).alias("user_dir"), F.element_at(path, -1).alias("file_name"), "summary", "visible_text")
    value = F.struct("summary", "visible_text")
    return rows.groupBy("user_dir", "file_name").agg(F.min(value).alias("v"), (F.countDistinct(value) > 1).alias("conflict")).select("user_dir", "file_name", "v.summary", "v.visible_text", "conflict")


def caption_coverage(media: DataFrame, captions: DataFrame) -> DataFrame:
    """Images and captioned images per user: posts' media joined to the cache by file name."""
    wanted = media.filter(F.col("media_type").isin("image", "video_cover", "video"))
    name = F.element_at(F.split(F.translate(F.coalesce("storage_uri", F.lit("")), "\\", "/"), "/"), -1)
    joined = wanted.withColumn("file_name", name).join(captions.select(F.col("user_dir").alias("user_id"), "file_name", "summary"), ["user_id", "file_name"], "left")
    return joined.groupBy("user_id").agg(F.count("*").alias("images"), F.count("summary").alias("captions"))


def coverage_gate(per_user: DataFrame, minimum: float) -> DataFrame:
    totals = per_user.agg(F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum("captions"), F.lit(0)).alias("captions"))
    return totals.withColumn("enough", F.col("captions") / F.greatest(F.lit(1), F.col("images")) >= minimum)


def supporting_posts(interests: DataFrame, posts: DataFrame) -> DataFrame:
    """Evidence ids of each interest looked up in the timeline: found and missing counts, and no support at all."""
    rows = interests.select("user_id", "item_id", F.explode_outer("evidence_post_ids").alias("post_id"))
    joined = rows.join(posts.select("user_id", "post_id", "post_index"), ["user_id", "post_id"], "left")
    agg = joined.groupBy("user_id", "item_id").agg(
        F.countDistinct("post_index").alias("n_support"), F.sum((F.col("post_id").isNotNull() & F.col("post_index").isNull()).cast("long")).alias("n_missing")
    )
    return agg.withColumn("unsupported", F.col("n_support") == 0)


def spend(calls: DataFrame, by: list[str]) -> DataFrame:
    """Requests, metered and committed cost, and calls whose cost is not settled."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("requests"), round6(F.coalesce(F.sum("actual"), F.lit(0.0))).alias("metered"),
        round6(F.coalesce(F.sum(F.coalesce("actual", "reserved")), F.lit(0.0))).alias("committed"), F.sum(F.col("actual").isNull().cast("long")).alias("uncertain_requests"),
    )


def readiness(estimates: DataFrame) -> DataFrame:
    """Size and reserved cost of a planned run."""
    return estimates.agg(
        F.count("*").alias("generation_calls"), F.countDistinct("user_id").alias("users"), round6(F.sum("reserved")).alias("generation_reserved"),
        round6(F.avg("tokens")).alias("input_tokens_mean"), F.max("tokens").alias("input_tokens_max"),
    )
