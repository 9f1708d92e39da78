"""Personalised dialogue: interest facts, scenario cases, and rule scores of responses.

Interests come one row each: ``user_id, domain_ord, domain, status, bucket (long_term |
short_term | negative), rank, label, evidence_count, modalities, evidence_indices``.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.fuzzy import best_window_ratio
from ..functions.text import blank, dialogue_label, literal, nonblank, response_form, round4, word_count
from .judging import DIALOGUE_WEIGHTS, weighted
from .ranking import top_rows

# Markers, templates and prompts of the dialogue rules.
ACTION_MARKERS = [
    "recommend", "try", "go for", "go with", "pick", "choose", "plan", "watch", "read", "listen",
    "visit", "make", "build", "start with", "center", "session", "option", "tonight", "this week",
]
REASON_MARKERS = ["because", "since", "fits", "while", "still", "so it", "without"]
NEGATIVE_MARKERS = [
    "avoid", "skip", "not ", "don't", "do not", "wouldn't", "would not", "rather than", "instead of", "too noisy", "over-read", "overread", "noisy signal",
]
ARTIFACTS = r'(?i)\{\s*"|```|\bturn\s*\d\b|post index|benchmark|scoring'
LEADS = {
    "entertainment": "I’d recommend a %s-leaning pick for tonight.",
    "gaming": "I’d recommend something in the %s lane.",
    "food_drink": "I’d recommend going for %s.",
    "travel_city_exploration": "I’d recommend planning a small outing around %s.",
    "photography_creation": "I’d recommend a small session built around %s.",
    "pets": "I’d recommend a simple idea centered on %s.",
    "sports_outdoor": "I’d recommend centering it on %s.",
}
OTHER_LEAD = "I’d recommend something centered on %s."
STABLE_WITH_OPTION = "%s It is a safe fit for your usual taste, and you can keep it close to %s if you want a small variation."
STABLE_ALONE = "%s It is a safe fit for your usual taste without forcing a random detour."
RECENT_WITH_ANCHOR = "%s It gives you something a bit new while still staying close to your %s side, so it should not feel random."
RECENT_ALONE = "%s It gives you a bit of novelty while still staying close to what your recent taste suggests."
PROMPTS = {
    "stable_recommendation": "I want something that fits my usual taste. Could you recommend one option for me?",
    "short_term_exploration": "I want to try something a bit new, but still something that feels like me. Any suggestion?",
}
# End of fixed values.

CLAIM_RATIO, LABEL_RATIO, CONTEXT = 70.0, 85.0, 60


def modality_bonus(modalities: Column) -> Column:
    m = F.transform(F.filter(F.coalesce(modalities, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))
    return F.when(F.array_contains(m, "text") & F.array_contains(m, "visual"), 0.20).when(F.size(m) > 0, 0.08).otherwise(0.0)


def _best_labels(candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` facts per user; equal labels count once, at their best."""
    order = F.struct(-F.col("rank_score"), F.col("domain"), F.col("label"))
    keyed = candidates.withColumn("_key", dialogue_label(F.col("label"))).filter("_key is not null").withColumn("_o", order)
    single = keyed.groupBy("user_id", "_key").agg(F.min_by(F.struct("domain", "label", "horizon", "evidence_indices", "rank_score"), "_o").alias("f"), F.min("_o").alias("_o"))
    return top_rows(single, ["user_id"], ["_o"], k, "position").select("user_id", "position", "f.*")


def interest_facts(interests: DataFrame, k: int = 4) -> DataFrame:
    """Best positive facts of active domains."""
    base = F.when(F.col("bucket") == "long_term", 2.0).otherwise(1.4)
    score = base + 0.2 * F.least("evidence_count", F.lit(4)) + modality_bonus(F.col("modalities")) + F.when(F.col("rank") == 0, 0.15).otherwise(0.0)
    rows = interests.filter((F.col("status") == "active") & F.col("bucket").isin("long_term", "short_term"))
    return _best_labels(rows.withColumn("rank_score", round4(score)).withColumn("horizon", F.col("bucket")), k)


def negative_facts(interests: DataFrame, k: int = 4) -> DataFrame:
    """Best negative facts of all domains."""
    score = 1.0 + 0.2 * F.least("evidence_count", F.lit(4)) + modality_bonus(F.col("modalities")) + F.when(F.col("rank") == 0, 0.1).otherwise(0.0)
    rows = interests.filter(F.col("bucket") == "negative")
    return _best_labels(rows.withColumn("rank_score", round4(score)).withColumn("horizon", F.lit("negative")), k)


def case_winners(interests: DataFrame, scenario: str) -> DataFrame:
    """Winning interest per user for a scenario."""
    stable = scenario == "stable_recommendation"
    bucket = "long_term" if stable else "short_term"
    active = interests.filter((F.col("status") == "active") & nonblank(F.col("label")).isNotNull())
    n = active.groupBy("user_id", "domain").agg(
        F.sum((F.col("bucket") == bucket).cast("int")).alias("n"), F.max((F.col("bucket") == "long_term").cast("int")).alias("has_long")
    )
    rows = active.filter(F.col("bucket") == bucket).join(n, ["user_id", "domain"])
    score = (2.0 if stable else 1.8) + 0.25 * F.least("evidence_count", F.lit(4)) + modality_bonus(F.col("modalities"))
    score = score + F.when(F.col("rank") == 0, 0.15).otherwise(0.0) + 0.10 * F.least("n", F.lit(4))
    if not stable:
        score = score + F.when(F.col("has_long") == 1, 0.35).otherwise(0.0)
    order = F.struct(-F.round(score, 9), F.col("domain"), F.col("label"))
    won = rows.groupBy("user_id").agg(F.min_by(F.struct("domain_ord", "domain", "label", "evidence_indices", F.round(score, 9).alias("score")), order).alias("w"))
    return won.select("user_id", F.lit(scenario).alias("scenario_type"), "w.*")


def _listed(rows: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """First ``k`` distinct labels per user in the given order, as an array."""
    keyed = rows.withColumn("_key", dialogue_label(F.col("label"))).filter("_key is not null").withColumn("_o", F.struct(*order))
    single = keyed.groupBy("user_id", "_key").agg(F.min_by("label", "_o").alias("label"), F.min("_o").alias("_o"))
    best = top_rows(single, ["user_id"], ["_o"], k, "_r")
    return best.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda s: s["label"]).alias(name))


def scenario_case(interests: DataFrame, scenario: str) -> DataFrame:
    """Scenario turn per user: primary label, anchors, options, forbidden labels and reference response."""
    win = case_winners(interests, scenario)
    stable = scenario == "stable_recommendation"
    own = interests.join(win.select("user_id", "domain", F.col("label").alias("primary")), ["user_id", "domain"])
    other = own.filter(dialogue_label(F.col("label")) != dialogue_label(F.col("primary")))
    options = _listed(other.filter(F.col("bucket") == ("long_term" if stable else "short_term")), ["rank"], 2, "optional_labels")
    long_score = 2.0 + 0.25 * F.least("evidence_count", F.lit(4)) + modality_bonus(F.col("modalities")) + 0.15
    anchors = _listed(own.filter(F.col("bucket") == "long_term").withColumn("_s", -F.round(long_score, 9)), ["_s", "rank"], 2, "anchor_labels")
    negative = interests.filter(F.col("bucket") == "negative").join(win.select("user_id", F.col("domain").alias("_home")), "user_id")
    home = F.col("domain") == F.col("_home")
    negative = negative.filter(home | (F.col("rank") < 2)).withColumn("_away", (~home).cast("int"))
    forbidden = _listed(negative, ["_away", "domain_ord", "rank"], 12, "forbidden_labels")
    first_long = own.filter((F.col("bucket") == "long_term") & (F.col("rank") == 0)).select("user_id", F.col("evidence_indices").alias("_anchor_evidence"))
    none = F.array().cast("array<string>")
    out = win
    for part, name in ((options, "optional_labels"), (anchors, "anchor_labels"), (forbidden, "forbidden_labels")):
        out = out.join(part, "user_id", "left").withColumn(name, F.coalesce(name, none))
    evidence = F.array_distinct(F.filter("evidence_indices", lambda i: i >= 0))
    lead = F.format_string(OTHER_LEAD, F.lower("label"))
    for domain, template in LEADS.items():
        lead = F.when(F.col("domain") == domain, F.format_string(template, F.lower("label"))).otherwise(lead)
    if stable:
        out = out.withColumn("anchor_labels", none).withColumn("claim_evidence", evidence)
        companion, with_one, alone = F.col("optional_labels"), STABLE_WITH_OPTION, STABLE_ALONE
    else:
        out = out.join(first_long, "user_id", "left")
        both = F.array_union(evidence, F.coalesce(F.filter("_anchor_evidence", lambda i: i >= 0), F.array().cast("array<bigint>")))
        out = out.withColumn("claim_evidence", F.array_sort(both)).drop("_anchor_evidence")
        companion, with_one, alone = F.col("anchor_labels"), RECENT_WITH_ANCHOR, RECENT_ALONE
    first = F.lower(F.element_at(companion, 1))
    response = F.when(F.size(companion) > 0, F.format_string(with_one, lead, first)).otherwise(F.format_string(alone, lead))
    linked = F.array(F.col("label")) if stable else F.concat(F.array(F.col("label")), F.slice("anchor_labels", 1, 1))
    kind = F.lit("stable__%s__primary" if stable else "explore__%s__recent")
    return out.select(
        "user_id", "scenario_type", F.concat("scenario_type", F.lit("__"), "domain").alias("scenario_id"), "domain", F.lit(PROMPTS[scenario]).alias("user_prompt"),
        F.array("label").alias("required_labels"), "anchor_labels", "optional_labels", "forbidden_labels", response.alias("assistant_response"),
        F.array(F.struct(F.replace(kind, F.lit("%s"), dialogue_label(F.col("label"))).alias("claim_id"), response.alias("text"), linked.alias("labels"))).alias("claims"),
        "claim_evidence",
    )


def scenario_turns(interests: DataFrame) -> DataFrame:
    """The one or two turns of each user, numbered from 1."""
    stable, recent = (scenario_case(interests, s) for s in PROMPTS)
    first = stable.withColumn("turn_id", F.lit(1))
    second = recent.join(stable.select("user_id", F.lit(1).alias("_before")), "user_id", "left").withColumn("turn_id", F.coalesce("_before", F.lit(0)) + 1).drop("_before")
    return first.unionByName(second)


def profile_context(interests: DataFrame, max_domains: int = 5, max_labels: int = 4) -> DataFrame:
    """First active domains of each user with the first labels of every bucket."""
    rows = interests.filter((F.col("rank") < max_labels) & nonblank(F.col("label")).isNotNull())

    def labels(bucket):
        picked = F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("rank", F.trim("label").alias("label")))))
        return F.transform(picked, lambda s: s["label"]).alias(f"{bucket}_labels")

    domains = rows.groupBy("user_id", "domain_ord", "domain", "status").agg(labels("long_term"), labels("short_term"), labels("negative"))
    shown = domains.filter((F.col("status") == "active") & ((F.size("long_term_labels") > 0) | (F.size("short_term_labels") > 0)))
    return top_rows(shown, ["user_id"], ["domain_ord"], max_domains, "position")


def top_profile_labels(interests: DataFrame, max_labels: int = 4) -> DataFrame:
    """Distinct positive labels of active domains and negative labels of all, one row each with their place."""
    rows = interests.filter(F.col("rank") < max_labels).withColumn("key", dialogue_label(F.col("label"))).filter("key is not null")
    kind = F.when(F.col("bucket") == "negative", "negative").when(F.col("status") == "active", "positive")
    place = F.struct("domain_ord", (F.col("bucket") == "short_term").alias("late"), "rank")
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    return rows.groupBy("user_id", "kind", "key").agg(F.min_by(F.trim("label"), place).alias("label"), F.min(place).alias("place"))


# ------------------------------------------------------------------ rule scores


@pandas_udf(T.ArrayType(T.StringType()))
def matched_labels(labels: pd.Series, forms: pd.Series, text: pd.Series) -> pd.Series:
    """Labels whose normalised form is in the normalised text, or nearly so."""

    def hits(names, keys, body):
        return [n for n, k in zip(names, keys) if k and body and (k in body or best_window_ratio(k, body, LABEL_RATIO) >= LABEL_RATIO)]

    return pd.Series([hits(n, k, t) for n, k, t in zip(labels, forms, text)])


@pandas_udf(T.IntegerType())
def claim_hits(texts: pd.Series, labels: pd.Series, body: pd.Series) -> pd.Series:
    """Number of claims whose text, or any of whose linked labels, is (nearly) in the response."""

    def near(form, text, cutoff):
        return bool(form) and (form in text or best_window_ratio(form, text, cutoff) >= cutoff)

    def hits(forms, linked, text):
        if not text:
            return 0
        return sum(near(f, text, CLAIM_RATIO) or any(near(x, text, LABEL_RATIO) for x in ls) for f, ls in zip(forms, linked))

    return pd.Series([hits(f, ls, t) for f, ls, t in zip(texts, labels, body)], dtype="int32")


def clean_labels(labels: Column) -> Column:
    """Labels with a normal form, each form once, first spelling kept."""
    kept = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.trim), lambda x: response_form(x) != "")
    forms = F.transform(kept, response_form)
    numbered = F.transform(kept, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda s: F.array_position(forms, response_form(s["x"])) == s["i"] + 1), lambda s: s["x"])


def recommended(label: Column, text: Column) -> Column:
    """Does the label occur literally without a negation nearby?

    A label that only resembles a part of the text has no place to look at and does not count.
    """
    body = F.replace(F.lower(F.trim(blank(text))), F.lit("_"), F.lit(" "))
    phrase = F.replace(F.lower(F.trim(blank(label))), F.lit("_"), F.lit(" "))
    pieces = F.split(body, literal(phrase), -1)
    n, size = F.length(phrase), F.length(body)
    before = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: i < F.size(pieces)),
        lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p)) + (i - 1) * n,
    )

    def clear(start):
        lo = F.greatest(start - CONTEXT, F.lit(0))
        window = F.substring(body, lo + 1, F.least(start + n + CONTEXT, size) - lo)
        return ~window.rlike("|".join(NEGATIVE_MARKERS))

    return F.when(phrase == "", False).otherwise(F.exists(before, clear))


def coverage(scenario: Column, required: Column, anchor: Column, optional: Column, has_required: Column, has_anchor: Column) -> Column:
    explore = 5.0 * (0.70 * required + 0.25 * F.when(has_anchor, anchor).otherwise(1.0) + 0.05 * optional)
    usual = 5.0 * F.least(F.lit(1.0), 0.90 * required + 0.10 * optional)
    score = F.when(scenario == "short_term_exploration", explore).otherwise(usual)
    return F.when(~has_required, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), score)))


def avoidance(n_recommended: Column) -> Column:
    return F.when(n_recommended == 0, 5.0).when(n_recommended == 1, 2.0).otherwise(0.0)


def concreteness(text: Column) -> Column:
    t = F.trim(blank(text))
    n, lowered = word_count(t), F.lower(t)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = 1.0 + one(n >= 12) + one(n >= 22) + one(lowered.rlike("|".join(ACTION_MARKERS))) + one(lowered.rlike("|".join(REASON_MARKERS)))
    return F.when(t == "", 0.0).otherwise(score)


def fluency(text: Column) -> Column:
    t = F.trim(blank(text))
    n = word_count(t)
    score = 3.0 + F.when(n.between(12, 90), 1.0).otherwise(0.0) + F.when(t.rlike(r"[.!?]$"), 0.5).otherwise(0.0) + F.when(t.rlike(ARTIFACTS), 0.0).otherwise(0.5)
    return F.when(t == "", 0.0).when(n < 5, 1.0).otherwise(score)


def length_ok(text: Column) -> Column:
    return word_count(blank(text)).between(18, 120)


def format_ok(text: Column) -> Column:
    return F.length(F.trim(blank(text))) >= 24


def run_models(responses: DataFrame, most: int = 1000) -> list[str]:
    """Models of a run, from its configuration's size: more than ``most`` are an error."""
    found = [r[0] for r in responses.select("model").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a run has {most} models at most")
    return sorted(m for m in found if m is not None)


def scored_turns(turns: DataFrame, responses: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Rule scores of the responses ``(model, user_id, turn_id, response)`` to the gold turns, for every model of the run.

    ``models`` are those that responded if none are named. A turn without a response of a model is scored as an empty one.
    """
    keys = ["user_id", "turn_id"]
    every = F.array(*[F.lit(m) for m in (run_models(responses) if models is None else models)]).cast("array<string>")
    rows = turns.withColumn("model", F.explode(every)).join(responses, ["model", *keys], "left").withColumn("response", F.trim(blank(F.col("response"))))
    rows = rows.withColumn("_body", response_form(F.col("response")))
    for kind in ("required", "anchor", "optional", "forbidden"):
        rows = rows.withColumn(f"{kind}_labels", clean_labels(F.col(f"{kind}_labels")))
        forms = F.transform(f"{kind}_labels", response_form)
        rows = rows.withColumn(f"matched_{kind}", matched_labels(f"{kind}_labels", forms, "_body"))
    bad = F.filter("forbidden_labels", lambda x: recommended(x, F.col("response")))
    rows = rows.withColumn("forbidden_recommended", bad)
    rows = rows.withColumn("forbidden_negated", F.array_except("matched_forbidden", "forbidden_recommended"))
    forms = F.transform("claims", lambda c: response_form(c["text"]))
    linked = F.transform("claims", lambda c: F.transform(F.coalesce(c["labels"], F.array().cast("array<string>")), response_form))
    rows = rows.withColumn("_claims", claim_hits(forms, linked, "_body"))
    claim_recall = F.when(F.size("claims") > 0, F.col("_claims") / F.size("claims")).otherwise(1.0)

    def rate(kind, default):
        return F.when(F.size(f"{kind}_labels") > 0, F.size(f"matched_{kind}") / F.size(f"{kind}_labels")).otherwise(default)

    pool = F.array_distinct(F.concat("required_labels", "anchor_labels", "optional_labels"))
    hit = F.array_distinct(F.concat("matched_required", "matched_anchor", "matched_optional"))
    rows = rows.withColumn("_r", rate("required", 1.0)).withColumn("_a", rate("anchor", 1.0)).withColumn("_o", rate("optional", 0.0))
    cover = coverage(F.col("scenario_type"), F.col("_r"), F.col("_a"), F.col("_o"), F.size("required_labels") > 0, F.size("anchor_labels") > 0)
    rows = rows.withColumn("_c", cover).withColumn("_n", avoidance(F.size("forbidden_recommended"))).withColumn("_k", concreteness(F.col("response"))).withColumn("_f", fluency(F.col("response")))
    total = weighted([F.col("_c"), F.col("_n"), F.col("_k"), F.col("_f")], DIALOGUE_WEIGHTS)
    return rows.select(
        "model", *keys, "scenario_type", word_count(F.col("response")).alias("word_count"), length_ok(F.col("response")).alias("length_ok"), format_ok(F.col("response")).alias("format_ok"),
        round4(claim_recall).alias("claim_recall"), round4(F.when(F.size(pool) > 0, F.size(hit) / F.size(pool)).otherwise(1.0)).alias("interest_hit_rate"),
        round4(F.col("_r")).alias("required_hit_rate"), round4(F.col("_a")).alias("anchor_hit_rate"), round4(F.col("_o")).alias("optional_hit_rate"),
        round4(F.col("_c")).alias("interest_coverage"), F.col("_n").alias("negative_avoidance"), F.col("_k").alias("concreteness"), F.col("_f").alias("fluency"),
        round4(F.col("_c") / 5.0).alias("strategy_score"), "matched_required", "matched_anchor", "matched_optional", "forbidden_recommended", "forbidden_negated",
        *[F.array_except(f"{k}_labels", f"matched_{k}").alias(f"missing_{k}") for k in ("required", "anchor", "optional")], round4(total).alias("turn_score"),
    )


MEANS = ["claim_recall", "interest_hit_rate", "interest_coverage", "negative_avoidance", "concreteness", "fluency", "turn_score"]


def turn_means(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means and rates of scored turns, rounded to four digits."""
    flags = {
        "length_compliance_rate": F.col("length_ok").cast("double"), "format_compliance_rate": F.col("format_ok").cast("double"),
        "forbidden_recommendation_rate": (F.size("forbidden_recommended") > 0).cast("double"), "strategy_score_mean": F.col("strategy_score"),
    }
    return scored.groupBy(*by).agg(
        F.count("*").alias("turn_count"), *[round4(F.avg(c)).alias(f"{c}_mean") for c in MEANS], *[round4(F.avg(c)).alias(n) for n, c in flags.items()]
    )


def run_report(user_rows: DataFrame, by: list[str]) -> DataFrame:
    """Means over users, with error and block counts."""
    return user_rows.groupBy(*by).agg(
        F.count("*").alias("n_users"), round4(F.avg("overall_score")).alias("overall_score_mean"),
        F.sum(nonblank(F.col("error")).isNotNull().cast("long")).alias("n_errors"), F.sum(F.col("provider_blocked").cast("long")).alias("n_blocked"),
    )


# ------------------------------------------------------------------ judge inputs and retries


def fact_snippets(facts: DataFrame, posts: DataFrame, k: int = 2) -> DataFrame:
    """First ``k`` evidence posts of each fact that are in the timeline, in evidence order."""
    rows = facts.select("user_id", "position", F.posexplode("evidence_indices").alias("_at", "post_index"))
    joined = rows.join(posts.select("user_id", "post_index", "post_id", F.trim(blank(F.col("text"))).alias("text")), ["user_id", "post_index"])
    return top_rows(joined, ["user_id", "position"], ["_at"], k, "snippet").drop("_at")


def safe_judge_input(turns: DataFrame) -> DataFrame:
    """Judge input without any user text, responses cut to 500 letters."""
    body = F.to_json(F.struct(F.lit("[redacted_for_provider_safety]").alias("prompt"), "turn_id", F.substring(blank(F.col("response")), 1, 500).alias("assistant_response"), F.lit("provider_safe_input").alias("judge_retry_mode")))
    return turns.withColumn("judge_input", body)


def compact_judge_input(turns: DataFrame) -> DataFrame:
    """Judge input of labels and responses only: 900 letters, 20 forbidden labels."""
    rubric = F.struct("required_labels", "anchor_labels", "optional_labels", F.slice("forbidden_labels", 1, 20).alias("forbidden_labels"))
    body = F.to_json(F.struct("turn_id", rubric.alias("rubric"), F.substring(blank(F.col("response")), 1, 900).alias("assistant_response")))
    return turns.withColumn("judge_input", body)


def next_stage(requests: DataFrame, results: DataFrame, error_class: Column) -> DataFrame:
    """Requests for the next, smaller stage: failed on the context limit. All other failures are final."""
    failed = results.filter((error_class == "context_limit") & F.col("content").isNull()).select("request_key")
    return requests.join(failed, "request_key", "left_semi")
