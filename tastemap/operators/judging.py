"""Answers of judge models: score coercion, placeholder checks, weighted scores, verdict parsing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, nonblank, squeeze
from .evaluation import PROVIDER_BLOCK

SCORE_KEYS = ["interest_coverage", "negative_avoidance", "concreteness", "fluency"]
LIST_KEYS = ["matched_positive_interests", "matched_negative_interests", "unsupported_interests", "missed_core_interest_labels"]
RUBRIC_KEYS = ["anchor_correctness", "anchor_coverage", "evidence_grounding", "summary_faithfulness"]
# Weights of the dialogue score and of the rubric score.
DIALOGUE_WEIGHTS = [0.40, 0.25, 0.20, 0.15]
RUBRIC_WEIGHTS = [0.35, 0.25, 0.25, 0.15]
MATCH_KEYS = ["is_match", "is_same_interest", "match", "result", "same"]
REASON_KEYS = ["reason", "rationale", "explanation", "analysis"]
TRANSIENT_REASONS = ["anchor_match_error", "anchor_match_llm_not_configured", "403 client error", "forbidden"]
# End of fixed values.


def score(value: Column) -> Column:
    """A number cut to 0..5; 0 for anything else."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(5.0), n)))


def rubric_total(value: Column, parts: list[Column]) -> Column:
    """Judge total cut to 0..20. Totals up to 5 are on the single-score scale; without one, the parts add up."""
    n = value.try_cast("double")
    added = sum(parts[1:], parts[0])
    total = F.coalesce(n, added)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.when(total <= 5.0, total * 4.0).otherwise(total)))
    return F.when(value.isNull(), added).otherwise(scaled)


def weighted(parts: list[Column], weights: list[float]) -> Column:
    """Weighted score in percent of the best."""
    out = weights[0] * parts[0]
    for w, p in zip(weights[1:], parts[1:]):
        out = out + w * p
    return out / 5.0 * 100.0


def json_kind(raw: Column, key: str) -> Column:
    return F.get_json_object(raw, f"$.{key}")


def dialogue_verdicts(responses: DataFrame) -> DataFrame:
    """Parsed dialogue judgements ``(request_key, content)``: scores, final score and state.

    A missing score key or an untouched placeholder (all zero, nothing said) is invalid.
    """
    keys = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in SCORE_KEYS]), keys)) > 0
    out = responses
    for k in SCORE_KEYS:
        out = out.withColumn(k, score(json_kind(F.col("content"), k)))
    silent = nonblank(json_kind(F.col("content"), "brief_rationale")).isNull()
    for k in LIST_KEYS:
        silent = silent & F.coalesce(json_kind(F.col("content"), k), F.lit("[]")).isin("[]", "", "null")
    zero = (F.col(SCORE_KEYS[0]) + F.col(SCORE_KEYS[1]) + F.col(SCORE_KEYS[2]) + F.col(SCORE_KEYS[3])) == 0
    state = F.when(missing, "missing_scores").when(zero & silent, "placeholder").otherwise("valid")
    out = out.withColumn("state", state)
    final = weighted([F.col(k) for k in SCORE_KEYS], DIALOGUE_WEIGHTS)
    return out.withColumn("final_dialogue_score", F.when(F.col("state") == "valid", final)).withColumn(
        "brief_rationale", F.trim(blank(json_kind(F.col("content"), "brief_rationale")))
    )


def with_judge_fallback(requests: DataFrame, verdicts: DataFrame, missed: str = "core_labels") -> DataFrame:
    """A verdict for every request: zero scores with the error and all core labels missed when none is valid."""
    joined = requests.join(verdicts.filter("state = 'valid'"), "request_key", "left")
    failed = F.col("state").isNull()
    out = joined
    for k in [*SCORE_KEYS, "final_dialogue_score"]:
        out = out.withColumn(k, F.coalesce(k, F.lit(0.0)))
    reason = F.coalesce("error", F.lit("missing response"))
    return out.withColumn("missed_core_interest_labels", F.when(failed, F.col(missed)).otherwise(F.array().cast("array<string>"))).withColumn(
        "judge_error", F.when(failed, reason).otherwise("")
    ).withColumn("provider_blocked", failed & F.lower(reason).rlike("|".join(PROVIDER_BLOCK)))


def score_lines(text: Column) -> tuple[dict[str, Column], Column, Column]:
    """Scores given as ``key: number`` lines, a rationale of up to 500 letters, and whether all four are there."""
    found = {k: F.nullif(F.regexp_extract(text, rf"(?i){k}\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")) for k in SCORE_KEYS}
    complete = F.lit(True)
    for c in found.values():
        complete = complete & c.isNotNull()
    own = F.nullif(F.regexp_extract(text, r"(?is)(?:rationale|brief_rationale)\s*[:=]\s*(.+?)(?:\n|$)", 1), F.lit(""))
    default = F.lit("Fallback line judge parsed numeric scores but no rationale was provided.")
    rationale = F.substring(F.coalesce(nonblank(squeeze(F.coalesce(own, text))), default), 1, 500)
    return {k: score(c) for k, c in found.items()}, rationale, complete


def yes_no(text: Column) -> Column:
    """true, false, or null when the answer does not say."""
    t = F.lower(F.trim(blank(text)))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    named = F.nullif(F.regexp_extract(t, r"\bis[_ ]?match\b\s*[:=]\s*(true|false)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(t, r'"is_match"\s*:\s*(true|false)', 1), F.lit(""))
    yes, no = padded.contains(" yes"), padded.contains(" no")
    return (
        F.when(t.isin("true", "false"), t == "true")
        .when(named.isNotNull(), named == "true")
        .when(quoted.isNotNull(), quoted == "true")
        .when(t.startswith("yes"), True)
        .when(t.startswith("no"), False)
        .when(yes & ~no, True)
        .when(no & ~yes, False)
    )


def match_verdict(content: Column) -> tuple[Column, Column]:
    """Verdict and reason of a label-match answer under any of the accepted keys; numbers count as flags."""
    value = F.coalesce(*[json_kind(content, k) for k in MATCH_KEYS])
    number = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double") != 0)
    reason = F.coalesce(*[F.nullif(json_kind(content, k), F.lit("")) for k in REASON_KEYS])
    return F.coalesce(number, yes_no(value), F.lit(False)), F.trim(blank(reason))


def is_transient(flag: Column, reason: Column) -> Column:
    """Judgements that must not be reused."""
    return F.coalesce(flag, F.lit(False)) | F.lower(F.trim(blank(reason))).rlike("|".join(TRANSIENT_REASONS))


def judge_eligible(rows: DataFrame) -> DataFrame:
    """Rows that go to the rubric judge: valid enough, and active on both sides."""
    return rows.filter(~F.col("hard_fail") & (F.col("gold_status") == "active") & (F.col("status") == "active"))


def rubric_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of the rubric scores and the main score (0 to 1) over active tasks, with the counts of tasks; 0 without active ones."""
    active = F.col("gold_status") == "active"
    mean = lambda c: F.coalesce(F.avg(F.when(active, F.col(c))), F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_tasks"), F.sum(active.cast("long")).alias("n_active_tasks"), F.sum(F.coalesce("status_correct", F.lit(False)).cast("long")).alias("n_status_correct"),
        *[mean(k).alias(f"active_{k}_mean") for k in RUBRIC_KEYS], (mean("final_task_score") / 100.0).alias("benchmark_main_score"))


def cache_key(task: Column, model: Column, prompt_version: Column, gold: Column, pred: Column) -> Column:
    """Identity of a judgement: the same task, judge, prompt version, gold and prediction give the same key.

    ``gold`` and ``pred`` are structs (or strings of canonical JSON); nulls inside them count.
    """
    fields = F.struct(gold.alias("gold"), model.alias("judge_model"), pred.alias("pred"), prompt_version.alias("prompt_version"), task.alias("task_id"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def with_cached(requests: DataFrame, responses: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with the newest response of their key (``content``, null while none came) and whether it came from the cache.

    ``responses``: the key, content and created_at; a key may have been answered more than once.
    """
    newest = responses.groupBy(key).agg(F.max_by("content", "created_at").alias("content"), F.lit(True).alias("from_cache"))
    return requests.join(newest, key, "left").withColumn("from_cache", F.coalesce("from_cache", F.lit(False)))


def rubric_scores(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rubric result of every row; rows that are not judged get zeros and the reason."""
    judged = ~F.col("hard_fail") & (F.col("gold_status") == "active") & (F.col("status") == "active")
    missing = judged & F.col(content).isNull()
    parts = [F.when(judged & ~missing, score(json_kind(F.col(content), k))).otherwise(0.0) for k in RUBRIC_KEYS]
    reason = (
        F.when(F.col("hard_fail"), "hard_fail_precheck")
        .when(F.col("gold_status") != "active", "inactive_task_not_scored")
        .when(F.col("status") != "active", "gold_active_but_prediction_not_active")
        .when(missing, F.concat(F.lit("judge_error: "), F.coalesce("error", F.lit("missing response"))))
        .otherwise(F.trim(blank(json_kind(F.col(content), "brief_rationale"))))
    )
    total = rubric_total(json_kind(F.col(content), "judge_total_score"), parts)
    out = rows
    for k, p in zip(RUBRIC_KEYS, parts):
        out = out.withColumn(k, p)
    correct = F.when(F.col("hard_fail"), False).when(F.col("gold_status") != "active", F.col("gold_status") == F.col("status")).otherwise(judged & ~missing)
    return (
        out.withColumn("judge_total_score", F.when(judged & ~missing, total).otherwise(0.0))
        .withColumn("final_task_score", weighted([F.col(k) for k in RUBRIC_KEYS], RUBRIC_WEIGHTS))
        .withColumn("status_correct", correct)
        .withColumn("brief_rationale", reason)
    )
