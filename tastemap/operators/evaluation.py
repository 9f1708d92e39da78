"""Profile predictions: normalisation, precheck, label matching and metrics.

Tables: tasks ``(task_id, user_id, domain, gold_status, n_posts)``, gold and predicted
labels one row each, predictions one row per (model, task).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, distinct_ints, f1, match_label, nonblank, ratio
from ..session import cut_lineage

# Versions and message parts that classify provider errors.
RETRY_CONTEXT_VERSION = "preserve_img_text_timestamp_v1"
PROTOCOL_VERSION = "uncapped_interest_tags_v1"
COMPACT_RETRY_MODES = ["compact_context", "compact_context_text_redacted"]
CONTEXT_LIMIT = [
    "context length", "maximum context", "max context", "too many tokens", "prompt is too long", "input is too large",
    "input length", "range of input length", "request too large", "too many images",
]
DATA_INSPECTION = ["datainspectionfailed", "data_inspection_failed", "inappropriate content"]
TRANSPORT_TIMEOUT = ["write operation timed out", "connection aborted", "read timed out", "timeouterror", "connectionerror"]
PROVIDER_BLOCK = ["data_inspection_failed", "inappropriate content", "content_policy", "safety", "moderation"]
# End of fixed values.

PARSED = """status string, summary_natural_pred string, summary string, domain_summary string,
  long_term_interest_tags array<string>, long_term_interest_anchors array<string>,
  short_term_interest_tags array<string>, short_term_interest_anchors array<string>,
  summary_support_post_indices array<string>, evidence_post_indices array<string>,
  evidence_post_indices_representative array<string>"""
ANCHOR = """label string, interest string, evidence_post_indices array<string>,
  representative_evidence_post_indices array<string>, evidence_indices array<string>"""
MAX_EVIDENCE, MAX_SUPPORT = 2, 4


def status_form(value: Column) -> Column:
    """active or inactive; "inactive" is looked for first because it contains "active"."""
    s = F.lower(F.trim(blank(value)))
    return F.when(s == "active", "active").when(s.contains("inactive"), "inactive").when(s.contains("active"), "active").otherwise("inactive")


def _first_filled(*arrays: Column) -> Column:
    filled = [F.when(F.size(a) > 0, a) for a in arrays]
    return F.coalesce(*filled)


def _first_text(*texts: Column) -> Column:
    """First text that is not empty, then trimmed (a blank one still counts as given)."""
    return F.trim(blank(F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])))


def anchors(items: Column, evidence: int = MAX_EVIDENCE) -> Column:
    """Anchors of a JSON array whose items are objects or bare labels; items without label drop out."""

    def one(item):
        obj = F.when(item.startswith("{"), F.from_json(item, ANCHOR))
        label = F.when(obj.isNotNull(), _first_text(obj["label"], obj["interest"])).otherwise(F.trim(item))
        given = _first_filled(obj["evidence_post_indices"], obj["representative_evidence_post_indices"], obj["evidence_indices"])
        indices = F.coalesce(distinct_ints(given, evidence), F.array().cast("array<bigint>"))
        return F.struct(label.alias("label"), indices.alias("evidence_post_indices"))

    none = F.array().cast("array<struct<label:string,evidence_post_indices:array<bigint>>>")
    return F.coalesce(F.filter(F.transform(items, one), lambda a: a["label"] != ""), none)


def normalized(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Prediction columns of a parsed model answer (``PARSED``). Inactive ones keep nothing."""
    p = F.col(parsed)
    active = F.col("pred_status") == "active"
    no_anchor = F.array().cast("array<struct<label:string,evidence_post_indices:array<bigint>>>")
    no_index = F.array().cast("array<bigint>")
    support = distinct_ints(_first_filled(p["summary_support_post_indices"], p["evidence_post_indices"], p["evidence_post_indices_representative"]), MAX_SUPPORT)
    return (
        rows.withColumn("pred_status", status_form(p["status"]))
        .withColumn("pred_summary_natural", F.when(active, _first_text(p["summary_natural_pred"], p["summary"], p["domain_summary"])).otherwise(""))
        .withColumn("pred_long_term_anchors", F.when(active, anchors(_first_filled(p["long_term_interest_tags"], p["long_term_interest_anchors"]))).otherwise(no_anchor))
        .withColumn("pred_short_term_anchors", F.when(active, anchors(_first_filled(p["short_term_interest_tags"], p["short_term_interest_anchors"]))).otherwise(no_anchor))
        .withColumn("pred_summary_support_post_indices", F.when(active, F.coalesce(support, no_index)).otherwise(no_index))
        .drop(parsed)
    )


def with_fallback(tasks: DataFrame, predictions: DataFrame, error: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Every task of a run, with an inactive prediction and an error where none came back; ``by`` names more key columns, such as the model."""
    joined = tasks.join(predictions, [*by, "task_id"], "left")
    missing = F.col("pred_status").isNull()
    return joined.withColumn("error", F.when(missing, error).otherwise(F.col("error"))).withColumn("pred_status", F.coalesce("pred_status", F.lit("inactive")))


def reusable(error: Column, retry_mode: Column, retry_version: Column) -> Column:
    """No error, and compact retries only of the current context version."""
    compact = F.coalesce(F.trim(retry_mode).isin(*COMPACT_RETRY_MODES), F.lit(False))
    current = F.coalesce(F.trim(retry_version) == RETRY_CONTEXT_VERSION, F.lit(False))
    return nonblank(error).isNull() & (~compact | current)


def same_run(rows: DataFrame, visual_mode: str, input_mode: str, method: str) -> DataFrame:
    """Reusable rows of exactly this run configuration and protocol."""
    wanted = {"visual_mode": visual_mode, "profile_input_mode": input_mode, "profile_method": method, "profile_eval_protocol_version": PROTOCOL_VERSION}
    keep = reusable(F.col("error"), F.col("retry_mode"), F.col("retry_context_version"))
    for name, value in wanted.items():
        keep = keep & (F.col(name) == value)
    return rows.filter(keep)


def pending(tasks: DataFrame, reusable_rows: DataFrame, user_level: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Tasks without a reusable row; user-level methods redo all tasks of such users. ``by`` names more key columns."""
    key, user = [*by, "task_id"], [*by, "source_tag", "user_id"]
    open_tasks = tasks.join(reusable_rows.select(*key), key, "left_anti")
    if not user_level:
        return open_tasks
    return tasks.join(open_tasks.select(*user).distinct(), user, "left_semi")


def _any_of(text: Column, needles: list[str]) -> Column:
    return F.lower(F.trim(blank(text))).rlike("|".join(needles))


def error_class(message: Column) -> Column:
    """First matching class of a provider error message, null for others."""
    return (
        F.when(_any_of(message, CONTEXT_LIMIT), "context_limit")
        .when(_any_of(message, DATA_INSPECTION), "data_inspection")
        .when(_any_of(message, TRANSPORT_TIMEOUT), "transport_timeout")
        .when(_any_of(message, PROVIDER_BLOCK), "provider_block")
    )


def error_flags(message: Column) -> list[Column]:
    """All classes side by side, as they overlap."""
    return [
        _any_of(message, CONTEXT_LIMIT).alias("context_limit"),
        _any_of(message, DATA_INSPECTION).alias("data_inspection"),
        _any_of(message, TRANSPORT_TIMEOUT).alias("transport_timeout"),
        _any_of(message, PROVIDER_BLOCK).alias("provider_block"),
    ]


def merged_anchors(long: Column, short: Column, merged: Column | None = None) -> Column:
    """Long and short anchors in one list with their bucket, unless a merged list is given."""

    def tagged(items, bucket):
        kept = F.filter(F.coalesce(items, F.array()), lambda a: F.trim(blank(a["label"])) != "")
        return F.transform(
            kept,
            lambda a: F.struct(
                F.trim(a["label"]).alias("label"),
                F.slice(F.array_distinct(a["evidence_post_indices"]), 1, MAX_EVIDENCE).alias("evidence_post_indices"),
                F.lit(bucket).alias("source_bucket"),
            ),
        )

    both = F.concat(tagged(long, "long"), tagged(short, "short"))
    if merged is None:
        return both
    own = tagged(merged, "merged")
    return F.when(F.size(own) > 0, own).otherwise(both)


def gold_notes(weak_labels: Column, uncertainty: Column) -> Column:
    """Notes for the judge from dropped weak labels and the uncertainty note."""
    listed = F.concat(F.lit("Weak signals not to reward: ['"), F.array_join(weak_labels, "', '"), F.lit("']"))
    weak = F.when(F.size(weak_labels) > 0, listed)
    note = F.when(nonblank(uncertainty).isNotNull(), F.concat(F.lit("Uncertainty: "), F.trim(uncertainty)))
    return F.concat_ws("\n", weak, note)


def precheck(rows: DataFrame) -> DataFrame:
    """Format errors of canonical predictions ``(status, anchors, support, n_posts)``.

    Hard failures are an invalid status and any index outside the user's posts.
    """
    n = F.col("n_posts")

    def outside(i):
        return (i < 0) | (i > n - 1)

    def anchor_errors(a, i):
        at = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        bad = F.transform(
            F.filter(a["evidence_post_indices"], outside),
            lambda x: F.concat(F.lit("anchor_evidence_oob"), at, F.lit("="), x.cast("string")),
        )
        own = F.array_compact(
            F.array(
                F.when(F.trim(a["label"]) == "", F.concat(F.lit("empty_anchor_label"), at)),
                F.when(F.size(a["evidence_post_indices"]) > MAX_EVIDENCE, F.concat(F.lit("too_many_anchor_evidence"), at)),
            )
        )
        return F.concat(own, bad)

    support_bad = F.transform(F.filter("support", outside), lambda x: F.concat(F.lit("summary_support_oob="), x.cast("string")))
    errors = F.concat(
        F.array_compact(F.array(F.when(~F.col("status").isin("active", "inactive"), "invalid_status"))),
        F.flatten(F.transform("anchors", anchor_errors)),
        F.array_compact(F.array(F.when(F.size("support") > MAX_SUPPORT, "too_many_summary_support"))),
        support_bad,
    )
    hard = F.exists("format_errors", lambda e: (e == "invalid_status") | e.startswith("anchor_evidence_oob") | e.startswith("summary_support_oob"))
    return rows.withColumn("format_errors", errors).withColumn("precheck_valid", F.size("format_errors") == 0).withColumn("hard_fail", hard)


def exact_matches(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Matched labels per task when only equal normalised labels match.

    Equal labels pair up one to one, so each label gives the smaller of its two counts.
    """
    g = gold.withColumn("l", match_label(F.col("label"))).filter("l is not null").groupBy("task_id", "l").agg(F.count("*").alias("g"))
    p = pred.withColumn("l", match_label(F.col("label"))).filter("l is not null").groupBy(*keys, "l").agg(F.count("*").alias("p"))
    return p.join(g, ["task_id", "l"]).groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("tp"))


def judged_edges(gold: DataFrame, pred: DataFrame, judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Matching pairs of label positions: equal labels, or labels judged to be the same interest.

    ``judgements``: ``(domain, label_a, label_b)`` of positive verdicts with ``label_a <= label_b``.
    Joins run on label keys; pairs that nobody judged are never built.
    """
    g = gold.select("task_id", "domain", F.col("position").alias("g"), match_label(F.col("label")).alias("gl"))
    p = pred.select(*keys, F.col("position").alias("p"), match_label(F.col("label")).alias("pl"))
    equal = g.join(p.withColumnRenamed("pl", "gl"), ["task_id", "gl"]).select(*keys, "g", "p")
    both = judgements.select("domain", F.col("label_a").alias("gl"), F.col("label_b").alias("pl"))
    both = both.union(judgements.select("domain", F.col("label_b"), F.col("label_a"))).distinct()
    judged = g.join(both, ["domain", "gl"]).join(p, ["task_id", "pl"]).select(*keys, "g", "p")
    return equal.union(judged).distinct()


def judgement_key(domain: Column, a: Column, b: Column) -> list[Column]:
    """Symmetric identity of a judged pair, for reuse: domain and the two labels in order."""
    la, lb = blank(match_label(a)), blank(match_label(b))
    return [F.lower(F.trim(domain)).alias("domain"), F.least(la, lb).alias("label_a"), F.greatest(la, lb).alias("label_b")]


def maximum_matching(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Maximum one-to-one matching of each bipartite graph, as ``keys, g, p`` pairs.

    Rounds of breadth-first search from all unmatched g at once. Every vertex joins one
    search tree only, so the trees are disjoint and each may flip one path. When no tree
    ends at an unmatched p, the matching is maximum. All state is in tables.
    """
    edges = cut_lineage(edges.select(*keys, "g", "p").distinct())
    by_g, by_p = [*keys, "g"], [*keys, "p"]
    # Start: each p proposes to its smallest g, each g takes its smallest proposer.
    proposals = edges.groupBy(*by_p).agg(F.min("g").alias("g"))
    mates = cut_lineage(proposals.groupBy(*by_g).agg(F.min("p").alias("p")))
    while True:
        free = edges.select(*by_g).distinct().join(mates, by_g, "left_anti")
        frontier = cut_lineage(free.withColumn("root", F.col("g")))
        tree = edges.limit(0).select(*by_p, F.col("g").alias("parent"), F.col("g").alias("root"), F.lit(0).alias("depth"))
        depth = 0
        while not frontier.isEmpty():
            reached = frontier.join(edges, by_g).join(tree, by_p, "left_anti")
            fresh = reached.groupBy(*by_p).agg(F.min(F.struct("root", "g")).alias("via"))
            fresh = fresh.select(*by_p, F.col("via.g").alias("parent"), F.col("via.root").alias("root"), F.lit(depth).alias("depth"))
            tree = cut_lineage(tree.unionByName(fresh))
            newest = tree.filter(F.col("depth") == depth)
            frontier = cut_lineage(newest.join(mates, by_p).select(*by_g, "root"))
            depth += 1
        ends = tree.join(mates, by_p, "left_anti").groupBy(*keys, "root").agg(F.min(F.struct("depth", "p")).alias("e"))
        step = cut_lineage(ends.select(*keys, F.col("e.p").alias("p")))
        if step.isEmpty():
            return mates
        flipped = None
        while not step.isEmpty():
            taken = cut_lineage(step.join(tree, by_p).select(*by_p, F.col("parent").alias("g")))
            flipped = taken if flipped is None else flipped.unionByName(taken)
            step = taken.select(*by_g).join(mates, by_g).select(*by_p)
            step = cut_lineage(step)
        mates = cut_lineage(mates.join(flipped.select(*by_g), by_g, "left_anti").select(*by_g, "p").unionByName(flipped.select(*by_g, "p")))


def match_outcomes(rows: DataFrame) -> DataFrame:
    """tp, fp, fn and rates per scored row with ``gold_status, status, hard_fail, n_gold, n_pred, tp``.

    Inactive gold gives zeros. Predicted labels count only for valid active predictions.
    """
    active = F.col("gold_status") == "active"
    usable = ~F.col("hard_fail") & (F.col("status") == "active")
    n_gold = F.coalesce("n_gold", F.lit(0))
    n_pred = F.when(usable, F.coalesce("n_pred", F.lit(0))).otherwise(0)
    tp = F.when(active & usable, F.coalesce("tp", F.lit(0))).otherwise(0)
    out = rows.withColumn("_tp", tp).withColumn("_fp", F.when(active, n_pred - tp).otherwise(0)).withColumn("_fn", F.when(active, n_gold - tp).otherwise(0))
    empty = active & (n_gold == 0) & (n_pred == 0)
    p = F.when(empty, 1.0).otherwise(ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")))
    r = F.when(empty, 1.0).otherwise(ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")))
    return (
        out.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .withColumn("exact", active & (F.col("_fp") == 0) & (F.col("_fn") == 0))
        .drop("tp")
        .withColumnsRenamed({"_tp": "tp", "_fp": "fp", "_fn": "fn"})
    )


def skip_reason(error: Column, is_reusable: Column) -> Column:
    """Why a task is left out of the metrics. A missing prediction is no reason: it counts as inactive."""
    return F.when(nonblank(error).isNotNull(), F.trim(error)).when(~is_reusable, "stale_prediction_cache")


def metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts, micro and macro rates per model. Skipped rows only count as skipped."""
    scored = F.col("skip_reason").isNull()
    active = scored & (F.col("gold_status") == "active")
    pred_active = scored & (F.col("status") == "active")

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    def total(name):
        return F.sum(F.when(active, F.col(name)).otherwise(0))

    def mean(value):
        return F.coalesce(F.avg(F.when(active, value)), F.lit(0.0))

    agg = outcomes.groupBy(*by).agg(
        n(scored).alias("n_tasks"),
        F.count("*").alias("n_tasks_total"),
        n(~scored).alias("n_tasks_skipped"),
        n(active).alias("n_active_tasks"),
        n(active & pred_active).alias("_stp"),
        n(pred_active & ~active).alias("_sfp"),
        n(active & ~pred_active).alias("_sfn"),
        total("tp").alias("anchor_tp"),
        total("fp").alias("anchor_fp"),
        total("fn").alias("anchor_fn"),
        mean(F.col("precision")).alias("macro_precision"),
        mean(F.col("recall")).alias("macro_recall"),
        mean(F.col("f1")).alias("macro_f1"),
        mean(F.col("exact").cast("double")).alias("exact_accuracy"),
    )
    for name, (tp, fp, fn) in {"active": ("_stp", "_sfp", "_sfn"), "interest_tag": ("anchor_tp", "anchor_fp", "anchor_fn")}.items():
        agg = agg.withColumn(f"{name}_precision", ratio(F.col(tp), F.col(tp) + F.col(fp)))
        agg = agg.withColumn(f"{name}_recall", ratio(F.col(tp), F.col(tp) + F.col(fn)))
        agg = agg.withColumn(f"{name}_f1", f1(F.col(f"{name}_precision"), F.col(f"{name}_recall")))
    return agg.drop("_stp", "_sfp", "_sfn")


def binary_rates(rows: DataFrame, gold: Column, pred: Column, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of a yes/no label."""
    agg = rows.groupBy(*by).agg(
        F.sum((gold & pred).cast("long")).alias("tp"), F.sum((~gold & pred).cast("long")).alias("fp"), F.sum((gold & ~pred).cast("long")).alias("fn")
    )
    agg = agg.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return agg.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def unmatched_labels(labels: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Labels whose position is in no matched pair."""
    return labels.join(matched.select(*keys, "position"), [*keys, "position"], "left_anti")


def oracle_predictions(gold: DataFrame, model: str = "mock_oracle") -> DataFrame:
    """Predictions that copy the gold labels: the self-check of the scoring (F1 = 1)."""
    return gold.withColumn("model", F.lit(model))


def complete_runs(metric_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per batch: is every expected model's metrics row valid? Only then is a merged report made."""
    joined = expected.join(metric_rows, ["batch", "model"], "left")
    valid = (
        (F.lower("profile_method") == F.lower("expected_method"))
        & (F.col("profile_eval_protocol_version") == PROTOCOL_VERSION)
        & (F.col("n_tasks") == F.col("expected_n_tasks"))
        & (F.coalesce("n_tasks_skipped", F.lit(0)) == 0)
    )
    return joined.withColumn("valid", F.coalesce(valid, F.lit(False))).groupBy("batch").agg(
        F.sum(F.col("valid").cast("long")).alias("n_valid"), F.count("*").alias("n_models"), F.bool_and("valid").alias("complete")
    )
