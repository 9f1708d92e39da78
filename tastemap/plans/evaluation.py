"""Profile evaluation over label tables derived from events, documents and labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import evaluation as ev
from ..operators import judging
from ..session import load, shared_folder
from ..sources import config, readers
from .adapters import REC, events, pick, sql_list
from .registry import query

STATUSES = ["Inactive (no signal)", " ACTIVE", "probably active", "active", "none", "active", "active"]
STATUS_FORMS = ["inactive", "active", "active", "active", "inactive", "active", "active"]
ERRORS = [
    "", "HTTP 400: maximum context length is 128k", "DataInspectionFailed: inappropriate content", "requests.ReadTimeout: Read timed out.",
    "blocked by content_policy", "HTTP 500", "Input length exceeds the range of input length",
]


def tasks(spark, sf):
    """One task per (user, event type); every fifth user's gold is inactive."""
    e = events(spark, sf)
    n_posts = e.groupBy("user_id").agg(F.count("*").alias("n_posts"))
    t = e.select("user_id", F.col("post_type").alias("domain")).distinct().join(n_posts, "user_id")
    status = F.when(F.col("user_id") % 5 == 0, "inactive").otherwise("active")
    return t.withColumn("task_id", _task_id()).withColumn("gold_status", status)


def _task_id():
    return F.concat(F.lit("set__"), "user_id", F.lit("__"), "domain")


def gold_labels(spark, sf):
    e = events(spark, sf).filter(F.col("post_id") % 3 != 0).withColumn("domain", F.col("post_type"))
    return e.select("user_id", "domain", "k").distinct().withColumn("task_id", _task_id()).withColumn("label", F.concat(F.lit("Topic-"), "k")).withColumnRenamed("k", "position")


def predictions(spark, sf):
    """Two models; some predictions are missing, failed, or of an old retry version."""
    u = F.col("user_id")
    t = tasks(spark, sf)
    models = t.withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta")))).filter(~((u % 13 == 0) & (F.col("model") == "beta")))
    return models.select(
        "model", "task_id", "user_id", "domain", "gold_status", "n_posts", ev.status_form(pick(STATUSES, u % 7)).alias("status"),
        F.when(u % 11 == 0, "HTTP 429").otherwise("").alias("error"), F.when(u % 19 == 0, "compact_context").alias("retry_mode"),
        F.when(u % 38 == 0, ev.RETRY_CONTEXT_VERSION).alias("retry_context_version"),
    )


def predicted_labels(spark, sf):
    e = events(spark, sf).withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))
    chosen = F.when(F.col("model") == "alpha", F.col("post_id") % 3 != 1).otherwise(F.col("post_id") % 4 != 1)
    e = e.filter(chosen).withColumn("domain", F.col("post_type"))
    rows = e.select("model", "user_id", "domain", "k").distinct().withColumn("task_id", _task_id())
    return rows.withColumn("label", F.concat(F.lit("topic "), "k")).withColumn("evidence", F.when(F.col("user_id") % 17 == 0, F.lit(100000)).otherwise(F.lit(0))).withColumnRenamed("k", "position")


LABELS = f"""{REC}, tk AS (
  SELECT user_id, post_type AS domain, 'set__' || user_id || '__' || post_type AS task_id, CASE WHEN user_id % 5 = 0 THEN 'inactive' ELSE 'active' END AS gold_status FROM ev GROUP BY ALL
), np AS (SELECT user_id, count(*) AS n_posts FROM ev GROUP BY 1
), gl AS (SELECT DISTINCT user_id, post_type AS domain, k FROM ev WHERE post_id % 3 <> 0
), pl AS (SELECT DISTINCT 'alpha' AS model, user_id, post_type AS domain, k FROM ev WHERE post_id % 3 <> 1
  UNION ALL SELECT DISTINCT 'beta', user_id, post_type, k FROM ev WHERE post_id % 4 <> 1
), pr AS (
  SELECT model, tk.*, list_extract({sql_list(STATUS_FORMS)}, 1 + user_id % 7) AS status, user_id % 11 = 0 AS failed, user_id % 19 = 0 AND user_id % 38 <> 0 AS stale, user_id % 17 = 0 AS oob
  FROM tk, (VALUES ('alpha'), ('beta')) m(model) WHERE NOT (user_id % 13 = 0 AND model = 'beta')
), ng AS (SELECT user_id, domain, count(*) AS n_gold FROM gl GROUP BY ALL
), npred AS (SELECT model, user_id, domain, count(*) AS n_pred FROM pl GROUP BY ALL
), tps AS (SELECT model, user_id, domain, count(*) AS tp FROM pl JOIN gl USING (user_id, domain, k) GROUP BY ALL
), allt AS (SELECT m.model, tk.* FROM tk, (VALUES ('alpha'), ('beta')) m(model)
), o0 AS (
  SELECT a.model, a.user_id, a.domain, a.task_id, a.gold_status, coalesce(p.status, 'inactive') AS status,
    CASE WHEN p.failed THEN 'HTTP 429' WHEN p.stale THEN 'stale_prediction_cache' END AS skip_reason,
    coalesce(p.oob AND n_pred > 0 AND p.status = 'active', false) AS hard_fail, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred0, coalesce(tp, 0) AS tp0
  FROM allt a LEFT JOIN pr p USING (model, task_id) LEFT JOIN ng ON ng.user_id = a.user_id AND ng.domain = a.domain
  LEFT JOIN npred q ON q.model = a.model AND q.user_id = a.user_id AND q.domain = a.domain LEFT JOIN tps t ON t.model = a.model AND t.user_id = a.user_id AND t.domain = a.domain
), o1 AS (SELECT *, gold_status = 'active' AS act, CASE WHEN NOT hard_fail AND status = 'active' THEN n_pred0 ELSE 0 END AS n_pred, CASE WHEN NOT hard_fail AND status = 'active' AND gold_status = 'active' THEN tp0 ELSE 0 END AS tp FROM o0
), o2 AS (SELECT *, CASE WHEN act THEN n_pred - tp ELSE 0 END AS fp, CASE WHEN act THEN n_gold - tp ELSE 0 END AS fn, act AND n_gold = 0 AND n_pred = 0 AS empty FROM o1
), o3 AS (SELECT *, CASE WHEN empty THEN 1.0::DOUBLE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN empty THEN 1.0::DOUBLE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM o2
), oc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1, act AND fp = 0 AND fn = 0 AS exact FROM o3)"""


def outcomes(spark, sf):
    t = tasks(spark, sf)
    every = t.withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))
    given = predictions(spark, sf).select("model", "task_id", "status", "error", "retry_mode", "retry_context_version")
    rows = every.join(given, ["model", "task_id"], "left")
    reason = ev.skip_reason(F.col("error"), ev.reusable(F.col("error"), F.col("retry_mode"), F.col("retry_context_version")))
    rows = rows.withColumn("skip_reason", reason).withColumn("status", F.coalesce("status", F.lit("inactive")))
    gold, pred = gold_labels(spark, sf), predicted_labels(spark, sf)
    counts = pred.groupBy("model", "task_id").agg(F.count("*").alias("n_pred"), F.max("evidence").alias("evidence"))
    rows = rows.join(counts, ["model", "task_id"], "left").join(gold.groupBy("task_id").agg(F.count("*").alias("n_gold")), "task_id", "left")
    rows = rows.join(ev.exact_matches(gold, pred, ["model", "task_id"]), ["model", "task_id"], "left")
    outside = (F.col("status") == "active") & (F.col("evidence") > F.col("n_posts") - 1)
    return ev.match_outcomes(rows.withColumn("hard_fail", F.coalesce(outside, F.lit(False))))


@query("match_outcomes", f"""WITH {LABELS} SELECT model, task_id, skip_reason, tp, fp, fn, round(p + 1e-10, 6) AS precision, round(r + 1e-10, 6) AS recall, round(f1 + 1e-10, 6) AS f1, exact FROM oc""")
def match_outcomes(spark, sf):
    o = outcomes(spark, sf)
    return o.select("model", "task_id", "skip_reason", "tp", "fp", "fn", *[round6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "exact")


@query("exact_label_matches", f"WITH {LABELS} SELECT model, 'set__' || user_id || '__' || domain AS task_id, tp FROM tps")
def exact_label_matches(spark, sf):
    return ev.exact_matches(gold_labels(spark, sf), predicted_labels(spark, sf), ["model", "task_id"])


RATES = ["active_precision", "active_recall", "active_f1", "interest_tag_precision", "interest_tag_recall", "interest_tag_f1", "macro_precision", "macro_recall", "macro_f1", "exact_accuracy"]


@query("profile_metrics", f"""WITH {LABELS}, m AS (
  SELECT model, count(*) FILTER (skip_reason IS NULL) AS n_tasks, count(*) AS n_tasks_total, count(*) FILTER (skip_reason IS NOT NULL) AS n_tasks_skipped,
    count(*) FILTER (skip_reason IS NULL AND act) AS n_active_tasks, count(*) FILTER (skip_reason IS NULL AND act AND status = 'active') AS stp,
    count(*) FILTER (skip_reason IS NULL AND NOT act AND status = 'active') AS sfp, count(*) FILTER (skip_reason IS NULL AND act AND status <> 'active') AS sfn,
    CAST(coalesce(sum(tp) FILTER (skip_reason IS NULL AND act), 0) AS BIGINT) AS anchor_tp, CAST(coalesce(sum(fp) FILTER (skip_reason IS NULL AND act), 0) AS BIGINT) AS anchor_fp, CAST(coalesce(sum(fn) FILTER (skip_reason IS NULL AND act), 0) AS BIGINT) AS anchor_fn,
    avg(p) FILTER (skip_reason IS NULL AND act) AS mp, avg(r) FILTER (skip_reason IS NULL AND act) AS mr, avg(f1) FILTER (skip_reason IS NULL AND act) AS mf, avg(exact::INT) FILTER (skip_reason IS NULL AND act) AS ex
  FROM oc GROUP BY model
), q AS (SELECT *, stp::DOUBLE / (stp + sfp) AS ap, stp::DOUBLE / (stp + sfn) AS ar, anchor_tp::DOUBLE / (anchor_tp + anchor_fp) AS ip, anchor_tp::DOUBLE / (anchor_tp + anchor_fn) AS ir FROM m)
SELECT model, n_tasks, n_tasks_total, n_tasks_skipped, n_active_tasks, anchor_tp, anchor_fp, anchor_fn, round(ap + 1e-10, 6) AS active_precision, round(ar + 1e-10, 6) AS active_recall, round(2 * ap * ar / (ap + ar) + 1e-10, 6) AS active_f1,
  round(ip + 1e-10, 6) AS interest_tag_precision, round(ir + 1e-10, 6) AS interest_tag_recall, round(2 * ip * ir / (ip + ir) + 1e-10, 6) AS interest_tag_f1,
  round(mp + 1e-10, 6) AS macro_precision, round(mr + 1e-10, 6) AS macro_recall, round(mf + 1e-10, 6) AS macro_f1, round(ex + 1e-10, 6) AS exact_accuracy FROM q""")
def profile_metrics(spark, sf):
    m = ev.metrics(outcomes(spark, sf), ["model"])
    return m.select("model", "n_tasks", "n_tasks_total", "n_tasks_skipped", "n_active_tasks", "anchor_tp", "anchor_fp", "anchor_fn", *[round6(F.col(c)).alias(c) for c in RATES])


@query("skipped_tasks", f"WITH {LABELS} SELECT model, skip_reason, count(*) AS n FROM oc WHERE skip_reason IS NOT NULL GROUP BY ALL")
def skipped_tasks(spark, sf):
    return outcomes(spark, sf).filter("skip_reason is not null").groupBy("model", "skip_reason").agg(F.count("*").alias("n"))


@query("oracle_self_check", f"WITH {LABELS} SELECT 'mock_oracle' AS model, task_id, 1.0::DOUBLE AS f1, true AS exact FROM tk")
def oracle_self_check(spark, sf):
    """Gold labels as predictions: every task must come out exact."""
    gold = gold_labels(spark, sf)
    pred = ev.oracle_predictions(gold)
    n = gold.groupBy("task_id").agg(F.count("*").alias("n_gold"))
    rows = tasks(spark, sf).withColumn("model", F.lit("mock_oracle")).withColumn("gold_status", F.lit("active")).withColumn("status", F.lit("active")).withColumn("hard_fail", F.lit(False))
    rows = rows.join(n, "task_id", "left").withColumn("n_pred", F.col("n_gold")).join(ev.exact_matches(gold, pred, ["model", "task_id"]), ["model", "task_id"], "left")
    return ev.match_outcomes(rows).select("model", "task_id", round6(F.col("f1")).alias("f1"), "exact")


@query("judged_matching", f"""WITH {LABELS}, b AS (
  SELECT model, user_id, domain, k // 2 AS pair, bool_or(g AND k % 2 = 0) AS g0, bool_or(g AND k % 2 = 1) AS g1, bool_or(p AND k % 2 = 0) AS p0, bool_or(p AND k % 2 = 1) AS p1 FROM (
    SELECT model, user_id, domain, k, false AS g, true AS p FROM pl UNION ALL SELECT m.model, user_id, domain, k, true, false FROM gl, (VALUES ('alpha'), ('beta')) m(model)) GROUP BY ALL)
SELECT model, 'set__' || user_id || '__' || domain AS task_id,
  CAST(sum(greatest((g0 AND p0)::INT + (g1 AND p1)::INT, (g0 AND p1)::INT + (g1 AND p0)::INT)) AS BIGINT) AS tp FROM b GROUP BY ALL HAVING tp > 0""")
def judged_matching(spark, sf):
    """Labels with an even number and the next odd number are judged to be the same interest."""
    gold, pred = gold_labels(spark, sf), predicted_labels(spark, sf)
    k = F.col("position")
    verdicts = gold.filter(k % 2 == 0).select(*ev.judgement_key(F.col("domain"), F.concat(F.lit("topic "), k), F.concat(F.lit("topic "), k + 1))).distinct()
    edges = ev.judged_edges(gold, pred, verdicts, ["model", "task_id"])
    return ev.maximum_matching(edges, ["model", "task_id"]).groupBy("model", "task_id").agg(F.count("*").alias("tp"))


@query("unmatched_gold_labels", f"""WITH {LABELS} SELECT m.model, 'set__' || g.user_id || '__' || g.domain AS task_id, k AS position FROM gl g, (VALUES ('alpha'), ('beta')) m(model)
WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.model = m.model AND pl.user_id = g.user_id AND pl.domain = g.domain AND pl.k = g.k)""")
def unmatched_gold_labels(spark, sf):
    gold = gold_labels(spark, sf).withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))
    hit = predicted_labels(spark, sf).select("model", "task_id", "position")
    return ev.unmatched_labels(gold, hit, ["model", "task_id"]).select("model", "task_id", "position")


@query("judgement_keys", f"""WITH {LABELS} SELECT DISTINCT domain, least('topic ' || k, 'topic ' || (k * 7) % 100) AS label_a, greatest('topic ' || k, 'topic ' || (k * 7) % 100) AS label_b FROM gl""")
def judgement_keys(spark, sf):
    g = gold_labels(spark, sf)
    return g.select(*ev.judgement_key(F.concat(F.upper("domain"), F.lit(" ")), F.col("label"), F.concat(F.lit("Topic_"), F.col("position") * 7 % 100))).distinct()


@query("status_forms", f"""WITH {REC} SELECT post_id, list_extract({sql_list(STATUS_FORMS)}, 1 + k % 7) AS status FROM ev""")
def status_forms(spark, sf):
    return events(spark, sf).select("post_id", ev.status_form(pick(STATUSES, F.col("k") % 7)).alias("status"))


@query("error_classes", f"""WITH {REC}, m AS (SELECT post_id, k % 7 AS c FROM ev)
SELECT post_id, CASE c WHEN 1 THEN 'context_limit' WHEN 2 THEN 'data_inspection' WHEN 3 THEN 'transport_timeout' WHEN 4 THEN 'provider_block' WHEN 6 THEN 'context_limit' END AS error_class,
  c IN (1, 6) AS context_limit, c = 2 AS data_inspection, c = 3 AS transport_timeout, c IN (2, 4) AS provider_block FROM m""")
def error_classes(spark, sf):
    message = pick(ERRORS, F.col("k") % 7)
    return events(spark, sf).select("post_id", ev.error_class(message).alias("error_class"), *ev.error_flags(message))


def _answers(spark, sf):
    """Model answers as JSON text, built from the events' numbers."""
    k = F.col("k")
    tag = F.struct(F.concat(F.lit("Tag "), k).alias("label"), F.array(k % 20, k % 20, (k * 3) % 20, k % 7).alias("evidence_post_indices"))
    alias = F.struct(F.concat(F.lit(" tag "), k + 1).alias("interest"), F.array(k % 5).alias("evidence_indices"))
    body = F.struct(
        pick(STATUSES, k % 7).alias("status"), F.when(k % 2 == 0, F.concat(F.lit(" sum "), k)).alias("summary"),
        F.array(tag).alias("long_term_interest_tags"), F.array(alias, alias).alias("short_term_interest_anchors"),
        F.array(k, k, k + 1, k + 2, k + 3, k + 4).alias("evidence_post_indices"),
    )
    return events(spark, sf).select("user_id", "post_id", F.to_json(body).alias("content"))


@query("normalized_predictions", f"""WITH {REC}, s AS (SELECT *, list_extract({sql_list(STATUS_FORMS)}, 1 + k % 7) AS status FROM ev)
SELECT post_id, status AS pred_status, CASE WHEN status = 'active' AND k % 2 = 0 THEN 'sum ' || k ELSE '' END AS pred_summary_natural,
  CASE WHEN status = 'active' THEN 'Tag ' || k || ':' || (k % 20) || CASE WHEN (k * 3) % 20 <> k % 20 THEN ',' || (k * 3) % 20 WHEN k % 7 <> k % 20 THEN ',' || k % 7 ELSE '' END ELSE '' END AS long_anchors,
  CASE WHEN status = 'active' THEN 'tag ' || (k + 1) || ':' || (k % 5) || '|tag ' || (k + 1) || ':' || (k % 5) ELSE '' END AS short_anchors,
  CASE WHEN status = 'active' THEN k || ',' || (k + 1) || ',' || (k + 2) || ',' || (k + 3) ELSE '' END AS support FROM s""")
def normalized_predictions(spark, sf):
    rows = ev.normalized(_answers(spark, sf).withColumn("parsed", F.from_json("content", ev.PARSED)))

    def show(c):
        return F.array_join(F.transform(c, lambda a: F.concat(a["label"], F.lit(":"), F.array_join(a["evidence_post_indices"].cast("array<string>"), ","))), "|")

    return rows.select(
        "post_id", "pred_status", "pred_summary_natural", show("pred_long_term_anchors").alias("long_anchors"), show("pred_short_term_anchors").alias("short_anchors"),
        F.array_join(F.col("pred_summary_support_post_indices").cast("array<string>"), ",").alias("support"),
    )


@query("prediction_prechecks", f"""WITH {REC}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT e.post_id, e.k, n.n, CASE WHEN k % 9 = 0 THEN 'maybe' ELSE 'active' END AS st FROM ev e JOIN n USING (user_id)),
x AS (SELECT *, list_filter([CASE WHEN st = 'maybe' THEN 'invalid_status' END, CASE WHEN k % 4 = 0 THEN 'empty_anchor_label[0]' END, CASE WHEN k % 6 = 0 THEN 'too_many_anchor_evidence[0]' END,
  CASE WHEN k > n - 1 THEN 'anchor_evidence_oob[0]=' || k END, CASE WHEN k % 8 = 0 THEN 'too_many_summary_support' END, CASE WHEN k % 5 - 1 < 0 THEN 'summary_support_oob=-1' END], lambda v: v IS NOT NULL) AS e FROM c)
SELECT post_id, array_to_string(e, ';') AS format_errors, len(e) = 0 AS precheck_valid, st = 'maybe' OR k > n - 1 OR k % 5 = 0 AS hard_fail FROM x""")
def prediction_prechecks(spark, sf):
    e = events(spark, sf)
    k = F.col("k")
    n = e.groupBy("user_id").agg(F.count("*").alias("n_posts"))
    evidence = F.when(k % 6 == 0, F.array(k, F.lit(0), F.lit(1))).otherwise(F.array(k))
    anchor = F.struct(F.when(k % 4 == 0, " ").otherwise("x").alias("label"), evidence.alias("evidence_post_indices"))
    support = F.when(k % 8 == 0, F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0), k % 5 - 1)).otherwise(F.array(k % 5 - 1))
    rows = e.join(n, "user_id").withColumn("status", F.when(k % 9 == 0, "maybe").otherwise("active")).withColumn("anchors", F.array(anchor)).withColumn("support", support)
    return ev.precheck(rows).select("post_id", F.array_join("format_errors", ";").alias("format_errors"), "precheck_valid", "hard_fail")


@query("merged_anchors", f"""WITH {REC} SELECT post_id, CASE WHEN k % 3 = 0 THEN 'merged:m' || k ELSE 'long:a' || k || '|short:b' END AS anchors,
  concat_ws(chr(10), CASE WHEN k % 2 = 0 THEN 'Weak signals not to reward: [''w' || k || ''']' END, CASE WHEN k % 5 = 0 THEN 'Uncertainty: thin' END) AS notes FROM ev""")
def merged_anchors(spark, sf):
    k = F.col("k")
    none = F.array().cast("array<bigint>")

    def items(label):
        return F.array(F.struct(label.alias("label"), none.alias("evidence_post_indices")))

    empty = F.array().cast("array<struct<label:string,evidence_post_indices:array<bigint>>>")
    merged = F.when(k % 3 == 0, items(F.concat(F.lit("m"), k))).otherwise(empty)
    both = ev.merged_anchors(items(F.concat(F.lit(" a"), k)), F.concat(items(F.lit("b ")), items(F.lit(" "))), merged)
    notes = ev.gold_notes(F.when(k % 2 == 0, F.array(F.concat(F.lit("w"), k))), F.when(k % 5 == 0, " thin "))
    return events(spark, sf).select("post_id", F.array_join(F.transform(both, lambda a: F.concat(a["source_bucket"], F.lit(":"), a["label"])), "|").alias("anchors"), notes.alias("notes"))


@query("reusable_predictions", f"""WITH {LABELS} SELECT model, task_id FROM pr WHERE NOT failed AND NOT stale AND user_id % 3 <> 0""")
def reusable_predictions(spark, sf):
    u = F.col("user_id")
    p = predictions(spark, sf).withColumn("visual_mode", F.lit("native")).withColumn("profile_input_mode", F.when(u % 3 == 0, "text_only").otherwise("text_image_captions"))
    p = p.withColumn("profile_method", F.lit("direct")).withColumn("profile_eval_protocol_version", F.lit(ev.PROTOCOL_VERSION))
    return ev.same_run(p, "native", "text_image_captions", "direct").select("model", "task_id")


@query("pending_tasks", f"""WITH {LABELS}, ok AS (SELECT model, task_id FROM pr WHERE NOT failed AND NOT stale AND NOT (domain = 'view' AND user_id % 4 = 0)),
x AS (SELECT a.*, ok.task_id IS NULL AS open FROM allt a LEFT JOIN ok ON ok.model = a.model AND ok.task_id = a.task_id) SELECT model, task_id, open FROM x SEMI JOIN (SELECT model, user_id FROM x WHERE open) o USING (model, user_id)""")
def pending_tasks(spark, sf):
    """User-level pending work of both models: one open task reopens all tasks of its user."""
    t = tasks(spark, sf).withColumn("source_tag", F.lit("set")).withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))
    p = predictions(spark, sf)
    ok = p.filter(ev.reusable(F.col("error"), F.col("retry_mode"), F.col("retry_context_version")) & ~((F.col("domain") == "view") & (F.col("user_id") % 4 == 0)))
    again = ev.pending(t, ok, user_level=True, by=("model",))
    return again.join(ok.select("model", "task_id", F.lit(True).alias("done")), ["model", "task_id"], "left").select("model", "task_id", F.col("done").isNull().alias("open"))


@query("fallback_predictions", f"""WITH {LABELS} SELECT t.model, t.task_id, coalesce(p.status, 'inactive') AS pred_status, CASE WHEN p.task_id IS NULL THEN 'no_prediction' WHEN p.failed THEN 'HTTP 429' ELSE '' END AS error
FROM allt t LEFT JOIN pr p USING (model, task_id)""")
def fallback_predictions(spark, sf):
    p = predictions(spark, sf).select("model", "task_id", F.col("status").alias("pred_status"), "error")
    t = tasks(spark, sf).select("task_id", F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("model"))
    return ev.with_fallback(t, p, "no_prediction", by=("model",)).select("model", "task_id", "pred_status", "error")


@query("status_rates", """WITH x AS (SELECT lang, quality = 1 AS g, n_chars >= 2000 AS p FROM documents JOIN labels USING (doc_id)), c AS (
SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM x GROUP BY 1), d AS (
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS a, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS b FROM c)
SELECT lang, tp, fp, fn, round(a + 1e-10, 6) AS precision, round(b + 1e-10, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0.0::DOUBLE END + 1e-10, 6) AS f1 FROM d""")
def status_rates(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    r = ev.binary_rates(rows, F.col("quality") == 1, F.col("n_chars") >= 2000, ["lang"])
    return r.select("lang", "tp", "fp", "fn", *[round6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("complete_runs", f"""WITH {LABELS}, r AS (SELECT model, user_id % 4 AS batch, count(*) AS n, count(*) FILTER (failed AND user_id % 4 = 1) AS skipped FROM pr GROUP BY ALL),
e AS (SELECT user_id % 4 AS batch, count(*) AS n FROM tk GROUP BY 1), v AS (SELECT e.batch, m.model, coalesce(r.n = e.n AND r.skipped = 0, false) AS valid FROM e, (VALUES ('alpha'), ('beta'), ('gamma')) m(model) LEFT JOIN r ON r.batch = e.batch AND r.model = m.model WHERE NOT (m.model = 'gamma' AND e.batch = 0))
SELECT batch, count(*) FILTER (valid) AS n_valid, count(*) AS n_models, bool_and(valid) AS complete FROM v GROUP BY 1""")
def complete_runs(spark, sf):
    batch = (F.col("user_id") % 4).alias("batch")
    p = predictions(spark, sf)
    skipped = F.sum(F.when((F.col("error") != "") & (F.col("user_id") % 4 == 1), 1).otherwise(0))
    rows = p.groupBy("model", batch).agg(F.count("*").alias("n_tasks"), skipped.alias("n_tasks_skipped"))
    rows = rows.withColumn("profile_method", F.lit("Direct")).withColumn("profile_eval_protocol_version", F.lit(ev.PROTOCOL_VERSION))
    expected = tasks(spark, sf).groupBy(batch).agg(F.count("*").alias("expected_n_tasks")).withColumn("model", F.explode(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))))
    expected = expected.filter("not (model = 'gamma' and batch = 0)").withColumn("expected_method", F.lit("direct"))
    return ev.complete_runs(rows, expected)


def _verdicts(spark, sf):
    """Dialogue judgements as JSON text: some placeholders, some with a key missing."""
    k = F.col("k")
    zero = k % 10 == 0
    s = lambda n: F.when(zero, F.lit(0)).otherwise((k + n) % 7)
    full = F.to_json(F.struct(s(0).alias("interest_coverage"), s(1).alias("negative_avoidance"), s(2).alias("concreteness"), s(3).alias("fluency"), F.when(k % 20 == 0, "").otherwise("ok").alias("brief_rationale"), F.array().cast("array<string>").alias("unsupported_interests")))
    short = F.to_json(F.struct(s(0).alias("interest_coverage"), F.lit("x").alias("fluency")))
    return events(spark, sf).select(F.col("post_id").alias("request_key"), "k", F.when(k % 11 == 5, short).otherwise(full).alias("content"))


VERDICT = f"""{REC}, v AS (SELECT post_id AS request_key, k, k % 10 = 0 AS zero, k % 11 = 5 AS short FROM ev), w AS (SELECT *, CASE WHEN zero THEN 0 ELSE least(5, k % 7) END AS a, CASE WHEN zero THEN 0 ELSE least(5, (k + 1) % 7) END AS b, CASE WHEN zero THEN 0 ELSE least(5, (k + 2) % 7) END AS c, CASE WHEN zero THEN 0 ELSE least(5, (k + 3) % 7) END AS d FROM v),
y AS (SELECT *, CASE WHEN short THEN 'missing_scores' WHEN zero AND k % 20 = 0 THEN 'placeholder' ELSE 'valid' END AS state, round((0.40::DOUBLE * a + 0.25::DOUBLE * b + 0.20::DOUBLE * c + 0.15::DOUBLE * d) / 5 * 100 + 1e-10, 6) AS final FROM w)"""


@query("dialogue_verdicts", f"WITH {VERDICT} SELECT request_key, state, CASE WHEN state = 'valid' THEN final END AS final_dialogue_score FROM y")
def dialogue_verdicts(spark, sf):
    v = judging.dialogue_verdicts(_verdicts(spark, sf))
    return v.select("request_key", "state", round6(F.col("final_dialogue_score")).alias("final_dialogue_score"))


@query("judge_fallbacks", f"""WITH {VERDICT} SELECT request_key, CASE WHEN state = 'valid' AND k % 13 <> 0 THEN final ELSE 0.0::DOUBLE END AS final_dialogue_score, CASE WHEN state = 'valid' AND k % 13 <> 0 THEN 0 ELSE 1 END AS n_missed,
  CASE WHEN state = 'valid' AND k % 13 <> 0 THEN '' WHEN k % 2 = 0 THEN 'stopped by moderation' ELSE 'missing response' END AS judge_error, NOT (state = 'valid' AND k % 13 <> 0) AND k % 2 = 0 AS provider_blocked FROM y""")
def judge_fallbacks(spark, sf):
    rows = _verdicts(spark, sf)
    k = F.col("k")
    requests = rows.select("request_key", F.when(k % 2 == 0, "stopped by moderation").alias("error"), F.array(F.concat(F.lit("label "), k)).alias("core_labels"))
    given = judging.dialogue_verdicts(rows.filter(k % 13 != 0)).drop("k", "content", "brief_rationale")
    out = judging.with_judge_fallback(requests, given)
    return out.select("request_key", round6(F.col("final_dialogue_score")).alias("final_dialogue_score"), F.size("missed_core_interest_labels").alias("n_missed"), "judge_error", "provider_blocked")


@query("rubric_scores", f"""WITH {LABELS}, x AS (SELECT *, user_id % 6 AS a, (user_id * 3) % 8 AS b, user_id % 23 = 0 AS nojudge FROM oc), y AS (SELECT *, act AND NOT hard_fail AND status = 'active' AS judged FROM x),
z AS (SELECT *, CASE WHEN judged AND NOT nojudge THEN a ELSE 0 END AS s1, CASE WHEN judged AND NOT nojudge THEN least(5, b) ELSE 0 END AS s2 FROM y)
SELECT model, task_id, round((0.35::DOUBLE * s1 + 0.25::DOUBLE * s2 + 0.25::DOUBLE * s1) / 5 * 100 + 1e-10, 6) AS final_task_score,
  CASE WHEN judged AND NOT nojudge THEN CASE WHEN b = 7 THEN 2.0::DOUBLE * s1 + s2 ELSE least(20, CASE WHEN b * 3 <= 5 THEN b * 12 ELSE b * 3 END)::DOUBLE END ELSE 0.0::DOUBLE END AS judge_total_score,
  CASE WHEN hard_fail THEN false WHEN NOT act THEN status <> 'active' ELSE judged AND NOT nojudge END AS status_correct,
  CASE WHEN hard_fail THEN 'hard_fail_precheck' WHEN NOT act THEN 'inactive_task_not_scored' WHEN status <> 'active' THEN 'gold_active_but_prediction_not_active' WHEN nojudge THEN 'judge_error: timeout' ELSE 'fine' END AS brief_rationale FROM z""")
def rubric_scores(spark, sf):
    u = F.col("user_id")
    b = u * 3 % 8
    body = F.to_json(F.struct((u % 6).alias("anchor_correctness"), b.alias("anchor_coverage"), (u % 6).alias("evidence_grounding"), F.lit("bad").alias("summary_faithfulness"), F.when(b != 7, b * 3).alias("judge_total_score"), F.lit(" fine ").alias("brief_rationale")))
    rows = outcomes(spark, sf).withColumn("content", F.when(u % 23 != 0, body)).withColumn("error", F.lit("timeout"))
    return judging.rubric_scores(rows).select("model", "task_id", round6(F.col("final_task_score")).alias("final_task_score"), "judge_total_score", "status_correct", "brief_rationale")


RUBRIC = f"""{LABELS}, x AS (SELECT *, user_id % 6 AS a, (user_id * 3) % 8 AS b, user_id % 23 = 0 AS nojudge FROM oc), y AS (SELECT *, act AND NOT hard_fail AND status = 'active' AS judged FROM x),
z AS (SELECT *, CASE WHEN judged AND NOT nojudge THEN a ELSE 0 END AS s1, CASE WHEN judged AND NOT nojudge THEN least(5, b) ELSE 0 END AS s2,
  CASE WHEN hard_fail THEN false WHEN NOT act THEN status <> 'active' ELSE judged AND NOT nojudge END AS ok FROM y)"""


@query("rubric_report", f"""WITH {RUBRIC} SELECT model, count(*) AS n_tasks, count(*) FILTER (act) AS n_active_tasks, count(*) FILTER (ok) AS n_status_correct, round(avg(s1) FILTER (act) + 1e-10, 6) AS anchor_correctness, round(avg(s2) FILTER (act) + 1e-10, 6) AS anchor_coverage,
  0.0::DOUBLE AS summary_faithfulness, round(avg((0.35::DOUBLE * s1 + 0.25::DOUBLE * s2 + 0.25::DOUBLE * s1) / 5 * 100) FILTER (act) / 100 + 1e-10, 6) AS benchmark_main_score FROM z GROUP BY model""")
def rubric_report(spark, sf):
    u = F.col("user_id")
    body = F.to_json(F.struct((u % 6).alias("anchor_correctness"), (u * 3 % 8).alias("anchor_coverage"), (u % 6).alias("evidence_grounding"), F.lit("bad").alias("summary_faithfulness")))
    rows = outcomes(spark, sf).withColumn("content", F.when(u % 23 != 0, body)).withColumn("error", F.lit("timeout"))
    r = judging.rubric_report(judging.rubric_scores(rows), ["model"])
    means = [round6(F.col(f"active_{k}_mean")).alias(k) for k in ("anchor_correctness", "anchor_coverage", "summary_faithfulness")]
    return r.select("model", "n_tasks", "n_active_tasks", "n_status_correct", *means, round6(F.col("benchmark_main_score")).alias("benchmark_main_score"))


@query("cached_judgements", """WITH k AS (SELECT doc_id, sha256('{"gold":{"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '},"judge_model":"judge-' || doc_id % 2 || '","pred":{"lang":"' || lang || '"},"prompt_version":"v2","task_id":"' || doc_id || '"}') AS cache_key FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, cache_key, CASE WHEN doc_id % 3 = 0 THEN 'new ' || doc_id END AS content, doc_id % 3 = 0 AS from_cache FROM k""")
def cached_judgements(spark, sf):
    """Every third request was answered twice; the newer answer counts. Another prompt version is another key."""
    d = F.col("doc_id")
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    key = lambda version: judging.cache_key(d.cast("string"), F.concat(F.lit("judge-"), d % 2), F.lit(version), F.struct("quality", "toxic"), F.struct("lang"))
    asked = rows.select("doc_id", key("v2").alias("cache_key"))
    some = rows.filter(d % 3 == 0)
    answers = [some.select(key("v2").alias("cache_key"), F.concat(F.lit(word), d).alias("content"), F.lit(at).alias("created_at")) for word, at in (("old ", 1), ("new ", 2))]
    other = rows.select(key("v1").alias("cache_key"), F.lit("stale").alias("content"), F.lit(3).alias("created_at"))
    return judging.with_cached(asked, answers[0].unionByName(answers[1]).unionByName(other)).select("doc_id", "cache_key", "content", "from_cache")


@query("fixed_users", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS position, c_name AS name FROM customer WHERE c_custkey % 7 <> 3 ORDER BY c_custkey LIMIT 100")
def fixed_users(spark, sf):
    """The first hundred names of a list in which every seventh line is blank."""
    k = F.col("c_custkey")
    listed = load(spark, sf, "customer").select(k.alias("position"), F.when(k % 7 == 3, " ").otherwise(F.col("c_name")).alias("name"))
    return config.fixed_users(listed, 100)


@query("user_list_problems", """WITH l AS (SELECT o_orderkey, 'u' || o_custkey AS name FROM orders), a AS (SELECT 'u' || doc_id AS name FROM documents)
SELECT 'Repeated user' AS issue, name FROM l GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'User without a file', name FROM l WHERE name NOT IN (SELECT name FROM a)""")
def user_list_problems(spark, sf):
    listed = load(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("u"), "o_custkey").alias("name"))
    return config.user_list_problems(listed, load(spark, sf, "documents").select(F.concat(F.lit("u"), "doc_id").alias("name")))


@query("judge_eligible_tasks", f"WITH {LABELS} SELECT model, task_id FROM oc WHERE act AND NOT hard_fail AND status = 'active'")
def judge_eligible_tasks(spark, sf):
    return judging.judge_eligible(outcomes(spark, sf)).select("model", "task_id")


LINES = ["interest_coverage: 4\nnegative_avoidance = 5\nConcreteness: 3.5\nfluency:9\nrationale: good  fit\nmore", "interest_coverage: 4", "interest_coverage=1 negative_avoidance=2 concreteness=3 fluency=-4"]


@query("score_lines", f"""WITH {REC} SELECT post_id, CASE k % 3 WHEN 2 THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS interest_coverage, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS fluency, k % 3 <> 1 AS complete,
  CASE k % 3 WHEN 0 THEN 'good fit' WHEN 1 THEN 'interest_coverage: 4' ELSE 'interest_coverage=1 negative_avoidance=2 concreteness=3 fluency=-4' END AS rationale FROM ev""")
def score_lines(spark, sf):
    scores, rationale, complete = judging.score_lines(pick(LINES, F.col("k") % 3))
    return events(spark, sf).select("post_id", scores["interest_coverage"].alias("interest_coverage"), scores["fluency"].alias("fluency"), complete.alias("complete"), rationale.alias("rationale"))


VERDICT_TEXTS = ['{"is_match": true, "reason": "same"}', '{"match": "no way"}', '{"result": 1, "rationale": " r "}', '{"same": "I say yes"}', '{"reason": "403 Client Error"}', '{"is_same_interest": "is_match: false"}']


@query("match_verdicts", f"""WITH {REC} SELECT post_id, k % 6 IN (0, 2, 3) AS is_match, CASE k % 6 WHEN 0 THEN 'same' WHEN 2 THEN 'r' WHEN 4 THEN '403 Client Error' ELSE '' END AS reason, k % 6 = 4 AS transient FROM ev""")
def match_verdicts(spark, sf):
    verdict, reason = judging.match_verdict(pick(VERDICT_TEXTS, F.col("k") % 6))
    return events(spark, sf).select("post_id", verdict.alias("is_match"), reason.alias("reason"), judging.is_transient(F.lit(None).cast("boolean"), reason).alias("transient"))


@query("model_reports", """WITH p AS (SELECT 'm' || doc_id % 3 AS model, doc_id AS task_position, lang, doc_id % 4 = 0 AS hit FROM documents)
SELECT model, row_number() OVER (PARTITION BY model ORDER BY task_position) - 1 AS position, task_position, avg(hit::INT) OVER (PARTITION BY model) AS accuracy FROM p""")
def model_reports(spark, sf):
    """Predictions and metrics written as report files and read back in their order."""
    d = F.col("doc_id")
    rows = load(spark, sf, "documents").select(F.concat(F.lit("m"), d % 3).alias("model"), d.alias("task_position"), "lang", (d % 4 == 0).alias("hit"))
    target = shared_folder(spark)
    readers.write_reports(rows, rows.groupBy("model").agg(F.avg(F.col("hit").cast("int")).alias("accuracy")), target)
    metrics = spark.read.json(f"{target}/report")
    place = F.get_json_object("value", "$.task_position").cast("long")
    return readers.read_reports(spark, target).select("model", "position", place.alias("task_position")).join(metrics, "model")
