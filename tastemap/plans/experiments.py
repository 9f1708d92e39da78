"""Experiment statistics over lineitem, parts, events and documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round6
from ..operators import experiments as ex
from ..session import load
from .adapters import POST, REC, events, posts, records
from .dialogue import GI, interests
from .registry import query


def scores(spark, sf):
    """Order lines as scores: one per (model, condition, intent, user), the last line wins."""
    li = load(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("long")
    cover = F.when(F.col("l_linenumber") != 7, q % 6).cast("int")
    body = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", cover.alias("coverage"), (q % 5).cast("int").alias("concreteness"), (F.col("l_partkey") % 6).cast("int").alias("fluency"))
    condition = F.when(F.col("l_returnflag") == "A", "gold_profile").when(F.col("l_returnflag") == "N", "predicted_profile").otherwise("wrong_profile")
    rows = li.groupBy(F.col("l_linestatus").alias("model"), condition.alias("condition"), F.when(F.col("l_suppkey") % 2 == 0, "stable").otherwise("recent").alias("intent"), F.col("l_orderkey").alias("user_id"))
    return rows.agg(F.max(body).alias("b")).select("model", "condition", "intent", "user_id", "b.coverage", "b.concreteness", "b.fluency")


SC = """s0 AS (SELECT l_linestatus AS model, CASE l_returnflag WHEN 'A' THEN 'gold_profile' WHEN 'N' THEN 'predicted_profile' ELSE 'wrong_profile' END AS condition, CASE WHEN l_suppkey % 2 = 0 THEN 'stable' ELSE 'recent' END AS intent, l_orderkey AS user_id,
  l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) % 6 END AS coverage, CAST(l_quantity AS BIGINT) % 5 AS concreteness, l_partkey % 6 AS fluency FROM lineitem
), sc AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY model, condition, intent, user_id ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC, coverage DESC, concreteness DESC, fluency DESC) = 1)"""


@query("condition_means", f"""WITH {SC} SELECT model, condition, intent, count(*) AS n_responses, round(avg(coverage) + 1e-10, 6) AS coverage, count(coverage) AS n_coverage, round(avg(concreteness) + 1e-10, 6) AS concreteness, count(concreteness) AS n_concreteness,
  round(avg(fluency) + 1e-10, 6) AS fluency, count(fluency) AS n_fluency FROM sc GROUP BY ALL""")
def condition_means(spark, sf):
    return ex.condition_means(scores(spark, sf))


PAIRS = f"""{SC}, df AS (SELECT a.model, a.intent, a.user_id, c.contrast, a.coverage - b.coverage AS delta FROM (VALUES ('gold_profile', 'predicted_profile', 'gold_profile - predicted_profile'), ('gold_profile', 'wrong_profile', 'gold_profile - wrong_profile')) c(x, y, contrast)
  JOIN sc a ON a.condition = c.x JOIN sc b ON b.condition = c.y AND a.model = b.model AND a.intent = b.intent AND a.user_id = b.user_id WHERE a.coverage IS NOT NULL AND b.coverage IS NOT NULL)"""


@query("paired_differences", f"WITH {PAIRS} SELECT model, intent, user_id, contrast, delta FROM df")
def paired_differences(spark, sf):
    return ex.paired_differences(scores(spark, sf)).select("model", "intent", "user_id", "contrast", F.col("delta").cast("long").alias("delta"))


# The interval is a random draw; the SQL side checks n, mean and that a normal interval is close.
@query("paired_bootstrap", f"WITH {PAIRS} SELECT model, intent, contrast, count(*) AS n, round(avg(delta) + 1e-10, 6) AS mean, true AS plausible FROM df GROUP BY ALL")
def paired_bootstrap(spark, sf):
    d = ex.paired_differences(scores(spark, sf))
    spread = d.groupBy("model", "intent", "contrast").agg((F.stddev_pop("delta") / F.sqrt(F.count("*"))).alias("se"))
    b = ex.paired_bootstrap(d).join(spread, ["model", "intent", "contrast"])
    near = (F.abs(F.col("ci_low") - (F.col("mean") - 1.96 * F.col("se"))) <= 0.25 * F.col("se") + 0.35 / F.col("n")) & (F.abs(F.col("ci_high") - (F.col("mean") + 1.96 * F.col("se"))) <= 0.25 * F.col("se") + 0.35 / F.col("n"))
    return b.select("model", "intent", "contrast", "n", "mean", near.alias("plausible"))


def temporal(spark, sf):
    """Items of a user are their (domain, tag); support posts carry timestamps; answers follow the numbers."""
    r = records(spark, sf).withColumn("item_id", F.concat("domain", F.lit("/"), "raw_tag"))
    targets = r.groupBy("user_id", "item_id").agg(F.when(F.max("k") % 2 == 0, "stable").otherwise("recent").alias("bucket"))
    n = F.min("k")
    answer = F.when(n % 3 == 0, "recent").otherwise("stable")
    a = r.groupBy("user_id", "item_id").agg(answer.alias("bucket"), n.alias("n")).filter("n % 10 != 1")
    model = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return r, targets, a.select(model.alias("model"), "user_id", "item_id", "bucket")


TMP = f"""{REC}, itm AS (SELECT user_id, domain || '/' || raw_tag AS item_id, CASE WHEN max(k) % 2 = 0 THEN 'stable' ELSE 'recent' END AS truth, min(k) AS n, count(DISTINCT post_id) AS np, count(DISTINCT strftime(created_at, '%Y-%m')) AS nm FROM rec GROUP BY ALL
), ans AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, CASE WHEN n % 10 = 1 THEN 'invalid' WHEN n % 3 = 0 THEN 'recent' ELSE 'stable' END AS predicted FROM itm WHERE user_id IN (SELECT user_id FROM itm WHERE n % 10 <> 1)
), conf AS (SELECT model, count(DISTINCT user_id) AS n_users, count(*) FILTER (truth = 'stable' AND predicted = 'stable') AS ss, count(*) FILTER (truth = 'stable' AND predicted = 'recent') AS sr, count(*) FILTER (truth = 'stable' AND predicted = 'invalid') AS si,
  count(*) FILTER (truth = 'recent' AND predicted = 'stable') AS rs, count(*) FILTER (truth = 'recent' AND predicted = 'recent') AS rr, count(*) FILTER (truth = 'recent' AND predicted = 'invalid') AS ri FROM ans GROUP BY model)"""


@query("temporal_confusion", f"""WITH {TMP} SELECT model, n_users, ss AS stable_stable, sr AS stable_recent, si AS stable_invalid, rs AS recent_stable, rr AS recent_recent, ri AS recent_invalid, round(ss::DOUBLE / (ss + sr + si) + 1e-10, 6) AS stable_recall,
  round(rr::DOUBLE / (rs + rr + ri) + 1e-10, 6) AS recent_recall, round((ss::DOUBLE / (ss + sr + si) + rr::DOUBLE / (rs + rr + ri)) / 2 + 1e-10, 6) AS balanced_accuracy FROM conf""")
def temporal_confusion(spark, sf):
    _, targets, answers = temporal(spark, sf)
    return ex.temporal_confusion(ex.user_confusion(ex.scored_assignments(targets, answers)))


@query("scored_assignments", f"WITH {TMP} SELECT model, user_id, item_id, truth, predicted FROM ans")
def scored_assignments(spark, sf):
    _, targets, answers = temporal(spark, sf)
    return ex.scored_assignments(targets, answers)


@query("assignment_problems", f"WITH {TMP}, u AS (SELECT DISTINCT model, user_id FROM ans) SELECT model, user_id, 'unknown_bucket' AS problem FROM u WHERE user_id % 5 = 0 UNION ALL SELECT model, user_id, 'unknown_item' FROM u WHERE user_id % 7 = 0 UNION ALL SELECT model, user_id, 'duplicate' FROM u WHERE user_id % 3 = 0")
def assignment_problems(spark, sf):
    _, targets, answers = temporal(spark, sf)
    u = F.col("user_id")
    one = answers.groupBy("model", "user_id").agg(F.min("item_id").alias("item_id"))
    bad = answers.withColumn("bucket", F.when(u % 5 == 0, "later").otherwise(F.col("bucket")))
    extra = one.filter(u % 7 == 0).select("model", "user_id", F.lit("nothing").alias("item_id"), F.lit("stable").alias("bucket"))
    again = one.filter(u % 3 == 0).withColumn("bucket", F.lit("stable"))
    return ex.assignment_problems(targets, bad.unionByName(extra).unionByName(again))


@query("cluster_bootstrap", f"WITH {TMP} SELECT model, true AS plausible FROM conf")
def cluster_bootstrap(spark, sf):
    """The interval must hold the point estimate and be narrow."""
    _, targets, answers = temporal(spark, sf)
    per_user = ex.user_confusion(ex.scored_assignments(targets, answers))
    b = ex.cluster_bootstrap(per_user).join(ex.temporal_confusion(per_user), "model")
    return b.select("model", ((F.col("ci_low") < F.col("balanced_accuracy")) & (F.col("ci_high") > F.col("balanced_accuracy")) & (F.col("ci_high") - F.col("ci_low") < 0.1)).alias("plausible"))


@query("rule_assignments", f"WITH {TMP} SELECT user_id, item_id, CASE WHEN np >= 3 AND nm >= 2 THEN 'stable' ELSE 'recent' END AS bucket FROM itm")
def rule_assignments(spark, sf):
    r, _, _ = temporal(spark, sf)
    return ex.rule_assignments(r.select("user_id", "item_id", "post_id", F.date_format("created_at", "yyyy-MM-dd").alias("timestamp")))


@query("blind_items", f"""WITH {REC}, i AS (SELECT user_id, domain, raw_tag AS interest, domain || '/' || raw_tag AS item_id, '[' || string_agg('"' || post_id || '"', ',' ORDER BY post_id::VARCHAR) || ']' AS sp FROM rec GROUP BY ALL),
h AS (SELECT *, sha256('{{"domain":"' || domain || '","interest":"' || interest || '","supporting_posts":' || sp || '}}') AS d FROM i) SELECT user_id, item_id, printf('I%03d', row_number() OVER (PARTITION BY user_id ORDER BY d, item_id) - 1) AS blind_id FROM h""")
def blind_items(spark, sf):
    r = records(spark, sf)
    items = r.groupBy("user_id", "domain", F.col("raw_tag").alias("interest")).agg(F.collect_list(F.col("post_id").cast("string")).alias("supporting_posts"))
    items = items.withColumn("item_id", F.concat("domain", F.lit("/"), "interest"))
    return ex.blind_items(items).select("user_id", "item_id", "blind_id")


@query("wrong_profiles", f"WITH {GI}, u AS (SELECT DISTINCT user_id FROM g) SELECT count(*) AS users, count(*) AS distinct_sources, 0::BIGINT AS own FROM u")
def wrong_profiles(spark, sf):
    """The pairing is one to one and gives no one their own profile."""
    w = ex.wrong_profiles(ex.domain_profiles(interests(spark, sf).filter("status = 'active'")).unionByName(ex.domain_profiles(interests(spark, sf).filter("status != 'active'"))))
    return w.agg(F.count("*").alias("users"), F.countDistinct("wrong_user_id").alias("distinct_sources"), F.sum((F.col("user_id") == F.col("wrong_user_id")).cast("long")).alias("own"))


@query("domain_profiles", f"""WITH {GI} SELECT user_id, domain, coalesce(string_agg(label, '|' ORDER BY rank, label) FILTER (bucket = 'long_term'), '') AS stable, coalesce(string_agg(label, '|' ORDER BY rank, label) FILTER (bucket = 'short_term'), '') AS recent FROM g GROUP BY ALL""")
def domain_profiles(spark, sf):
    return ex.domain_profiles(interests(spark, sf)).select("user_id", "domain", F.array_join("stable", "|").alias("stable"), F.array_join("recent", "|").alias("recent"))


@query("profile_costs", f"""WITH {GI}, p AS (SELECT user_id, list(DISTINCT domain) FILTER (bucket <> 'negative') AS d, count(*) FILTER (bucket <> 'negative') AS n FROM g GROUP BY 1)
SELECT a.user_id, round(3 * (1 - len(list_intersect(a.d, b.d))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.d, b.d))))) + abs(a.n - b.n)::DOUBLE / greatest(1, a.n, b.n) + 1e-10, 6) AS cost FROM p a JOIN p b ON b.user_id = a.user_id + 1""")
def profile_costs(spark, sf):
    """Cost between each user and the next one."""
    i = interests(spark, sf).filter("bucket != 'negative'")
    p = i.groupBy("user_id").agg(F.collect_set("domain").alias("d"), F.count("*").alias("n"))
    q = p.select((F.col("user_id") - 1).alias("user_id"), F.col("d").alias("d2"), F.col("n").alias("n2"))
    return p.join(q, "user_id").select("user_id", round6(ex.profile_cost(F.col("d"), F.col("d2"), F.col("n"), F.col("n2"))).alias("cost"))


@query("job_grid", """WITH u AS (SELECT DISTINCT user_id FROM events), m AS (SELECT unnest(['a', 'b']) AS model) SELECT user_id, model, c AS condition, i AS intent, 'dialogue' AS stage FROM u, m, (SELECT unnest(['no_context', 'timeline', 'predicted_profile', 'gold_profile', 'wrong_profile']) AS c), (SELECT unnest(['stable', 'recent']) AS i)
UNION ALL SELECT user_id, model, NULL, NULL, 'temporal' FROM u, m""")
def job_grid(spark, sf):
    return ex.job_grid(load(spark, sf, "events"), ["a", "b"])


def _estimates(spark, sf):
    """Planned calls for the documents' users with a context per condition."""
    p = posts(spark, sf).groupBy("user_id").agg(F.sum("n_chars").alias("timeline"))
    g = ex.job_grid(p, ["a", "b"]).filter("stage = 'dialogue'").join(p, "user_id")
    u = F.col("user_id")
    size = F.coalesce(ex.condition_context(F.col("condition"), F.col("timeline"), 100 + u, 200 + u, 300 + u), F.lit(0))
    tokens, cost = ex.estimate(size + 1000, 2, F.when(F.col("model") == "a", 0.002).otherwise(0.01), F.lit(0.03), F.lit(500))
    return g.withColumn("context_chars", size).withColumn("tokens", tokens).withColumn("reserved", cost)


EST = f"""{POST}, p AS (SELECT user_id, sum(n_chars) AS timeline FROM post GROUP BY 1), e AS (SELECT p.user_id, m.model, c.condition, i.intent, CAST(CASE condition WHEN 'timeline' THEN timeline WHEN 'predicted_profile' THEN 100 + user_id WHEN 'gold_profile' THEN 200 + user_id WHEN 'wrong_profile' THEN 300 + user_id ELSE 0 END AS BIGINT) AS ctx
  FROM p, (VALUES ('a'), ('b')) m(model), (SELECT unnest(['no_context', 'timeline', 'predicted_profile', 'gold_profile', 'wrong_profile']) AS condition) c, (SELECT unnest(['stable', 'recent']) AS intent) i
), t AS (SELECT *, CAST(24 + ceil((ctx + 1000)::DOUBLE / 4) AS BIGINT) AS tokens FROM e), es AS (SELECT *, (ceil(tokens * 1.25::DOUBLE + 128) * CASE model WHEN 'a' THEN 0.002::DOUBLE ELSE 0.01::DOUBLE END + 500 * 0.03::DOUBLE) / 1000 AS reserved FROM t)"""


@query("call_estimates", f"WITH {EST} SELECT user_id, model, condition, intent, ctx AS context_chars, tokens, round(reserved + 1e-10, 6) AS reserved FROM es")
def call_estimates(spark, sf):
    e = _estimates(spark, sf)
    return e.select("user_id", "model", "condition", "intent", F.col("context_chars").cast("long").alias("context_chars"), "tokens", round6(F.col("reserved")).alias("reserved"))


@query("run_readiness", f"WITH {EST} SELECT count(*) AS generation_calls, count(DISTINCT user_id) AS users, round(sum(reserved) + 1e-10, 6) AS generation_reserved, round(avg(tokens) + 1e-10, 6) AS input_tokens_mean, max(tokens) AS input_tokens_max FROM es")
def run_readiness(spark, sf):
    return ex.readiness(_estimates(spark, sf))


@query("pilot_users", f"""WITH {POST}, p AS (SELECT user_id, CAST(sum(n_chars) AS BIGINT) AS length FROM post GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY length, user_id) - 1 AS i, count(*) OVER () AS n FROM p) SELECT user_id, length FROM r WHERE i IN (0, n // 2, n - 1)""")
def pilot_users(spark, sf):
    return ex.pilot_users(posts(spark, sf).groupBy("user_id").agg(F.sum("n_chars").alias("length")), "length")


@query("valid_scores", f"""WITH {REC} SELECT post_id, CASE WHEN k % 5 = 0 THEN k % 3 = 0 ELSE k % 3 <> 0 AND k % 8 <= 5 END AND k % 7 <= 5 AND k % 11 <> 0 AS valid FROM ev""")
def valid_scores(spark, sf):
    k = F.col("k")
    as_json = lambda c: F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$.x")
    valid = ex.valid_scores(as_json(F.when(k % 3 != 0, k % 8)), as_json(k % 7), F.lit("3"), F.when(k % 11 != 0, "why"), k % 5 != 0)
    return events(spark, sf).select("post_id", valid.alias("valid"))


@query("eligible_users", f"WITH {GI} SELECT user_id, bool_or(bucket = 'short_term') AS target_eligible FROM g WHERE status = 'active' GROUP BY 1")
def eligible_users(spark, sf):
    return ex.eligible(ex.domain_profiles(interests(spark, sf).filter("status = 'active'")), "recent")


@query("accepted_models", f"WITH {REC} SELECT post_id FROM ev WHERE k % 3 IN (0, 1)")
def accepted_models(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).withColumn("model", F.when(k % 2 == 0, "m1").otherwise("m2")).withColumn(
        "returned_model", F.when(k % 3 == 0, F.col("model")).when((k % 3 == 1) & (k % 2 == 0), "m1-2026").when(k % 3 == 1, "m2").otherwise("other")
    )
    return ex.accepted_models(rows, {"m1": ["m1", "m1-2026"]}).select("post_id")


@query("current_results", f"WITH {REC} SELECT post_id FROM ev WHERE k % 4 <> 0 AND (k % 2 = 1 OR k % 3 = 0) AND k % 5 <> 0")
def current_results(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).withColumn("protocol", F.when(k % 4 == 0, "old").otherwise(ex.PROTOCOL)).withColumn("stage", F.when(k % 2 == 1, "dialogue").otherwise("temporal"))
    rows = rows.withColumn("temporal_protocol", F.when(k % 3 == 0, ex.TEMPORAL_PROTOCOL)).withColumn("input_hash", F.when(k % 5 == 0, "stale").otherwise(F.sha2(F.col("user_id").cast("string"), 256)))
    inputs = events(spark, sf).select("user_id").distinct().withColumn("input_hash", F.sha2(F.col("user_id").cast("string"), 256))
    return ex.current_results(rows, inputs).select("post_id")


@query("prediction_snapshots", f"""WITH {REC}, x AS (SELECT user_id, domain, k % 9 <> 0 AS same, k % 25 = 1 AS failed FROM rec) SELECT user_id, count(*) FILTER (NOT same) AS n_rejected, count(*) FILTER (same AND failed) AS n_errors, count(*) FILTER (same) - count(DISTINCT CASE WHEN same THEN domain END) AS n_duplicates,
  count(DISTINCT CASE WHEN same THEN domain END) = 7 AS complete FROM x GROUP BY 1""")
def prediction_snapshots(spark, sf):
    k = F.col("k")
    p = records(spark, sf).withColumn("profile_method", F.when(k % 9 == 0, "other").otherwise("direct")).withColumn("error", F.when(k % 25 == 1, "boom").otherwise(" "))
    return ex.complete_predictions(p, {"profile_method": "direct"})


def _cache(spark, sf):
    d = F.col("post_id")
    return posts(spark, sf).select(
        F.when(d % 3 == 0, "old").otherwise("cap").alias("model_name"), F.lit("v1").alias("prompt_version"),
        F.when(d % 7 == 0, F.concat(F.lit("C:\\data\\"), "user_id", F.lit("\\media\\"), d, F.lit(".jpg"))).otherwise(F.concat(F.lit("/data/"), "user_id", F.lit("/media/"), d, F.lit(".jpg"))).alias("source"),
        F.col("text").alias("summary"), F.array(F.lit("x")).alias("visible_text"),
    )


@query("cached_captions", "SELECT CAST(doc_id % 50 AS VARCHAR) AS user_dir, doc_id || '.jpg' AS file_name, text AS summary, false AS conflict FROM documents WHERE doc_id % 3 <> 0")
def cached_captions(spark, sf):
    return ex.cached_captions(_cache(spark, sf), "cap", "v1").drop("visible_text")


@query("caption_coverage", f"WITH {POST} SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(sum(n_images + n_videos) AS BIGINT) AS images, CAST(sum(CASE WHEN post_id % 3 <> 0 THEN n_images ELSE 0 END) AS BIGINT) AS captions FROM post GROUP BY 1 HAVING sum(n_images + n_videos) > 0")
def caption_coverage(spark, sf):
    media = posts(spark, sf).select(F.col("user_id").cast("string").alias("user_id"), F.explode("media").alias("m")).select("user_id", "m.media_type", "m.storage_uri")
    return ex.caption_coverage(media, ex.cached_captions(_cache(spark, sf), "cap", "v1"))


@query("supporting_posts", f"""WITH {POST}, e AS (SELECT p_partkey % 50 AS user_id, p_partkey AS item_id, unnest(CASE WHEN p_partkey % 9 = 0 THEN [-1] ELSE [p_partkey % 50 + 50 * (p_partkey % 4), p_partkey % 50 + 50, -1] END) AS post_id FROM part)
SELECT e.user_id, item_id, count(DISTINCT p.post_index) AS n_support, count(*) FILTER (p.post_id IS NULL) AS n_missing, count(DISTINCT p.post_index) = 0 AS unsupported FROM e LEFT JOIN post p ON p.user_id = e.user_id AND p.post_id = e.post_id GROUP BY ALL""")
def supporting_posts(spark, sf):
    k = F.col("p_partkey")
    ids = F.when(k % 9 == 0, F.array(F.lit(-1))).otherwise(F.array(k % 50 + 50 * (k % 4), k % 50 + 50, F.lit(-1)))
    i = load(spark, sf, "part").select((k % 50).alias("user_id"), k.alias("item_id"), ids.cast("array<bigint>").alias("evidence_post_ids"))
    return ex.supporting_posts(i, posts(spark, sf))


@query("spend_summary", """SELECT o_orderpriority AS model, count(*) AS requests, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 0) + 1e-10, 6) AS metered, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 100.0::DOUBLE END) + 1e-10, 6) AS committed, count(*) FILTER (o_orderstatus = 'P') AS uncertain_requests FROM orders GROUP BY 1""")
def spend_summary(spark, sf):
    calls = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("actual"), F.lit(100.0).alias("reserved"))
    return ex.spend(calls, ["model"])
