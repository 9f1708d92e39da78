"""Dialogue tasks and rule scores: interests from parts, responses from conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogue as dg
from ..operators.evaluation import error_class
from ..schemas import DOMAINS
from ..session import load
from .adapters import POST, pick, posts, sql_list
from .registry import query

KINDS = ["long_term", "short_term", "negative"]


def interests(spark, sf):
    """Parts as gold interests of 90 users; the rank counts within (user, domain, bucket)."""
    k = F.col("p_partkey")
    rows = load(spark, sf, "part").select(
        (k % 90).alias("user_id"), F.floor(k / 90).alias("i"), pick(KINDS, F.floor(k / 90) % 3).alias("bucket"), (F.floor(k / 270) % 7).cast("int").alias("domain_ord"),
        F.floor(k / 1890).cast("int").alias("rank"), F.concat(F.lit(" "), F.initcap("p_name")).alias("label"), (F.col("p_size") % 6).alias("evidence_count"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("text"), F.lit("Visual"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("modalities"),
        F.array((k % 7).cast("long"), (F.col("p_size") % 5).cast("long"), F.lit(-1).cast("long")).alias("evidence_indices"),
    )
    status = F.when((F.col("user_id") + F.col("domain_ord")) % 4 == 0, "inactive").otherwise("active")
    return rows.withColumn("domain", pick(DOMAINS, F.col("domain_ord"))).withColumn("status", status)


GI = f"""gi AS (
  SELECT p_partkey % 90 AS user_id, list_extract({sql_list(KINDS)}, 1 + (p_partkey // 90) % 3) AS bucket, CAST((p_partkey // 270) % 7 AS INTEGER) AS domain_ord, CAST(p_partkey // 1890 AS INTEGER) AS rank,
    ' ' || upper(left(string_split(p_name, ' ')[1], 1)) || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) AS label,
    lower(p_name) AS key, least(p_size % 6, 4) AS ev, CASE p_size % 3 WHEN 0 THEN 0.20::DOUBLE WHEN 1 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS bonus, p_partkey % 7 AS e1, p_size % 5 AS e2 FROM part
), g AS (SELECT *, list_extract({sql_list(DOMAINS)}, 1 + domain_ord) AS domain, CASE WHEN (user_id + domain_ord) % 4 = 0 THEN 'inactive' ELSE 'active' END AS status FROM gi)"""

FACTS = """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, domain, label) AS INTEGER) AS position, domain, label, bucket AS horizon, score AS rank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY score DESC, domain, label) AS n FROM ({inner})) WHERE n = 1 QUALIFY position <= 4"""


@query("interest_facts", f"WITH {GI} " + FACTS.format(inner="SELECT *, round(CASE bucket WHEN 'long_term' THEN 2.0::DOUBLE ELSE 1.4::DOUBLE END + 0.2::DOUBLE * ev + bonus + CASE WHEN rank = 0 THEN 0.15::DOUBLE ELSE 0 END + 1e-10, 4) AS score FROM g WHERE status = 'active' AND bucket <> 'negative'"))
def interest_facts(spark, sf):
    return dg.interest_facts(interests(spark, sf)).drop("evidence_indices")


@query("negative_facts", f"WITH {GI} " + FACTS.format(inner="SELECT *, round(1.0::DOUBLE + 0.2::DOUBLE * ev + bonus + CASE WHEN rank = 0 THEN 0.1::DOUBLE ELSE 0 END + 1e-10, 4) AS score FROM g WHERE bucket = 'negative'"))
def negative_facts(spark, sf):
    return dg.negative_facts(interests(spark, sf)).drop("evidence_indices")


CASES = f"""{GI}, act AS (SELECT *, count(*) FILTER (bucket = 'long_term') OVER (PARTITION BY user_id, domain) AS nl, count(*) FILTER (bucket = 'short_term') OVER (PARTITION BY user_id, domain) AS ns FROM g WHERE status = 'active'
), sc AS (SELECT *, 'stable_recommendation' AS scenario_type, round(2.0::DOUBLE + 0.25::DOUBLE * ev + bonus + CASE WHEN rank = 0 THEN 0.15::DOUBLE ELSE 0 END + 0.10::DOUBLE * least(nl, 4), 9) AS score FROM act WHERE bucket = 'long_term'
  UNION ALL SELECT *, 'short_term_exploration', round(1.8::DOUBLE + 0.25::DOUBLE * ev + bonus + CASE WHEN rank = 0 THEN 0.15::DOUBLE ELSE 0 END + 0.10::DOUBLE * least(ns, 4) + CASE WHEN nl > 0 THEN 0.35::DOUBLE ELSE 0 END, 9) FROM act WHERE bucket = 'short_term'
), win AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY user_id, scenario_type ORDER BY score DESC, domain, label) = 1
), own AS (SELECT w.scenario_type, w.key AS pkey, o.* FROM win w JOIN g o USING (user_id, domain)
), opt AS (SELECT user_id, scenario_type, key, label, rank, row_number() OVER (PARTITION BY user_id, scenario_type, key ORDER BY rank) AS d FROM own WHERE key <> pkey AND bucket = CASE scenario_type WHEN 'stable_recommendation' THEN 'long_term' ELSE 'short_term' END
), opts AS (SELECT user_id, scenario_type, string_agg(label, '|' ORDER BY r) AS optional_labels, arg_min(label, r) AS o1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, scenario_type ORDER BY rank) AS r FROM opt WHERE d = 1 QUALIFY r <= 2) GROUP BY ALL
), anc AS (SELECT user_id, scenario_type, key, label, rank, -round(2.0::DOUBLE + 0.25::DOUBLE * ev + bonus + 0.15::DOUBLE, 9) AS s, row_number() OVER (PARTITION BY user_id, scenario_type, key ORDER BY -round(2.0::DOUBLE + 0.25::DOUBLE * ev + bonus + 0.15::DOUBLE, 9), rank) AS d FROM own WHERE bucket = 'long_term' AND scenario_type = 'short_term_exploration'
), ancs AS (SELECT user_id, scenario_type, string_agg(label, '|' ORDER BY r) AS anchor_labels, arg_min(label, r) AS a1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, scenario_type ORDER BY s, rank) AS r FROM anc WHERE d = 1 QUALIFY r <= 2) GROUP BY ALL
), neg AS (SELECT w.user_id, w.scenario_type, n.key, n.label, (n.domain <> w.domain)::INT AS away, n.domain_ord, n.rank FROM win w JOIN g n USING (user_id) WHERE n.bucket = 'negative' AND (n.domain = w.domain OR n.rank < 2)
), negd AS (SELECT *, row_number() OVER (PARTITION BY user_id, scenario_type, key ORDER BY away, domain_ord, rank) AS d FROM neg
), negs AS (SELECT user_id, scenario_type, string_agg(label, '|' ORDER BY r) AS forbidden_labels FROM (SELECT *, row_number() OVER (PARTITION BY user_id, scenario_type ORDER BY away, domain_ord, rank) AS r FROM negd WHERE d = 1 QUALIFY r <= 12) GROUP BY ALL)"""
LEAD_SQL = "CASE w.domain " + " ".join(f"WHEN '{d}' THEN replace('{t}', '%s', lower(w.label))" for d, t in dg.LEADS.items()) + " END"


@query("scenario_turns", f"""WITH {CASES} SELECT w.user_id, w.scenario_type, w.scenario_type || '__' || w.domain AS scenario_id, w.label AS required_labels, coalesce(anchor_labels, '') AS anchor_labels, coalesce(optional_labels, '') AS optional_labels, coalesce(forbidden_labels, '') AS forbidden_labels,
  CASE w.scenario_type WHEN 'stable_recommendation' THEN {LEAD_SQL} || CASE WHEN o1 IS NULL THEN ' It is a safe fit for your usual taste without forcing a random detour.' ELSE ' It is a safe fit for your usual taste, and you can keep it close to ' || lower(o1) || ' if you want a small variation.' END
    ELSE {LEAD_SQL} || CASE WHEN a1 IS NULL THEN ' It gives you a bit of novelty while still staying close to what your recent taste suggests.' ELSE ' It gives you something a bit new while still staying close to your ' || lower(a1) || ' side, so it should not feel random.' END END AS assistant_response,
  CAST(CASE WHEN w.scenario_type = 'stable_recommendation' OR NOT EXISTS (SELECT 1 FROM win x WHERE x.user_id = w.user_id AND x.scenario_type = 'stable_recommendation') THEN 1 ELSE 2 END AS INTEGER) AS turn_id
FROM win w LEFT JOIN opts USING (user_id, scenario_type) LEFT JOIN ancs USING (user_id, scenario_type) LEFT JOIN negs USING (user_id, scenario_type)""")
def scenario_turns(spark, sf):
    t = dg.scenario_turns(interests(spark, sf))
    lists = [F.array_join(c, "|").alias(c) for c in ("required_labels", "anchor_labels", "optional_labels", "forbidden_labels")]
    return t.select("user_id", "scenario_type", "scenario_id", *lists, "assistant_response", "turn_id")


@query("case_winners", f"WITH {CASES} SELECT user_id, scenario_type, domain, label, score FROM win")
def case_winners(spark, sf):
    i = interests(spark, sf)
    both = [dg.case_winners(i, s).select("user_id", "scenario_type", "domain", "label", "score") for s in dg.PROMPTS]
    return both[0].unionByName(both[1])


@query("profile_context", f"""WITH {GI}, d AS (SELECT user_id, domain_ord, domain, status, coalesce(string_agg(trim(label), '|' ORDER BY rank) FILTER (bucket = 'long_term'), '') AS long_labels, coalesce(string_agg(trim(label), '|' ORDER BY rank) FILTER (bucket = 'short_term'), '') AS short_labels,
  coalesce(string_agg(trim(label), '|' ORDER BY rank) FILTER (bucket = 'negative'), '') AS negative_labels FROM g WHERE rank < 4 GROUP BY ALL)
SELECT user_id, domain, long_labels, short_labels, negative_labels, CAST(row_number() OVER (PARTITION BY user_id ORDER BY domain_ord) AS INTEGER) AS position FROM d WHERE status = 'active' AND (long_labels <> '' OR short_labels <> '') QUALIFY position <= 5""")
def profile_context(spark, sf):
    p = dg.profile_context(interests(spark, sf))
    return p.select("user_id", "domain", F.array_join("long_term_labels", "|").alias("long_labels"), F.array_join("short_term_labels", "|").alias("short_labels"), F.array_join("negative_labels", "|").alias("negative_labels"), "position")


@query("top_profile_labels", f"""WITH {GI}, k AS (SELECT *, CASE WHEN bucket = 'negative' THEN 'negative' WHEN status = 'active' THEN 'positive' END AS kind FROM g WHERE rank < 4)
SELECT user_id, kind, key, trim(arg_min(label, (domain_ord, bucket = 'short_term', rank))) AS label FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def top_profile_labels(spark, sf):
    return dg.top_profile_labels(interests(spark, sf)).drop("place")


ABSENT = "90817263"


def turns(spark, sf):
    """Assistant turns with labels that are cut from the response itself or occur in no text."""
    c = load(spark, sf, "conversations").filter("role = 'assistant'")
    n, t = F.col("conv_id"), F.col("text")
    start, middle = F.substring(t, 1, 9), F.substring(t, 11, 8)
    gone = F.lit(ABSENT)
    return c.select(
        n.alias("user_id"), F.col("turn").alias("turn_id"), F.when(n % 2 == 0, "stable_recommendation").otherwise("short_term_exploration").alias("scenario_type"),
        F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 3 == 0, F.array(gone)).otherwise(F.array(start)).alias("required_labels"),
        F.when(n % 4 == 1, F.array(middle, gone)).otherwise(F.array().cast("array<string>")).alias("anchor_labels"),
        F.array(middle, middle, gone).alias("optional_labels"),
        F.when(n % 5 == 0, F.array(start, middle)).when(n % 5 == 1, F.array(gone, start)).otherwise(F.array(gone)).alias("forbidden_labels"),
        F.array(F.struct(F.lit("c").alias("claim_id"), F.when(n % 3 == 0, gone).otherwise(start).alias("text"), F.array(gone).alias("labels"))).alias("claims"),
    )


def responses(spark, sf, model="m"):
    """Responses with some rule words around the whole text; every eleventh is missing."""
    c = load(spark, sf, "conversations").filter("role = 'assistant' and conv_id % 11 != 3")
    n = F.col("conv_id")
    text = F.concat("text", F.when(n % 4 == 0, " I would try it because it fits.").when(n % 4 == 1, ' ```{"a": 1}').otherwise(""))
    lead = F.when((n % 10 == 0) & F.lit(model == "m"), "do not pick ").otherwise("")
    return c.select(F.lit(model).alias("model"), n.alias("user_id"), F.col("turn").alias("turn_id"), F.concat(lead, text).alias("response"))


def _form(x):
    return f"array_to_string(regexp_extract_all(replace(lower(trim({x})), '_', ' '), '[a-z0-9]+'), ' ')"


def _low(x):
    return f"replace(lower(trim({x})), '_', ' ')"


def _has(markers, x):
    return "(" + " OR ".join("contains({}, '{}')".format(x, m.replace("'", "''")) for m in markers) + ")"


SCORES = rf"""c AS (SELECT 'm' AS md, conv_id AS n, turn, text AS t, substr(text, 1, 9) AS st, substr(text, 11, 8) AS mi FROM conversations WHERE role = 'assistant'
), r AS (SELECT *, CASE WHEN n % 11 = 3 OR md = 'o' AND n % 5 = 2 THEN '' ELSE trim(CASE WHEN n % 10 = 0 AND md = 'm' THEN 'do not pick ' ELSE '' END || t || CASE n % 4 WHEN 0 THEN ' I would try it because it fits.' WHEN 1 THEN ' ```{{"a": 1}}' ELSE '' END) END AS resp FROM c
), f AS (SELECT *, {_form("resp")} AS body, {_form("st")} AS fs, {_form("mi")} AS fm, len(regexp_extract_all(resp, '[\p{{L}}\p{{N}}_]+')) AS words, lower(resp) AS low FROM r
), h AS (SELECT *, fs <> '' AND contains(body, fs) AS hs, fm <> '' AND contains(body, fm) AS hm FROM f
), k AS (SELECT *, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 3 <> 0 AND fs = '' THEN 0 ELSE 1 END AS nr, CASE WHEN n % 7 <> 0 AND n % 3 <> 0 AND hs THEN 1 ELSE 0 END AS mr,
    CASE WHEN n % 4 = 1 THEN 1 + (fm <> '')::INT ELSE 0 END AS na, CASE WHEN n % 4 = 1 AND hm THEN 1 ELSE 0 END AS ma, 1 + (fm <> '')::INT AS no, hm::INT AS mo FROM h
), w AS (SELECT *, CASE WHEN nr > 0 THEN mr::DOUBLE / nr ELSE 1 END AS rr, CASE WHEN na > 0 THEN ma::DOUBLE / na ELSE 1 END AS ra, CASE WHEN no > 0 THEN mo::DOUBLE / no ELSE 0 END AS ro FROM k
), v AS (SELECT *, CASE WHEN nr = 0 THEN 0.0::DOUBLE WHEN n % 2 = 1 THEN 5.0::DOUBLE * (0.70::DOUBLE * rr + 0.25::DOUBLE * CASE WHEN na > 0 THEN ra ELSE 1 END + 0.05::DOUBLE * ro) ELSE 5.0::DOUBLE * least(1.0::DOUBLE, 0.90::DOUBLE * rr + 0.10::DOUBLE * ro) END AS cov,
    CASE WHEN resp = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + (words >= 12)::INT + (words >= 22)::INT + {_has(dg.ACTION_MARKERS, "low")}::INT + {_has(dg.REASON_MARKERS, "low")}::INT END AS conc,
    CASE WHEN resp = '' THEN 0.0::DOUBLE WHEN words < 5 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE + (words BETWEEN 12 AND 90)::INT + CASE WHEN regexp_matches(resp, '[.!?]$') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(resp, '(?i)\{{\s*"|```|\bturn\s*\d\b|post index|benchmark|scoring') THEN 0 ELSE 0.5::DOUBLE END END AS flu FROM w)"""


@query("concreteness_scores", f"WITH {SCORES} SELECT n AS user_id, turn AS turn_id, conc AS concreteness FROM v")
def concreteness_scores(spark, sf):
    return _scored(spark, sf).select("user_id", "turn_id", "concreteness")


def _scored(spark, sf):
    return dg.scored_turns(turns(spark, sf), responses(spark, sf))


@query("fluency_scores", f"WITH {SCORES} SELECT n AS user_id, turn AS turn_id, flu AS fluency, CAST(words AS INTEGER) AS word_count, words BETWEEN 18 AND 120 AS length_ok, length(resp) >= 24 AS format_ok FROM v")
def fluency_scores(spark, sf):
    return _scored(spark, sf).select("user_id", "turn_id", "fluency", "word_count", "length_ok", "format_ok")


@query("label_hits", f"WITH {SCORES} SELECT n AS user_id, turn AS turn_id, mr AS n_required, ma AS n_anchor, mo AS n_optional, round(rr + 1e-10, 4) AS required_hit_rate, round(ra + 1e-10, 4) AS anchor_hit_rate, round(ro + 1e-10, 4) AS optional_hit_rate, round(cov + 1e-10, 4) AS interest_coverage FROM v")
def label_hits(spark, sf):
    s = _scored(spark, sf)
    return s.select("user_id", "turn_id", *[F.size(f"matched_{k}").alias(f"n_{k}") for k in ("required", "anchor", "optional")], "required_hit_rate", "anchor_hit_rate", "optional_hit_rate", "interest_coverage")


# A label's first occurrence decides in SQL; later ones are looked for by cutting the text after each.
NEGATED = rf"""pos AS (SELECT md, n, turn, resp, {_low("resp")} AS b, CASE n % 5 WHEN 0 THEN [{_low("st")}, {_low("mi")}] WHEN 1 THEN [{_low("st")}] ELSE [] END AS labels, CASE n % 5 WHEN 0 THEN [fs, fm] WHEN 1 THEN [fs] ELSE [] END AS forms FROM h
), lb AS (SELECT md, n, turn, b, unnest(labels) AS p, unnest(forms) AS f FROM pos), lbd AS (SELECT md, n, turn, b, f, first(p) AS p FROM lb WHERE f <> '' GROUP BY ALL
), occ AS (SELECT md, n, turn, p, b, unnest(string_split(b, p)) AS piece, generate_subscripts(string_split(b, p), 1) AS i FROM lbd WHERE p <> ''
), st2 AS (SELECT md, n, turn, p, b, i, sum(length(piece) + length(p)) OVER (PARTITION BY md, n, turn, p ORDER BY i) - length(p) AS s, count(*) OVER (PARTITION BY md, n, turn, p) AS m FROM occ
), win2 AS (SELECT md, n, turn, p, substr(b, CAST(greatest(s - 60, 0) + 1 AS BIGINT), CAST(least(s + length(p) + 60, length(b)) - greatest(s - 60, 0) AS BIGINT)) AS win FROM st2 WHERE i < m
), rec2 AS (SELECT md, n, turn, p, bool_or(NOT {_has(dg.NEGATIVE_MARKERS, "win")}) AS rec FROM win2 GROUP BY ALL), bad AS (SELECT md, n, turn, count(*) FILTER (rec) AS nb FROM rec2 GROUP BY ALL)"""


@query("forbidden_recommendations", f"WITH {SCORES}, {NEGATED} SELECT v.n AS user_id, v.turn AS turn_id, CAST(coalesce(nb, 0) AS INTEGER) AS n_recommended, CASE coalesce(nb, 0) WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS negative_avoidance FROM v LEFT JOIN bad USING (md, n, turn)")
def forbidden_recommendations(spark, sf):
    return _scored(spark, sf).select("user_id", "turn_id", F.size("forbidden_recommended").alias("n_recommended"), "negative_avoidance")


TOTAL = f"""{SCORES}, {NEGATED}, tot AS (SELECT v.*, CASE coalesce(nb, 0) WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS avo, coalesce(nb, 0) AS nb FROM v LEFT JOIN bad USING (md, n, turn)
), tt AS (SELECT *, md AS model, CASE n % 2 WHEN 0 THEN 'stable_recommendation' ELSE 'short_term_exploration' END AS scenario_type, round(cov + 1e-10, 4) AS cov4, round((0.40::DOUBLE * cov + 0.25::DOUBLE * avo + 0.20::DOUBLE * conc + 0.15::DOUBLE * flu) / 5 * 100 + 1e-10, 4) AS score FROM tot)"""


# Two models, of which the second leaves out more turns.
TWO = TOTAL.replace("'m' AS md, conv_id AS n", "unnest(['m', 'o']) AS md, conv_id AS n")


@query("scored_turns", f"WITH {TWO} SELECT model, n AS user_id, turn AS turn_id, scenario_type, cov4 AS interest_coverage, avo AS negative_avoidance, conc AS concreteness, flu AS fluency, score AS turn_score, CASE WHEN n % 3 <> 0 AND hs THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS claim_recall FROM tt")
def scored_turns(spark, sf):
    other = responses(spark, sf, "o").filter("user_id % 5 != 2")
    scored = dg.scored_turns(turns(spark, sf), responses(spark, sf).unionByName(other))
    return scored.select("model", "user_id", "turn_id", "scenario_type", "interest_coverage", "negative_avoidance", "concreteness", "fluency", "turn_score", "claim_recall")


@query("user_dialogue_means", f"""WITH {TOTAL} SELECT n AS user_id, count(*) AS turn_count, round(avg(cov4) + 1e-10, 4) AS interest_coverage_mean, round(avg(avo) + 1e-10, 4) AS negative_avoidance_mean, round(avg(score) + 1e-10, 4) AS turn_score_mean,
  round(avg((words BETWEEN 18 AND 120)::INT) + 1e-10, 4) AS length_compliance_rate, round(avg((nb > 0)::INT) + 1e-10, 4) AS forbidden_recommendation_rate FROM tt GROUP BY n""")
def user_dialogue_means(spark, sf):
    m = dg.turn_means(_scored(spark, sf), ["user_id"])
    return m.select("user_id", "turn_count", "interest_coverage_mean", "negative_avoidance_mean", "turn_score_mean", "length_compliance_rate", "forbidden_recommendation_rate")


@query("scenario_breakdown", f"""WITH {TOTAL} SELECT scenario_type, count(*) AS turn_count, round(avg(score) + 1e-10, 4) AS turn_score_mean, round(avg(round(cov / 5 + 1e-10, 4)) + 1e-10, 4) AS strategy_score_mean, round(avg(cov4) + 1e-10, 4) AS interest_coverage_mean,
  round(avg(conc) + 1e-10, 4) AS concreteness_mean, round(avg(flu) + 1e-10, 4) AS fluency_mean FROM tt GROUP BY 1""")
def scenario_breakdown(spark, sf):
    m = dg.turn_means(_scored(spark, sf), ["scenario_type"])
    return m.select("scenario_type", "turn_count", "turn_score_mean", "strategy_score_mean", "interest_coverage_mean", "concreteness_mean", "fluency_mean")


@query("dialogue_run_report", f"""WITH {TOTAL}, u AS (SELECT n, round(avg(score) + 1e-10, 4) AS s FROM tt GROUP BY 1) SELECT 'm' AS model, count(*) AS n_users, round(avg(s) + 1e-10, 4) AS overall_score_mean, count(*) FILTER (n % 11 = 3) AS n_errors, count(*) FILTER (n % 11 = 3 AND n % 2 = 0) AS n_blocked FROM u""")
def dialogue_run_report(spark, sf):
    n = F.col("user_id")
    users = dg.turn_means(_scored(spark, sf), ["user_id"]).select(
        F.lit("m").alias("model"), F.col("turn_score_mean").alias("overall_score"), F.when(n % 11 == 3, "no response").otherwise("").alias("error"), ((n % 11 == 3) & (n % 2 == 0)).alias("provider_blocked")
    )
    return dg.run_report(users, ["model"])


@query("fact_snippets", f"""WITH {GI}, {POST}, facts AS ({FACTS.format(inner="SELECT *, round(CASE bucket WHEN 'long_term' THEN 2.0::DOUBLE ELSE 1.4::DOUBLE END + 0.2::DOUBLE * ev + bonus + CASE WHEN rank = 0 THEN 0.15::DOUBLE ELSE 0 END + 1e-10, 4) AS score FROM g WHERE status = 'active' AND bucket <> 'negative'").replace("score AS rank_score FROM (", "score AS rank_score, [e1, e2, -1] AS ix FROM (")}),
e AS (SELECT user_id, position, unnest(ix) AS post_index, generate_subscripts(ix, 1) AS i FROM facts), j AS (SELECT e.user_id, e.position, e.post_index, p.post_id, md5(trim(p.text)) AS text_md5, CAST(row_number() OVER (PARTITION BY e.user_id, e.position ORDER BY i) AS INTEGER) AS snippet FROM e JOIN post p ON p.user_id = e.user_id AND p.post_index = e.post_index)
SELECT * FROM j WHERE snippet <= 2""")
def fact_snippets(spark, sf):
    rows = dg.fact_snippets(dg.interest_facts(interests(spark, sf)), posts(spark, sf))
    return rows.select("user_id", "position", "post_index", "post_id", F.md5("text").alias("text_md5"), "snippet")


@query("judge_inputs", """SELECT conv_id AS user_id, turn AS turn_id, CAST(least(500, length(r)) AS INTEGER) AS n_safe, CAST(least(900, length(r)) AS INTEGER) AS n_compact, 20 AS n_forbidden FROM (
  SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN 'do not pick ' ELSE '' END || text || CASE conv_id % 4 WHEN 0 THEN ' I would try it because it fits.' WHEN 1 THEN ' ```{"a": 1}' ELSE '' END AS r FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 3)""")
def judge_inputs(spark, sf):
    rows = turns(spark, sf).join(responses(spark, sf), ["user_id", "turn_id"]).withColumn("forbidden_labels", F.array_repeat(F.lit("x"), 30))
    rows = dg.compact_judge_input(dg.safe_judge_input(rows).withColumnRenamed("judge_input", "safe"))
    compact = F.from_json("judge_input", "rubric struct<forbidden_labels:array<string>>, assistant_response string")
    safe = F.from_json("safe", "assistant_response string")
    return rows.select("user_id", "turn_id", F.length(safe["assistant_response"]).alias("n_safe"), F.length(compact["assistant_response"]).alias("n_compact"), F.size(compact["rubric"]["forbidden_labels"]).alias("n_forbidden"))


@query("retry_stage", "SELECT conv_id AS request_key FROM conversations WHERE role = 'assistant' AND conv_id % 5 = 1 GROUP BY 1")
def retry_stage(spark, sf):
    """Requests that failed on the context limit go on, others do not."""
    keys = load(spark, sf, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("request_key")).distinct()
    n = F.col("request_key")
    error = F.when(n % 5 == 1, "Prompt is too long").when(n % 5 == 2, "HTTP 500")
    results = keys.select("request_key", error.alias("error"), F.when(n % 5 > 2, "ok").alias("content"))
    return dg.next_stage(keys, results, error_class(F.col("error")))


@query("distinct_labels", f"WITH {GI} SELECT user_id, domain, trim(arg_min(label, rank)) AS label, key FROM g GROUP BY user_id, domain, key")
def distinct_labels(spark, sf):
    """First spelling of each label key."""
    from ..functions.text import dialogue_label

    rows = interests(spark, sf).withColumn("key", dialogue_label(F.col("label"))).filter("key is not null")
    return rows.groupBy("user_id", "domain", "key").agg(F.min_by(F.trim("label"), "rank").alias("label"))
