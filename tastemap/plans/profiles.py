"""Domain packs, summary validation and gold export over events as posts with tags."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import round6, tag_form
from ..operators import packs, scoring, tags, timeline, validation
from ..session import cut_lineage, spread
from .adapters import REC, pick, records
from .registry import query
from .timeline import DOMAIN_AGG, FLAGS, INTEREST_AGG, REPRESENTATIVES, TAGGED

IFLAGS = FLAGS.replace("fl AS (", "ifl AS (").replace("r.*,", "r.*, r.tag AS interest,")
REPS = REPRESENTATIVES.format(limit=15, third=5, sixth=2, tail=5)
BASE = f"""{REC}, {FLAGS}, {DOMAIN_AGG}, {IFLAGS}, {INTEREST_AGG.replace("FROM fl", "FROM ifl")}, {TAGGED}, {REPS}, cl AS (
  SELECT user_id, domain, tag AS canonical_tag, count(DISTINCT post_id) AS n_posts, round(sum(dup_weight) + 1e-10, 6) AS weighted_support, round(avg(confidence) + 1e-10, 6) AS mean_confidence,
    least(min(raw_tag) FILTER (regexp_matches(trim(raw_tag), '_|\\S\\s+\\S')), min(CASE WHEN contains(tag, '_') THEN tag END)) AS phrase, min(created_at) AS a, max(created_at) AS b,
    CASE WHEN bool_and(modality_code = 1) THEN true ELSE false END AS visual FROM rec GROUP BY ALL
), ce AS (SELECT c.*, CASE canonical_tag WHEN 'retro_gam' THEN 'retro gaming' WHEN 'craft_beer' THEN 'craft beer' ELSE coalesce(replace(phrase, '_', ' '), replace(canonical_tag, '_', ' ')) END AS display_label, i.status AS istatus, i.stable_score AS iss
  FROM cl c LEFT JOIN interest_row i ON i.user_id = c.user_id AND i.domain = c.domain AND i.interest = c.canonical_tag)"""


def _parts(spark, sf):
    """The tables of the packs: records with tags, windows, statistics, clusters and so on."""
    # Stages are tables of their own: each one is written once and read by the stages after it.
    rec = cut_lineage(spread(records(spark, sf)).withColumn("tag", tag_form(F.col("raw_tag"))).withColumn("text", F.concat(F.lit("been cooking "), F.col("raw_tag"))))
    window = scoring.observation_window(rec)
    canonical = rec.select("user_id", "domain", "tag").distinct().withColumn("canonical_tag", F.col("tag"))
    p = {
        "rec": rec,
        "domains": scoring.domain_stats(rec, window),
        "interests": scoring.interest_stats(rec.withColumn("interest", F.col("tag")), window),
        "members": tags.cluster_members(rec, canonical),
        "evidence": tags.cluster_evidence(rec, canonical),
        "posts": rec.select("user_id", "post_id", F.col("post_id").alias("post_index"), "created_at", "text"),
        "reps": timeline.representative_posts(rec.select("user_id", "domain", "post_id", "confidence", "post_signal_strength", "created_at", F.when(F.col("k") >= 7, F.col("tag")).alias("first_tag"))).select("user_id", "domain", "post_id", "pick_order"),
        "sources": timeline.post_signal_sources(rec.withColumn("position", F.col("post_id")), "position"),
    }
    modal = rec.groupBy("user_id", "domain", F.col("tag").alias("canonical_tag")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_modalities")))).alias("modalities"))
    for part in ("interests", "members", "evidence", "domains", "reps"):
        p[part] = cut_lineage(p[part])
    p["clusters"] = packs.cluster_entries(tags.tag_clusters(rec, canonical), p["interests"], p["members"], p["evidence"], p["posts"]).join(modal, ["user_id", "domain", "canonical_tag"])
    p["clusters"] = cut_lineage(p["clusters"])
    p["examples"] = packs.evidence_examples(p["evidence"], p["posts"])
    return p


@query("domain_packs", f"""WITH {BASE}, u AS (SELECT DISTINCT user_id FROM rec WHERE user_id % 10 <> 0 UNION SELECT DISTINCT user_id FROM rec WHERE user_id % 10 = 0), ds AS (SELECT unnest(['sports_outdoor', 'entertainment', 'gaming', 'food_drink', 'travel_city_exploration', 'photography_creation', 'pets']) AS domain)
SELECT u.user_id, ds.domain, coalesce(status, 'absent') AS status, coalesce(stable_score, 0) AS stable_score, coalesce(recent_score, 0) AS recent_score, coalesce(n_support, 0) AS n_support, coalesce(n_weak, 0) AS n_weak, status IS NOT NULL AND status <> 'absent' AS domain_present
FROM u CROSS JOIN ds LEFT JOIN (SELECT * FROM dom WHERE user_id % 10 <> 0) d ON d.user_id = u.user_id AND d.domain = ds.domain""")
def domain_packs(spark, sf):
    """Every tenth user has no statistics and gets seven absent domains."""
    p = _parts(spark, sf)
    rows = packs.all_domains(p["rec"], p["domains"].filter("user_id % 10 != 0"))
    return rows.select("user_id", "domain", "status", "stable_score", "recent_score", "n_support", "n_weak", "domain_present")


@query("pack_clusters", f"""WITH {BASE} SELECT user_id, domain, canonical_tag, display_label, n_posts, weighted_support, mean_confidence, coalesce(istatus, 'weak_signal') AS status, coalesce(iss, 0) AS stable_score, strftime(a, '%Y-%m') AS first_seen, strftime(b, '%Y-%m') AS last_seen FROM ce""")
def pack_clusters(spark, sf):
    c = _parts(spark, sf)["clusters"]
    return c.select("user_id", "domain", "canonical_tag", "display_label", "n_posts", "weighted_support", "mean_confidence", "status", "stable_score", "first_seen", "last_seen")


@query("evidence_examples", f"WITH {REC}, e AS (SELECT DISTINCT user_id, domain, tag AS canonical_tag, post_id FROM rec) SELECT *, CAST(row_number() OVER (PARTITION BY user_id, domain, canonical_tag ORDER BY post_id) AS INTEGER) AS example FROM e QUALIFY example <= 3")
def evidence_examples(spark, sf):
    return _parts(spark, sf)["examples"].select("user_id", "domain", "canonical_tag", "post_id", "example")


@query("member_spellings", f"""WITH {REC}, t AS (SELECT DISTINCT user_id, domain, tag AS c, unnest([tag, replace(tag, '_', ' '), raw_tag, replace(raw_tag, '_', ' ')]) AS tok FROM rec
  UNION SELECT user_id, domain, tag, CASE tag WHEN 'retro_gam' THEN 'retro gaming' WHEN 'craft_beer' THEN 'craft beer' ELSE tag END FROM rec)
SELECT user_id, domain, trim(regexp_replace(replace(replace(lower(tok), '_', ' '), '-', ' '), '\\s+', ' ', 'g')) AS key, min(c) AS canonical_tag FROM t GROUP BY ALL""")
def member_spellings(spark, sf):
    p = _parts(spark, sf)
    return validation.member_map(p["clusters"], p["members"])


def _items(rec):
    """Summary items as a model might write them: one per (user, domain, tag) cited in some posts.

    Every fourth has no label, some cite nothing, one kind is about jobs, labels repeat in upper case.
    """
    r = rec.select("user_id", "domain", "post_id", "tag", "k")
    g = r.groupBy("user_id", "domain", "tag").agg(F.min("post_id").alias("item"), F.max("k").alias("k"))
    k = F.col("k")
    bucket = pick(["stable", "short", "weak"], F.floor(F.col("item") / 7) % 3)
    label = F.when(F.col("item") % 4 == 0, " ").when(F.col("item") % 13 == 0, "my job").when(F.col("item") % 5 == 0, F.upper("tag")).when(F.col("item") % 9 == 0, "shared label").otherwise(F.col("tag"))
    rows = g.select(
        "user_id", "domain", "item", "tag", bucket.alias("bucket"), label.alias("label"),
        F.when(F.col("item") % 4 == 0, F.array(F.lit("unknown"), F.replace("tag", F.lit("_"), F.lit("-")), F.col("tag"))).otherwise(F.array().cast("array<string>")).alias("given_tags"),
        F.lit("").alias("description"), (k / 50.0).cast("string").alias("confidence"), F.lit(None).cast("string").alias("reasoning"),
    )
    rows = cut_lineage(rows)
    cites = r.join(rows.select("user_id", "domain", "tag", "bucket", "item"), ["user_id", "domain", "tag"]).filter("item % 3 != 0 and post_id % 2 = 0")
    ids = cut_lineage(cites.select("user_id", "domain", "bucket", "item", F.lit("all").alias("kind"), F.col("post_id").alias("ord"), "post_id"))
    ids = ids.unionByName(ids.withColumn("kind", F.lit("rep")).withColumn("ord", -F.col("post_id"))).unionByName(ids.withColumn("post_id", F.lit(-1).cast("long")))
    return rows.drop("tag"), ids


ITEMS = f"""{BASE}, g0 AS (SELECT user_id, domain, tag, min(post_id) AS item, max(k) AS k FROM rec GROUP BY ALL
), g1 AS (SELECT *, list_extract(['stable', 'short', 'weak'], CAST(1 + (item // 7) % 3 AS BIGINT)) AS bucket, CASE WHEN item % 4 = 0 THEN NULL WHEN item % 13 = 0 THEN 'my job' WHEN item % 5 = 0 THEN upper(tag) WHEN item % 9 = 0 THEN 'shared label' ELSE tag END AS lab, least(1.0::DOUBLE, k / 50.0::DOUBLE) AS conf FROM g0
), cit AS (SELECT DISTINCT g.user_id, g.domain, g.bucket, g.item, r.post_id FROM rec r JOIN g1 g USING (user_id, domain, tag) WHERE g.item % 3 <> 0 AND r.post_id % 2 = 0
), hascit AS (SELECT DISTINCT user_id, domain, bucket, item FROM cit
), g2 AS (SELECT g.*, h.item IS NOT NULL AS cited, CASE WHEN g.item % 4 = 0 OR h.item IS NOT NULL OR g.lab NOT IN ('my job', 'shared label') THEN tag END AS ctag FROM g1 g LEFT JOIN hascit h USING (user_id, domain, bucket, item)
), g3 AS (SELECT g2.*, coalesce(lab, display_label) AS label, ce.display_label FROM g2 LEFT JOIN ce ON ce.user_id = g2.user_id AND ce.domain = g2.domain AND ce.canonical_tag = g2.tag
), ok AS (SELECT * FROM g3 WHERE label <> 'my job'
), iev AS (SELECT c.* FROM cit c SEMI JOIN ok USING (user_id, domain, bucket, item) UNION ALL SELECT DISTINCT o.user_id, o.domain, o.bucket, o.item, r.post_id FROM ok o JOIN rec r ON r.user_id = o.user_id AND r.domain = o.domain AND r.tag = o.ctag WHERE NOT o.cited)"""


def _cleaned(spark, sf):
    p = _parts(spark, sf)
    items, ids = _items(p["rec"])
    rows, ev = validation.cleaned(items, ids, p["clusters"], p["members"], p["evidence"], p["reps"])
    return p, ids, rows, cut_lineage(ev)


@query("cleaned_interests", f"""WITH {ITEMS} SELECT user_id, domain, bucket, item, label, coalesce(ctag, '') AS canonical_tags, round(conf + 1e-10, 6) AS confidence,
  CASE WHEN ctag IS NULL THEN 'Evidence in this domain points to ' || label || ' as a potential interest signal.' ELSE 'Evidence in this domain consistently points to ' || label || ' as a meaningful interest signal.' END AS description,
  CASE WHEN label = 'my job' THEN 'excluded_non_interest_attribute' END AS drop_reason FROM g3""")
def cleaned_interests(spark, sf):
    _, _, rows, _ = _cleaned(spark, sf)
    return rows.select("user_id", "domain", "bucket", "item", "label", F.array_join("canonical_tags", ",").alias("canonical_tags"), round6(F.col("confidence")).alias("confidence"), "description", "drop_reason")


@query("interest_evidence", f"WITH {ITEMS} SELECT user_id, domain, bucket, item, post_id FROM iev")
def interest_evidence(spark, sf):
    _, _, _, ev = _cleaned(spark, sf)
    return ev.select("user_id", "domain", "bucket", "item", "post_id")


@query("representative_ids", f"""WITH {ITEMS}, r AS (SELECT i.*, CASE WHEN o.cited THEN -i.post_id ELSE i.post_id END AS w FROM iev i JOIN ok o USING (user_id, domain, bucket, item))
SELECT user_id, domain, bucket, item, CAST(row_number() OVER (PARTITION BY user_id, domain, bucket, item ORDER BY w) AS INTEGER) AS pick, post_id FROM r QUALIFY pick <= 3""")
def representative_ids(spark, sf):
    _, ids, _, ev = _cleaned(spark, sf)
    return validation.representative_ids(ev, ids)


DOWN = f"""{ITEMS}, nev AS (SELECT user_id, domain, bucket, item, count(DISTINCT post_id) AS n FROM iev GROUP BY ALL
), d0 AS (SELECT o.*, o.bucket = 'stable' AND (coalesce(stable_score, 0) < 0.55 OR coalesce(n, 0) < 2) AS moved, trim(replace(replace(lower(label), '_', ' '), '-', ' ')) AS nk FROM ok o LEFT JOIN nev USING (user_id, domain, bucket, item) LEFT JOIN dom d ON d.user_id = o.user_id AND d.domain = o.domain
), d1 AS (SELECT *, CASE WHEN moved THEN 'weak' WHEN bucket = 'stable' AND EXISTS (SELECT 1 FROM d0 x WHERE x.moved AND x.user_id = d0.user_id AND x.domain = d0.domain AND x.nk = d0.nk) THEN NULL ELSE bucket END AS nb FROM d0
), mg AS (SELECT user_id, domain, nb AS bucket, lower(trim(label)) AS merge_key, arg_min(label, (-conf, moved::INT, item)) AS label, max(conf) AS confidence, string_agg(DISTINCT ctag, ',' ORDER BY ctag) AS ctags FROM d1 WHERE nb IS NOT NULL GROUP BY ALL
), mp AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, domain, bucket ORDER BY confidence DESC, label) - 1 AS INTEGER) AS position FROM mg
), mev AS (SELECT DISTINCT d1.user_id, d1.domain, nb AS bucket, lower(trim(label)) AS merge_key, post_id FROM d1 JOIN iev ON iev.user_id = d1.user_id AND iev.domain = d1.domain AND iev.bucket = d1.bucket AND iev.item = d1.item WHERE nb IS NOT NULL)"""


@query("downgraded_interests", f"WITH {DOWN} SELECT user_id, domain, item, bucket, nb AS new_bucket FROM d1")
def downgraded_interests(spark, sf):
    p, _, rows, ev = _cleaned(spark, sf)
    return validation.downgraded(rows.filter("drop_reason is null"), ev, p["domains"]).select("user_id", "domain", "item", "bucket", "new_bucket")


def _merged(spark, sf):
    p, ids, rows, ev = _cleaned(spark, sf)
    return p, *_merged_from(p, ids, rows, ev)


def _merged_from(p, ids, rows, ev):
    moved = validation.downgraded(rows.filter("drop_reason is null"), ev, p["domains"]).filter("new_bucket is not null")
    # Three parts of the merge read these.
    moved = cut_lineage(moved.withColumn("source_bucket", F.col("bucket")).withColumn("bucket", F.col("new_bucket")))
    items, evidence = validation.merged(moved, ev, validation.representative_ids(ev, ids), ["late", "item"])
    return cut_lineage(items), cut_lineage(evidence)


@query("merged_interests", f"WITH {DOWN} SELECT user_id, domain, bucket, label, round(confidence + 1e-10, 6) AS confidence, coalesce(ctags, '') AS canonical_tags, position FROM mp")
def merged_interests(spark, sf):
    _, items, _ = _merged(spark, sf)
    return items.select("user_id", "domain", "bucket", "label", round6(F.col("confidence")).alias("confidence"), F.array_join("canonical_tags", ",").alias("canonical_tags"), "position")


@query("merged_evidence", f"WITH {DOWN} SELECT * FROM mev")
def merged_evidence(spark, sf):
    _, _, ev = _merged(spark, sf)
    return ev.drop("at")


@query("backfilled_candidates", f"""WITH {DOWN}, have AS (SELECT DISTINCT user_id, domain FROM mp WHERE bucket IN ('stable', 'short'))
SELECT o.user_id, o.domain, o.item, CASE o.item % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'short' ELSE 'weak' END AS bucket FROM ok o ANTI JOIN have USING (user_id, domain)""")
def backfilled_candidates(spark, sf):
    p, ids, rows, ev = _cleaned(spark, sf)
    items, _ = _merged_from(p, ids, rows, ev)
    hint = pick(["stable_candidate", "recent_candidate", "weak_candidate", "unheard of"], F.col("item") % 4)
    good = rows.filter("drop_reason is null").withColumn("time_hint", hint).drop("bucket")
    return validation.backfill_candidates(good, items, p["domains"]).select("user_id", "domain", "item", "bucket")


SEEDS = f"""sd AS (SELECT *, round(weighted_support * greatest(0.1::DOUBLE, mean_confidence) + 0.05::DOUBLE * n_posts + 0.08::DOUBLE * (len(string_split(trim(display_label), ' ')) - 1), 9) AS rnk FROM ce
  WHERE (n_posts >= 2 OR weighted_support >= 1.2) AND NOT (domain = 'pets' AND canonical_tag IN ('cat', 'dog') AND visual))"""


@query("seed_clusters", f"WITH {BASE}, {SEEDS} SELECT user_id, domain, canonical_tag, display_label AS label, mean_confidence AS confidence, istatus AS status FROM sd WHERE istatus IN ('stable', 'recent') QUALIFY row_number() OVER (PARTITION BY user_id, domain, istatus ORDER BY rnk DESC, canonical_tag) = 1")
def seed_clusters(spark, sf):
    p = _parts(spark, sf)
    both = [validation.seed_clusters(p["clusters"], p["examples"], s).withColumn("status", F.lit(s)) for s in ("stable", "recent")]
    return both[0].unionByName(both[1])


@query("seeded_interests", f"""WITH {DOWN}, {SEEDS}, one AS (SELECT * FROM sd WHERE istatus IN ('stable', 'recent') QUALIFY row_number() OVER (PARTITION BY user_id, domain, istatus ORDER BY rnk DESC, canonical_tag) = 1)
SELECT o.user_id, o.domain, o.canonical_tag, CASE o.istatus WHEN 'stable' THEN 'stable' ELSE 'short' END AS bucket FROM one o JOIN dom d ON d.user_id = o.user_id AND d.domain = o.domain
WHERE ((o.istatus = 'stable' AND d.status IN ('stable', 'stable_with_recent_surge')) OR (o.istatus = 'recent' AND d.status = 'recent')) AND NOT EXISTS (SELECT 1 FROM mp WHERE mp.user_id = o.user_id AND mp.domain = o.domain AND mp.bucket = CASE o.istatus WHEN 'stable' THEN 'stable' ELSE 'short' END)""")
def seeded_interests(spark, sf):
    p, items, _ = _merged(spark, sf)
    return validation.seeded(items, p["domains"], p["clusters"], p["examples"]).select("user_id", "domain", "canonical_tag", "bucket")


TEXTS = f"""{DOWN}, lb AS (SELECT user_id, domain, string_agg(label, ', ' ORDER BY position) FILTER (bucket = 'stable') AS st, string_agg(label, ', ' ORDER BY position) FILTER (bucket = 'short') AS sh, string_agg(label, ', ' ORDER BY position) FILTER (bucket = 'weak') AS wk FROM mp WHERE position < 2 GROUP BY ALL
), tx AS (SELECT d.user_id, d.domain, d.status, stable_score, CASE WHEN d.user_id % 3 = 0 THEN 'A fine summary.' WHEN d.user_id % 3 = 1 THEN 'Domain evidence status is weak' ELSE '' END AS given, st, sh, wk, st IS NULL AND sh IS NULL AND wk IS NULL AS empty FROM dom d LEFT JOIN lb USING (user_id, domain))"""


@query("summary_texts", f"""WITH {TEXTS} SELECT user_id, domain, given <> 'A fine summary.' AS rewritten,
  CASE WHEN given = 'A fine summary.' THEN given WHEN empty THEN '{validation.NO_INTEREST}' ELSE concat_ws(' ', 'This domain most clearly reflects a sustained interest in ' || st || '.', 'There is also a more recent or emerging focus on ' || sh || '.', 'Weaker signals also point to ' || wk || ', but the evidence is not yet strong enough to treat them as central interests.') END AS domain_summary,
  nullif(concat_ws(' ', CASE WHEN empty THEN '{validation.SPARSE_NOTE}' WHEN stable_score < 0.55 THEN '{validation.LOW_NOTE}' END, CASE WHEN user_id % 8 = 0 THEN '{validation.FALLBACK_NOTE}' END), '') AS uncertainty_note FROM tx""")
def summary_texts(spark, sf):
    p, items, _ = _merged(spark, sf)
    u = F.col("user_id")
    d = p["domains"].select("user_id", "domain", "stable_score", F.when(u % 3 == 0, " A fine summary.").when(u % 3 == 1, "Domain evidence status is weak").otherwise("").alias("domain_summary"), F.lit(" ").alias("uncertainty_note"), (u % 8 == 0).alias("failed"))
    rows = validation.summary_texts(d, items)
    return rows.select("user_id", "domain", "rewritten", "domain_summary", F.nullif("uncertainty_note", F.lit("")).alias("uncertainty_note"))


# The whole validation: candidates of the first pass are the usable items with a time hint.
WHOLE = f"""{DOWN}, {SEEDS}, live AS (SELECT DISTINCT user_id, domain FROM d1 WHERE nb IN ('stable', 'short')
), bf AS (SELECT o.*, CASE o.item % 4 WHEN 0 THEN 'stable' WHEN 1 THEN 'short' ELSE 'weak' END AS tb FROM ok o ANTI JOIN live USING (user_id, domain)
), every_item AS (SELECT user_id, domain, nb AS bucket, label, conf, moved::INT AS late, item FROM d1 WHERE nb IS NOT NULL UNION ALL SELECT user_id, domain, tb, label, conf, 2, item FROM bf
), fm AS (SELECT user_id, domain, bucket, arg_min(label, (-conf, late, item)) AS label, max(conf) AS confidence FROM every_item GROUP BY user_id, domain, bucket, lower(trim(label))
), sdd AS (SELECT o.user_id, o.domain, CASE o.istatus WHEN 'stable' THEN 'stable' ELSE 'short' END AS bucket, o.display_label AS label, o.mean_confidence AS confidence FROM (SELECT * FROM sd WHERE istatus IN ('stable', 'recent') QUALIFY row_number() OVER (PARTITION BY user_id, domain, istatus ORDER BY rnk DESC, canonical_tag) = 1) o JOIN dom d ON d.user_id = o.user_id AND d.domain = o.domain
  WHERE ((o.istatus = 'stable' AND d.status IN ('stable', 'stable_with_recent_surge')) OR (o.istatus = 'recent' AND d.status = 'recent')) AND NOT EXISTS (SELECT 1 FROM fm WHERE fm.user_id = o.user_id AND fm.domain = o.domain AND fm.bucket = CASE o.istatus WHEN 'stable' THEN 'stable' ELSE 'short' END)
), fin AS (SELECT * FROM fm UNION ALL SELECT * FROM sdd
), cnt AS (SELECT d.user_id, d.domain, (SELECT count(*) FILTER (bucket = 'stable') || '/' || count(*) FILTER (bucket = 'short') || '/' || count(*) FILTER (bucket = 'weak') FROM g1 WHERE g1.user_id = d.user_id AND g1.domain = d.domain) AS before,
    (SELECT count(*) FILTER (bucket = 'stable') || '/' || count(*) FILTER (bucket = 'short') || '/' || count(*) FILTER (bucket = 'weak') FROM fin WHERE fin.user_id = d.user_id AND fin.domain = d.domain) AS after FROM dom d)"""


def _validated(spark, sf):
    p = _parts(spark, sf)
    items, ids = _items(p["rec"])
    hint = pick(["stable_candidate", "recent_candidate", "weak_candidate", "unheard of"], F.col("item") % 4)
    found, found_ev = validation.cleaned(items, ids, p["clusters"], p["members"], p["evidence"], p["reps"])
    u = F.col("user_id")
    told = F.when(u % 3 == 0, " A fine summary.").when(u % 3 == 1, "Domain evidence status is weak").otherwise("")
    summaries = p["domains"].select("user_id", "domain", "stable_score", told.alias("domain_summary"), F.when(u % 4 == 1, "Unsure").otherwise(" ").alias("uncertainty_note"), F.lit(False).alias("failed"))
    return validation.validated(
        items, ids, p["clusters"], p["members"], p["evidence"], p["reps"], p["examples"], p["domains"], summaries, (found.withColumn("time_hint", hint), found_ev))


@query("validated_interests", f"WITH {WHOLE} SELECT user_id, domain, bucket, label, round(confidence + 1e-10, 6) AS confidence FROM fin")
def validated_interests(spark, sf):
    return _validated(spark, sf)["items"].select("user_id", "domain", "bucket", "label", round6(F.col("confidence")).alias("confidence"))


@query("validation_actions", f"""WITH {WHOLE}, note AS (SELECT d.user_id, d.domain, CASE WHEN NOT EXISTS (SELECT 1 FROM fin WHERE fin.user_id = d.user_id AND fin.domain = d.domain) THEN 'no_structured_interests' WHEN stable_score < 0.55 THEN 'low_stable_score' END AS why FROM dom d WHERE d.user_id % 4 <> 1)
SELECT user_id, domain, 'drop_interest' AS type, label AS interest, bucket AS from_bucket, NULL::VARCHAR AS to_bucket, 'excluded_non_interest_attribute' AS reason, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM g3 WHERE label = 'my job'
UNION ALL SELECT user_id, domain, 'downgrade_interest', label, 'stable', 'weak', 'insufficient_stability_or_evidence_spread', NULL, NULL FROM d1 WHERE moved
UNION ALL SELECT user_id, domain, 'backfill_interest_from_pass1', label, NULL, tb, 'pass1_' || CASE item % 4 WHEN 0 THEN 'stable_candidate' WHEN 1 THEN 'recent_candidate' ELSE 'weak_candidate' END, NULL, NULL FROM bf
UNION ALL SELECT user_id, domain, 'seed_interest_from_cluster', label, NULL, bucket, 'status_requires_' || CASE bucket WHEN 'stable' THEN 'stable' ELSE 'recent' END || '_interest_with_nontrivial_cluster', NULL, NULL FROM sdd
UNION ALL SELECT user_id, domain, 'rewrite_domain_summary', NULL, NULL, NULL, 'missing_or_placeholder_summary', NULL, NULL FROM dom WHERE user_id % 3 <> 0
UNION ALL SELECT user_id, domain, 'set_uncertainty_note', NULL, NULL, NULL, why, NULL, NULL FROM note WHERE why IS NOT NULL
UNION ALL SELECT user_id, domain, 'interest_bucket_count_change', NULL, NULL, NULL, NULL, before, after FROM cnt WHERE before <> after""")
def validation_actions(spark, sf):
    return _validated(spark, sf)["actions"]


@query("domain_evidence_rollup", f"""WITH {DOWN}, pl AS (SELECT e.user_id, e.domain, e.post_id, CASE e.bucket WHEN 'stable' THEN 0 WHEN 'short' THEN 1 ELSE 2 END AS a FROM mev e UNION ALL SELECT user_id, domain, post_id, 3 FROM rec UNION ALL SELECT user_id, domain, post_id, 4 FROM rep)
SELECT user_id, domain, post_id, CAST(min(a) AS INTEGER) AS source_level FROM pl GROUP BY ALL""")
def domain_evidence_rollup(spark, sf):
    p, items, ev = _merged(spark, sf)
    rows = validation.domain_evidence_rows(items, ev, p["evidence"], p["reps"])
    return rows.select("user_id", "domain", "post_id", F.col("place.place.a").alias("source_level"))


EXPORT = f"""{DOWN}, stt AS (SELECT d.user_id, d.domain, CASE WHEN EXISTS (SELECT 1 FROM mp WHERE mp.user_id = d.user_id AND mp.domain = d.domain AND bucket IN ('stable', 'short')) THEN 'active' ELSE 'inactive' END AS status FROM dom d
), ex AS (SELECT mp.*, stt.status FROM mp JOIN stt USING (user_id, domain) WHERE position < 3 AND (status = 'active' OR bucket = 'weak'))"""


@query("export_interests", f"WITH {EXPORT} SELECT user_id, domain, status, CASE bucket WHEN 'stable' THEN 'long_term' WHEN 'short' THEN 'short_term' ELSE 'negative' END AS bucket, label, position FROM ex")
def export_interests(spark, sf):
    p, items, _ = _merged(spark, sf)
    rows = validation.export_interests(items, validation.export_status(items, p["domains"]))
    return rows.select("user_id", "domain", "status", F.col("export_bucket").alias("bucket"), "label", "position")


@query("atomic_summaries", f"""WITH {EXPORT}, l AS (SELECT user_id, domain, string_agg(label, ', ' ORDER BY position) FILTER (bucket = 'stable') AS st, string_agg(label, ', ' ORDER BY position) FILTER (bucket = 'short') AS sh FROM ex GROUP BY ALL)
SELECT user_id, domain, status, 'In ' || domain || CASE WHEN st IS NOT NULL AND sh IS NOT NULL THEN ', the user shows a long-term interest in ' || st || '. Recent or emerging interests include ' || sh || '.' WHEN st IS NOT NULL THEN ', the user shows a long-term interest in ' || st || '.'
  WHEN sh IS NOT NULL THEN ', the strongest identifiable signal is a recent or emerging interest in ' || sh || '.' ELSE ', no reliable interest can be established from the observed posts.' END AS summary_atomic,
  CASE WHEN user_id % 3 = 0 THEN 'A fine summary.' WHEN status = 'active' THEN NULL WHEN user_id % 3 = 1 THEN 'This domain does not currently provide a reliable profile signal. Unsure' ELSE 'This domain does not currently provide a reliable profile signal.' END AS fallback FROM stt LEFT JOIN l USING (user_id, domain)""")
def atomic_summaries(spark, sf):
    p, items, _ = _merged(spark, sf)
    status = validation.export_status(items, p["domains"])
    ex = validation.export_interests(items, status)
    labels = status.join(validation.bucket_labels(ex, 3), ["user_id", "domain"], "left")
    none = F.array().cast("array<string>")
    atomic = packs.atomic_summary(F.col("domain"), F.col("status"), F.coalesce("stable", none), F.coalesce("short", none))
    u = F.col("user_id")
    natural = validation.natural_summary(F.col("status"), F.lit(" "), F.when(u % 3 == 0, "A fine summary."), F.when(u % 3 == 1, "Unsure"), F.lit(None).cast("string"))
    return labels.select("user_id", "domain", "status", atomic.alias("summary_atomic"), natural.alias("fallback"))


@query("export_evidence_indices", f"""WITH {EXPORT}, o AS (SELECT d1.user_id, d1.domain, nb AS bucket, lower(trim(label)) AS merge_key, iev.post_id, min((moved::INT, d1.item)) AS w FROM d1 JOIN iev ON iev.user_id = d1.user_id AND iev.domain = d1.domain AND iev.bucket = d1.bucket AND iev.item = d1.item WHERE nb IS NOT NULL GROUP BY ALL)
SELECT user_id, domain, bucket, merge_key, CAST(row_number() OVER (PARTITION BY user_id, domain, bucket, merge_key ORDER BY w, post_id) AS INTEGER) AS nth, post_id AS post_index FROM o SEMI JOIN ex USING (user_id, domain, bucket, merge_key) QUALIFY nth <= 3""")
def export_evidence_indices(spark, sf):
    p, items, ev = _merged(spark, sf)
    key = ["user_id", "domain", "bucket", "merge_key"]
    ex = validation.export_interests(items, validation.export_status(items, p["domains"]))
    return validation.evidence_indices(ev.join(ex.select(*key), key, "left_semi"), p["posts"], key, 3)


@query("export_evidence_sources", f"""WITH {EXPORT} SELECT DISTINCT e.user_id, e.domain, e.bucket, e.merge_key, CASE modality_code WHEN 0 THEN 'text_only' WHEN 1 THEN 'visual_only' ELSE 'mixed' END AS evidence_modality, e.post_id, e.post_id AS post_index FROM mev e SEMI JOIN ex USING (user_id, domain, bucket, merge_key) JOIN rec r ON r.user_id = e.user_id AND r.domain = e.domain AND r.post_id = e.post_id WHERE modality_code < 3""")
def export_evidence_sources(spark, sf):
    p, items, ev = _merged(spark, sf)
    key = ["user_id", "domain", "bucket", "merge_key"]
    ex = validation.export_interests(items, validation.export_status(items, p["domains"]))
    return validation.evidence_sources(ev.join(ex.select(*key), key, "left_semi"), p["sources"], p["posts"], key)


@query("export_domain_evidence", f"""WITH {EXPORT}, o AS (SELECT d1.user_id, d1.domain, nb AS bucket, lower(trim(label)) AS merge_key, iev.post_id, min((moved::INT, d1.item)) AS w FROM d1 JOIN iev ON iev.user_id = d1.user_id AND iev.domain = d1.domain AND iev.bucket = d1.bucket AND iev.item = d1.item WHERE nb IS NOT NULL GROUP BY ALL
), wl AS (SELECT o.user_id, o.domain, o.post_id, min((CASE ex.bucket WHEN 'stable' THEN 0 WHEN 'short' THEN 1 ELSE 2 END, ex.position, o.w, o.post_id)) AS w FROM o JOIN (SELECT mp.*, stt.status FROM mp JOIN stt USING (user_id, domain)) ex USING (user_id, domain, bucket, merge_key) WHERE (ex.status = 'active' AND ex.bucket <> 'weak' AND ex.position < 3) OR (ex.status <> 'active' AND ex.bucket = 'weak') GROUP BY ALL
), fs AS (SELECT user_id, domain, CAST(row_number() OVER (PARTITION BY user_id, domain ORDER BY w) AS INTEGER) AS nth, post_id FROM wl QUALIFY nth <= 4
), rs AS (SELECT r.user_id, r.domain, CAST(row_number() OVER (PARTITION BY r.user_id, r.domain ORDER BY pick_order) AS INTEGER) AS nth, r.post_id FROM rep r SEMI JOIN stt USING (user_id, domain) ANTI JOIN wl USING (user_id, domain) QUALIFY row_number() OVER (PARTITION BY r.user_id, r.domain ORDER BY pick_order) <= 4)
SELECT * FROM fs UNION ALL SELECT * FROM rs""")
def export_domain_evidence(spark, sf):
    p, items, ev = _merged(spark, sf)
    status = validation.export_status(items, p["domains"])
    return validation.domain_evidence_ids(status, items, ev, p["reps"])


@query("rewrite_examples", f"""WITH {EXPORT}, xs AS (SELECT DISTINCT user_id, domain, post_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain, tag ORDER BY post_id) AS n FROM (SELECT DISTINCT user_id, domain, tag, post_id FROM rec)) WHERE n <= 3
), o AS (SELECT d1.user_id, d1.domain, nb AS bucket, lower(trim(label)) AS merge_key, iev.post_id, min((moved::INT, d1.item)) AS w FROM d1 JOIN iev ON iev.user_id = d1.user_id AND iev.domain = d1.domain AND iev.bucket = d1.bucket AND iev.item = d1.item WHERE nb IS NOT NULL GROUP BY ALL
), sh AS (SELECT o.*, rep.post_id IS NOT NULL AS is_representative, xs.post_id IS NOT NULL AS ex FROM o LEFT JOIN rep ON rep.user_id = o.user_id AND rep.domain = o.domain AND rep.post_id = o.post_id LEFT JOIN xs ON xs.user_id = o.user_id AND xs.domain = o.domain AND xs.post_id = o.post_id)
SELECT user_id, domain, bucket, merge_key, CAST(row_number() OVER (PARTITION BY user_id, domain, bucket, merge_key ORDER BY w, post_id) AS INTEGER) AS nth, post_id, is_representative FROM sh WHERE is_representative OR ex QUALIFY nth <= 2""")
def rewrite_examples(spark, sf):
    p, _, ev = _merged(spark, sf)
    reps = p["reps"].join(p["posts"], ["user_id", "post_id"])
    rows = validation.example_lookup(ev, reps, p["examples"], ["user_id", "domain", "bucket", "merge_key"])
    return rows.drop("text")


@query("rewrite_requests", f"""WITH {EXPORT}, xs AS (SELECT DISTINCT user_id, domain, post_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, domain, tag ORDER BY post_id) AS n FROM (SELECT DISTINCT user_id, domain, tag, post_id FROM rec)) WHERE n <= 3
), shown AS (SELECT user_id, domain, post_id FROM rep UNION SELECT user_id, domain, post_id FROM xs
), o AS (SELECT DISTINCT m.user_id, m.domain, m.bucket, m.merge_key, m.post_id FROM mev m SEMI JOIN shown USING (user_id, domain, post_id)
), per AS (SELECT user_id, domain, bucket, merge_key, least(2, count(*)) AS n FROM o GROUP BY ALL
), li AS (SELECT ex.user_id, ex.domain, count(*) FILTER (ex.bucket = 'stable') AS ns, count(*) FILTER (ex.bucket = 'short') AS nh, CAST(sum(coalesce(per.n, 0)) FILTER (ex.bucket <> 'weak') AS BIGINT) AS nx, first(ex.label) FILTER (ex.bucket = 'stable' AND ex.position = 0) AS lead FROM ex LEFT JOIN per USING (user_id, domain, bucket, merge_key) GROUP BY ALL
), wk AS (SELECT user_id, domain, count(*) AS nw FROM mp WHERE bucket = 'weak' AND position < 2 GROUP BY ALL
), wx AS (SELECT o.user_id, o.domain, least(2, count(DISTINCT o.post_id)) AS nwx FROM o JOIN mp USING (user_id, domain, bucket, merge_key) WHERE bucket = 'weak' AND position < 2 GROUP BY ALL)
SELECT s.user_id, s.domain, 'rewrite__' || s.user_id || '__' || s.domain AS request_key, s.status, CAST(coalesce(ns, 0) AS INTEGER) AS n_long_term, CAST(coalesce(nh, 0) AS INTEGER) AS n_short_term, CAST(coalesce(nx, 0) AS INTEGER) AS n_examples, lead, CAST(coalesce(nw, 0) AS INTEGER) AS n_weak_labels, CAST(coalesce(nwx, 0) AS INTEGER) AS n_weak_examples, 'Sum ' || s.user_id AS source_domain_summary
FROM stt s LEFT JOIN li USING (user_id, domain) LEFT JOIN wk USING (user_id, domain) LEFT JOIN wx USING (user_id, domain)""")
def rewrite_requests(spark, sf):
    p, items, ev = _merged(spark, sf)
    reps = p["reps"].join(p["posts"], ["user_id", "post_id"])
    texts = p["domains"].select("user_id", "domain", F.concat(F.lit("Sum "), "user_id").alias("domain_summary"), F.lit(None).cast("string").alias("uncertainty_note"))
    rows = validation.rewrite_requests(p["domains"], items, ev, reps, p["examples"], texts)
    entry = "array<struct<label: string, evidence_examples: array<struct<post_id: bigint>>>>"
    body = F.from_json("user_prompt", f"long_term_interests {entry}, short_term_interests {entry}, weak_signal_labels array<string>, weak_signal_examples array<struct<post_id: bigint>>, source_domain_summary string")
    size = lambda c: F.size(body[c])
    total = F.aggregate(F.concat(body["long_term_interests"], body["short_term_interests"]), F.lit(0), lambda n, x: n + F.size(x["evidence_examples"]))
    return rows.select(
        "user_id", "domain", "request_key", "status", size("long_term_interests").alias("n_long_term"), size("short_term_interests").alias("n_short_term"), total.alias("n_examples"), F.get(body["long_term_interests"], F.lit(0))["label"].alias("lead"),
        size("weak_signal_labels").alias("n_weak_labels"), size("weak_signal_examples").alias("n_weak_examples"), body["source_domain_summary"].alias("source_domain_summary"))


@query("summary_requests", f"""WITH {BASE}, c AS (SELECT user_id, domain, count(*) AS n FROM ce GROUP BY ALL), r AS (SELECT user_id, domain, count(*) AS n FROM rep GROUP BY ALL)
SELECT 'summary__' || d.user_id || '__' || d.domain || '__2' AS request_key, CAST(c.n AS INTEGER) AS n_clusters, CAST(r.n AS INTEGER) AS n_representatives, CAST(least(12, r.n) AS INTEGER) AS n_images, d.status, d.user_id % 2 = 0 AS has_first FROM dom d JOIN c USING (user_id, domain) JOIN r USING (user_id, domain)""")
def summary_requests(spark, sf):
    """Second-stage requests carry the first stage's answer where there is one (even users)."""
    p = _parts(spark, sf)
    pk = packs.all_domains(p["rec"], p["domains"])
    reps = p["reps"].join(p["posts"], ["user_id", "post_id"]).withColumn("image_url", F.concat(F.lit("https://img.example/"), "post_id"))
    first = p["domains"].filter("user_id % 2 = 0").select("user_id", "domain", F.lit('{"candidate_interests": []}').alias("content"))
    rows = packs.summary_requests(pk, p["clusters"], reps, first)
    body = F.from_json("user_prompt", "status string, tag_clusters array<struct<canonical_tag:string>>, representative_posts array<struct<post_id:bigint>>, evidence_first_result string")
    return rows.select("request_key", body["evidence_first_result"].isNotNull().alias("has_first"), F.size(body["tag_clusters"]).alias("n_clusters"), F.size(body["representative_posts"]).alias("n_representatives"), F.size("image_urls").alias("n_images"), body["status"].alias("status"))
