"""Checks of model-written domain summaries against the evidence, and the gold export.

Items: ``user_id, domain, bucket (stable | short | weak), item, label, given_tags, description,
confidence, reasoning``; their evidence ids one row each: ``..., item, kind (all | rep), ord, post_id``.
Clusters: ``user_id, domain, canonical_tag, display_label, n_posts, weighted_support,
mean_confidence, status, modalities``, with member and evidence rows.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, interest_form, nonblank
from ..schemas import DOMAIN_DEFINITIONS
from ..session import cut_lineage
from .packs import SCOPE
from .ranking import top_rows

STABLE_FLOOR, MIN_STABLE_POSTS, MAX_REPS = 0.55, 2, 3

# Blocked attribute words, placeholder phrases, food words and note texts.
BLOCKED = ["family", "career", "job", "profession", "age"]
PLACEHOLDERS = ["domain evidence status is", "summary is kept conservative", "the domain is stable", "support_posts=", "weak_posts=", "stable_score="]
LITERAL_FOOD = [
    "recipe", "ingredients", "dish", "meal", "kitchen", "restaurant", "cafe", "coffee", "tea", "burger", "shawarma", "ramen", "cheesecake", "dessert",
    "eat ", "eating", "ate ", "drank ", "drink ", "drinking", "made ", "making ", "i cooked", "i made", "we cooked", "we made",
]
FOOD_SLANG = ["cooked or nah", "been cooking", "can cook", "chef"]
SPARSE_NOTE = "Evidence in this domain is currently too sparse or fragmented for a reliable interest profile."
LOW_NOTE = "Evidence is limited or uneven; treat these interests as provisional."
FALLBACK_NOTE = "LLM summarization failed; returned conservative fallback from algorithmic evidence only."
NO_INTEREST = "The current evidence in this domain is too sparse, too one-off, or too noisy to support a reliable interest description."
DEFAULT_REASONING = "Evidence-grounded interest retained after validation."
# End of fixed values.

ITEM = [*SCOPE, "bucket", "item"]


def excluded_attribute(label: Column) -> Column:
    """Labels about family, work or age are no interests."""
    t = interest_form(label)
    return F.arrays_overlap(F.split(t, " "), F.array(*[F.lit(b) for b in BLOCKED])) | t.contains("age range")


def member_map(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Canonical tag of every known spelling; the first cluster that claims a spelling keeps it."""
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    own = clusters.select(*SCOPE, "canonical_tag", F.posexplode(F.array("canonical_tag", spaced(F.col("canonical_tag")), "display_label")).alias("at", "token"))
    told = members.select(*SCOPE, "canonical_tag", F.lit(3).alias("at"), F.explode(F.array(F.col("member"), spaced(F.col("member")))).alias("token"))
    keyed = own.unionByName(told).withColumn("key", interest_form(F.col("token"))).filter("key != ''")
    return keyed.groupBy(*SCOPE, "key").agg(F.min_by("canonical_tag", F.struct("canonical_tag", "at")).alias("canonical_tag"))


def allowed_posts(evidence: DataFrame, representatives: DataFrame) -> DataFrame:
    return evidence.select(*SCOPE, "post_id").unionByName(representatives.select(*SCOPE, "post_id")).distinct()


def cleaned(items: DataFrame, ids: DataFrame, clusters: DataFrame, members: DataFrame, evidence: DataFrame, representatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable items and their evidence rows ``(..., item, at, post_id)``.

    Tags: those given, else those whose posts the item cites (four at most), else the label's.
    Evidence: cited posts that are allowed, else all posts of the tags.
    """
    known = member_map(clusters, members)
    allowed = allowed_posts(evidence, representatives)
    cited = ids.filter("kind = 'all'").join(allowed, [*SCOPE, "post_id"], "left_semi").groupBy(*ITEM, "post_id").agg(F.min("ord").alias("ord"))
    cited = cut_lineage(cited)
    given = items.select(*ITEM, F.posexplode("given_tags").alias("at", "token")).withColumn("key", interest_form(F.col("token"))).join(known, [*SCOPE, "key"])
    given = given.groupBy(*ITEM, "canonical_tag").agg(F.min("at").alias("at"))

    def listed(rows, name):
        return rows.groupBy(*ITEM).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "canonical_tag"))), lambda s: s["canonical_tag"]).alias(name))

    touched = cited.join(evidence, [*SCOPE, "post_id"]).select(*ITEM, "canonical_tag").distinct()
    inferred = top_rows(touched, ITEM, ["canonical_tag"], 4, "at")
    guessed = items.select(*ITEM, interest_form(F.col("label")).alias("key")).join(known, [*SCOPE, "key"]).select(*ITEM, F.array("canonical_tag").alias("_guess"))
    rows = items.join(listed(given, "_given"), ITEM, "left").join(listed(inferred, "_inferred"), ITEM, "left").join(guessed, ITEM, "left")
    rows = rows.withColumn("canonical_tags", F.coalesce("_given", "_inferred", "_guess", F.array().cast("array<string>")))
    shown = clusters.select(*SCOPE, F.col("canonical_tag").alias("_t"), F.col("display_label").alias("_shown"))
    rows = rows.withColumn("_t", F.try_element_at("canonical_tags", F.lit(1))).join(shown, [*SCOPE, "_t"], "left")
    label = F.coalesce(nonblank(F.col("label")), nonblank(F.col("_shown")), nonblank(F.replace("_t", F.lit("_"), F.lit(" "))))
    rows = rows.withColumn("label", label)
    reason = F.when(excluded_attribute(blank(F.col("label"))), "excluded_non_interest_attribute").when(F.col("label").isNull(), "missing_label_after_normalization")
    rows = rows.withColumn("drop_reason", reason)
    text = F.concat(
        F.when(F.size("canonical_tags") > 0, "Evidence in this domain consistently points to ").otherwise("Evidence in this domain points to "), "label",
        F.when(F.size("canonical_tags") > 0, " as a meaningful interest signal.").otherwise(" as a potential interest signal."),
    )
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5))))
    extra = ["time_hint"] if "time_hint" in items.columns else []
    rows = rows.select(
        *ITEM, "label", "canonical_tags", F.coalesce(nonblank(F.col("description")), text).alias("description"), conf.alias("confidence"),
        F.coalesce(nonblank(F.col("reasoning")), F.lit(DEFAULT_REASONING)).alias("reasoning"), "drop_reason", *extra,
    )
    rows = cut_lineage(rows)
    good = rows.filter("drop_reason is null")
    own = cited.join(good.select(*ITEM), ITEM, "left_semi").select(*ITEM, F.struct(F.lit(0).alias("t"), F.col("ord").cast("long").alias("o")).alias("at"), "post_id")
    bare = good.join(cited.select(*ITEM).distinct(), ITEM, "left_anti").select(*ITEM, F.posexplode("canonical_tags").alias("t", "canonical_tag"))
    filled = bare.join(evidence, [*SCOPE, "canonical_tag"]).groupBy(*ITEM, "post_id").agg(F.min("t").alias("t"))
    filled = filled.select(*ITEM, F.struct("t", F.lit(0).cast("long").alias("o")).alias("at"), "post_id")
    return rows, own.unionByName(filled)


def representative_ids(evidence: DataFrame, ids: DataFrame, keys: list[str] = ITEM) -> DataFrame:
    """Up to three posts per item: preferred ones that are evidence, then the evidence in order."""
    wanted = ids.filter("kind = 'rep'").groupBy(*keys, "post_id").agg(F.min("ord").alias("_want"))
    ranked = evidence.join(wanted, [*keys, "post_id"], "left")
    order = [F.col("_want").isNull(), "_want", "at", "post_id"]
    return top_rows(ranked, keys, order, MAX_REPS, "pick").select(*keys, "pick", "post_id")


def downgraded(items: DataFrame, evidence: DataFrame, algorithm: DataFrame) -> DataFrame:
    """Bucket after the stability check: unstable or thinly supported stable items become weak.

    A stable item that only shares its normalised label with such an item is dropped
    (bucket null). Moved items come after the weak ones: ``late`` is 1.
    """
    n = evidence.groupBy(*ITEM).agg(F.countDistinct("post_id").alias("_n"))
    rows = items.join(n, ITEM, "left").join(algorithm.select(*SCOPE, "stable_score"), SCOPE, "left")
    thin = (F.coalesce("stable_score", F.lit(0.0)) < STABLE_FLOOR) | (F.coalesce("_n", F.lit(0)) < MIN_STABLE_POSTS)
    rows = rows.withColumn("_moved", (F.col("bucket") == "stable") & thin).withColumn("_key", interest_form(F.col("label")))
    names = rows.filter("_moved").select(*SCOPE, "_key").distinct().withColumn("_hit", F.lit(True))
    rows = rows.join(names, [*SCOPE, "_key"], "left")
    bucket = F.when(F.col("_moved"), "weak").when((F.col("bucket") == "stable") & F.col("_hit"), None).otherwise(F.col("bucket"))
    return rows.withColumn("new_bucket", bucket).withColumn("late", F.col("_moved").cast("int")).drop("_n", "_moved", "_key", "_hit", "stable_score")


def merged(items: DataFrame, evidence: DataFrame, reps: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items with equal lower-case labels become one; the most confident (then first) one leads.

    Evidence is joined in item order. Result: items with their ``position`` (by falling
    confidence, then label) and evidence rows with an ordinal that keeps the order.
    """
    at = F.struct(*order)
    keyed = items.withColumn("merge_key", F.lower(F.trim("label"))).withColumn("_at", at)
    key = [*SCOPE, "bucket", "merge_key"]
    lead = F.min_by(F.struct("label", "description", "confidence", "reasoning"), F.struct(-F.col("confidence"), F.col("_at")))
    heads = keyed.groupBy(*key).agg(lead.alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("canonical_tags")))).alias("canonical_tags"))
    links = keyed.select(*ITEM, "merge_key", "_at", F.col("source_bucket"))
    source = [*SCOPE, "source_bucket", "item"]
    ev = evidence.withColumnRenamed("bucket", "source_bucket").join(links, source).groupBy(*key, "post_id").agg(F.min(F.struct("_at", "at", "post_id")).alias("at"))
    rp = reps.withColumnRenamed("bucket", "source_bucket").join(links, source).groupBy(*key, "post_id").agg(F.min(F.struct("_at", "pick")).alias("_p"))
    best = top_rows(rp, key, ["_p"], MAX_REPS, "_r").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "post_id"))), lambda s: s["post_id"]).alias("representative_ids"))
    out = heads.join(best, key, "left").select(*key, "w.label", "canonical_tags", "w.description", "w.confidence", "w.reasoning", "representative_ids")
    place = W.partitionBy(*SCOPE, "bucket").orderBy(F.desc("confidence"), "label")  # interests of one model answer
    return out.withColumn("position", F.row_number().over(place) - 1), ev


def bucket_from_hint(hint: Column, status: Column) -> Column:
    return (
        F.when(hint == "stable_candidate", "stable").when(hint == "recent_candidate", "short").when(hint == "weak_candidate", "weak")
        .when(status.isin("stable", "stable_with_recent_surge"), "stable").when(status == "recent", "short").otherwise("weak")
    )


def backfill_candidates(candidates: DataFrame, items: DataFrame, algorithm: DataFrame) -> DataFrame:
    """First-pass candidates of domains that have neither stable nor short interests, with their bucket."""
    filled = items.filter(F.col("bucket").isin("stable", "short")).select(*SCOPE).distinct()
    rows = candidates.join(filled, SCOPE, "left_anti").join(algorithm.select(*SCOPE, "status"), SCOPE, "left")
    known = F.col("time_hint").isin("stable_candidate", "recent_candidate", "weak_candidate")
    hint = F.when(known, F.col("time_hint")).otherwise("weak_candidate")
    return rows.withColumn("bucket", bucket_from_hint(hint, F.col("status"))).drop("status")


def ambiguous_food(examples: DataFrame) -> DataFrame:
    """Clusters whose example posts use cooking slang and no literal food word."""
    text = F.lower(F.trim(F.regexp_replace(blank(F.col("text")), r"\s+", " ")))
    flags = examples.filter(text != "").groupBy(*SCOPE, "canonical_tag").agg(
        F.max(text.rlike("|".join(LITERAL_FOOD))).alias("literal"), F.max(text.rlike("|".join(FOOD_SLANG))).alias("slang")
    )
    return flags.filter("slang and not literal").select(*SCOPE, "canonical_tag")


def seed_clusters(clusters: DataFrame, examples: DataFrame, required_status: str) -> DataFrame:
    """Best cluster per (user, domain) to seed a missing interest from."""
    nontrivial = (F.col("n_posts") >= 2) | (F.col("weighted_support") >= 1.2)
    visual = F.array_distinct(F.filter("modalities", lambda m: F.trim(m) != "")) == F.array(F.lit("visual"))
    tag = F.col("canonical_tag")
    skip = (tag.endswith("_ownership") & visual) | ((F.col("domain") == "pets") & tag.isin("cat", "dog") & visual)
    food = (F.col("domain") == "food_drink") & tag.isin("cook", "home_cook", "food_preparation")
    vague = ambiguous_food(examples).withColumn("_vague", F.lit(True))
    rows = clusters.filter((F.col("status") == required_status) & nontrivial & ~F.coalesce(skip, F.lit(False))).join(vague, [*SCOPE, "canonical_tag"], "left")
    rows = rows.filter(~(food & F.coalesce("_vague", F.lit(False))) & ~excluded_attribute(F.col("display_label")))
    words = F.size(F.split(F.trim("display_label"), r"\s+"))
    rank = F.col("weighted_support") * F.greatest(F.lit(0.1), F.col("mean_confidence")) + 0.05 * F.col("n_posts") + 0.08 * F.greatest(F.lit(0), words - 1)
    best = rows.groupBy(*SCOPE).agg(F.min_by(F.struct("canonical_tag", "display_label", "mean_confidence"), F.struct(-F.round(rank, 9), tag)).alias("b"))
    return best.select(*SCOPE, "b.canonical_tag", F.col("b.display_label").alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.mean_confidence"))).alias("confidence"))


def seeded(items: DataFrame, algorithm: DataFrame, clusters: DataFrame, examples: DataFrame) -> DataFrame:
    """Seed interests for domains whose status demands one that the summary lacks."""
    out = None
    for bucket, statuses, wanted in (("stable", ["stable", "stable_with_recent_surge"], "stable"), ("short", ["recent"], "recent")):
        need = algorithm.filter(F.col("status").isin(*statuses)).select(*SCOPE)
        need = need.join(items.filter(F.col("bucket") == bucket).select(*SCOPE).distinct(), SCOPE, "left_anti")
        rows = seed_clusters(clusters, examples, wanted).join(need, SCOPE, "left_semi").withColumn("bucket", F.lit(bucket))
        out = rows if out is None else out.unionByName(rows)
    return out


def bucket_labels(items: DataFrame, k: int) -> DataFrame:
    """First ``k`` labels of each bucket per (user, domain), as arrays."""

    def first(bucket):
        rows = F.array_sort(F.collect_list(F.when((F.col("bucket") == bucket) & (F.col("position") < k), F.struct("position", "label"))))
        return F.transform(rows, lambda s: s["label"]).alias(bucket)

    return items.groupBy(*SCOPE).agg(first("stable"), first("short"), first("weak"))


def is_placeholder(summary: Column) -> Column:
    s = F.lower(F.trim(blank(summary)))
    hit = s == ""
    for p in PLACEHOLDERS:
        hit = hit | s.contains(p)
    return hit


def summary_texts(domains: DataFrame, items: DataFrame) -> DataFrame:
    """Summary and uncertainty note of each domain ``(domain_summary, uncertainty_note, stable_score, failed)``.

    Placeholder summaries are rewritten from the first two labels of each bucket.
    """
    none = F.array().cast("array<string>")
    rows = domains.join(bucket_labels(items, 2), SCOPE, "left")
    for b in ("stable", "short", "weak"):
        rows = rows.withColumn(b, F.coalesce(b, none))
    said = F.concat_ws(
        " ",
        F.when(F.size("stable") > 0, F.concat(F.lit("This domain most clearly reflects a sustained interest in "), F.array_join("stable", ", "), F.lit("."))),
        F.when(F.size("short") > 0, F.concat(F.lit("There is also a more recent or emerging focus on "), F.array_join("short", ", "), F.lit("."))),
        F.when(
            F.size("weak") > 0,
            F.concat(F.lit("Weaker signals also point to "), F.array_join("weak", ", "), F.lit(", but the evidence is not yet strong enough to treat them as central interests.")),
        ),
    )
    empty = F.size(F.concat("stable", "short", "weak")) == 0
    rewritten = is_placeholder(F.col("domain_summary"))
    note = F.coalesce(nonblank(F.col("uncertainty_note")), F.when(empty, SPARSE_NOTE).when(F.col("stable_score") < STABLE_FLOOR, LOW_NOTE))
    note = F.when(F.coalesce("failed", F.lit(False)), F.concat_ws(" ", note, F.lit(FALLBACK_NOTE))).otherwise(note)
    return rows.select(
        *SCOPE, F.when(rewritten, F.when(empty, NO_INTEREST).otherwise(said)).otherwise(F.trim("domain_summary")).alias("domain_summary"), note.alias("uncertainty_note"), rewritten.alias("rewritten")
    )


def domain_evidence_rows(items: DataFrame, item_evidence: DataFrame, evidence: DataFrame, representatives: DataFrame) -> DataFrame:
    """All evidence of a domain in order: interests (stable, short, weak), clusters, representative posts."""
    level = F.when(F.col("bucket") == "stable", 0).when(F.col("bucket") == "short", 1).otherwise(2)
    own = item_evidence.join(items.select(*SCOPE, "bucket", "merge_key", "position"), [*SCOPE, "bucket", "merge_key"])
    inside = own.schema["at"].dataType

    def place(level, position, tag, at):
        return F.struct(level.alias("a"), position.cast("int").alias("b"), tag.alias("c"), at.alias("d")).alias("place")

    nowhere = F.lit(None).cast(inside)
    own = own.select(*SCOPE, "post_id", place(level, F.col("position"), F.lit(""), F.col("at")))
    tags = evidence.select(*SCOPE, "post_id", place(F.lit(3), F.lit(0), F.col("canonical_tag"), nowhere))
    reps = representatives.select(*SCOPE, "post_id", place(F.lit(4), F.col("pick_order"), F.lit(""), nowhere))
    return own.unionByName(tags).unionByName(reps).groupBy(*SCOPE, "post_id").agg(F.min(F.struct("place", "post_id")).alias("place"))


# Types and reasons of the action log.
DOWNGRADE, DOWNGRADE_REASON = "downgrade_interest", "insufficient_stability_or_evidence_spread"
BACKFILL, SEED = "backfill_interest_from_pass1", "seed_interest_from_cluster"
SEED_REASONS = {"stable": "status_requires_stable_interest_with_nontrivial_cluster", "short": "status_requires_recent_interest_with_nontrivial_cluster"}
REWRITE, REWRITE_REASON = "rewrite_domain_summary", "missing_or_placeholder_summary"
NOTE, NOTE_EMPTY, NOTE_LOW = "set_uncertainty_note", "no_structured_interests", "low_stable_score"
COUNT_CHANGE = "interest_bucket_count_change"
# End of fixed values.

LOG = ["type", "interest", "from_bucket", "to_bucket", "reason", "before", "after"]


def bucket_counts(items: DataFrame, name: str) -> DataFrame:
    """``stable/short/weak`` counts of each (user, domain) as one text."""
    n = [F.sum((F.col("bucket") == b).cast("int")).cast("string") for b in ("stable", "short", "weak")]
    return items.groupBy(*SCOPE).agg(F.concat_ws("/", *n).alias(name))


def _logged(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    given = {"type": F.lit(kind), **columns}
    return rows.select(*SCOPE, *[given.get(c, F.lit(None)).cast("string").alias(c) for c in LOG])


def validated(
    items: DataFrame, ids: DataFrame, clusters: DataFrame, members: DataFrame, evidence: DataFrame, representatives: DataFrame, examples: DataFrame,
    algorithm: DataFrame, summaries: DataFrame, candidates: tuple[DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The whole validation of all domain summaries: cleaned, downgraded, merged, backfilled, seeded, summarised.

    ``summaries`` has a row for each (user, domain) that was asked for; one without items, as after a failed answer,
    is backfilled and seeded like any other. ``candidates`` are the first pass's, as ``cleaned`` returns them, with
    ``time_hint``. Result: ``items`` and ``evidence`` of the final interests, ``texts``, and ``actions``: the log of what
    was dropped, moved, added, rewritten and noted, one row each, with the counts of the buckets before and after
    where they differ.
    """
    rows, ev = cleaned(items, ids, clusters, members, evidence, representatives)
    ev = cut_lineage(ev)
    down = cut_lineage(downgraded(rows.filter("drop_reason is null"), ev, algorithm))
    kept = down.filter("new_bucket is not null").withColumn("source_bucket", F.col("bucket")).withColumn("bucket", F.col("new_bucket"))
    parts = ["source_bucket", "item", "late", *SCOPE, "bucket", "label", "canonical_tags", "description", "confidence", "reasoning"]
    rest, reps = kept.select(*parts), representative_ids(ev, ids)
    added = None
    if candidates is not None:
        found, found_ev = candidates
        fine = found.filter("drop_reason is null").withColumn("source_bucket", F.col("bucket")).drop("bucket")
        added = cut_lineage(backfill_candidates(fine, kept, algorithm).withColumn("late", F.lit(2)))
        none = ids.limit(0)
        rest = rest.unionByName(added.select(*parts))
        found_ev = cut_lineage(found_ev)
        ev, reps = ev.unionByName(found_ev).distinct(), reps.unionByName(representative_ids(found_ev, none))
    final, final_ev = (cut_lineage(df) for df in merged(rest, ev, reps, ["late", "item"]))
    seeds = cut_lineage(seeded(final, algorithm, clusters, examples).join(summaries.select(*SCOPE), SCOPE, "left_semi"))
    shown = F.concat(F.lit("Evidence in this domain consistently points to "), "label", F.lit(" as a meaningful interest signal."))
    first = top_rows(evidence.join(seeds.select(*SCOPE, "canonical_tag"), [*SCOPE, "canonical_tag"]), [*SCOPE, "canonical_tag"], ["post_id"], MAX_REPS, "_r")
    first = first.groupBy(*SCOPE, "canonical_tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "post_id"))), lambda x: x["post_id"]).alias("representative_ids"))
    planted = seeds.join(first, [*SCOPE, "canonical_tag"], "left").select(
        *SCOPE, "bucket", F.lower(F.trim("label")).alias("merge_key"), "label", F.array("canonical_tag").alias("canonical_tags"), shown.alias("description"), "confidence",
        F.lit(DEFAULT_REASONING).alias("reasoning"), "representative_ids", F.lit(0).alias("position"))
    whole = cut_lineage(final.unionByName(planted))
    inside = final_ev.schema["at"].dataType
    grown = seeds.join(evidence, [*SCOPE, "canonical_tag"]).select(*SCOPE, "bucket", F.lower(F.trim("label")).alias("merge_key"), "post_id", F.lit(None).cast(inside).alias("at"))
    texts = cut_lineage(summary_texts(summaries, whole))
    blank_note = summaries.filter(nonblank(F.col("uncertainty_note")).isNull()).select(*SCOPE, "stable_score")
    has = whole.select(*SCOPE).distinct().withColumn("_has", F.lit(True))
    noted = blank_note.join(has, SCOPE, "left").withColumn("why", F.when(F.col("_has").isNull(), NOTE_EMPTY).when(F.col("stable_score") < STABLE_FLOOR, NOTE_LOW)).filter("why is not null")
    counts = summaries.select(*SCOPE).join(bucket_counts(items, "before"), SCOPE, "left").join(bucket_counts(whole, "after"), SCOPE, "left")
    counts = counts.withColumn("before", F.coalesce("before", F.lit("0/0/0"))).withColumn("after", F.coalesce("after", F.lit("0/0/0"))).filter("before != after")
    log = [
        _logged(rows.filter("drop_reason is not null"), "drop_interest", interest=F.col("label"), from_bucket=F.col("bucket"), reason=F.col("drop_reason")),
        _logged(down.filter("late = 1"), DOWNGRADE, interest=F.col("label"), from_bucket=F.lit("stable"), to_bucket=F.lit("weak"), reason=F.lit(DOWNGRADE_REASON)),
        _logged(seeds, SEED, interest=F.col("label"), to_bucket=F.col("bucket"), reason=F.when(F.col("bucket") == "stable", SEED_REASONS["stable"]).otherwise(SEED_REASONS["short"])),
        _logged(texts.filter("rewritten"), REWRITE, reason=F.lit(REWRITE_REASON)),
        _logged(noted, NOTE, reason=F.col("why")),
        _logged(counts, COUNT_CHANGE, before=F.col("before"), after=F.col("after")),
    ]
    if added is not None:
        hint = F.when(F.col("time_hint").isin("stable_candidate", "recent_candidate", "weak_candidate"), F.col("time_hint")).otherwise("weak_candidate")
        log.append(_logged(added, BACKFILL, interest=F.col("label"), to_bucket=F.col("bucket"), reason=F.concat(F.lit("pass1_"), hint)))
    return {"items": whole, "evidence": final_ev.unionByName(grown), "texts": texts, "actions": functools.reduce(DataFrame.unionByName, log)}


# ------------------------------------------------------------------ export

EXPORT_BUCKETS = {"stable": "long_term", "short": "short_term", "weak": "negative"}


def export_status(items: DataFrame, domains: DataFrame) -> DataFrame:
    """active when a domain has a stable or short interest."""
    live = items.filter(F.col("bucket").isin("stable", "short")).select(*SCOPE).distinct().withColumn("_a", F.lit(True))
    return domains.select(*SCOPE).join(live, SCOPE, "left").withColumn("status", F.when(F.col("_a"), "active").otherwise("inactive")).drop("_a")


def export_interests(items: DataFrame, status: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` interests per bucket; inactive domains keep their negative ones only."""
    names = F.create_map(*[F.lit(x) for kv in EXPORT_BUCKETS.items() for x in kv])
    rows = items.filter(F.col("position") < k).join(status, SCOPE).withColumn("export_bucket", names[F.col("bucket")])
    return rows.filter((F.col("status") == "active") | (F.col("bucket") == "weak"))


def evidence_indices(evidence: DataFrame, posts: DataFrame, keys: list[str], k: int | None, order: str = "at") -> DataFrame:
    """Timeline positions of the first ``k`` evidence posts that exist, in evidence order."""
    rows = evidence.join(posts.select("user_id", "post_id", "post_index"), ["user_id", "post_id"])
    first = rows.groupBy(*keys, "post_index").agg(F.min(order).alias("_at"))
    if k is None:
        return first.withColumnRenamed("_at", order)
    return top_rows(first, keys, ["_at"], k, "nth").drop("_at")


def evidence_sources(evidence: DataFrame, sources: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows with their modality bucket and position; unknown ones drop out."""
    rows = evidence.join(sources.select(*SCOPE, "post_id", "evidence_modality"), [*SCOPE, "post_id"])
    rows = rows.filter(F.col("evidence_modality").isin("text_only", "visual_only", "mixed"))
    return rows.join(posts.select("user_id", "post_id", "post_index"), ["user_id", "post_id"], "left").select(*keys, "evidence_modality", "post_id", "post_index").distinct()


def domain_evidence_ids(status: DataFrame, items: DataFrame, item_evidence: DataFrame, representatives: DataFrame, n_items: int = 3, k: int = 4) -> DataFrame:
    """First ``k`` evidence posts of a domain: of its exported interests when active, of all its weak ones when not, else its representatives."""
    rank = F.when(F.col("bucket") == "stable", 0).when(F.col("bucket") == "short", 1).otherwise(2)
    live = (F.col("status") == "active") & F.col("bucket").isin("stable", "short") & (F.col("position") < n_items)
    own = items.join(status, SCOPE).filter(live | ((F.col("status") != "active") & (F.col("bucket") == "weak")))
    own = own.select(*SCOPE, "bucket", "merge_key", "position").join(item_evidence, [*SCOPE, "bucket", "merge_key"])
    own = own.groupBy(*SCOPE, "post_id").agg(F.min(F.struct(rank.alias("r"), "position", "at")).alias("at"))
    first = top_rows(own, SCOPE, ["at"], k, "nth").select(*SCOPE, "nth", "post_id")
    rest = status.join(own.select(*SCOPE).distinct(), SCOPE, "left_anti").select(*SCOPE).join(representatives, SCOPE)
    return first.unionByName(top_rows(rest, SCOPE, ["pick_order"], k, "nth").select(*SCOPE, "nth", "post_id"))


def example_lookup(evidence: DataFrame, representatives: DataFrame, examples: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """First ``k`` evidence posts that can be shown: a representative post, else a cluster example."""
    reps = representatives.select(*SCOPE, "post_id", F.col("text").alias("_rep"))
    shown = examples.groupBy(*SCOPE, "post_id").agg(F.min_by("text", "canonical_tag").alias("_ex"))
    rows = evidence.join(reps, [*SCOPE, "post_id"], "left").join(shown, [*SCOPE, "post_id"], "left").filter("_rep is not null or _ex is not null")
    best = top_rows(rows, keys, ["at", "post_id"], k, "nth")
    return best.select(*keys, "nth", "post_id", F.coalesce("_rep", "_ex").alias("text"), F.col("_rep").isNotNull().alias("is_representative"))


def rewrite_requests(
    domains: DataFrame, items: DataFrame, evidence: DataFrame, representatives: DataFrame, examples: DataFrame, texts: DataFrame, k_items: int = 3, k_weak: int = 2,
) -> DataFrame:
    """Request rows that ask for a natural summary of each (user, domain): request_key, status and user_prompt (JSON).

    The prompt carries the exported stable and short interests, each with up to two example posts that can be shown, the
    first ``k_weak`` weak labels with two examples of theirs as hints, the validated summary and its note. Every
    domain of ``domains`` has a row, with empty lists where it has no interests. All lists are bounded.
    """
    status = export_status(items, domains)
    key = [*SCOPE, "bucket", "merge_key"]
    shown = example_lookup(evidence, representatives, examples, key)
    lists = shown.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "post_id", "text"))), lambda x: F.struct(x["post_id"].alias("post_id"), x["text"].alias("text"))).alias("evidence_examples"))
    live = export_interests(items, status, k_items).filter("bucket != 'weak'").join(lists, key, "left")
    none = F.array().cast(lists.schema["evidence_examples"].dataType)
    entry = F.struct("position", "label", F.coalesce("evidence_examples", none).alias("evidence_examples"))
    pick = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))), lambda x: x.dropFields("position"))
    both = live.groupBy(*SCOPE).agg(pick("stable").alias("long_term_interests"), pick("short").alias("short_term_interests"))
    weak = items.filter((F.col("bucket") == "weak") & (F.col("position") < k_weak))
    labels = weak.groupBy(*SCOPE).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("weak_signal_labels"))
    cited = evidence.join(weak.select(*key, "position"), key).withColumn("at", F.struct("position", "at"))
    cited = cited.groupBy(*SCOPE, "post_id").agg(F.min("at").alias("at"))
    hints = example_lookup(cited, representatives, examples, SCOPE)
    hints = hints.groupBy(*SCOPE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "post_id", "text"))), lambda x: F.struct(x["post_id"].alias("post_id"), x["text"].alias("text"))).alias("weak_signal_examples"))
    rows = status.join(both, SCOPE, "left").join(labels, SCOPE, "left").join(hints, SCOPE, "left").join(texts.select(*SCOPE, "domain_summary", "uncertainty_note"), SCOPE, "left")
    definition = F.create_map(*[F.lit(x) for pair in DOMAIN_DEFINITIONS.items() for x in pair])[F.col("domain")]
    filled = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("long_term_interests", "short_term_interests", "weak_signal_labels", "weak_signal_examples")}
    rows = rows.withColumns(filled).withColumn("domain_definition", definition)
    body = F.struct("domain", "domain_definition", "status", *filled, F.col("domain_summary").alias("source_domain_summary"), "uncertainty_note")
    return rows.select(*SCOPE, F.concat_ws("__", F.lit("rewrite"), F.col("user_id").cast("string"), "domain").alias("request_key"), "status", F.to_json(body).alias("user_prompt"))


def natural_summary(status: Column, rewrite: Column, source: Column, uncertainty: Column, atomic: Column) -> Column:
    """Rewritten summary, else the source summary, else a fallback by status."""
    plain = F.lit("This domain does not currently provide a reliable profile signal.")
    hedged = F.concat(plain, F.lit(" "), nonblank(uncertainty))
    return F.coalesce(nonblank(rewrite), nonblank(source), F.when(status == "active", atomic).otherwise(F.coalesce(hedged, plain)))
