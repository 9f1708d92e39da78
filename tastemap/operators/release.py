"""De-identified releases: record-level candidates, topic derivatives, and their checks.

Inputs are flat tables keyed by the private ``user_id``:
posts ``(user_id, post_id, post_index, created_at, post_type, language, text)``,
interests ``(user_id, interest_index, domain, status, bucket, label, evidence_post_ids, evidence_post_indices)``,
captions ``(user_id, image_id, image_index, model, summary)``, mapping ``(source_id, public_id)``.
"""
from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CAPTION_MODELS, DOMAINS
from ..session import cut_lineage
from ..sources.files import manifest_problems
from .privacy import COUNTED, residual_patterns, scrub
from .ranking import index_buckets, top_rows, with_position
from .timeline import phases, relative_days

VERSION = "targeted-deidentified-v2"
TOPIC_VERSION = "privacy-derived-v1"
PUBLIC_USER = r"^participant_\d{3,}$"
PHASES, MIN_USERS, MAX_TOPICS = 4, 5, 5

# The topic vocabulary of each domain, label and pattern.
VOCABULARY = {
    "sports_outdoor": {
        "outdoor activities": r"outdoor|recreation|camping|campground",
        "walking and hiking": r"walk(?:ing|s)?|hik(?:e|es|ing)|trail|trekking",
        "running": r"running|jogging|marathon",
        "cycling": r"cycling|bicycl\w*|biking",
        "water sports": r"swimming|surfing|kayaking|paddling|snorkeling",
        "fitness": r"fitness|workout|gym|weightlifting|yoga",
        "spectator sports": r"sports?|football|soccer|basketball|baseball|tennis|wrestling|racing",
        "nature observation": r"wildlife|birdwatching|stargazing|aurora|nature|garden(?:ing)?",
    },
    "entertainment": {
        "music": r"music|songs?|singing|singer|album|guitar|piano",
        "live performances": r"concert|performance|theater|theatre|musical|festival",
        "film and television": r"movie|film|television|cinema|sitcom|tv|anime",
        "reading": r"reading|books?|novels?|literature|comic|manga",
        "comedy": r"comedy|humou?r|comedian|jokes?",
    },
    "gaming": {
        "video games": r"video games?|gaming|videogames?|gameplay|console",
        "strategy games": r"strategy games?|turn.based|tactical games?",
        "role-playing games": r"role.playing|rpg|mmorpg",
        "board and card games": r"board games?|card games?|tabletop|puzzles?",
        "competitive gaming": r"esports?|competitive gaming|speedrun",
    },
    "food_drink": {
        "cooking": r"cooking|recipes?|homemade|home.made|meal preparation",
        "dining": r"dining|restaurant|cafe|café|breakfast|lunch|dinner|meal|food",
        "baking and desserts": r"baking|dessert|cakes?|pastry|pastries|cookies?|ice cream|chocolate",
        "coffee and tea": r"coffee|tea|espresso|latte",
        "savory food": r"savory|pizza|pasta|noodles?|bread|rice|soup|sandwich|barbecue",
    },
    "travel_city_exploration": {
        "travel": r"travel|tourism|tourist|vacation|holiday|sightseeing|trips?",
        "city exploration": r"city|urban|architecture|skyline|street|neighborhood",
        "cultural visits": r"museum|exhibition|gallery|historic|heritage",
        "nature visits": r"landscape|mountain|beach|forest|lake|ocean|waterfall|desert",
        "cruise travel": r"cruise|cruising",
    },
    "photography_creation": {
        "photography": r"photograph\w*|camera|photo|photos",
        "visual art": r"art|painting|drawing|illustration|sketch|sculpture",
        "video creation": r"videography|filmmaking|video editing|animation",
        "crafts and design": r"crafts?|knitting|sewing|design|ceramics|pottery",
    },
    "pets": {
        "dogs": r"dogs?|pupp(?:y|ies)|canine",
        "cats": r"cats?|kittens?|feline",
        "pet care": r"pets?|pet care|animal care|grooming",
    },
}
TOPIC_NOISE = r"(?i)https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|[@#][\w]+|\[[^\]]*\]"
# End of fixed values.

W = r"[\p{L}\p{N}_]"


def fallback_label(domain: Column) -> Column:
    return F.concat(F.replace(domain, F.lit("_"), F.lit(" ")), F.lit(" interests"))


def public_post_id(public_user: Column, post_index: Column) -> Column:
    """Sequential public id of a post in its timeline."""
    return F.format_string("%s_post_%04d", public_user, post_index + 1)


# ------------------------------------------------------------------ record-level candidate


def mapping_problems(mapping: DataFrame, users: DataFrame) -> DataFrame:
    """Violations of a one-to-one, well-formed mapping that covers exactly the users."""
    known = users.select(F.col("user_id").alias("source_id")).distinct()
    doubled = [mapping.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.concat(F.lit("Duplicate "), F.lit(c)).alias("issue")) for c in ("source_id", "public_id")]
    checks = [
        known.join(mapping, "source_id", "left_anti").select(F.lit("User without mapping").alias("issue")),
        mapping.join(known, "source_id", "left_anti").select(F.lit("Mapping without user").alias("issue")),
        mapping.filter(~F.col("public_id").rlike(PUBLIC_USER)).select(F.lit("Invalid public ID").alias("issue")),
        *doubled,
    ]
    return functools.reduce(DataFrame.unionByName, checks).distinct()


def _mapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the ``public_id`` of their user; a user without one is an error."""
    joined = rows.join(mapping.withColumnRenamed("source_id", "user_id"), "user_id", "left")
    missing = F.raise_error(F.concat(F.lit("User without mapping: "), F.coalesce(F.col("user_id").cast("string"), F.lit("null")))).cast("string")
    return joined.withColumn("public_id", F.coalesce("public_id", missing))


def candidate_posts(posts: DataFrame, mapping: DataFrame, rules: DataFrame | None = None, handles: list[str] = ()) -> DataFrame:
    """Public posts: new ids, relative days, scrubbed texts, no media. A user without a mapping stops the release."""
    rows = _mapped(scrub(relative_days(posts), rules, handles, counts=True), mapping)
    return rows.select(
        "user_id", "post_id", "post_index", F.col("public_id").alias("public_user_id"), public_post_id(F.col("public_id"), F.col("post_index")).alias("public_post_id"),
        "relative_day", "post_type", "language", "text", "scrubbed", "was_rewritten", "hits",
    )


def resolved_evidence(interests: DataFrame, posts: DataFrame) -> DataFrame:
    """Evidence positions of each interest, one row each. Ids are authoritative; indices count only without ids.

    ``problem`` marks ids that are in no timeline and indices outside it.
    """
    key = ["user_id", "interest_index"]
    index = posts.select("user_id", "post_id", "post_index")
    has_ids = F.coalesce(F.size("evidence_post_ids"), F.lit(0)) > 0
    ids = interests.filter(has_ids).select(*key, F.explode("evidence_post_ids").alias("post_id")).distinct().join(index, ["user_id", "post_id"], "left")
    ids = ids.select(*key, "post_index", F.when(F.col("post_index").isNull(), "Unresolved evidence IDs").alias("problem"))
    n = index.groupBy("user_id").agg(F.count("*").alias("n"))
    plain = interests.filter(~has_ids).select(*key, F.explode("evidence_post_indices").alias("post_index")).distinct().join(n, "user_id", "left")
    outside = (F.col("post_index") < 0) | (F.col("post_index") >= F.coalesce("n", F.lit(0)))
    plain = plain.select(*key, "post_index", F.when(outside, "Invalid evidence index").alias("problem"))
    return ids.unionByName(plain).distinct()


def repaired_interests(interests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Interests whose given indices differ from the positions their ids stand for."""
    key = ["user_id", "interest_index", "post_index"]
    with_ids = interests.filter(F.size("evidence_post_ids") > 0)
    given = with_ids.select("user_id", "interest_index", F.explode("evidence_post_indices").alias("post_index")).distinct()
    found = evidence.join(with_ids.select("user_id", "interest_index"), ["user_id", "interest_index"], "left_semi").filter("problem is null").select(*key)
    diff = given.join(found, key, "left_anti").union(found.join(given, key, "left_anti"))
    return diff.select("user_id", "interest_index").distinct()


def candidate_interests(interests: DataFrame, rules: DataFrame | None = None, handles: list[str] = ()) -> DataFrame:
    """Interests with scrubbed labels. Travel places that vanish get a number per user, in order of appearance."""
    rows = cut_lineage(scrub(interests, rules, handles, column="label", counts=True))  # read for the places and for the labels
    gone = (F.trim("scrubbed") == "[LOCATION]") & (F.col("domain") == "travel_city_exploration")
    places = rows.filter(gone).groupBy("user_id", "label").agg(F.min("interest_index").alias("first_at"))
    numbered = with_position(places, ["user_id"], ["first_at"], index_buckets("first_at"), "_area").select("user_id", "label", F.col("_area") + 1)
    numbered = cut_lineage(numbered.toDF("user_id", "label", "area")).withColumn("_travel", F.lit(True))  # of known size: few places need no shuffle of all labels
    rows = rows.withColumn("_travel", gone).join(numbered, ["user_id", "label", "_travel"], "left")
    named = F.when(F.col("_travel"), F.concat(F.lit("exploring local area "), "area")).otherwise(F.col("scrubbed"))
    return rows.withColumn("public_label", named).drop("_travel", "area", "scrubbed")


def candidate_evidence(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """Public evidence rows: index and public post id. Unresolved evidence and users without a mapping stop the release."""
    sound = F.when(F.col("problem").isNull(), F.col("post_index")).otherwise(F.raise_error(F.concat("problem", F.lit(" of "), "user_id")).cast("long"))
    rows = _mapped(evidence.withColumn("post_index", sound), mapping)
    return rows.select("user_id", "interest_index", "post_index", public_post_id(F.col("public_id"), F.col("post_index")).alias("public_post_id"))


def candidate_captions(captions: DataFrame, mapping: DataFrame, rules: DataFrame | None = None, handles: list[str] = ()) -> DataFrame:
    """Public captions: images renumbered in their order, summaries scrubbed. Unknown models and captions without a user are errors."""
    captions = captions.withColumn("user_id", F.coalesce("user_id", F.raise_error(F.lit("Caption without a user")).cast("string")))
    images = captions.groupBy("user_id", "image_id").agg(F.min("image_index").alias("image_index"))
    numbered = with_position(images, ["user_id"], ["image_index", "image_id"], index_buckets("image_index"), "_serial").select("user_id", "image_id", "_serial")
    rows = scrub(captions, rules, handles, column="summary", counts=True).join(numbered, ["user_id", "image_id"])
    rows = _mapped(rows, mapping)
    known = F.when(F.col("model").isin(*CAPTION_MODELS), F.col("model")).otherwise(F.raise_error(F.concat(F.lit("Unexpected model "), "model")))
    return rows.select(F.col("public_id").alias("public_user_id"), F.format_string("image_%05d", F.col("_serial") + 1).alias("image_id"), known.alias("model"), F.col("scrubbed").alias("summary"), "hits")


def release_counts(posts: DataFrame, interests: DataFrame, captions: DataFrame, repaired: DataFrame) -> DataFrame:
    """Audit counters of a candidate as one row; scrub counters add up the ``hits`` of all its strings."""
    rows = posts.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("posts"))
    labels = interests.agg(F.count("*").alias("interest_entries"), F.coalesce(F.sum((F.col("label") != F.col("public_label")).cast("long")), F.lit(0)).alias("changed_labels"))
    images = captions.agg(F.count("*").alias("captions"), F.countDistinct("public_user_id", "image_id").alias("images"))
    fixed = repaired.agg(F.count("*").alias("repaired_evidence_indices"))
    names = [*COUNTED, "keyword", "reviewed_rewrite"]
    sums = [F.coalesce(F.sum(f"hits.{n}"), F.lit(0)).alias(n) for n in names]
    hits = functools.reduce(DataFrame.union, [df.select("hits") for df in (posts, interests, captions)])
    hits = hits.agg(F.count("*").alias("strings"), F.coalesce(F.sum("hits.changed"), F.lit(0)).alias("changed_strings"), *sums)
    # Each part is one row with its own counters; together they fold into one.
    parts = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, labels, images, fixed, hits])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def source_counts(posts: DataFrame, captions: DataFrame, interests: DataFrame) -> DataFrame:
    """Counters of what a topic release is made from and what it takes away, as one row."""
    has = lambda pattern: F.coalesce(F.col("text").rlike(pattern), F.lit(False)).cast("long")
    hashes = F.coalesce(F.size(F.filter(F.coalesce("media", F.array()), lambda m: F.coalesce(m["sha256"], F.lit("")) != "")), F.lit(0)).cast("long")
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    rows = posts.agg(
        F.countDistinct("user_id").alias("source_users"), F.count("*").alias("source_posts"), n(has(rf"@{W}"), "posts_with_mentions"), n(has(rf"#{W}"), "posts_with_hashtags"),
        n(F.col("created_at").isNotNull().cast("long"), "exact_timestamps_removed"), n(hashes, "media_hashes_removed"))
    images = captions.agg(F.count("*").alias("source_captions"), F.countDistinct("user_id", "image_id").alias("source_images"))
    parts = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, images, interests.agg(F.count("*").alias("source_interest_labels"))])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


# ------------------------------------------------------------------ topic derivative


def _stems(pattern: str) -> list[str]:
    """Literal starts of a pattern's alternatives: no alternative matches without its start."""
    starts, depth, current = [], 0, ""
    for ch in pattern + "|":
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            starts.append(current)
            current = ""
        else:
            current += ch
    stems = []
    for s in starts:
        literal = re.match(r"[a-zé ]+", s).group()
        stems.append(literal[:-1] if s[len(literal) : len(literal) + 1] == "?" else literal)
    return stems


def topics(text: Column, domain: str | None = None) -> Column:
    """Vocabulary labels found in a text once links, handles and placeholders are blanked.

    A plain substring test on the start of each term goes first; the pattern itself only
    runs on texts that pass it.
    """
    bare = F.lower(F.regexp_replace(text, "(?U)" + TOPIC_NOISE.replace(r"\w", W), " "))
    terms = VOCABULARY[domain] if domain else {t: p for v in VOCABULARY.values() for t, p in v.items()}

    def found(t):
        hits = []
        for topic, pattern in terms.items():
            maybe = functools.reduce(lambda a, b: a | b, [t.contains(s) for s in _stems(pattern)])
            exact = t.rlike(rf"(?<!{W})(?:" + pattern.replace(r"\w", W) + rf")(?!{W})")
            hits.append(F.when(maybe & exact, F.lit(topic)))
        return F.array_compact(F.array(*hits))

    # One lambda argument, so that the cleaned text is computed once.
    return F.flatten(F.transform(F.array(bare), found))


def domain_topics(label: Column, domain: Column) -> Column:
    """Labels of the interest's own domain vocabulary."""
    found = topics(label)
    own = F.lit(None).cast("array<string>")
    for d in DOMAINS:
        own = F.when(domain == d, F.array_intersect(found, F.array(*[F.lit(t) for t in VOCABULARY[d]]))).otherwise(own)
    return F.coalesce(own, F.array().cast("array<string>"))


def topic_mentions(posts: DataFrame, captions: DataFrame, interests: DataFrame) -> DataFrame:
    """Every (user, source, part, topic) mention: posts by phase, captions by model, interest labels."""
    by_phase = phases(posts).select("user_id", F.lit("phase").alias("source"), F.col("phase").cast("string").alias("part"), F.explode(topics(F.col("text"))).alias("topic"))
    by_model = captions.select("user_id", F.lit("model").alias("source"), F.col("model").alias("part"), F.explode(topics(F.col("summary"))).alias("topic"))
    labels = interests.select("user_id", F.lit("label").alias("source"), F.col("domain").alias("part"), F.explode(domain_topics(F.col("label"), F.col("domain"))).alias("topic"))
    return by_phase.unionByName(by_model).unionByName(labels)


def allowed_topics(mentions: DataFrame, min_users: int = MIN_USERS) -> DataFrame:
    """Topics that enough different users support."""
    return mentions.groupBy("topic").agg(F.countDistinct("user_id").alias("n_users")).filter(F.col("n_users") >= min_users)


def selected_topics(mentions: DataFrame, allowed: DataFrame, parts: DataFrame, k: int = MAX_TOPICS) -> DataFrame:
    """The most frequent allowed topics of each part, then in name order; empty parts stay."""
    counted = mentions.groupBy("user_id", "source", "part", "topic").agg(F.count("*").alias("n")).join(allowed.select("topic"), "topic", "left_semi")
    best = top_rows(counted, ["user_id", "source", "part"], [F.desc("n"), "topic"], k, "_r")
    listed = best.groupBy("user_id", "source", "part").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    rows = parts.join(listed, ["user_id", "source", "part"], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    return rows.withColumn("summary", topic_summary(F.col("topics"), F.when(F.col("source") == "phase", "text").otherwise("visual")))


def topic_summary(found: Column, kind: Column) -> Column:
    body = F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("content withheld")
    return F.concat(F.lit("Generalized "), kind, F.lit(" topics: "), body, F.lit("."))


def generalized_labels(interests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allowed topics of each interest's domain, else the domain's fallback label."""
    found = interests.select("user_id", "interest_index", "domain", "bucket", F.explode_outer(domain_topics(F.col("label"), F.col("domain"))).alias("topic"))
    ok = found.join(allowed.select("topic", F.lit(True).alias("_ok")), "topic", "left").groupBy("user_id", "interest_index", "domain", "bucket").agg(F.collect_set(F.when(F.col("_ok"), F.col("topic"))).alias("ts"))
    labels = F.when(F.size("ts") > 0, F.col("ts")).otherwise(F.array(fallback_label(F.col("domain"))))
    return ok.select("user_id", "interest_index", "domain", "bucket", F.explode(labels).alias("label"))


def resolved_phases(interests: DataFrame, phased_posts: DataFrame) -> DataFrame:
    """Phases of each interest's evidence. Ids are authoritative; indices count only when there are no ids."""
    key = ["user_id", "interest_index"]
    has_ids = F.coalesce(F.size("evidence_post_ids"), F.lit(0)) > 0
    ids = interests.filter(has_ids).select(*key, F.explode("evidence_post_ids").alias("post_id")).join(phased_posts.select("user_id", "post_id", "phase"), ["user_id", "post_id"])
    plain = interests.filter(~has_ids).select(*key, F.explode("evidence_post_indices").alias("post_index")).join(phased_posts.select("user_id", "post_index", "phase"), ["user_id", "post_index"])
    return ids.select(*key, "phase").union(plain.select(*key, "phase")).distinct()


def released_topics(labels: DataFrame, label_phases: DataFrame) -> DataFrame:
    """Generalised interests per user, domain and bucket, with the union of their phases (four at most)."""
    joined = labels.join(label_phases, ["user_id", "interest_index"], "left")
    return joined.groupBy("user_id", "domain", "bucket", "label").agg(F.array_sort(F.collect_set("phase")).alias("evidence_post_indices"))


def evidence_audit(interests: DataFrame, phased_posts: DataFrame) -> DataFrame:
    """Unresolved ids, invalid indices and phase disagreements, as one row."""
    key = ["user_id", "interest_index"]
    ids = interests.select(*key, F.explode("evidence_post_ids").alias("post_id")).join(phased_posts.select("user_id", "post_id", F.col("phase").alias("a")), ["user_id", "post_id"], "left")
    idx = interests.select(*key, F.explode("evidence_post_indices").alias("post_index")).join(phased_posts.select("user_id", "post_index", F.col("phase").alias("b")), ["user_id", "post_index"], "left")
    pa = ids.groupBy(*key).agg(F.array_sort(F.collect_set("a")).alias("pa"), F.sum(F.col("a").isNull().cast("long")).alias("u"))
    pb = idx.groupBy(*key).agg(F.array_sort(F.collect_set("b")).alias("pb"), F.sum(F.col("b").isNull().cast("long")).alias("v"))
    both = interests.select(*key, (F.size("evidence_post_ids") > 0).alias("has_ids")).join(pa, key, "left").join(pb, key, "left")
    none = F.array().cast("array<int>")
    differs = F.col("has_ids") & (F.coalesce("pa", none) != F.coalesce("pb", none))
    return both.agg(
        F.coalesce(F.sum("u"), F.lit(0)).alias("unresolved_source_evidence_ids"), F.coalesce(F.sum("v"), F.lit(0)).alias("invalid_source_evidence_indices"),
        F.coalesce(F.sum(differs.cast("long")), F.lit(0)).alias("source_evidence_phase_disagreements"),
    )


def random_public_ids(users: DataFrame, seed: int) -> DataFrame:
    """Public ids in an order that a secret seed decides; the seed stays out of the release."""
    # 62 mixed bits of a keyed hash give the order; the buckets are its leading bits.
    mixed = users.select("user_id").distinct().withColumn("_o", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.sha2(F.concat(F.lit(str(seed)), F.col("user_id").cast("string")), 256)), 2))
    placed = with_position(mixed, [], ["_o", "user_id"], [F.shiftright("_o", 52), F.shiftright("_o", 42)], "_n")
    return placed.select("user_id", F.format_string("participant_%03d", F.col("_n") + 1).alias("public_id"))


# ------------------------------------------------------------------ verification

POST_TYPES = ["original", "reply", "quote", "repost", "retweet"]


USER_FILES = ["posts.jsonl", "gold_profile.json", "image_captions.json"]
PACKAGE_FILES = ["data/README.md", "data/privacy_audit.json", "data/manifest.json"]


def _broken(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold for a row."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def _issues(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each row and check that does not hold."""
    return df.select(F.explode(_broken(checks)).alias("issue"))


def _checked(df: DataFrame, keys: list[str], checks: dict[str, Column], text: str) -> DataFrame:
    """``keys`` and the ``issues`` of each row, without its text: written once, so that each text is made and searched once.

    Exploded where they are found, the issues would be filtered first, with all that makes the text put into each pattern.
    """
    residual = F.transform(residual_patterns(F.col(text)), lambda n: F.concat(F.lit("Residual "), n))
    return cut_lineage(df.select(*keys, F.concat(_broken(checks), residual).alias("issues")))


def file_set_issues(files: DataFrame, users: DataFrame) -> DataFrame:
    """Package files beside or short of the three of each user and the package's own; ``files`` has path, ``users`` user_id."""
    parts = F.split("path", "/")
    in_users = F.startswith("path", F.lit("data/users/"))
    rows = files.select("path", F.get(parts, F.lit(2)).alias("user_id"), F.get(parts, F.lit(3)).alias("name"), F.size(parts).alias("depth"), in_users.alias("in_users"))
    fine = (F.col("depth") == 4) & F.col("name").isin(*USER_FILES)
    checks = [
        _issues(rows.filter("in_users"), {"Unexpected user file": fine, "Invalid participant": F.col("user_id").rlike(PUBLIC_USER)}),
        _issues(rows.filter("not in_users"), {"Unexpected data file": F.col("path").isin(*PACKAGE_FILES)}),
    ]
    wanted = users.select("user_id", F.explode(F.array(*map(F.lit, USER_FILES))).alias("name"))
    checks.append(wanted.join(rows.filter("in_users").filter(fine), ["user_id", "name"], "left_anti").select(F.lit("Missing user file").alias("issue")))
    return functools.reduce(DataFrame.unionByName, checks)


def candidate_issues(
    posts: DataFrame, interests: DataFrame, evidence: DataFrame, captions: DataFrame, domains: DataFrame | None = None,
    counts: dict[str, int] | None = None, users: int | None = None, files: DataFrame | None = None, manifest: DataFrame | None = None, variant: str = VERSION,
) -> DataFrame:
    """Violations of a record-level candidate with their number of rows: issue, n.

    posts ``(user_id, post_id, post_index, relative_day, post_type, language, text)``, interests
    ``(user_id, interest_index, domain, status, label)``, evidence ``(user_id, interest_index, ordinal, post_index, post_id)``,
    captions ``(user_id, image_id, image_index, model, summary)``; where given: domains ``(user_id, domain, status)``, all seven
    of each user; counts as declared in the audit; the expected number of users; files ``(path, sha256)`` of the
    package and its manifest ``(release_variant, path, sha256)``.
    """
    posts = _checked(
        posts,
        ["user_id", "post_id", "post_index"],
        {
            "Invalid participant": F.col("user_id").rlike(PUBLIC_USER),
            "Invalid post ID": F.col("post_id") == public_post_id(F.col("user_id"), F.col("post_index")),
            "Invalid post metadata": F.col("relative_day") >= 0,
            "Invalid post type": F.col("post_type").isNull() | F.col("post_type").isin(*POST_TYPES),
            "Invalid language code": F.col("language").isNull() | F.col("language").rlike("^[a-z]{2,3}$"),
            "Non-string prose": F.col("text").isNotNull(),
        },
        "text",
    )
    interests = _checked(interests, [], {"Invalid domains": F.col("domain").isin(*DOMAINS), "Invalid domain schema": F.col("status").isin("active", "inactive")}, "label")
    shown = {"Invalid image": F.col("image_id") == F.format_string("image_%05d", F.col("image_index") + 1), "Unexpected caption model": F.col("model").isin(*CAPTION_MODELS)}
    captions = _checked(captions, ["user_id", "image_id"], shown, "summary")
    checks = [df.select(F.explode("issues").alias("issue")) for df in (posts, interests, captions)]
    known = posts.select("user_id", "post_index", F.col("post_id").alias("_post"))
    joined = evidence.join(known, ["user_id", "post_index"], "left")
    checks.append(_issues(joined, {"Evidence out of range": F.col("_post").isNotNull(), "Evidence mismatch": F.col("_post").isNull() | (F.col("_post") == F.col("post_id"))}))
    later = evidence.select("user_id", "interest_index", (F.col("ordinal") - 1).alias("ordinal"), F.col("post_index").alias("_next"))
    checks.append(_issues(evidence.join(later, ["user_id", "interest_index", "ordinal"]), {"Unsorted evidence": F.col("post_index") < F.col("_next")}))
    people = posts.select("user_id").distinct()
    if domains is not None:
        per_user = domains.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("domain").isin(*DOMAINS), F.col("domain"))).alias("d"))
        whole = (F.col("n") == len(DOMAINS)) & (F.col("d") == len(DOMAINS))
        checks.append(_issues(people.join(per_user, "user_id", "full_outer"), {"Invalid domains": whole}))
        checks.append(_issues(domains, {"Invalid domain schema": F.col("status").isin("active", "inactive")}))
        checks.append(domains.select("user_id").distinct().join(people, "user_id", "left_anti").select(F.lit("Empty timeline").alias("issue")))
    if users is not None:
        checks.append(_issues(people.agg(F.count("*").alias("n")), {"Wrong user count": F.col("n") == users}))
    measured = {"users": people, "posts": posts, "images": captions.select("user_id", "image_id").distinct(), "interest_entries": interests, "captions": captions}
    for name, df in measured.items():
        if counts is not None:
            checks.append(_issues(df.agg(F.count("*").alias("n")), {f"Count mismatch: {name}": F.col("n") == F.lit(counts.get(name))}))
    if files is not None:
        checks.append(file_set_issues(files, people))
    if manifest is not None and files is not None:
        checks.append(manifest_problems(files, manifest, variant).select("issue"))
    return functools.reduce(DataFrame.unionByName, checks).groupBy("issue").agg(F.count("*").alias("n"))


def verify_candidate(posts: DataFrame, interests: DataFrame, evidence: DataFrame, captions: DataFrame, **given) -> DataFrame:
    """Distinct messages of ``candidate_issues``; none when the candidate may be released."""
    return candidate_issues(posts, interests, evidence, captions, **given).select("issue")


def topic_issues(parts: DataFrame, labels: DataFrame, allowed: DataFrame) -> DataFrame:
    """Violations of a topic derivative with their number: unknown or suppressed topics, free text, wrong phases."""
    vocabulary = F.array(*[F.lit(t) for v in VOCABULARY.values() for t in v])
    kind = F.when(F.col("source") == "phase", "text").otherwise("visual")
    checks = [
        _issues(
            parts,
            {
                "invalid vocabulary": (F.size("topics") <= MAX_TOPICS) & (F.size(F.array_except("topics", vocabulary)) == 0) & (F.col("topics") == F.array_sort(F.array_distinct("topics"))),
                "free text detected": F.col("summary") == topic_summary(F.col("topics"), kind),
            },
        ),
        parts.select(F.explode("topics").alias("topic")).distinct().join(allowed, "topic", "left_anti").select(F.lit("suppressed topic").alias("issue")),
        _issues(labels, {"invalid evidence indices": F.forall("evidence_post_indices", lambda i: (i >= 0) & (i < PHASES))}),
        labels.filter(F.col("label") != fallback_label(F.col("domain"))).select(F.col("label").alias("topic")).distinct().join(allowed, "topic", "left_anti").select(F.lit("suppressed label").alias("issue")),
    ]
    return functools.reduce(DataFrame.unionByName, checks).groupBy("issue").agg(F.count("*").alias("n"))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only; none when both tables hold the same rows."""
    a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
