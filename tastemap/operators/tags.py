"""Tag observations, and merging of tags that mean the same, per (user, domain)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fuzzy import indel
from ..functions.text import round6, tag_form
from ..session import cut_lineage
from .components import components


def observations(domain_rows: DataFrame, aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One row per (post, domain, tag) with the normalised tag, after the domain's reviewed aliases.

    The alias map is reviewed configuration, so it is a literal map and costs no join.
    """
    rows = domain_rows.select("*", F.posexplode("tags").alias("tag_position", "t")).withColumn("raw_tag", F.col("t.tag"))
    rows = rows.withColumn("tag", tag_form(F.col("raw_tag"))).withColumn("confidence", F.col("t.confidence")).drop("t", "tags")
    flat = [F.lit(x) for d, m in (aliases or {}).items() for a, b in m.items() for x in (f"{d}/{a}", b)]
    if not flat:
        return rows
    return rows.withColumn("tag", F.coalesce(F.create_map(*flat)[F.concat("domain", F.lit("/"), "tag")], "tag"))


SCOPE = ["user_id", "domain"]
FUZZY = 90.0
EMBEDDING = 0.72


def distinct_tags(obs: DataFrame) -> DataFrame:
    return obs.select(*SCOPE, "tag").distinct()


def _bigrams(tag):
    """Bigrams numbered by repetition, so that equal pieces count as often as they occur."""
    places = F.when(F.length(tag) >= 2, F.sequence(F.lit(1), F.length(tag) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(tag, i, F.lit(2)))


def fuzzy_pairs(tags: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """Tag pairs of one (user, domain) whose normalised insert/delete ratio reaches the threshold.

    A pair at the threshold has at most D edits, and each edit destroys at most two bigrams,
    so the pair shares one of the 2D+1 rarest bigrams of each side.
    """
    share = 1.0 - threshold / 100.0
    grams = tags.select(*SCOPE, "tag", F.posexplode(_bigrams(F.col("tag"))).alias("at", "gram"))
    nth = W.partitionBy(*SCOPE, "tag", "gram").orderBy("at")  # one tag
    grams = grams.withColumn("nth", F.row_number().over(nth))
    spread = grams.groupBy(*SCOPE, "gram", "nth").agg(F.count("*").alias("df"))
    own = W.partitionBy(*SCOPE, "tag").orderBy("df", "gram", "nth")
    # The longest partner of length n has n * (1 + share) / (1 - share) letters.
    edits = F.floor(share * F.length("tag") * (1 + (1 + share) / (1 - share)) + 1e-9)
    rare = grams.join(spread, [*SCOPE, "gram", "nth"]).withColumn("i", F.row_number().over(own)).filter(F.col("i") <= 2 * edits + 1)
    a = rare.select(*SCOPE, "gram", "nth", F.col("tag").alias("a"))
    b = rare.select(*SCOPE, "gram", "nth", F.col("tag").alias("b"))
    la, lb = F.length("a"), F.length("b")
    near = a.join(b, [*SCOPE, "gram", "nth"]).filter("a < b").filter(F.abs(la - lb) <= share * (la + lb) + 1e-9)
    # Substitution counts as one step in Levenshtein and two here, so this bound keeps every hit.
    near = near.select(*SCOPE, "a", "b").distinct().filter(F.levenshtein("a", "b") <= F.floor(share * (la + lb) + 1e-9))
    return near.withColumn("ratio", indel("a", "b")).filter(F.col("ratio") >= threshold - 1e-9)


def gram_weights(tags: DataFrame) -> DataFrame:
    """Normalised TF-IDF weights of the 3- to 5-character pieces of each blank-padded word."""
    words = tags.select(*SCOPE, "tag", F.explode(F.split(F.lower("tag"), " ")).alias("w")).filter("w != ''")
    padded = words.withColumn("p", F.concat(F.lit(" "), "w", F.lit(" ")))
    # A padded word not longer than n gives one piece of that size and none of a larger size.
    sizes = F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: (n == 3) | (F.length("p") >= n))
    pieces = F.flatten(
        F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - n + 1)), lambda i: F.substring(F.col("p"), i, n)))
    )
    grams = padded.select(*SCOPE, "tag", F.explode(pieces).alias("gram")).groupBy(*SCOPE, "tag", "gram").agg(F.count("*").alias("tf"))
    docs = tags.groupBy(*SCOPE).agg(F.count("*").alias("docs"))
    df = grams.groupBy(*SCOPE, "gram").agg(F.count("*").alias("df"))
    idf = F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    raw = grams.join(df, [*SCOPE, "gram"]).join(docs, SCOPE).withColumn("x", F.col("tf") * idf)
    norm = raw.groupBy(*SCOPE, "tag").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, [*SCOPE, "tag"]).select(*SCOPE, "tag", "gram", "df", (F.col("x") / F.col("norm")).alias("w"))


def _similar(vectors: DataFrame, limit: float) -> DataFrame:
    """Pairs ``a < b`` of sum vectors with mean cosine above ``limit``.

    ``vectors``: scope, ``c`` (cluster), ``gram``, ``df``, ``w`` (summed weights), ``size``.
    """
    own = W.partitionBy(*SCOPE, "c").orderBy("df", "gram")  # pieces of one cluster
    mean = F.col("w") / F.col("size")
    total = F.sum(mean * mean).over(W.partitionBy(*SCOPE, "c"))
    before = F.sum(mean * mean).over(own) - mean * mean
    # Common pieces start at or after the first one; the partner's mean vector has length 1 at most.
    heads = vectors.withColumn("left", total - before).filter(F.col("left") >= limit * limit - 1e-9)
    a = heads.select(*SCOPE, "gram", F.col("c").alias("a"))
    b = heads.select(*SCOPE, "gram", F.col("c").alias("b"))
    pairs = a.join(b, [*SCOPE, "gram"]).filter("a < b").select(*SCOPE, "a", "b").distinct()
    va = vectors.select(*SCOPE, F.col("c").alias("a"), "gram", F.col("w").alias("wa"), F.col("size").alias("na"))
    vb = vectors.select(*SCOPE, F.col("c").alias("b"), "gram", F.col("w").alias("wb"), F.col("size").alias("nb"))
    dots = pairs.join(va, [*SCOPE, "a"]).join(vb, [*SCOPE, "b", "gram"])
    sims = dots.groupBy(*SCOPE, "a", "b").agg((F.sum(F.col("wa") * F.col("wb")) / (F.first("na") * F.first("nb"))).alias("sim"))
    return sims.filter(F.col("sim") > limit + 1e-12)


def _as_vectors(weights: DataFrame) -> DataFrame:
    return weights.select(*SCOPE, F.col("tag").alias("c"), "gram", "df", "w", F.lit(1).alias("size"))


def similar_tags(tags: DataFrame, limit: float = EMBEDDING) -> DataFrame:
    """Tag pairs of one (user, domain) with cosine above ``limit``."""
    return _similar(_as_vectors(gram_weights(tags)), limit)


def linked_groups(tags: DataFrame, limit: float = EMBEDDING) -> DataFrame:
    """Average linkage cut at cosine distance ``1 - limit``: ``(scope, tag, group)`` of merged tags.

    The mean cosine of two clusters is the dot product of their sum vectors over both sizes.
    Average linkage is reducible, so all pairs that are each other's nearest merge in one
    round, and the result equals the one-pair-at-a-time order.
    """
    weights = cut_lineage(gram_weights(tags))
    sims = cut_lineage(_similar(_as_vectors(weights), limit))
    involved = sims.select(*SCOPE, F.col("a").alias("tag")).union(sims.select(*SCOPE, F.col("b").alias("tag"))).distinct()
    member = cut_lineage(involved.withColumn("c", F.col("tag")))
    while not sims.isEmpty():
        sides = sims.select(*SCOPE, F.col("a").alias("c"), F.col("b").alias("o"), "sim").union(sims.select(*SCOPE, "b", "a", "sim"))
        nearest = sides.groupBy(*SCOPE, "c").agg(F.min_by("o", F.struct(-F.round("sim", 12), F.least("c", "o"), F.greatest("c", "o"))).alias("o"))
        back = nearest.select(*SCOPE, F.col("o").alias("c"), F.col("c").alias("o"))
        merges = nearest.join(back, [*SCOPE, "c", "o"]).filter("c > o").withColumnRenamed("o", "into")
        member = cut_lineage(member.join(merges, [*SCOPE, "c"], "left").select(*SCOPE, "tag", F.coalesce("into", "c").alias("c")))
        sizes = member.groupBy(*SCOPE, "c").agg(F.count("*").alias("size"))
        summed = weights.join(member, [*SCOPE, "tag"]).groupBy(*SCOPE, "c", "gram").agg(F.first("df").alias("df"), F.sum("w").alias("w"))
        sims = cut_lineage(_similar(summed.join(sizes, [*SCOPE, "c"]), limit))
    return member.withColumnRenamed("c", "group")


def canonical_tags(tags: DataFrame, aliases: dict[str, dict[str, str]] | None = None, fuzzy: float = FUZZY, embedding: float = EMBEDDING) -> DataFrame:
    """Canonical tag of every tag: closure of alias, fuzzy and linkage merges.

    The canonical tag has the fewest words, then the fewest letters, then comes first.
    """
    tags = cut_lineage(tags)
    edges = fuzzy_pairs(tags, fuzzy).select(*SCOPE, "a", "b")
    edges = edges.unionByName(linked_groups(tags, embedding).filter("tag != group").select(*SCOPE, F.col("tag").alias("a"), F.col("group").alias("b")))
    flat = [F.lit(x) for d, m in (aliases or {}).items() for a, b in m.items() for x in (f"{d}/{a}", b)]
    if flat:
        mapped = tags.select(*SCOPE, F.col("tag").alias("a"), F.create_map(*flat)[F.concat("domain", F.lit("/"), "tag")].alias("b")).filter("b is not null")
        edges = edges.unionByName(mapped.join(tags.withColumnRenamed("tag", "b"), [*SCOPE, "b"], "left_semi"))
    label = F.struct(F.size(F.split("tag", "_")).alias("words"), F.length("tag").alias("letters"), F.col("tag").alias("tag"))
    found = components(tags.select(*SCOPE, F.col("tag").alias("v"), label.alias("label")), edges, SCOPE)
    return found.select(*SCOPE, F.col("v").alias("tag"), F.col("label.tag").alias("canonical_tag"))


def tag_clusters(obs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Posts, weighted support and mean confidence per canonical tag."""
    rows = obs.join(canonical, [*SCOPE, "tag"])
    return rows.groupBy(*SCOPE, "canonical_tag").agg(
        F.countDistinct("post_id").alias("n_posts"),
        round6(F.sum("dup_weight")).alias("weighted_support"),
        round6(F.avg("confidence")).alias("mean_confidence"),
    )


def cluster_members(obs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Normalised and raw spellings of each canonical tag, one row each."""
    rows = obs.select(*SCOPE, "tag", "raw_tag").distinct().join(canonical, [*SCOPE, "tag"])
    return rows.select(*SCOPE, "canonical_tag", F.explode(F.array("tag", "raw_tag")).alias("member")).distinct()


def cluster_evidence(obs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Posts of each canonical tag, one row each."""
    return obs.join(canonical, [*SCOPE, "tag"]).select(*SCOPE, "canonical_tag", "post_id").distinct()


def post_tags(evidence: DataFrame) -> DataFrame:
    """Sorted canonical tags of each (post, domain); a post has few of them."""
    return evidence.groupBy(*SCOPE, "post_id").agg(F.array_sort(F.collect_set("canonical_tag")).alias("canonical_tags"))


def cluster_records(records: DataFrame, evidence: DataFrame, obs: DataFrame, members: DataFrame, position: str = "tag_position") -> DataFrame:
    """Records behind each canonical tag, with the confidence of the post's first matching tag, else 0."""
    hits = obs.join(members.withColumnRenamed("member", "tag"), [*SCOPE, "tag"])
    first = hits.groupBy(*SCOPE, "canonical_tag", "post_id").agg(F.min_by("confidence", position).alias("tag_confidence"))
    rows = records.drop("confidence").join(evidence, [*SCOPE, "post_id"]).join(first, [*SCOPE, "canonical_tag", "post_id"], "left")
    return rows.withColumn("confidence", F.coalesce("tag_confidence", F.lit(0.0))).withColumnRenamed("canonical_tag", "interest").drop("tag_confidence")
