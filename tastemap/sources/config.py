"""Reviewed configuration as small tables: domain cues, tag aliases and fixed user lists."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import DOMAINS

CUE_FILE = "domains array<struct<name: string, seed_keywords: array<string>, seed_hashtags: array<string>>>"
ALIAS_FILE = "map<string, map<string, string>>"


def config_document(spark: SparkSession, path: str) -> DataFrame:
    """A configuration file as one row with its JSON text; YAML files need the yaml package."""
    text = spark.read.text(path, wholetext=True).select("value")
    if not path.endswith((".yaml", ".yml")):
        return text
    import yaml

    parsed = yaml.safe_load(text.first()["value"])
    return text.select(F.lit(json.dumps(parsed, ensure_ascii=False)).alias("value"))


def cue_entries(document: DataFrame) -> DataFrame:
    """The entries of a cue file: at, name, seed_keywords, seed_hashtags."""
    listed = document.select(F.from_json("value", CUE_FILE)["domains"].alias("d"))
    return listed.select(F.posexplode("d").alias("at", "e")).select("at", F.trim(F.coalesce("e.name", F.lit(""))).alias("name"), "e.seed_keywords", "e.seed_hashtags")


def cue_problems(entries: DataFrame) -> DataFrame:
    """What is wrong with a cue file: unknown or repeated domains, or no entry at all."""
    unknown = entries.filter(~F.col("name").isin(*DOMAINS)).select(F.concat(F.lit("Unknown domain: "), "name").alias("issue"))
    again = entries.groupBy("name").count().filter("count > 1").select(F.concat(F.lit("Repeated domain: "), "name").alias("issue"))
    none = entries.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("No domains").alias("issue"))
    return unknown.unionByName(again).unionByName(none).distinct()


def cue_terms(entries: DataFrame) -> DataFrame:
    """name, kind (keyword or hashtag) and term, each once: lower case, without blanks around and leading hash signs."""
    kinds = [("keyword", "seed_keywords", ""), ("hashtag", "seed_hashtags", "#")]
    rows = [entries.select("name", F.lit(kind).alias("kind"), F.explode(c).alias("t")).withColumn("term", F.lower(F.trim("t"))) for kind, c, _ in kinds]
    rows[1] = rows[1].withColumn("term", F.regexp_replace("term", "^#+", ""))
    return rows[0].unionByName(rows[1]).filter("term != ''").select("name", "kind", "term").distinct()


def read_cues(spark: SparkSession, path: str) -> dict[str, tuple[list[str], list[str]]]:
    """Keywords and hashtags of each domain, as the gate takes them. A file with problems is an error."""
    entries = cue_entries(config_document(spark, path))
    issues = [r["issue"] for r in cue_problems(entries).collect()]
    if issues:
        raise ValueError(f"{path}: {'; '.join(sorted(issues))}")
    found = {r["name"]: ([], []) for r in entries.select("name").collect()}  # at most one row a domain
    for r in cue_terms(entries).orderBy("name", "kind", "term").collect():
        found[r["name"]][r["kind"] == "hashtag"].append(r["term"])
    return found


def alias_rows(document: DataFrame) -> DataFrame:
    """domain, tag and the canonical tag it stands for."""
    tags = document.select(F.explode(F.from_json("value", ALIAS_FILE)).alias("domain", "tags"))
    return tags.select("domain", F.explode("tags").alias("tag", "canonical_tag")).filter("tag is not null and canonical_tag is not null")


def read_aliases(spark: SparkSession, path: str | None) -> dict[str, dict[str, str]]:
    """Reviewed aliases by domain, as the tag operators take them; no path, no aliases."""
    found: dict[str, dict[str, str]] = {}
    for r in alias_rows(config_document(spark, path)).collect() if path else ():
        found.setdefault(r["domain"], {})[r["tag"]] = r["canonical_tag"]
    return found


def user_list_problems(listed: DataFrame, available: DataFrame, n: int = 0) -> DataFrame:
    """issue and name: names that a fixed list repeats or that have no file, and a list shorter than ``n`` (name null).

    ``listed`` has position and name; blank lines do not count.
    """
    filled = listed.filter(F.trim("name") != "").select("position", F.trim("name").alias("name"))
    again = filled.groupBy("name").count().filter("count > 1").select(F.lit("Repeated user").alias("issue"), "name")
    lost = fixed_users(filled, n).join(available.select("name").distinct(), "name", "left_anti").select(F.lit("User without a file").alias("issue"), "name").distinct()
    short = filled.agg(F.count("*").alias("c")).filter(F.col("c") < max(n, 1)).select(F.lit("List too short").alias("issue"), F.lit(None).cast("string").alias("name"))
    return again.unionByName(lost).unionByName(short)


def fixed_users(listed: DataFrame, n: int = 0) -> DataFrame:
    """The first ``n`` names of a list in its order; all for 0."""
    if n < 0:
        raise ValueError("a number of users is not negative")
    filled = listed.filter(F.trim("name") != "").select("position", F.trim("name").alias("name"))
    if not n:
        return filled
    first = filled.orderBy("position").limit(n)
    return first.withColumn("position", F.row_number().over(W.orderBy("position")) - 1)
