"""Driver tables as canonical tables, once for Spark and once as SQL common table expressions.

The timelines of the test tables carry no profiles, tags or labels of their own, so each
canonical column is a fixed function of the given columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOMAINS
from ..session import load

RAW_TAGS = [
    "Retro Gaming", "hiking", "Hikes", "craft beer", "Café visits", "movies", "movie", "street-photo",
    "street photos", "dogs", "dog", "road trips", "board games", "baking", "baked goods",
]
# Normalised spelling of RAW_TAGS, for the SQL side.
TAG_FORMS = [
    "retro_gam", "hik", "hike", "craft_beer", "cafe_visit", "movy", "movie", "street_photo",
    "street_photo", "dog", "dog", "road_trip", "board_game", "bak", "bak_good",
]
MODALITY_SETS = [["text"], ["visual"], ["visual", "text"], []]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as timeline posts; ``k`` is the number in their properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf, "events").select(
        "user_id",
        F.col("event_id").alias("post_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("post_type"),
        "value",
        k.alias("k"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """One (post, domain) record per event, with confidence, signal, tag and modalities."""
    k = F.col("k")
    sets = F.array(*[F.array(*[F.lit(m) for m in s]) if s else F.array().cast("array<string>") for s in MODALITY_SETS])
    return events(spark, sf).select(
        "user_id",
        "post_id",
        "created_at",
        "post_type",
        pick(DOMAINS, k % 7).alias("domain"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        (k / 100.0).alias("post_signal_strength"),
        pick(RAW_TAGS, F.floor(k / 7)).alias("raw_tag"),
        F.element_at(sets, (k % 4 + 1).cast("int")).alias("evidence_modalities"),
        k.alias("k"),
        (1.0 / (1 + k % 3)).alias("dup_weight"),
    )


REC = f"""ev AS (
  SELECT user_id, event_id AS post_id, ts AS created_at, event_type AS post_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
), rec AS (
  SELECT user_id, post_id, created_at, post_type, k,
         list_extract({sql_list(DOMAINS)}, 1 + k % 7) AS domain,
         least(CAST(1.0 AS DOUBLE), value / 100) AS confidence,
         CAST(k AS DOUBLE) / 100 AS post_signal_strength,
         list_extract({sql_list(RAW_TAGS)}, 1 + k // 7) AS raw_tag,
         list_extract({sql_list(TAG_FORMS)}, 1 + k // 7) AS tag,
         k % 4 AS modality_code,
         1.0::DOUBLE / (1 + k % 3) AS dup_weight
  FROM ev
), span AS (
  SELECT user_id, count(*) AS posts, min(created_at) AS observed_start, max(created_at) AS observed_end,
         greatest(1, CAST(floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000) AS BIGINT)) AS window_days
  FROM rec GROUP BY user_id
)"""

ORDER_REC = """rec AS (
  SELECT o_custkey % 100 AS user_id, o_orderkey AS post_id, o_orderdate AS created_at,
         o_orderpriority AS domain, least(CAST(1.0 AS DOUBLE), o_totalprice / 500000) AS confidence,
         CAST(1.0 AS DOUBLE) AS dup_weight
  FROM orders
), span AS (
  SELECT user_id, count(*) AS posts, min(created_at) AS observed_start, max(created_at) AS observed_end,
         greatest(1, CAST(floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000) AS BIGINT)) AS window_days
  FROM rec GROUP BY user_id
)"""


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records over several years, for the monthly time bins."""
    return load(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).alias("user_id"),
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderpriority").alias("domain"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"),
        F.lit(1.0).alias("dup_weight"),
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts of fifty users, with derived media, hashtags and times."""
    d = F.col("doc_id")
    image = lambda alt: F.struct(
        F.concat(F.lit("m"), d).alias("media_id"),
        F.lit("image").alias("media_type"),
        F.concat(F.lit("media/"), d, F.lit(".jpg")).alias("storage_uri"),
        F.when(d % 4 == 0, F.concat(F.lit("https://img.example/"), d)).cast("string").alias("source_url"),
        alt.cast("string").alias("alt_text"),
    )
    video = F.struct(
        F.concat(F.lit("v"), d).alias("media_id"),
        F.lit("video").alias("media_type"),
        F.lit(None).cast("string").alias("storage_uri"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("alt_text"),
    )
    meme = F.when(d % 10 == 0, "caption this meme").when(d % 3 == 0, "a plain photo")
    return load(spark, sf, "documents").select(
        (d % 50).alias("user_id"),
        d.alias("post_id"),
        F.floor(d / 50).alias("post_index"),
        F.timestamp_micros(F.lit(1704067200000000) + F.floor(d / 50) * 86400000000 + (d % 7) * 3600000000).alias("created_at"),
        F.when(d % 3 == 0, "original").when(d % 3 == 1, "quote").otherwise("reply").alias("post_type"),
        F.col("lang").alias("language"),
        "text",
        F.when(d % 6 == 0, F.array(F.lit("#Food"), F.lit(" "), F.lit("travel")))
        .when(d % 6 == 1, F.array(F.lit("##Gaming")))
        .otherwise(F.array().cast("array<string>"))
        .alias("hashtags"),
        F.when(d % 5 == 0, F.array(image(meme)))
        .when(d % 5 == 1, F.array(video))
        .when(d % 5 == 2, F.array(image(F.lit(None)), image(meme)))
        .otherwise(F.array().cast("array<struct<media_id:string,media_type:string,storage_uri:string,source_url:string,alt_text:string>>"))
        .alias("media"),
        "source",
        "n_chars",
    )


POST = """post AS (
  SELECT doc_id % 50 AS user_id, doc_id AS post_id, doc_id // 50 AS post_index,
         make_timestamp(1704067200000000 + (doc_id // 50) * 86400000000 + (doc_id % 7) * 3600000000) AS created_at,
         CASE doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'quote' ELSE 'reply' END AS post_type,
         lang AS language, text, source, n_chars,
         CASE doc_id % 6 WHEN 0 THEN ['#Food', ' ', 'travel'] WHEN 1 THEN ['##Gaming'] ELSE [] END AS hashtags,
         CASE WHEN doc_id % 10 = 0 THEN 'caption this meme' WHEN doc_id % 3 = 0 THEN 'a plain photo' END AS alt_text,
         CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 = 2 THEN 2 ELSE 0 END AS n_images,
         CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS n_videos,
         CASE WHEN doc_id % 4 = 0 THEN 'https://img.example/' || doc_id END AS source_url
  FROM documents
)"""

CUES = {
    "sports_outdoor": (["ation the", "running"], ["running"]),
    "entertainment": (["eaux", "movie"], ["movies"]),
    "gaming": (["video game", "ththe"], ["gaming"]),
    "food_drink": (["recipe", "unge"], ["food"]),
    "travel_city_exploration": (["caption", "los de"], ["travel"]),
    "photography_creation": (["photo", "camera"], ["camera"]),
    "pets": (["puppy"], ["pets"]),
}
