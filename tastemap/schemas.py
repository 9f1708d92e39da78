"""Canonical table schemas and fixed enumerations."""
from __future__ import annotations

from pyspark.sql import types as T

# Names and order of the seven interest domains and their definitions.
DOMAINS = [
    "sports_outdoor",
    "entertainment",
    "gaming",
    "food_drink",
    "travel_city_exploration",
    "photography_creation",
    "pets",
]
DOMAIN_DEFINITIONS = {
    "sports_outdoor": "sports participation, exercise, fitness routines, hiking, running, cycling, camping, outdoor recreation, and active-use sports gear.",
    "entertainment": "movies, TV, music, concerts, books/comics/anime, celebrities, and media consumption.",
    "gaming": "video games, gaming hardware/platforms, esports, game fandom, game streaming, and playing/watching games.",
    "food_drink": "cooking, meals, restaurants, cafes, recipes, coffee, tea, cocktails, and other food/drink consumption or creation.",
    "travel_city_exploration": "trips, flights, hotels, cities, neighborhoods, sightseeing, landmarks, museums, and city walks/exploration.",
    "photography_creation": "taking photos, cameras, lenses, editing, visual creation, making images/videos/artworks.",
    "pets": "pets, pet ownership, pet care, dogs, cats, training, grooming, adoption, veterinary care, pet products, and spending time with companion animals.",
}
TAG_TYPES = ["activity", "preference", "subject", "place", "object", "routine", "relation"]
NOISE_REASONS = ["too_little_content", "meme_image_only"]
MODALITIES = ["text", "visual"]
BUCKETS = ["long_term_interests", "short_term_interests", "negative_interests"]
CAPTION_MODELS = [
    "gemini-2.5-flash",
    "gpt-4o-mini",
    "gpt-5.4",
    "qwen2.5-vl-7b-instruct",
    "qwen3-vl-8b-instruct",
    "qwen3.5-35b-a3b",
]
# End of fixed values.

MEDIA = T.ArrayType(
    T.StructType(
        [
            T.StructField("media_id", T.StringType()),
            T.StructField("media_type", T.StringType()),
            T.StructField("storage_uri", T.StringType()),
            T.StructField("source_url", T.StringType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("alt_text", T.StringType()),
            T.StructField("sha256", T.StringType()),
        ]
    )
)

POST = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("post_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("hashtags", T.ArrayType(T.StringType())),
        T.StructField("mentions", T.ArrayType(T.StringType())),
        T.StructField("urls", T.ArrayType(T.StringType())),
        T.StructField("reply_to_post_id", T.StringType()),
        T.StructField("quote_post_id", T.StringType()),
        T.StructField("media", MEDIA),
        T.StructField("relative_day", T.IntegerType()),
    ]
)

EVIDENCE = T.ArrayType(
    T.StructType([T.StructField("source", T.StringType()), T.StructField("value", T.StringType())])
)
TAGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("tag", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("tag_type", T.StringType()),
        ]
    )
)
PROFILE = T.StructType(
    [
        T.StructField("is_noise", T.BooleanType()),
        T.StructField("should_use_for_profile", T.BooleanType()),
        T.StructField("noise_reason", T.StringType()),
        T.StructField("post_signal_strength", T.DoubleType()),
        T.StructField(
            "domains",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("domain", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                        T.StructField("evidence", EVIDENCE),
                        T.StructField("evidence_modalities", T.ArrayType(T.StringType())),
                        T.StructField("evidence_source_breakdown", T.MapType(T.StringType(), T.IntegerType())),
                        T.StructField("tags", TAGS),
                    ]
                )
            ),
        ),
        T.StructField("uncertainty_note", T.StringType()),
    ]
)

ANCHORS = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("interest", T.StringType()),
            T.StructField("evidence_post_indices", T.ArrayType(T.StringType())),
            T.StructField("representative_evidence_post_indices", T.ArrayType(T.StringType())),
            T.StructField("evidence_indices", T.ArrayType(T.StringType())),
        ]
    )
)

INTERESTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("evidence_post_indices", T.ArrayType(T.LongType())),
            T.StructField("evidence_post_ids", T.ArrayType(T.StringType())),
        ]
    )
)
GOLD_PROFILE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("release_variant", T.StringType()),
        T.StructField(
            "domains",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("domain", T.StringType()),
                        T.StructField("status", T.StringType()),
                        T.StructField("long_term_interests", INTERESTS),
                        T.StructField("short_term_interests", INTERESTS),
                        T.StructField("negative_interests", INTERESTS),
                        T.StructField("domain_representative_evidence_post_indices", T.ArrayType(T.LongType())),
                        T.StructField("domain_evidence_post_indices", T.ArrayType(T.LongType())),
                        T.StructField("summary_atomic", T.StringType()),
                        T.StructField("summary_natural_gold", T.StringType()),
                        T.StructField(
                            "debug_meta",
                            T.StructType(
                                [
                                    T.StructField("dropped_weak_interest_labels", T.ArrayType(T.StringType())),
                                    T.StructField("uncertainty_note", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

CAPTION_FILE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("release_variant", T.StringType()),
        T.StructField("post_association", T.StringType()),
        T.StructField(
            "captions",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "model_captions",
                            T.MapType(T.StringType(), T.StructType([T.StructField("summary", T.StringType())])),
                        )
                    ]
                ),
            ),
        ),
    ]
)

