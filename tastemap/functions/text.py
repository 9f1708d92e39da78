"""Text normalisation as Column functions.

Everything runs inside the JVM except Unicode decomposition, which Spark has no
built-in for; those two functions are Arrow-batched.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

WORD = r"[\p{L}\p{N}_]+"
WORD_WITH_MARKS = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_#@']*[\p{L}\p{N}_])?"
NOT_WORD_OR_SPACE = r"(?U)[^\p{L}\p{N}_\s]+"
SPACES = r"(?U)\s+"
URL = r"(?i)https?://\S+"


def _without(text: str, drop: Callable[[str], object]) -> str:
    """A text without some characters; each of its different characters is asked for once."""
    for c in filter(drop, set(text)):
        text = text.replace(c, "")
    return text


@pandas_udf(T.StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without the combining marks."""

    def fold(value):
        if value is None or value.isascii():
            return value
        return _without(unicodedata.normalize("NFKD", value), unicodedata.combining)

    return text.map(fold, na_action="ignore")


@pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    """NFKC form without invisible format characters."""

    def fold(value):
        if value is None or value.isascii():
            return value
        return _without(unicodedata.normalize("NFKC", value), lambda c: unicodedata.category(c) == "Cf")

    return text.map(fold, na_action="ignore")


def _where_needed(function, text: Column) -> Column:
    """Only texts beyond ASCII travel to Python; the others are their own normal form."""
    return F.coalesce(function(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_accents(text: Column) -> Column:
    return _where_needed(_decomposed, text)


def compatibility_form(text: Column) -> Column:
    return _where_needed(_composed, text)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def nonblank(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def free_text(c: Column) -> Column:
    """Lower case, no accents, punctuation as blanks, blanks squeezed."""
    return squeeze(F.regexp_replace(strip_accents(F.lower(blank(c))), NOT_WORD_OR_SPACE, " "))


def singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, 1, n - 3), F.lit("y")))
        .when(token.endswith("ses") & (n > 4), F.substring(token, 1, n - 2))
        .when(token.endswith("s") & ~token.endswith("ss"), F.substring(token, 1, n - 1))
        .otherwise(token)
    )


def stem(token: Column) -> Column:
    """Drop one of the endings -ing and -ed when three letters remain."""
    n = F.length(token)
    return (
        F.when(token.endswith("ing") & (n >= 6), F.substring(token, 1, n - 3))
        .when(token.endswith("ed") & (n >= 5), F.substring(token, 1, n - 2))
        .otherwise(token)
    )


def lemma(token: Column) -> Column:
    """Drop one of the endings -ing and -ed when three letters remain, then singular."""
    return singular(stem(token))


def lemmas(tokens: Column) -> Column:
    """Lemma of each token. The stem is a variable of its own: written out in ``singular`` it would run for each use."""
    return F.transform(F.transform(tokens, stem), singular)


def tag_form(tag: Column) -> Column:
    """Canonical spelling of a tag: lemmas joined by underscores."""
    parts = F.filter(F.split(F.replace(free_text(tag), F.lit(" "), F.lit("_")), "_"), lambda p: p != "")
    return F.array_join(lemmas(parts), "_")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def duplicate_tokens(text: Column) -> Column:
    """Lemmas of the free text, in order and with repeats."""
    return lemmas(words(free_text(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap; 0 when either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def match_label(label: Column) -> Column:
    """Label key for exact matching. Labels without Latin letters or digits have none (null)."""
    return nonblank(F.regexp_replace(F.lower(F.trim(blank(label))), "[^a-z0-9]+", " "))


def dialogue_label(label: Column) -> Column:
    """Label key of the dialogue tasks; blank labels have none (null)."""
    return F.nullif(squeeze(F.replace(F.lower(F.trim(blank(label))), F.lit("_"), F.lit(" "))), F.lit(""))


def response_form(text: Column) -> Column:
    """Latin words and digits of a response, joined by blanks."""
    lowered = F.replace(F.lower(F.trim(blank(text))), F.lit("_"), F.lit(" "))
    return F.array_join(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def interest_form(text: Column) -> Column:
    """Interest key of the summary validation: underscores and hyphens are blanks."""
    return squeeze(F.translate(F.lower(blank(text)), "_-", "  "))


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(blank(text))), "[^a-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "^_+|_+$", ""), F.lit("")), F.lit("model"))


# Tags with a spelled-out display label.
DISPLAY_OVERRIDES = {
    "retro_gam": "retro gaming",
    "pc_gam": "PC gaming",
    "gam_hardware": "gaming hardware",
    "science_book": "science books",
    "movie_watch": "movies",
    "homebrew": "homebrewing",
    "craft_beer": "craft beer",
    "physical_media": "physical game media",
    "din_out": "dining out",
    "caffeinat_drink": "caffeinated drinks",
    "healthy_eat": "healthy eating",
    "restaurant_meal": "restaurant meals",
}


def display_label(tag: Column, first_phrase: Column) -> Column:
    """Readable label of a tag; ``first_phrase`` is its first several-word member, if any."""
    overrides = F.create_map(*[F.lit(x) for kv in DISPLAY_OVERRIDES.items() for x in kv])
    return F.coalesce(
        overrides[F.trim(tag)],
        F.replace(first_phrase, F.lit("_"), F.lit(" ")),
        F.replace(F.trim(tag), F.lit("_"), F.lit(" ")),
    )


def is_phrase(member: Column) -> Column:
    """Members that qualify as a display label: several words, or joined by underscores."""
    return F.trim(member).contains("_") | F.trim(member).rlike(r"\S\s+\S")


def timestamp_text(created_at: Column, relative_day: Column) -> Column:
    """Rendered time of a post: its timestamp, else a sortable relative day, else empty."""
    return F.coalesce(
        nonblank(created_at),
        F.when(relative_day >= 0, F.format_string("relative day %07d", relative_day)),
        F.lit(""),
    )


def iso_utc(ts: Column) -> Column:
    """ISO text with Z; the fraction is shown only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("Z"))


def month_range(start: Column, end: Column) -> Column:
    a, b = F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM")
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(a, F.lit(" to "), b)).otherwise(F.coalesce(a, b))


def distinct_ints(values: Column, limit: int | None = None, drop_negative: bool = False) -> Column:
    """Ordered distinct integers of a text array; what is no integer is skipped."""
    ints = F.filter(F.transform(values, lambda v: v.try_cast("bigint")), lambda v: v.isNotNull())
    if drop_negative:
        ints = F.filter(ints, lambda v: v >= 0)
    ints = F.array_distinct(ints)
    return F.slice(ints, 1, limit) if limit else ints


def distinct_short(values: Column, limit: int, item_limit: int) -> Column:
    """Ordered distinct texts, compared without case, each cut to ``item_limit``."""
    cleaned = F.filter(F.transform(values, lambda v: squeeze(blank(v))), lambda v: v != "")
    firsts = F.filter(
        F.transform(cleaned, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        lambda s: F.array_position(F.transform(cleaned, F.lower), F.lower(s["v"])) == s["i"] + 1,
    )
    return F.slice(F.transform(firsts, lambda s: F.substring(s["v"], 1, item_limit)), 1, limit)


def cut_then_distinct(values: Column, limit: int, item_limit: int) -> Column:
    """As ``distinct_short``, but cut first, so that equal starts count once."""
    cut = F.transform(values, lambda v: F.substring(squeeze(blank(v)), 1, item_limit))
    return distinct_short(cut, limit, item_limit)


def prompt_text(c: Column, limit: int) -> Column:
    """Squeezed text cut to ``limit``; null when empty, so that JSON omits it."""
    return F.nullif(F.substring(squeeze(blank(c)), 1, limit), F.lit(""))


def round_half_up(value: Column, digits: int) -> Column:
    """Decimal rounding that is stable against the last bits of a double sum."""
    return F.round(value + F.lit(1e-10), digits)


def round6(value: Column) -> Column:
    return round_half_up(value, 6)


def round4(value: Column) -> Column:
    return round_half_up(value, 4)


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is 0 when the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def digest(*fields: Column) -> Column:
    """Content hash of a canonical JSON object; give the fields in name order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def literal(text: Column) -> Column:
    """A pattern that matches the text itself, whatever characters it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
