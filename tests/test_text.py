import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tastemap.functions import text as T
from tastemap.functions.fuzzy import best_window_ratio, common_subsequence, indel_ratio


def values(spark, words, fn):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r["x"] for r in df.select("i", fn(F.col("w")).alias("x")).orderBy("i").collect()]


def test_lemmas(spark):
    words = ["gaming", "movies", "buses", "glass", "running", "bed", "red", "ring", "cats"]
    assert values(spark, words, T.lemma) == ["gam", "movy", "bus", "glass", "runn", "bed", "red", "ring", "cat"]


def test_tag_and_label_forms(spark):
    assert values(spark, ["Café Visits!", "retro-gaming", "  "], T.tag_form) == ["cafe_visit", "retro_gam", ""]
    assert values(spark, ["Board-Games!", "日本語", None], T.match_label) == ["board games", None, None]
    assert values(spark, ["ﬁne ÉTÉ", None], T.free_text) == ["fine ete", ""]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_and_ratios_against_plain_tables():
    rng = random.Random(7)
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        assert common_subsequence(a, b) == plain_lcs(a, b)
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        n, m = len(short), len(long)
        windows = [long[max(0, e - n) : min(m, e)] for e in range(1, m + n)] if n else []
        best = max([indel_ratio(short, w) for w in windows], default=100.0 if not m else 0.0)
        if n:
            got = best_window_ratio(a, b, 0.0)
            assert abs(got - (100.0 if short in long else best)) < 1e-9
            for cutoff in (70.0, 85.0):
                assert (best_window_ratio(a, b, cutoff) >= cutoff) == (got >= cutoff)
    assert SequenceMatcher(None, "a", "a").ratio() == 1.0


def test_the_stem_of_a_token_is_one_variable(spark):
    plan = spark.createDataFrame([("hikes",)], "t string").select(T.tag_form(F.col("t")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("ing)") == 1  # written out in every use of the stem before
    assert [r[0] for r in spark.createDataFrame([("Road-trips & hiking",), ("__",), (None,)], "t string").select(T.tag_form(F.col("t"))).collect()] == ["road_trip_hik", "", ""]
