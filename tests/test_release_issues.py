"""Checks of a candidate: each text is made and searched once."""
import unicodedata

from pyspark.sql import functions as F

from tastemap.functions.text import compatibility_form, strip_accents
from tastemap.operators import privacy, release


def test_each_text_of_a_candidate_is_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        calls.add(1)
        return text

    rows = [("participant_001", f"participant_001_post_{i + 1:04d}", i, i, "reply", "en", ["fine", "mail me: x@y.org", "see C:\\x and 3/4/24", None][i % 4]) for i in range(8)]
    posts = spark.createDataFrame(rows, "user_id string, post_id string, post_index long, relative_day int, post_type string, language string, raw string")
    posts = posts.select("user_id", "post_id", "post_index", "relative_day", "post_type", "language", said("raw").alias("text"))
    interests = spark.createDataFrame([("participant_001", 0, "pets", "active", "dogs")], "user_id string, interest_index int, domain string, status string, label string")
    evidence = spark.createDataFrame([("participant_001", 0, 0, 0, "participant_001_post_0001")], "user_id string, interest_index int, ordinal int, post_index long, post_id string")
    captions = spark.createDataFrame([("participant_001", "image_00001", 0, "other", "www.x.y")], "user_id string, image_id string, image_index int, model string, summary string")
    got = {r["issue"]: r["n"] for r in release.candidate_issues(posts, interests, evidence, captions, counts={"users": 1, "posts": 8, "images": 1, "interest_entries": 1, "captions": 2}).collect()}
    assert got == {
        "Residual email": 2, "Residual date": 2, "Residual private_path": 2, "Non-string prose": 2, "Residual url": 1, "Unexpected caption model": 1, "Count mismatch: captions": 1,
    }
    assert calls.value == 8


def test_patterns_look_ahead_without_missing_a_match(spark):
    texts = {
        "a.b+c@x.org": "[EMAIL]", "HTTPS://q ok": "[URL] ok", "(@who)": "([ACCOUNT])", "-12.3456, 9.87654": "[COORDINATES]", "+1 (555) 123-4567": "[PHONE]", "x(555) 123-4567": "x(555) 123-4567",
        "deadbeef" * 4: "[IDENTIFIER]", "+1234567890": "[IDENTIFIER]", "\u0663" * 10: "[IDENTIFIER]", "1 elm rd": "[ADDRESS]", "01022020": "[DATE]", "x01022020": "x01022020", "mai 5, may 5": "mai 5, [DATE]",
        "\u017fep 3": "[DATE]", "5TH march 2020": "[DATE]", "d:/x y": "[PATH] y", "/Users/a b": "[PATH] b", "[PET]@a [x]@b": "[PET][ACCOUNT] [x][ACCOUNT]", "]@a[PERSON]b@c.de": "][ACCOUNT][PERSON][EMAIL]",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    assert {r["t"]: r["m"] for r in df.select("t", privacy.masked(F.col("t"), True).alias("m")).collect()} == texts


def test_normal_forms_drop_marks_and_hidden_characters(spark):
    texts = ["plain", "caf\u00e9 cafe\u0301", "\ufb01ne \u00ad\u200bx\u2060", "\u0e01\u0e33 \u0939\u093f\u0928\u094d\u0926\u0940", "\u212b\u1e9b\u0323", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", strip_accents(F.col("t")).alias("a"), compatibility_form(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["a"] for r in got] == [t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert [r["c"] for r in got] == [t and "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf") for t in texts]
