"""Hand-worked cases of gate, scores, scrubbing, dialogue rules and experiments."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tastemap.operators import context, dialogue, experiments, gate, privacy, ranking, release, scoring, timeline
from tastemap.plans.adapters import CUES
from tastemap.schemas import MEDIA


def test_gate_cases(spark):
    image = [("m", "image", None, None, None, None, None, None)]
    meme = [("m", "image", None, None, None, None, "reaction image of a cat", None)]
    rows = [(1, "hello", [], []), (2, "went running today", [], []), (3, "", [], image), (4, "", [], meme), (5, None, [" "], None)]
    df = spark.createDataFrame(rows, f"post_id int, text string, hashtags array<string>, media {MEDIA.simpleString()}")
    got = {r["post_id"]: r for r in gate.gate(df, CUES).collect()}
    assert got[1]["noise_reason"] == "too_little_content" and got[1]["gate_reason"] == ["too_little_content"]
    assert not got[2]["is_noise"] and got[2]["candidate_domains"] == ["sports_outdoor"]
    assert not got[3]["is_noise"] and got[4]["noise_reason"] == "meme_image_only" and got[5]["is_noise"]


def test_domain_score_by_hand(spark):
    end = datetime(2024, 6, 1)
    days = [400, 399, 370, 369, 340, 339, 310, 0]
    rec = [("u", str(i), end - timedelta(days=d), "gaming", 0.8, 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rec, "user_id string, post_id string, created_at timestamp, domain string, confidence double, dup_weight double")
    row = scoring.domain_stats(df, scoring.observation_window(df)).first()
    months = len({(end - timedelta(days=d)).strftime("%Y-%m") for d in days})
    assert row["distinct_time_bins"] == months
    assert abs(row["stable_score"] - (0.45 + 0.35 + 0.16)) < 1e-9
    assert abs(row["recent_score"] - 0.406667) < 1e-9 and row["status"] == "stable"


def test_positions_match_row_numbers_under_ties(spark):
    rows = [(i % 3, datetime(2024, 1, 1 + i % 4), i) for i in range(60)] + [(None, datetime(2024, 1, 1), 99), (None, None, 100)]
    df = spark.createDataFrame(rows, "k int, created_at timestamp, i long")
    got = ranking.with_position(df, ["k"], ["created_at", "i"], ranking.time_buckets(), "at", "n").collect()
    for key in (0, 1, 2, None):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(len(mine))) and all(r["n"] == len(mine) for r in mine)
        order = [(r["created_at"] or datetime.min, r["i"]) for r in mine]
        assert order == sorted(order)


def test_phases_and_overflowing_representatives(spark):
    five = spark.createDataFrame([("u", datetime(2024, 1, i + 1), i) for i in range(5)], "user_id string, created_at timestamp, post_index long")
    assert [r["phase"] for r in timeline.phases(five).orderBy("post_index").collect()] == [0, 0, 1, 2, 3]
    rows = [("u", "d", f"p{i:02d}", datetime(2024, 1, i + 1), 0.5, 0.5, f"tag{i:02d}") for i in range(16)]
    df = spark.createDataFrame(rows, "user_id string, domain string, post_id string, created_at timestamp, confidence double, post_signal_strength double, first_tag string")
    picked = [r["post_id"] for r in timeline.representative_posts(df).orderBy("pick_order").collect()]
    assert picked == [f"p{i:02d}" for i in range(16) if i != 5]


def test_only_groups_above_the_limit_are_placed_in_time(spark, monkeypatch):
    placed = []

    def counted(df, *args):
        placed.append(df.count())
        return ranking.with_position(df, *args)

    monkeypatch.setattr(timeline, "with_position", counted)
    rows = [(user, "d", f"p{i:02d}", datetime(2024, 1, 28 - i), 0.5, 0.5, f"tag{i:02d}") for user, n in (("many", 6), ("few", 3), (None, 5), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, domain string, post_id string, created_at timestamp, confidence double, post_signal_strength double, first_tag string")
    picked = timeline.representative_posts(df, 4).orderBy("user_id", "pick_order").collect()
    got = {}
    for r in picked:
        got.setdefault(r["user_id"], []).append(r["post_id"])
    # Thinned groups in time order, the others in the order of their tags.
    assert got == {None: ["p04", "p03", "p01", "p00"], "few": ["p00", "p01", "p02"], "many": ["p05", "p03", "p01", "p00"], "one": ["p00"]}
    assert placed == [11]  # all 15 rows before


def scrubbed(spark, texts, rules=None, handles=()):
    df = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "user_id string, i int, text string")
    rules = spark.createDataFrame(rules, "scope string, kind string, term string, replacement string") if rules else None
    return [r["scrubbed"] for r in privacy.scrub(df, rules, list(handles)).orderBy("i").collect()]


def test_scrub_spans_and_boundaries(spark):
    texts = ["Ann met annual ANN", "mail ａ＠b.org or call (555) 123-4567", "#[PERSON] likes #hiking", "27 dresses on Jan 5, 2024", "by @ann.x and annx", "see New York City"]
    rules = [(None, "replace", "ann", "[PERSON]"), (None, "replace", "new york", "[LOCATION]"), (None, "replace", "new york city", "a city"), ("u", "replace", "annx", "[PET]")]
    got = scrubbed(spark, texts, rules)
    assert got[0] == "[PERSON] met annual [PERSON]"
    assert got[1] == "mail [EMAIL] or call [PHONE]"
    assert got[2] == "[PERSON] likes #hiking"
    assert got[3] == "27 dresses on [DATE]"
    assert got[4] == "by [ACCOUNT] and [PET]"
    assert got[5] == "see a city"
    assert scrubbed(spark, got) == got


def test_rewrite_cannot_bring_identifiers_back(spark):
    assert scrubbed(spark, ["a secret"], [(None, "rewrite", "a secret", "write to x@y.org")]) == ["write to [EMAIL]"]


def test_scrub_rules_have_one_order(spark):
    shared = [(None, "replace", "ann lee", "[PERSON]"), ("u", "replace", "ann", "[PET]"), ("v", "replace", "ann", "[ORGANIZATION]")]
    many = [(None, "replace", f"term{k}", "[IDENTIFIER]") for k in range(20_000)]
    assert scrubbed(spark, ["ann lee came", "Ann came, TERM19999 too", "ann term1 annx"], shared + many) == ["[PERSON] came", "[PET] came, [IDENTIFIER] too", "[PET] [IDENTIFIER] annx"]
    # Handles beat own and shared rules; what a rule inserts is seen by the shorter ones after it.
    assert scrubbed(spark, ["bobby"], [("u", "replace", "bobby", "[PERSON]"), (None, "replace", "bobby", "[PET]")], ["bobby"]) == ["[ACCOUNT]"]
    assert scrubbed(spark, ["old harbour", "harbour"], [(None, "replace", "old harbour", "a city"), ("u", "replace", "city", "a b"), (None, "replace", "b", "[PATH]"), (None, "replace", "\u2605", "x")]) == ["a a [PATH]", "harbour"]
    assert scrubbed(spark, ["\u2605 [PERSON] person", None, ""], [(None, "replace", "\u2605", "x"), (None, "replace", "person", "y")]) == ["x [PERSON] y", None, ""]
    for bad in [(None, "replace", "", "[PERSON]"), ("u", "replace", "a", None), (None, "rewrite", None, "x")]:
        with pytest.raises(ValueError):
            scrubbed(spark, ["a, b"], [bad])


def test_scrub_matches_python_patterns(spark):
    import re

    texts = ["id 12345678901 x", "at 12.34567, -98.76543!", "5/6/2024-ok", "12 North Main Street Apt 4b", "hex " + "ab" * 16, "(a)@b c@d.ef", "日本@name 語", "www.x.y, z"]
    want = []
    for t in texts:
        for _, p, r in privacy.IDENTIFIERS:
            t = re.sub(p, r, t)
        want.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["m"] for r in df.select("i", privacy.masked(F.col("t")).alias("m")).orderBy("i").collect()] == want


def test_evidence_ids_win_over_indices(spark):
    posts = spark.createDataFrame([("u", "b", 0), ("u", "a", 1)], "user_id string, post_id string, post_index long")
    rows = [("u", 0, ["a"], [0]), ("u", 1, [], [1]), ("u", 2, ["zz"], [0]), ("u", 3, [], [7])]
    interests = spark.createDataFrame(rows, "user_id string, interest_index int, evidence_post_ids array<string>, evidence_post_indices array<long>")
    ev = release.resolved_evidence(interests, posts)
    got = {r["interest_index"]: (r["post_index"], r["problem"]) for r in ev.collect()}
    assert got == {0: (1, None), 1: (1, None), 2: (None, "Unresolved evidence IDs"), 3: (7, "Invalid evidence index")}
    assert 0 in {r["interest_index"] for r in release.repaired_interests(interests, ev).collect()}


def test_topic_stems_never_hide_a_match():
    import re

    for terms in release.VOCABULARY.values():
        for pattern in terms.values():
            for stem in release._stems(pattern):
                assert len(stem) >= 2
            for word in re.split(r"\|(?![^(]*\))", pattern):
                plain = word.replace("?:", "").replace(r"\w*", "")
                plain = re.sub(r"\(([^|)]*)[^)]*\)\??", r"\1", plain)
                for form in {re.sub(r"(.)\?", "", plain), plain.replace("?", "")}:
                    form = form.replace(".", "-") if "." in form else form
                    if re.fullmatch(pattern, form):
                        assert any(s in form for s in release._stems(pattern)), (pattern, form)


def test_negated_and_fuzzy_labels(spark):
    rows = [("try jazz tonight", "jazz"), ("skip jazz tonight", "jazz"), ("try jaz tonight", "jazzz"), ("not now" + " x" * 40 + " but jazz", "jazz"), ("avoid jazz" + " y" * 40 + " jazz", "Jazz")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "i int, t string, l string")
    got = [r["x"] for r in df.select("i", dialogue.recommended(F.col("l"), F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [True, False, False, True, True]
    f = spark.createDataFrame([("one two three four",), (" ".join(["word"] * 20) + ".",), ("",)], "t string")
    assert [r["x"] for r in f.select(dialogue.fluency(F.col("t")).alias("x")).collect()] == [1.0, 5.0, 0.0]


def test_wrong_profiles_with_lone_users(spark):
    rows = [(f"u{i}", d, ["x"] * (i + 1), []) for i, d in enumerate(["a", "a", "a", "b", "c", "c"])]
    for n in (2, 3, 4, 6):
        df = spark.createDataFrame(rows[-n:], "user_id string, domain string, stable array<string>, recent array<string>")
        got = {r["user_id"]: r["wrong_user_id"] for r in experiments.wrong_profiles(df).collect()}
        assert set(got) == set(got.values()) == {r[0] for r in rows[-n:]} and all(k != v for k, v in got.items())


def test_missing_assignments_stay_in_the_denominator(spark):
    t = spark.createDataFrame([("u", "i1", "stable"), ("u", "i2", "recent")], "user_id string, item_id string, bucket string")
    a = spark.createDataFrame([("m", "u", "i1", "stable")], "model string, user_id string, item_id string, bucket string")
    row = experiments.temporal_confusion(experiments.user_confusion(experiments.scored_assignments(t, a))).first()
    assert (row["stable_stable"], row["recent_invalid"], row["balanced_accuracy"]) == (1, 1, 0.5)


def test_review_batches_keep_both_limits(spark):
    df = spark.createDataFrame([(i, 10 + i % 90) for i in range(500)], "record_id long, n long")
    rows = privacy.review_batches(df, F.col("n"), 20, 400, 5000)
    per = rows.groupBy("batch").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
    assert rows.count() == 500 and all(r["c"] <= 20 and r["s"] <= 400 for r in per)


def test_redaction_drops_hashtags_only(spark):
    df = spark.createDataFrame([("t", ["#a"])], "t string, h array<string>")
    none = F.array().cast("array<string>")
    out = df.select(context.retry_payload(F.lit(""), F.lit(0), F.col("t"), F.col("h"), none, True).alias("a"), context.retry_payload(F.lit(""), F.lit(0), F.col("t"), F.col("h"), none).alias("b")).first()
    assert out["a"] == '{"i":0,"t":"t"}' and out["b"] == '{"i":0,"t":"t","h":["#a"]}'


def test_repeated_result_ids_are_errors_not_more_rows(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    results = spark.createDataFrame([("a", "x", None), ("a", "y", None), ("b", "z", None)], "custom_id string, content string, error string")
    errors = spark.createDataFrame([], "custom_id string, error string")
    got = {r["custom_id"]: (r["content"], r["error"]) for r in context.batch_results(requests, results, errors).collect()}
    assert got == {"a": (None, "duplicate result id"), "b": ("z", None), "c": (None, "missing result row")}
    line = '{"custom_id": "%s", "response": {"candidates": [{"content": {"parts": [{"text": "{\\"k\\": 1}"}]}}]}}'
    output = spark.createDataFrame([(line % "a",), (line % "a",), (line % "b",)], "value string")
    rows = context.reconciled(requests, output).collect()
    assert {r["custom_id"]: r["error"] for r in rows} == {"a": "duplicate_custom_id", "b": None, "c": "missing_prediction_row"} and len(rows) == 3


def test_clustered_draws_do_not_depend_on_other_vectors_of_the_array(spark, monkeypatch):
    names = [f"{t}_{p}" for t, p in experiments.CELLS]
    df = spark.createDataFrame([("m", *[(i * 7 + j) % 5 for j in range(len(names))]) for i in range(30)], ["model", *names])
    whole = experiments.cluster_bootstrap(df).first()
    monkeypatch.setattr(experiments, "DRAW_CELLS", 10)
    assert experiments.cluster_bootstrap(df).first() == whole
