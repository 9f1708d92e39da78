"""Selections, repeated ids, missing turns, report files and literal patterns."""
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tastemap.functions.text import literal
from tastemap.operators import dialogue, experiments, gate, release
from tastemap.operators.ranking import nth_row
from tastemap.sources import readers


def test_nth_row_of_numbers_texts_ties_and_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 5, 5, 5, rng.randint(-10**12, 10**12)]), rng.choice([None, "", "participant_", f"participant_{rng.randint(0, 999)}", "é", "zÿ"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "n long, t string").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for k in (0, 1, 57, 150, 298, 299):
        for few in (2, 40, 10_000):
            assert [tuple(r) for r in nth_row(df, ["n", "t"], k, few).collect()] == [want[k]]
    assert nth_row(df, ["n", "t"], 300).collect() == [] and nth_row(df.limit(0), ["n"], 0).collect() == []


def test_pilot_users_with_one_length_for_all(spark):
    users = spark.range(50_001).select(F.format_string("participant_%06d", "id").alias("user_id"), F.lit(7).cast("long").alias("length"))
    assert sorted(r["user_id"] for r in experiments.pilot_users(users, "length").collect()) == ["participant_000000", "participant_025000", "participant_050000"]
    one = users.limit(1)
    assert experiments.pilot_users(one, "length").count() == 1 and experiments.pilot_users(users.limit(0), "length").count() == 0


def test_the_last_post_of_a_repeated_id_counts(spark):
    posts = spark.createDataFrame([("u", "p", datetime(2024, 1, 2), "new"), ("u", "p", datetime(2024, 1, 1), "old"), ("u", "q", None, "x")], "user_id string, post_id string, created_at timestamp, text string")
    profiles = spark.createDataFrame([("u", "p", False, True), ("u", "q", True, True)], "user_id string, post_id string, is_noise boolean, should_use_for_profile boolean")
    assert [r["text"] for r in gate.kept_posts(posts, profiles).collect()] == ["new"]


def test_a_turn_that_one_model_leaves_out_scores_as_empty(spark):
    none = F.array().cast("array<string>")
    turns = spark.createDataFrame([("u", 1, "stable_recommendation"), ("u", 2, "stable_recommendation")], "user_id string, turn_id int, scenario_type string")
    for kind in ("required", "anchor", "optional", "forbidden"):
        turns = turns.withColumn(f"{kind}_labels", none)
    turns = turns.withColumn("claims", F.array().cast("array<struct<claim_id:string,text:string,labels:array<string>>>"))
    said = spark.createDataFrame([("a", "u", 1, "one two three four five six"), ("a", "u", 2, "seven"), ("b", "u", 2, "eight")], "model string, user_id string, turn_id int, response string")
    got = {(r["model"], r["turn_id"]): r["word_count"] for r in dialogue.scored_turns(turns, said).collect()}
    assert got == {("a", 1): 6, ("a", 2): 1, ("b", 1): 0, ("b", 2): 1}
    assert {r["model"] for r in dialogue.scored_turns(turns, said, ["a", "c"]).collect()} == {"a", "c"}
    assert dialogue.scored_turns(turns, said.limit(0)).count() == 0


def test_literal_patterns_hold_any_text(spark):
    rows = spark.createDataFrame([(r"a.\Eb a.\Eb", r"a.\Eb"), (r"x\Ey", r"\E"), ("(a) (a)", "(a)"), (r"\Q\E\E", r"\E"), ("a\\", "\\")], "t string, f string")
    got = [r[0] for r in rows.select(F.size(F.split("t", literal(F.col("f")), -1)) - 1).collect()]
    assert got == [2, 1, 2, 2, 1]


def test_reports_keep_task_order_over_several_files(spark, tmp_path):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b c").otherwise("a").alias("model"), (999 - F.col("id")).alias("task_position"), F.concat(F.lit("r"), "id").alias("text")).repartition(7)
    metrics = rows.groupBy("model").agg(F.count("*").alias("n"))
    readers.write_reports(rows, metrics, str(tmp_path / "out"))
    got = {}
    for r in readers.read_reports(spark, str(tmp_path / "out")).orderBy("model", "position").select("model", F.get_json_object("value", "$.task_position").cast("int").alias("t")).collect():
        got.setdefault(r["model"], []).append(r["t"])
    assert got == {"a": sorted(999 - k for k in range(1000) if k % 10), "b c": sorted(999 - k for k in range(1000) if k % 10 == 0)}
    assert {(r["model"], r["n"]) for r in spark.read.json(str(tmp_path / "out" / "report")).collect()} == {("a", 900), ("b c", 100)}
    with pytest.raises(Exception):
        readers.write_reports(rows, metrics, str(tmp_path / "out"))


def test_releases_stop_on_unmapped_users_and_unresolved_evidence(spark):
    posts = spark.createDataFrame([("s1", "p", 0, datetime(2024, 1, 1), None, None, "hi"), ("s2", "q", 0, datetime(2024, 1, 1), None, None, "ho")], "user_id string, post_id string, post_index long, created_at timestamp, post_type string, language string, text string")
    mapping = spark.createDataFrame([("s1", "participant_001")], "source_id string, public_id string")
    with pytest.raises(Exception, match="User without mapping: s2"):
        release.candidate_posts(posts, mapping).collect()
    assert release.candidate_posts(posts.filter("user_id = 's1'"), mapping).count() == 1
    interests = spark.createDataFrame([("s1", 0, ["p"], [0]), ("s1", 1, ["gone"], [0])], "user_id string, interest_index long, evidence_post_ids array<string>, evidence_post_indices array<long>")
    found = release.resolved_evidence(interests, posts)
    with pytest.raises(Exception, match="Unresolved evidence IDs of s1"):
        release.candidate_evidence(found, mapping).collect()
    assert release.candidate_evidence(found.filter("interest_index = 0"), mapping).count() == 1


def test_file_sets_of_a_package(spark):
    users = spark.createDataFrame([("participant_001",), ("participant_002",)], "user_id string")
    paths = [f"data/users/participant_00{u}/{n}" for u in (1, 2) for n in release.USER_FILES] + ["data/manifest.json"]
    files = lambda p: spark.createDataFrame([(x,) for x in p], "path string")
    issues = lambda p: sorted(r["issue"] for r in release.file_set_issues(files(p), users).collect())
    assert issues(paths) == []
    assert issues(paths[1:] + ["data/users/bob/posts.jsonl", "data/users/participant_001/sub/posts.jsonl", "notes.txt"]) == ["Invalid participant", "Missing user file", "Unexpected data file", "Unexpected user file"]


def test_bootstrap_of_fractional_scores_draws_from_few_cells(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    fine = np.round(rng.gamma(2.0, 0.7, 4000) - 1, 6)
    whole = rng.integers(-3, 6, 500)
    rows = [("m", "i", "fine", float(x)) for x in fine] + [("m", "i", "whole", float(x)) for x in whole] + [("m", "i", "one", 0.25)] * 9
    found = {r["contrast"]: r for r in experiments.paired_bootstrap(spark.createDataFrame(rows, "model string, intent string, contrast string, delta double"), cells=32).collect()}
    for name, values in (("fine", fine), ("whole", whole)):
        draws = np.random.default_rng(1).choice(values, size=(5000, len(values))).mean(axis=1)
        low, high = np.quantile(draws, [0.025, 0.975])
        width = high - low
        assert abs(found[name]["ci_low"] - low) < 0.06 * width and abs(found[name]["ci_high"] - high) < 0.06 * width
        assert abs(found[name]["mean"] - values.mean()) < 1e-5 and found[name]["n"] == len(values)
    assert (found["one"]["ci_low"], found["one"]["ci_high"]) == (0.25, 0.25)
