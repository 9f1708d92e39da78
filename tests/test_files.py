"""Readers, sinks and incremental runs on small files."""
import hashlib
import json
import random

import pytest

from tastemap.plans.adapters import CUES
from tastemap.sources import config, files, readers
from tastemap.streaming import incremental


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def post(user, pid, text="hello"):
    return json.dumps({"user_id": user, "post_id": pid, "created_at": "2024-01-01T00:00:00Z", "text": text}, ensure_ascii=False)


def test_line_index_survives_bad_lines(spark, tmp_path):
    write(tmp_path / "x1" / "posts.jsonl", "\n".join([post("u1", "a"), "", "{bad", post("u1", "b", "line sep")]) + "\n")
    write(tmp_path / "x2" / "posts.jsonl", post("u1", "c"))
    lines = readers.read_lines(spark, str(tmp_path))
    got = {(r["directory"], r["post_index"]): r["post_id"] for r in readers.indexed_posts(lines).collect()}
    assert got == {("x1", 0): "a", ("x1", 3): "b", ("x2", 0): "c"}
    users = {r["user_id"]: r["path"].split("/")[-2] for r in readers.discovered_users(files.first_lines(spark, str(tmp_path))).collect()}
    assert users == {"u1": "x1", "x1": "x1", "x2": "x2"}


def test_strict_reader_and_limit(spark, tmp_path):
    write(tmp_path / "posts.jsonl", "\n".join(post("u", str(i)) for i in range(5)))
    assert readers.read_posts(spark, str(tmp_path)).count() == 5
    assert [r["post_id"] for r in readers.read_posts(spark, str(tmp_path), 2).orderBy("post_id").collect()] == ["0", "1"]
    write(tmp_path / "bad.jsonl", "{broken")
    with pytest.raises(Exception):
        readers.read_posts(spark, str(tmp_path)).collect()


def test_user_names_from_metadata(spark, tmp_path):
    write(tmp_path / "d1" / "posts.jsonl", post("q", "1"))
    write(tmp_path / "d1" / "metadata.json", '{"username": "bob"}')
    write(tmp_path / "d2" / "posts.jsonl", post("q", "2"))
    assert {r["post_id"]: r["user_id"] for r in readers.read_timelines(spark, str(tmp_path)).collect()} == {"1": "x_bob", "2": "d2"}


def test_gold_tasks_and_problems(spark, tmp_path):
    gold = {"user_id": "u", "domains": [{"domain": "pets", "status": "active", "long_term_interests": [{"label": "dogs"}]}, {"domain": "pets", "status": "inactive"}]}
    write(tmp_path / "set1" / "u.json", json.dumps(gold, indent=1))
    tasks = readers.gold_tasks(readers.read_gold(spark, str(tmp_path)))
    assert [r["task_id"] for r in tasks.collect()] == ["set1__u__pets"] * 2
    users = spark.createDataFrame([("other",)], "user_id string")
    assert {(r["key"], r["problem"]) for r in readers.task_problems(tasks, users).collect()} == {("set1__u__pets", "duplicate_task"), ("u", "no_timeline")}


def test_captions_with_dynamic_keys(spark, tmp_path):
    doc = {"user_id": "u", "captions": {"img_b": {"model_captions": {"m1": {"summary": "x"}, "m2": {"summary": "y"}}}, "img_a": {"model_captions": {}}}}
    write(tmp_path / "c.json", json.dumps(doc, indent=1))
    got = {(r["image_id"], r["model"], r["summary"]) for r in readers.read_captions(spark, str(tmp_path)).collect()}
    assert got == {("img_b", "m1", "x"), ("img_b", "m2", "y")}


def test_profile_rows_need_an_id(spark):
    good = spark.createDataFrame([('{"_post_id": "p", "is_noise": true}',), ('{"post_id": "q", "profile": {"is_noise": false}}',)], "value string")
    assert {r["post_id"]: r["profile"]["is_noise"] for r in readers.profile_rows(good).collect()} == {"p": True, "q": False}
    with pytest.raises(Exception):
        readers.profile_rows(spark.createDataFrame([('{"is_noise": true}',)], "value string")).collect()


def test_checksums_and_guarded_sinks(spark, tmp_path):
    write(tmp_path / "a" / "x.txt", "hi")
    write(tmp_path / "manifest.json", "{}")
    got = [(r["path"], r["sha256"]) for r in files.checksums(spark, str(tmp_path)).collect()]
    assert got == [("a/x.txt", hashlib.sha256(b"hi").hexdigest())]
    rows, clean = spark.range(2), spark.createDataFrame([], "issue string")
    with pytest.raises(ValueError):
        readers.copy_verified(clean, rows, str(tmp_path), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        readers.copy_verified(spark.createDataFrame([("x",)], "issue string"), rows, str(tmp_path / "a"), str(tmp_path / "b"))
    readers.copy_verified(clean, rows, str(tmp_path / "a"), str(tmp_path / "b"))
    with pytest.raises(Exception):
        readers.write_jsonl(rows, str(tmp_path / "b"))


def test_cue_config_is_checked(spark, tmp_path):
    entry = lambda name, words=(), tags=(): {"name": name, "seed_keywords": list(words), "seed_hashtags": list(tags)}
    write(tmp_path / "c.json", json.dumps({"domains": [entry(" pets", [" Dog ", "dog", ""], ["#Cats", "#", "##"]), entry("gaming")]}))
    assert config.read_cues(spark, str(tmp_path / "c.json")) == {"pets": (["dog"], ["cats"]), "gaming": ([], [])}
    for name, domains in (("d", [entry("nope")]), ("e", [entry("pets"), entry("pets ")]), ("f", [])):
        write(tmp_path / f"{name}.json", json.dumps({"domains": domains}))
        with pytest.raises(ValueError):
            config.read_cues(spark, str(tmp_path / f"{name}.json"))


def test_aliases_and_fixed_user_lists(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"pets": {"doggo": "dog", "pup": "dog"}, "gaming": {}}))
    assert config.read_aliases(spark, str(tmp_path / "a.json")) == {"pets": {"doggo": "dog", "pup": "dog"}}
    assert config.read_aliases(spark, None) == {}
    listed = spark.createDataFrame([(0, "u1"), (1, " "), (2, "u2 "), (3, "u3"), (4, "u1")], "position long, name string")
    files = spark.createDataFrame([("u1",), ("u3",)], "name string")
    assert [tuple(r) for r in config.fixed_users(listed, 2).orderBy("position").collect()] == [(0, "u1"), (1, "u2")]
    assert {tuple(r) for r in config.user_list_problems(listed, files, 2).collect()} == {("Repeated user", "u1"), ("User without a file", "u2")}
    assert {tuple(r) for r in config.user_list_problems(listed.limit(1), files, 5).collect()} == {("List too short", None)}
    with pytest.raises(ValueError):
        config.fixed_users(listed, -1)


def test_stream_equals_batch(spark, tmp_path):
    write(tmp_path / "in" / "1.json", "\n".join([post("u", "a", "mail x@y.org about running"), post("u", "b", "hi")]))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), CUES)
    incremental.run_gate(*args).awaitTermination()
    write(tmp_path / "in" / "2.json", post("u", "c", "one two three"))
    incremental.run_gate(*args).awaitTermination()
    got = {r["post_id"]: (r["is_noise"], r["masked_text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = incremental.gated_and_masked(readers.read_posts(spark, str(tmp_path / "in")), CUES).collect()
    assert got == {r["post_id"]: (r["is_noise"], r["masked_text"]) for r in batch} and len(got) == 3


def small_splits(spark, size):
    """Splits of about ``size`` bytes, as a large file has on a cluster."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")


@pytest.fixture
def splits(spark):
    yield lambda size: small_splits(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_files_beyond_one_split_are_numbered(spark, tmp_path, splits):
    rng = random.Random(1)
    texts = {f"f{k}": [rng.choice(["", "  ", "é" * rng.randint(1, 60), f"line {k}"]) for _ in range(n)] for k, n in enumerate([1, 7, 300, 900])}
    for name, lines in texts.items():
        write(tmp_path / name / "a.txt", "\n".join(lines) + "\n")
    splits(700)
    rows = files.numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 10
    got = {(r["path"].split("/")[-2], r["line_index"]): r["value"] for r in rows.collect()}
    assert got == {(name, k): line for name, lines in texts.items() for k, line in enumerate(lines)}
    first = {r["path"].split("/")[-2]: r["value"] for r in files.first_lines(spark, str(tmp_path)).collect()}
    assert first == {name: next(x for x in lines if x.strip()) for name, lines in texts.items() if any(x.strip() for x in lines)}
    write(tmp_path / "g" / "posts.jsonl", "\n".join([post("u", "a"), "", *(post("u", str(k)) for k in range(60))]))
    got = readers.read_posts(spark, str(tmp_path / "g"), 40).select("post_id").collect()
    assert {r[0] for r in got} == {"a", *map(str, range(39))}


def test_checksums_of_any_bytes_and_a_compared_manifest(spark, tmp_path, splits):
    rng = random.Random(2)
    contents = {
        "a.bin": bytes(rng.randrange(256) for _ in range(5000)).replace(b"\r", b"x"), "empty": b"", "n.txt": b"\n", "nn.txt": b"\n\n", "bom.txt": b"\xef\xbb\xbfx\ny", "bom2.txt": b"\xef\xbb\xbfx\n",
        "sub dir/ü+1.txt": "ü\r\nz".encode() * 900, "last": b"x" * 3000 + b"\n" + b"y" * 10, "cr.txt": b"a\rb\r\nc\r",
    }
    for name, content in contents.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(content)
    splits(600)
    found = files.checksums(spark, str(tmp_path / "r"))
    got = {r["path"]: (r["sha256"], r["bytes"]) for r in found.collect()}
    assert got == {name: (hashlib.sha256(c).hexdigest(), len(c)) for name, c in contents.items()}
    files.write_manifest(spark, str(tmp_path / "r"), str(tmp_path / "m"), "v1")
    listed = files.read_manifest(spark, str(tmp_path / "m"))
    assert files.manifest_problems(found, listed, "v1").isEmpty()
    with pytest.raises(Exception):
        files.write_manifest(spark, str(tmp_path / "r"), str(tmp_path / "m"), "v1")
    assert {r["issue"] for r in files.manifest_problems(found, listed.union(listed), "v2").collect()} == {"Doubled manifest entry", "Invalid manifest"}
    (tmp_path / "r" / "n.txt").write_bytes(b"other")
    (tmp_path / "r" / "empty").rename(tmp_path / "r" / "moved")
    issues = files.manifest_problems(files.checksums(spark, str(tmp_path / "r")), listed, "v1")
    assert {tuple(r) for r in issues.collect()} == {("Checksum mismatch", "n.txt"), ("Manifest file set mismatch", "empty"), ("Manifest file set mismatch", "moved")}


def test_only_pending_requests_run(spark, tmp_path):
    write(tmp_path / "done" / "r.json", '{"request_key": "a"}')
    write(tmp_path / "req" / "1.json", '{"request_key": "a"}\n{"request_key": "b"}\n{"request_key": "b"}')
    stream = spark.readStream.schema("request_key string").json(str(tmp_path / "req"))
    incremental.run_pending(spark, stream, str(tmp_path / "done"), str(tmp_path / "todo"), str(tmp_path / "cp")).awaitTermination()
    assert [r["request_key"] for r in spark.read.json(str(tmp_path / "todo")).collect()] == ["b"]


def test_a_key_is_issued_once_across_batches_and_restarts(spark, tmp_path):
    write(tmp_path / "done" / "r.json", '{"request_key": "a"}')

    def run(name, rows, **options):
        write(tmp_path / "req" / f"{name}.json", "\n".join(json.dumps({"request_key": k, "at": f"2024-01-{d:02d}T00:00:00Z"}) for k, d in rows))
        stream = spark.readStream.schema("request_key string, at timestamp").json(str(tmp_path / "req"))
        incremental.run_pending(spark, stream, str(tmp_path / "done"), str(tmp_path / "todo"), str(tmp_path / "cp"), **options).awaitTermination()
        todo = spark.read.schema("request_key string, epoch int").json(str(tmp_path / "todo"))
        return sorted(r["request_key"] for r in todo.collect())

    options = {"arrived": "at", "retention": "3 days"}
    assert run("1", [("a", 1), ("b", 1), ("b", 2)], **options) == ["b"]
    assert run("2", [("b", 2), ("c", 2)], **options) == ["b", "c"]
    assert run("3", [("c", 3), ("d", 20)], **options) == ["b", "c", "d"]
    assert run("4", [("c", 21), ("d", 21)], **options) == ["b", "c", "c", "d"]  # c is forgotten after three days, d is not


def test_without_arrivals_keys_are_kept_for_good(spark, tmp_path):
    (tmp_path / "done").mkdir()
    for name, keys in (("1", "ab"), ("2", "bc")):
        write(tmp_path / "req" / f"{name}.json", "\n".join(json.dumps({"request_key": k}) for k in keys))
        stream = spark.readStream.schema("request_key string").json(str(tmp_path / "req"))
        incremental.run_pending(spark, stream, str(tmp_path / "done"), str(tmp_path / "todo"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["request_key"] for r in spark.read.schema("request_key string, epoch int").json(str(tmp_path / "todo")).collect()) == ["a", "b", "c"]
