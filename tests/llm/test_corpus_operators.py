"""The corpus operators against brute force, libraries and SQL, with nulls, empty tables, ties and odd columns."""
import collections
import functools
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tastemap.llm import bpe, calls, components, decontaminate, grace, jaccard, lines, quality, substrings, suffix_arrays, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k string, row_key string, pos long, words string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", "r", 1, "w") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_url_filter", "op7_jaccard_join", "op8_exact_dedup", "op9_call_linking", "op10_line_dedup"])
def test_query_equals_sql(spark, con, name):
    message, n = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert message == "" and n > 0


def some_texts(seed, n=90):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("xyz ü") for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 4))]
        out.append("".join(parts))
    return [*out, "a" * 300, "ab" * 100, "\0" * 90, None, "", out[5], out[5]]


def brute_repeats(texts, window):
    texts = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                hit[i : i + window] = True
        yield len(t), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~hit])


@pytest.mark.parametrize("window, limits", [(80, {}), (80, {"group_contexts": 3, "shard_bytes": 500}), (52, {"group_contexts": 200, "shard_bytes": 400})])
def test_repeated_substrings_equal_brute_force(spark, window, limits):
    texts = some_texts(window)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.content)) for r in substrings.without_repeats(frame(spark, texts), window=window, **limits).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats(texts, window))


@pytest.fixture
def pieces(spark):
    """Joins by shuffles first, which adaptive execution splits or turns into broadcasts that read pieces of partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_substrings_of_groups_beside_large_ones_stay_in_one_shard(spark, pieces):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [word(120) for _ in range(40)]
    # Passages of two documents, and one passage of many, whose groups are large.
    texts = [word(60) + x + word(60) for x in shared * 2] + [word(50) + shared[0] + word(50) for _ in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.content)) for r in substrings.without_repeats(frame(spark, texts), window=80, group_contexts=10).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats(texts, 80))


def test_exact_groups_beside_full_buckets_stay_whole(spark, pieces):
    texts = [f"{i % 300} " + "x" * (i % 300) for i in range(900)]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in grace.exact_groups(frame(spark, texts), table_bytes=300).collect()}
    assert found == {i: (i % 300 + 600, 3) for i in range(900)}


def test_repeated_substrings_without_rows_and_with_repeated_rows(spark):
    assert substrings.without_repeats(frame(spark, [])).collect() == []
    rows = substrings.without_repeats(frame(spark, ["q" * 50 + "r" * 50] * 2, ids=[7, 7]), window=90).collect()
    assert [(r.n_removed, r.n_spans) for r in rows] == [(100, 1)] * 2


@pytest.mark.parametrize("bits", [7, 8, 10])
def test_anchors_of_texts_longer_than_a_position_holds(monkeypatch, bits):
    rng = random.Random(bits)
    texts = [(t or "").encode() for t in some_texts(bits)] + [bytes(rng.choices(b"abcd", k=3000))] * 2
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = suffix_arrays.window_anchors(data, ends, 80, 32)
    monkeypatch.setattr(suffix_arrays, "POSITION_BITS", bits)
    parts = suffix_arrays.window_anchors(data, ends, 80, 32)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(whole[0]) > 100
    # Each window lies in one run, whose anchor is inside it.
    first, last, anchor, _ = parts
    starts = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last)])
    assert starts.tolist() == [s + i for s, t in zip(np.r_[0, ends[:-1]].tolist(), texts) for i in range(len(t) - 79)]
    assert (anchor >= last).all() and (anchor + 32 <= first + 80).all()
    with pytest.raises(ValueError):
        suffix_arrays.window_anchors(data, ends, 2**bits + 1, 32)


def test_repeats_beyond_eight_mebibytes_of_a_text(spark):
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    one, two = letters(700), letters(600)
    texts = [letters((1 << 23) + 5000) + one + "-" + two + letters(100), "<" + one + ">", letters(50) + two]
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.without_repeats(frame(spark, texts)).select("doc_id", "n_removed", "n_spans").collect()}
    assert rows == {0: (1300, 2), 1: (700, 1), 2: (600, 1)}


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 60, 300):
        data = rng.integers(97, 99, n).astype(np.uint8)
        data[n // 3 : n // 2] = 97
        text = bytes(data)
        order = suffix_arrays.suffix_order(data, 1000)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        for limit in (5, 1000):
            got = suffix_arrays.common_prefixes(data, order, limit)
            for k in range(1, n):
                a, b = text[order[k - 1] :], text[order[k] :]
                size = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert got[k] == min(size, limit)


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = ["", None, "don't we'll 123", "a" * 3000, " \n\n x\x1c\x1d y ", "日本語😀" * 80, "<|endoftext|>"]
    texts += ["".join(rng.choice("abcdefgh \n'tséÉ漢字😀٣\x85") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    docs = frame(spark, texts)
    want = [reference.encode_ordinary(t or "") for t in texts]
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, block_bytes=2000)
    assert {r.doc_id: r.ids for r in encoded.collect()} == dict(enumerate(want))
    assert {r.doc_id: bytes(r.content) for r in bpe.decoded(encoded, path).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in bpe.token_digests(docs, path, public_tokenizers.PATTERN).collect():
        ids = np.array(want[r.doc_id], "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), sha(ids), sha((texts[r.doc_id] or "").encode()))
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("name, module, least", [("op1_quality_gam", quality, 0.97), ("op5_toxicity_ftrl", toxicity, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, module, least):
    label = {"op1_quality_gam": "quality", "op5_toxicity_ftrl": "toxic"}[name]
    big = "/root/testdata/sf0.1"
    rows = entry.queries()[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").select("score", label, "predicted").toPandas()
    good, bad = held[held[label] == 1], held[held[label] == 0]
    auc = np.mean([(s > bad.score).mean() + 0.5 * (s == bad.score).mean() for s in good.score])
    assert auc > least and held.score.between(0, 1).all()
    if label == "toxic":
        assert bad.predicted.mean() < 0.005
    else:
        assert good.predicted.mean() > 0.98


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_with_odd_inputs(spark, module):
    texts = ["you idiot " * 3, "fine words here"] * 30 + [None, "", "x" * 100_000]
    labels = spark.createDataFrame([(i, 1 - i % 2, 1 - i % 2) for i in range(60)] + [(0, 0, 0), (None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, "you idiot"], ids=[*range(63), None])
    label = "quality" if module is quality else "toxic"
    rows = module.predictions(docs, labels, label).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[0] > score[1] and score[60] == score[61]
    assert module.predictions(docs, labels.limit(0), label).count() == 64
    assert module.predictions(frame(spark, []), labels, label).collect() == []


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["ab", "Cd", "é1", "x", "yy"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(12)] + [None, "...", "ab"]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "?!", "ab " * 3000]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, n long")
    docs = frame(spark, texts)
    found = decontaminate.hits(docs, benchmark, n=4)
    rows = {r.doc_id: r for r in found.collect()}
    windows = {}
    for i, t in enumerate(items):
        w = words_of(t)
        n = min(4, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(i)
    for d, t in enumerate(texts):
        w, hit, ids = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    ids |= windows[tuple(w[at : at + n])]
        assert (rows[d].n_words, rows[d].n_hit, rows[d].items) == (len(w), len(hit), sorted(map(str, ids)))
    left = {r.doc_id: r.text for r in decontaminate.without_spans(docs, found).collect()}
    for d, t in enumerate(texts):
        assert (left[d] == t) if not rows[d].n_hit else len(words_of(left[d])) == rows[d].n_words - rows[d].n_hit
    empty = decontaminate.digests(decontaminate.hits(docs, benchmark.limit(0))).collect()
    assert len(empty) == len(texts) and not any(r.contaminated for r in empty)
    assert decontaminate.hits(frame(spark, []), benchmark).collect() == []


def test_url_verdicts_reach_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    pages = [
        (1, "http://a.example.org/es/1", ""), (2, "https://m.test/x", link % "http://a.example.org/es/1"), (3, "http://n.test/y", '<meta http-equiv=refresh content="0; url=https://m.test/x">'),
        (4, "http://b.org/", link % "http://n.test/y"), (5, "http://c.com/fr/", ""), (6, "http://d.com/de/1", ""), (7, "https://D.com/de/1#top", ""), (8, None, None), (9, "nothing", None),
        (10, "http://e.test/p", link % "/q"), (11, "http://e.test/q", link % "http://d.com/de/1"), (None, "http://x.test", ""), (5, "http://c.com/fr/", ""), (12, "http://z.test?u=http://d.com/de/1", ""),
    ]
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")], "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"alias": F.lit("x"), "verdict": F.lit(1)})
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got[1] == ("example.org/es/", "block") and got[4] == ("org/", "allow") and got[5] == ("com/fr/", "allow")
    # 2 and 3 are joined with a block and with an explicit allow, which comes first.
    assert got[2] == (None, "allow") and got[3] == (None, "allow")
    assert got[10] == (None, "block") and got[11] == (None, "block") and got[7] == ("com/de/", "block")
    assert got[8] == got[9] == got[None] == got[12] == (None, "allow")
    assert urls.judge(df, rules).count() == len(pages)
    edges = spark.createDataFrame([("http://x.test", "http://d.com/de/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in urls.judge(df, rules, html=None, edges=edges).collect()}[None] == "block"
    assert urls.judge(df.limit(0), rules).collect() == []


def test_relative_and_encoded_url_aliases(spark):
    page, link = "http://H.test/a/b/c.html?q=1#f", '<link rel="canonical" href="%s">'
    want = {
        "page.html": "h.test/a/b/page.html", "../a": "h.test/a/a", "?p=2": "h.test/a/b/c.html?p=2", "./x/../y?u=http://z.test": "h.test/a/b/y?u=http://z.test", "..": "h.test/a",
        "../../../top": "h.test/top", "/r/../s?a=1&amp;b=2": "h.test/s?a=1&b=2", "//o.test/x": "o.test/x", "https://o.test/y?a=1&#38;b=2": "o.test/y?a=1&b=2", "#f": None, "mailto:a@b.test": None,
    }
    html = {t: link % t for t in want} | {"refresh": '<meta http-equiv="refresh" content="0; url=d.html?a=1&amp;b=2; x">'}
    df = spark.createDataFrame([(t, page, h) for t, h in html.items()], "t string, url string, html string")
    df = df.select("t", F.transform(urls.alias_targets(F.col("html"), F.col("url")), urls.node_of).alias("nodes"))
    got = {r.t: r.nodes for r in df.collect()}
    assert got == {t: [n] if n else [] for t, n in want.items()} | {"refresh": ["h.test/a/b/d.html?a=1&b=2"]}
    bare = spark.createDataFrame([("http://h.test", link % "x")], "url string, html string")
    assert bare.select(F.transform(urls.alias_targets(F.col("html"), F.col("url")), urls.node_of)).first()[0] == ["h.test/x"]
    pages = spark.createDataFrame([(1, "http://e.test/d/p", link % "../q?a=1&amp;b=2"), (2, "http://e.test/q?a=1&b=2", link % "http://d.com/de/1"), (3, "http://d.com/de/1", "")], "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/de/", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "block"}


def brute_components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 340)] + [(3, 3)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    label = brute_components(340, edges)
    touched = {v for a, b in edges if a != b for v in (a, b)}
    assert {r.v: r.root for r in components.connected_components(df).collect()} == {v: label[v] for v in touched}
    assert components.connected_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"rows": 4}, {"rows": 6, "weight": 3000}])
def test_jaccard_components_equal_brute_force(spark, limits):
    rng = random.Random(6)
    texts = []
    for _ in range(6):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.randint(30, 90))]
        for _ in range(22):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice("QRSTUV") + str(rng.randrange(3))
            texts.append(rng.choice([" ", "\n"]).join(words))
    texts += ["one", "ONE", "one two", "one  two", "", None, " \t\n", "aa bb cc", texts[0], " "]
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    sets = [shingles(t) for t in texts]
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    label = brute_components(len(texts), edges)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, texts), **limits).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def test_jaccard_regions_in_memory():
    rng = np.random.default_rng(7)
    base = [np.arange(k * 1000, k * 1000 + 100) for k in range(5)]
    sets = []
    for _ in range(400):
        s = base[rng.integers(5)].copy()
        s[rng.integers(0, 100, rng.integers(0, 6))] = rng.integers(10**6, 10**6 + 40)
        sets.append(np.unique(s))
    region = jaccard.Region(sets, 90)
    region.join(np.arange(len(sets)))
    lists = [set(s.tolist()) for s in sets]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(lists[a] & lists[b]) >= 90 * len(lists[a] | lists[b])]
    assert brute_components(len(sets), region.links) == brute_components(len(sets), edges)
    assert all(100 * len(lists[a] & lists[b]) >= 90 * len(lists[a] | lists[b]) for a, b in region.links)


def test_jaccard_with_null_and_repeated_ids(spark):
    rows = jaccard.near_duplicates(frame(spark, ["a b c d", "a b c d", "a b c d", "x y z"], ids=[None, 4, 4, 4])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows if r.doc_id) == [(4, 1, 4), (4, 2, 4), (4, 2, 4)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("table_bytes", [1 << 20, 400])
def test_exact_groups_equal_brute_force(spark, table_bytes):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aAbÉé") for _ in range(rng.randint(0, 4))) for _ in range(300)] + [None, "", "long" * 5000, "LONG" * 5000]
    ids = [*range(len(texts) - 2), 5, 5]
    docs = frame(spark, [*texts, None, None], ids=[*ids, None, None])
    groups = collections.defaultdict(list)
    fold = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    for i, t in [*zip(ids, texts), (None, None), (None, None)]:
        groups[fold(t)].append(i)
    rows = grace.exact_groups(docs, table_bytes=table_bytes).collect()
    assert len(rows) == len(texts) + 2
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for t, members in groups.items():
        mine = [r for r in rows if sha[r.text_sha256] == t]
        assert sum(r.kept for r in mine) == 1 and {r.group_size for r in mine} == {len(members)}
        assert {r.keep_id for r in mine} == {max(m for m in members if m is not None)}
        assert all(r.doc_id == r.keep_id for r in mine if r.kept)
    assert grace.exact_groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_bitmaps_equal_brute_force(spark, keep_first):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["Foo", " foo\t", "bar", "", "É", "é", f"own {rng.random()}"]) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += [None, "", "\n", "foo\n" * 500]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    seen = collections.Counter(k for ls in split for k in {key(x) for x in ls})
    docs = frame(spark, texts)
    bitmaps = lines.drop_bitmaps(docs, min_docs=4, keep_first=keep_first)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.without_lines(docs, bitmaps).collect()}
    if not keep_first:
        for i, ls in enumerate(split):
            kept = [x for x in ls if not key(x) or seen[key(x)] < 4]
            assert got[i] == (len(ls), len(ls) - len(kept), "\n".join(kept))
    else:
        left = collections.Counter(key(x) for _, _, t in got.values() for x in t.split("\n"))
        assert all(left[k] == 1 for k, n in seen.items() if k and n >= 4)
    assert lines.without_lines(frame(spark, []), bitmaps).collect() == []


def test_linked_calls(spark):
    asked = [
        ("c", "1", "f", '{"b":[1.50, 2],"a":"x"}', 0, 0), ("c", "2", "f", '{"a":3}', 1, 0), ("c", "2", "g", "{}", 2, 0), ("c", "3", "g", "no json", 3, 0),
        ("c", "4", None, None, 4, 0), ("c", "5", "h", '{"n":1,"zz":null}', 5, 0), ("d", "1", "h", '{"n":"1"}', 0, 0), (None, "9", "f", "{}", 0, 0), ("c", None, "f", "{}", 0, 0),
    ]
    told = [("c", "1", 'say "hi"', 1), ("c", "1", "later", 2), ("c", "7", "lost", 3), (None, "1", "x", 1)]
    c = spark.createDataFrame(asked, "conv_id string, call_id string, name string, arguments string, turn long, place int")
    r = spark.createDataFrame(told, "conv_id string, call_id string, content string, turn long")
    tools = spark.createDataFrame([("f", "a", "string", True), ("f", "b", "array", False), ("g", "q", "string", True), ("h", "n", "integer", True)], "name string, field string, type string, required boolean")
    needs = spark.createDataFrame([("c", "2", "1"), ("c", "3", "2"), ("c", "4", "5"), ("c", "5", "4"), ("c", "1", "77")], "conv_id string, call_id string, needed string")
    got = {(x.conv_id, x.call_id): x for x in calls.link_calls(c, r, tools, needs).collect()}
    assert got["c", "1"].json == '{"arguments":{"a":"x","b":[1.5,2]},"call_id":"1","name":"f","result":"say \\"hi\\""}'
    assert (got["c", "1"].valid, got["c", "1"].n_results, got["c", "1"].step) == (True, 2, 0)
    assert (got["c", "2"].errors, got["c", "2"].n_calls, got["c", "2"].step) == (["type:a"], 2, 1)
    assert (got["c", "3"].errors, got["c", "3"].step) == (["no object"], 2)
    assert got["c", "4"].step is None and got["c", "5"].step is None and got["c", "5"].errors == ["unknown:zz"]
    assert got["d", "1"].errors == ["type:n"] and got["c", "7"].errors == ["no call"] and got["c", "7"].n_calls == 0
    assert len(got) == 7
    assert calls.link_calls(c.limit(0), r.limit(0), tools.limit(0), needs.limit(0)).collect() == []
    messages = spark.createDataFrame([
        ("c", 0, "assistant", '{"tool_calls":[{"id":"x","function":{"name":"f","arguments":"{\\"a\\":1}"}}]}'), ("c", 1, "tool", '{"tool_call_id":"x","content":"ok"}'),
        ("c", 2, "assistant", "{broken"), ("c", 3, "user", None), ("c", 4, "tool", None),
    ], "conv_id string, turn long, role string, text string")
    found, results = calls.message_calls(messages)
    assert [(x.call_id, x.name, x.arguments) for x in found.collect()] == [("x", "f", '{"a":1}')]
    assert [(x.call_id, x.content) for x in results.filter("call_id is not null").collect()] == [("x", "ok")]


def test_steps_of_long_chains_trees_and_cycles(spark):
    """Longest paths of random graphs, of a chain of 300 calls and behind cycles, against a plain recursion."""
    rng = random.Random(5)
    needs = {("chain", str(k)): {str(k - 1)} for k in range(1, 300)}
    for g in range(6):
        for k in range(1, 40):
            needs["dag%d" % g, str(k)] = {str(rng.randrange(max(0, k - 6), k)) for _ in range(rng.choice([0, 1, 1, 2, 3]))}
    needs |= {("loop", "a"): {"b"}, ("loop", "b"): {"c"}, ("loop", "c"): {"a"}, ("loop", "d"): {"c", "e"}, ("loop", "f"): {"e"}, ("loop", "g"): {"g"}, ("loop", "h"): {"gone", "f"}}
    known = set(needs) | {("chain", "0"), ("loop", "e")} | {("dag%d" % g, "0") for g in range(6)}

    @functools.cache
    def step(conv, call):
        found = [step(conv, n) for n in needs.get((conv, call), ()) if (conv, n) in known]
        return max(found, default=-1) + 1

    want = {}
    for k in range(300):  # fills the cache from below
        step("chain", str(k))
    for conv, call in known:
        want[conv, call] = None if conv == "loop" and call in "abcdg" else step(conv, call)
    df = spark.createDataFrame(sorted(known), "conv_id string, call_id string")
    links = spark.createDataFrame([(c, k, n) for (c, k), ns in needs.items() for n in ns] * 2, "conv_id string, call_id string, needed string")
    got = calls.topological_steps(df, links).collect()
    assert len(got) == len(known) and {(r.conv_id, r.call_id): r.step for r in got} == want


@pytest.mark.parametrize("n", [3, 200, 995, 1_005, 40_000])
def test_outlines_never_part_sets_that_link(n):
    """Also where counters are full, and where only one of the two sets has a long outline."""
    rng = np.random.default_rng(n)
    for _ in range(20):
        one = np.unique(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
        crowded = one & ~np.int64(511 << 20) if n > 1_000 else one  # all in one counter
        for base in (one, np.unique(crowded)):
            apart = len(base) // 20
            other = np.union1d(base[apart:], rng.integers(-(1 << 63), 1 << 63, apart // 2, dtype=np.int64))
            shared = len(np.intersect1d(base, other))
            assert 100 * shared >= 90 * (len(base) + len(other) - shared)
            pair = sorted((base, other), key=len)
            shapes = [np.frombuffer(jaccard.outline(s), np.uint8).astype(np.int64) for s in pair]
            assert jaccard._with_possible_partner(np.array([len(s) for s in pair]), shapes, 90).all()


def test_lines_of_one_very_long_document_cost_in_proportion(spark):
    many = [f"line {k}" for k in range(100_000)]
    texts = ["\n".join(many[:50_000] + [f"own {d} {k}" for k in range(50_000)]) for d in range(2)] + ["\n".join(many[k:k + 1] * 2) for k in range(8)]
    docs = frame(spark, texts)
    began = time.time()
    bitmaps = lines.drop_bitmaps(docs, min_docs=2)
    found = sorted(map(tuple, lines.without_lines(docs, bitmaps).collect()))
    assert time.time() - began < 60
    assert [r[1:3] for r in found] == [(100_000, 50_000)] * 2 + [(2, 2)] * 8
    assert found[1][3] == "\n".join(f"own 1 {k}" for k in range(50_000)) and found[2][3] == ""


def test_shingle_sets_hold_no_words_and_equal_sets_of_words():
    rng = random.Random(5)
    texts = ["", " \t\n", "One two", *(" ".join(rng.choice("aB cD é x1 x2 x3".split()) for _ in range(rng.randint(1, 60))) for _ in range(50))]
    words = [t.encode().lower().split() for t in texts]
    plain = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in words]
    found = jaccard.shingle_sets([t.encode() for t in texts], 3)
    assert [len(s) for s in found] == [len(s) for s in plain]
    for a, b in zip(range(0, 50), range(3, 53)):
        assert len(set(found[a].tolist()) & set(found[b].tolist())) == len(plain[a] & plain[b])
    assert all((s[1:] > s[:-1]).all() for s in found)
