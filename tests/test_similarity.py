"""Clustering against brute force on small fixtures."""
import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tastemap.functions.fuzzy import indel_ratio
from tastemap.operators import dedup, evaluation, tags


def leaders_by_hand(posts):
    """posts: (id, time, index, tokens) of one user."""
    reps, out = [], {}
    for pid, _, _, tokens in sorted(posts, key=lambda p: (p[1], p[2])):
        bag = Counter(tokens)
        for rid, rtok, rbag in reps:
            sa, sb = set(tokens), set(rtok)
            jac = len(sa & sb) / len(sa | sb) if sa and sb else 0.0
            norm = math.sqrt(sum(v * v for v in bag.values()) * sum(v * v for v in rbag.values()))
            cos = sum(bag[k] * rbag[k] for k in bag) / norm if norm else 0.0
            if jac >= 0.82 or cos >= 0.90:
                out[pid] = rid
                break
        else:
            reps.append((pid, tokens, bag))
            out[pid] = pid
    return out


def test_leader_clustering_in_several_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows, expected = [], {}
    for user in ("a", "b"):
        texts = []
        for i in range(40):
            if texts and rng.random() < 0.6:
                t = list(rng.choice(texts))
                for _ in range(rng.randint(0, 2)):
                    t[rng.randrange(len(t))] = rng.choice(words)
            else:
                t = [rng.choice(words) for _ in range(rng.randint(6, 14))]
            texts.append(t)
        posts = [(f"{user}{i}", datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 25)), i, t) for i, t in enumerate(texts)]
        posts += [(f"{user}{i}", datetime(2024, 1, 3), i, []) for i in (90, 91)]
        expected |= leaders_by_hand(posts)
        rows += [(user, p, t, i, " ".join(x)) for p, t, i, x in posts]
    df = spark.createDataFrame(rows, "user_id string, post_id string, created_at timestamp, post_index long, text string")
    for block in (8, 256):
        got = dedup.near_duplicate_clusters(df, first_block=block).collect()
        assert {r["post_id"]: r["leader_post_id"] for r in got} == expected
    sizes = Counter(expected.values())
    assert all(abs(r["dup_weight"] - 1 / sizes[r["leader_post_id"]]) < 1e-12 for r in got)


def test_leaders_of_blocks_meet_later_posts_by_tiles(spark, monkeypatch):
    """Several blocks and tiles a user; a bag travels once a tile, however many posts it may resemble."""
    monkeypatch.setattr(dedup, "TILE", 32)
    rng = random.Random(0)
    words = [f"w{i}" for i in range(60)]
    rows, expected = [], {}
    for user, n in (("a", 150), ("b", 40), ("c", 1)):
        texts = []
        for i in range(n):
            t = list(rng.choice(texts)) if texts and rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(4, 25))]
            t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(t + ["the"] * rng.randint(0, 12))
        posts = [(f"{user}{i}", datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 25)), i, t) for i, t in enumerate(texts)]
        expected |= leaders_by_hand(posts)
        rows += [(user, p, t, i, " ".join(x)) for p, t, i, x in posts]
    df = spark.createDataFrame(rows, "user_id string, post_id string, created_at timestamp, post_index long, text string")
    largest, cut = [], dedup.cut_lineage

    def counted(df):
        out = cut(df)
        largest.append(out.count())
        return out

    monkeypatch.setattr(dedup, "cut_lineage", counted)
    got = dedup.near_duplicate_clusters(df, first_block=16).collect()
    assert {r["post_id"]: r["leader_post_id"] for r in got} == expected
    assert max(largest) <= len(rows)


def char_grams(word):
    w, out = f" {word} ", []
    for n in (3, 4, 5):
        out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
        if len(w) <= n:
            break
    return Counter(out)


def vectors_by_hand(names):
    grams = {t: char_grams(t) for t in names}
    df = Counter(g for c in grams.values() for g in c)
    out = {}
    for t, c in grams.items():
        v = {g: n * (math.log((1 + len(names)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out[t] = {g: x / norm for g, x in v.items()}
    return out


def linkage_by_hand(names, limit):
    vec = vectors_by_hand(names)
    sim = {(a, b): sum(x * vec[b].get(g, 0.0) for g, x in vec[a].items()) for a in names for b in names}
    groups = [[t] for t in names]
    while len(groups) > 1:
        pairs = [(sum(sim[x, y] for x in a for y in b) / (len(a) * len(b)), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)]
        best = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        if not best[0] > limit:
            break
        groups[best[1]] += groups[best[2]]
        del groups[best[2]]
    return {frozenset(g) for g in groups if len(g) > 1}


NAMES = [
    "street_photo", "street_photography", "streetphoto", "photo", "photos", "board_game", "board_games", "boardgame", "card_game", "video_game", "video_gam",
    "hiking", "hike", "hik", "dog", "dogs", "dog_walk", "dog_walking", "coffee", "coffe", "craft_beer", "craft_beers", "ab", "a", "travelling_abroad", "traveling_abroad",
]


def tag_frame(spark):
    return spark.createDataFrame([("u", "d", t) for t in NAMES], "user_id string, domain string, tag string")


def test_fuzzy_pairs_find_everything(spark):
    for threshold in (90.0, 80.0):
        got = {(r["a"], r["b"]) for r in tags.fuzzy_pairs(tag_frame(spark), threshold).collect()}
        want = {(a, b) for a, b in itertools.combinations(sorted(NAMES), 2) if indel_ratio(a, b) >= threshold}
        assert got == want


def test_average_linkage_equals_one_merge_at_a_time(spark):
    for limit in (0.72, 0.45):
        rows = tags.linked_groups(tag_frame(spark), limit).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["group"], set()).add(r["tag"])
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == linkage_by_hand(sorted(NAMES), limit)


def test_canonical_tags_are_the_closure(spark):
    got = {r["tag"]: r["canonical_tag"] for r in tags.canonical_tags(tag_frame(spark), {"d": {"coffee": "dog"}}).collect()}
    parent = {t: t for t in NAMES}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges = [(a, b) for a, b in itertools.combinations(NAMES, 2) if indel_ratio(a, b) >= 90]
    edges += [(x, y) for g in linkage_by_hand(sorted(NAMES), 0.72) for x, y in itertools.combinations(g, 2)] + [("coffee", "dog")]
    for a, b in edges:
        parent[find(a)] = find(b)
    for t in NAMES:
        group = [x for x in NAMES if find(x) == find(t)]
        assert got[t] == min(group, key=lambda x: (len(x.split("_")), len(x), x))


def best_matching(edges):
    golds = sorted({g for g, _ in edges})

    def best(i, used):
        if i == len(golds):
            return 0
        return max([best(i + 1, used)] + [1 + best(i + 1, used | {p}) for g, p in edges if g == golds[i] and p not in used])

    return best(0, frozenset())


def test_maximum_matching_against_search(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for task in range(25):
        edges = {(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(1, 16))}
        rows += [(task, g, p) for g, p in edges]
        want[task] = best_matching(edges)
    df = spark.createDataFrame(rows, "task_id int, g int, p int")
    got = evaluation.maximum_matching(df, ["task_id"]).collect()
    assert Counter(r["task_id"] for r in got) == {k: v for k, v in want.items()}
    assert len({(r["task_id"], r["p"]) for r in got}) == len(got) == len({(r["task_id"], r["g"]) for r in got})
    assert {(r["task_id"], r["g"], r["p"]) for r in got} <= set(rows)


def test_label_match_pairs_equal_labels_once(spark):
    gold = spark.createDataFrame([("t", x) for x in ["a", "a", "b", "日本"]], "task_id string, label string")
    pred = spark.createDataFrame([("t", x) for x in ["A", "b", "c", "日本"]], "task_id string, label string")
    assert evaluation.exact_matches(gold, pred, ["task_id"]).first()["tp"] == 2
    assert gold.filter(F.col("label") == "a").count() == 2
