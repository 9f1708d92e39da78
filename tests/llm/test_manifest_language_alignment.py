"""Merkle manifest, language labels and tokenizer alignment against plain versions."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import sentencepiece
import tokenizers

from tastemap.llm import align, langid, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def reduce(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, k):
    for level in levels[:-1]:
        at = k - k % 3
        yield level[at:k], level[k + 1:at + 3]
        k //= 3


def plain_manifest(rows):
    """Leaf, subroot, root, proof and folded root of each row; rows of one group and id are in leaf order."""
    leaf = lambda r: sha("".join(map(field, r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = reduce([leaf(r) for r in groups[s]])
    top = reduce([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            steps = [*siblings(trees[s], k), *siblings(top, n)]
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                other = (*r[:4], r[4].replace("\n", ""))
            h = leaf(other)
            for a, b in steps:
                h = sha("".join(a) + h + "".join(b))
            proof = sha("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def found_manifest(spark, rows, schema=DOCS):
    df = merkle.manifest(spark.createDataFrame(rows, schema).repartition(5))
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def test_manifest_of_sparse_ids_nulls_and_groups_of_all_sizes(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-70_000, 9_000_000), 1100) + [2**62, -2**62]
    rows = [(i, rng.choice(["a", "b", "b", "b", None, "é", ""]), rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "x\ny", f"t{i}\n", "plain"])) for i in ids]
    rows += [(10_000_001, "alone", "en", 1, "one\n"), (10_000_002, "two", None, None, None), (10_000_003, "two", "fr", 2, "z\n\n")]
    assert sorted(found_manifest(spark, rows), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_many_groups(spark):
    rows = [(i, f"s{i % 300:03d}", "en", i, f"line {i}\nnext") for i in range(900)]
    assert sorted(found_manifest(spark, rows), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_repeated_and_null_ids(spark):
    rows = [(7, "a", "en", k, f"t{k}") for k in range(40)] + [(7, "a", "en", 1, "same\n")] * 30 + [(None, "a", "en", k % 3, None) for k in range(20)]
    rows += [(k, "a", None, None, "x") for k in range(100)] + [(8, None, None, None, "only")]
    found = found_manifest(spark, rows)
    # Equal rows are interchangeable, their proofs are not: compare them as one multiset.
    assert sorted(found, key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_an_empty_table_a_single_row_and_clashing_columns(spark):
    assert found_manifest(spark, []) == []
    rows = [(5, None, None, None, None)]
    assert found_manifest(spark, rows) == plain_manifest(rows)
    wide = DOCS + ", leaf string, id long, tree string, hash string, word long, size long, idx long"
    assert found_manifest(spark, [(5, None, None, None, None, "x", 1, "y", "z", 2, 3, 4)], wide) == plain_manifest(rows)


def test_manifest_digests_very_long_texts(spark):
    rows = [(k, "a", "en", 1, "ab\n" * 400_000 + str(k)) for k in range(4)]
    assert sorted(found_manifest(spark, rows), key=key) == sorted(plain_manifest(rows), key=key)


# Language


WORDS = {"aa": ["tha", "wen", "ing", "sho", "lyth"], "bb": ["eau", "où", "ière", "çon", "lle"], "cc": ["sch", "üng", "eit", "zwo", "ßen"]}


def sentences(rng, lang, n):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b"], [rng.normal(0, 0.5, (257, 9)) for _ in range(2)], [rng.normal(0, 0.5, (3, 9)) for _ in range(2)], rng.normal(0, 0.5, (6, 2)), np.zeros(2))
    symbols, used, wanted = rng.integers(97, 100, (6, 4)), np.array([6, 3, 5, 1]), np.array([0, 1, 1, 0])
    symbols[np.arange(6)[:, None] >= used] = langid.PAD
    _, found = langid.gradients(net, symbols, used, wanted)
    for weights, gradient in zip([*net.tables, *net.recurrent, net.out, net.bias], found):
        for at in zip(*(rng.integers(0, n, 6) for n in weights.shape)):
            at = (97 + at[0] % 3, at[1]) if weights.shape[0] == 257 else at
            old, losses = weights[at], []
            for step in (1e-2, -1e-2):
                weights[at] = old + step
                losses.append(langid.gradients(net, symbols, used, wanted)[0])
            weights[at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - gradient[at]) < 2e-3


def test_reader_equals_a_step_by_step_network():
    rng = np.random.default_rng(2)
    net = langid.train([b"thawen ing", b"eau lle"], ["aa", "bb"], steps=3, units=4)
    texts = [b"", b"a", bytes(rng.integers(97, 110, 300, np.uint8)), "çéß".encode() * 50]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def run(text, table, u):
        h, out = np.zeros(4), []
        for b in text:
            x, g = table[b].astype(float), h @ u.astype(float)
            z, r = sigmoid(x[:4] + g[:4]), sigmoid(x[4:8] + g[4:8])
            n = np.tanh(x[8:] + r * g[8:])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    pooled, labels = langid.Reader(net).pooled(texts), langid.Reader(net).labels(texts)
    for text, found, marks in zip(texts, pooled, labels):
        ps = []
        for at in range(0, len(text), langid.STRETCH):
            part = text[at:at + langid.STRETCH]
            states = zip(run(part, net.tables[0], net.recurrent[0]), run(part[::-1], net.tables[1], net.recurrent[1])[::-1])
            for f, b in states:
                e = np.exp(np.r_[f, b] @ net.out + net.bias)
                ps.append(e / e.sum())
        assert np.allclose(found, np.mean(ps, 0) if ps else 0, atol=1e-4)
        assert len(marks) == len(text)
        assert all(p[m] >= p.max() - 1e-4 for p, m in zip(ps, marks))


def test_languages_of_held_out_documents(spark):
    rng = random.Random(5)
    langs = list(WORDS)
    rows = [(k, sentences(rng, langs[k % 3], rng.choice([4, 20, 300])), langs[k % 3]) for k in range(600)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 $$ ..", "bb"), (None, "tha wen", "aa"), (1003, "eau " * 60_000, None), (1004, "é", None), (1004, "é", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("x")).withColumn("letters", langid.F.lit(1))
    found = langid.predictions(docs, rows=300).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    held = [(r.lang_pred, langs[r.doc_id % 3]) for r in found if r.held_out and (r.doc_id or 0) < 600 and r.doc_id is not None]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "bb" and not by_id[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_the_held_fold_change_nothing(spark):
    rng = random.Random(6)
    rows = [(k, sentences(rng, list(WORDS)[k % 3], 10), list(WORDS)[k % 3]) for k in range(120)]
    other = [(k, t, "cc" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    one, two = (sorted(map(tuple, langid.predictions(spark.createDataFrame(r, "doc_id long, text string, lang string"), rows=60).collect())) for r in (rows, other))
    assert one == two


def test_language_without_anything_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.predictions(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r)[2:] for r in langid.predictions(spark.createDataFrame([(3, "abc", None)], schema)).collect()] == [("und", 0.0)]


def test_language_spans_cover_texts(spark):
    net = langid.train([b"thawen ing", b"eau lle"], ["aa", "bb"], steps=20, units=4)
    docs = spark.createDataFrame([(1, "thawen eau lle " * 20), (2, None), (3, "")], "doc_id long, text string")
    found = sorted(map(tuple, langid.spans(docs, net).collect()))
    assert {r[0] for r in found} == {1} and found[0][1] == 0 and found[-1][2] == 300
    assert all(a[2] == b[1] and a[3] != b[3] for a, b in zip(found, found[1:]))


# Alignment


A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_alignment(texts):
    a_tok = tokenizers.Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = align._byte_of()
    counts, aligned = Counter(), []
    for text in texts:
        if not text:
            aligned.append(None)
            continue
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(k)[3:5], 16)]) if b_tok.is_byte(k) else b_tok.id_to_piece(k).replace("▁", " ").encode() for k in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            aligned.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in (a_bytes, b_bytes))
        at_a, at_b = dict(zip(ends_a, range(len(a)))), dict(zip(ends_b, range(len(b))))
        common = sorted(at_a.keys() & at_b.keys())
        links = [(a[at_a[e]], b[at_b[e]]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i:at_a[e] + 1])) + "|" + ",".join(map(str, b[j:at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        counts.update(links)
        aligned.append((len(a), len(b), links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else
        (x[0], x[1], len(x[2]), len(x[2]), sum(counts[p] == best[p[1]] for p in x[2]), sum(counts[p] for p in x[2]), sha(x[3]))
        for x in aligned
    ]


def found_alignment(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", align.F.lit("clash")).repartition(3)
    df = align.alignment(rows, A, B, P.PATTERN, **options).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r)[1:] for r in sorted(df.collect())]


def test_alignment_equals_both_libraries(spark):
    rng = random.Random(4)
    alphabet = "aàbcdeéfghß  \n\t.,'’0123456789中文😀\u0085 ▁<>|"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(300)]
    texts += [None, "", " ", "\n", "  two  spaces ", "a▁b", "<|endoftext|>", "<s> </s> <unk> <0x41>", "nul\0nul", "I'll don't 's", "é ﬁ ①", "﻿", "\r\n"]
    texts += ["The quick brown fox jumps over the lazy dog. " * 3] * 7 + ["x" * 5000, " " * 5000, "=" * 3000 + " " * 3000, "ab " * 3000]
    assert found_alignment(spark, texts) == plain_alignment(texts)


def test_long_texts_are_read_in_stretches_without_a_trace():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdeéß'.,中", k=rng.randint(1, 12))) for _ in range(400)), "word  " * 300, "no_space" * 90, "é é " * 200]
    pair = align._pair(A, B, P.PATTERN)
    assert pair.cuts
    whole, cut = [], []
    for found, size in ((whole, 1 << 20), (cut, 25)):
        for text in texts:
            one = align._Texts(1)
            for piece in pair.stretches(text, size):
                one.add(pair, [0], [piece])
            found.append([c.to_pylist() for c in one.columns()])
    assert whole == cut and len(pair.stretches(texts[0], 25)) > 20


def test_alignment_of_an_empty_table(spark):
    assert found_alignment(spark, []) == []
    assert found_alignment(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
