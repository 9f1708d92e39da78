"""Alignment of two tokenizers over a corpus: every distinct text once, pair counts weighted by its copies."""
from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

#: Both id spaces must fit: a pair of ids is one 31-bit number.
A_BITS, B_BITS = 16, 15
#: Characters after which a long text is cut at the next space between words, and bytes aligned together.
STRETCH, BLOCK = 1 << 16, 1 << 20
#: Runs of so many bytes go to the tokenizer whose merges are not quadratic in the run.
LONG_RUN = 2000

_CUT = re.compile(r"(?<=\w) (?=\w)")
_RUN = re.compile(rf"\S{{{LONG_RUN // 4}}}|\s{{{LONG_RUN // 4}}}")


def _byte_of() -> dict[str, int]:
    """Byte of each character that a byte-level vocabulary writes: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        with open(a_path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        self.a_path, byte_of = a_path, _byte_of()
        made = {bytes(byte_of[c] for c in token): k for token, k in content["model"]["vocab"].items() if token not in special}
        # Ids of the file follow its merges, so they are the ranks.
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=made, special_tokens={})
        self.a_len = np.zeros(max(made.values()) + 1, np.int64)
        for token, k in made.items():
            self.a_len[k] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.b_len = np.fromiter(map(len, self.b_bytes), np.int64)
        if len(self.a_len) > 1 << A_BITS or len(self.b_len) > 1 << B_BITS:
            raise ValueError("the vocabularies are too large for one pair number")
        # A text may be cut before a space if no piece goes on after one.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        numbers = [str(k).encode() for k in range(max(len(self.a_len), len(self.b_len)))]
        self.words = [n + end for n in numbers[: len(self.a_len)] for end in (b",", b"|")] + [n + end for n in numbers[: len(self.b_len)] for end in (b",", b";")]

    @functools.cached_property
    def slow(self) -> tokenizers.Tokenizer:
        made = tokenizers.Tokenizer.from_file(self.a_path)
        made.encode_special_tokens = True
        return made

    def stretches(self, text: str, size: int = STRETCH) -> list[str]:
        """The text in parts that both tokenizers read alone as they do in the whole; each part but the first loses its leading space."""
        out, at = [], 0
        while self.cuts and len(text) - at > size and (cut := _CUT.search(text, at + size)):
            out.append(text[at:cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def a_ids(self, parts: list[str], long_runs: bool) -> list[list[int]]:
        if not long_runs:
            return [self.fast.encode_ordinary(" " + p) for p in parts]
        return [self.slow.encode(" " + p, add_special_tokens=False).ids if _RUN.search(p) else self.fast.encode_ordinary(" " + p) for p in parts]


@functools.cache
def _pair(a_path: str, b_path: str, pattern: str) -> Pair:
    return Pair(a_path, b_path, pattern)


def _has_long_run(text: bytes) -> bool:
    blank = np.frombuffer(text, np.uint8) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return int(np.diff(turns, prepend=-1, append=len(blank)).max(initial=0)) >= LONG_RUN


class _Texts:
    """What is known of the texts of a slice: counts, running digests of the groups, and links."""

    def __init__(self, n: int) -> None:
        self.counts = np.zeros((n, 3), np.int64)  # A tokens, B tokens, links
        self.digests = [hashlib.sha256() for _ in range(n)]
        self.started, self.bad = [False] * n, np.zeros(n, bool)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # text << 31 | pair, with how often

    def add(self, pair: Pair, owners: list[int], parts: list[str]) -> None:
        """Align some parts; those of one text come in their order."""
        raw = [b" " + p.encode() for p in parts]
        a = pair.a_ids(parts, _has_long_run(b"".join(raw)))
        b = pair.b.encode(parts, num_threads=1)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, na), (b, nb)))
        whole = np.fromiter((b"".join(map(pair.b_bytes.__getitem__, ids)) == text for ids, text in zip(b, raw)), bool, len(raw))
        lengths = pair.a_len[flat_a]
        whole &= np.add.reduceat(lengths, np.cumsum(na) - na) == sizes  # bytes of A tokens are those of the text
        if not whole.all():
            self.bad[[o for o, ok in zip(owners, whole) if not ok]] = True
            flat_a, flat_b, lengths = flat_a[np.repeat(whole, na)], flat_b[np.repeat(whole, nb)], lengths[np.repeat(whole, na)]
            owners, na, nb, sizes = [o for o, ok in zip(owners, whole) if ok], na[whole], nb[whole], sizes[whole]
            if not owners:
                return
        ends_a, ends_b = np.cumsum(lengths), np.cumsum(pair.b_len[flat_b])
        mark = np.zeros((2, int(sizes.sum()) + 1), bool)
        mark[0, ends_a] = mark[1, ends_b] = True
        last_a, last_b = mark[1, ends_a], mark[0, ends_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # In the merged order all A tokens of a group stand before its B tokens.
        place_a = np.arange(len(flat_a)) + np.r_[0, np.flatnonzero(last_b) + 1][group_a]
        place_b = np.arange(len(flat_b)) + (np.flatnonzero(last_a) + 1)[group_b]
        merged = np.empty(len(flat_a) + len(flat_b), np.int32)
        merged[place_a] = flat_a * 2 + last_a
        merged[place_b] = 2 * len(pair.a_len) + flat_b * 2 + last_b
        cuts = np.r_[0, np.cumsum(na + nb)].tolist()
        codes, words = merged.tolist(), pair.words
        for k, owner in enumerate(owners):
            if self.started[owner]:
                self.digests[owner].update(b";")
            self.started[owner] = True
            self.digests[owner].update(b"".join(map(words.__getitem__, codes[cuts[k]:cuts[k + 1]]))[:-1])
        who = np.array(owners)
        linked = np.repeat(who, np.add.reduceat(last_a.astype(np.int64), np.cumsum(na) - na))
        for column, n in enumerate((na, nb)):
            np.add.at(self.counts[:, column], who, n)
        np.add.at(self.counts[:, 2], linked, 1)
        self.links.append(np.unique(linked << (A_BITS + B_BITS) | flat_a[last_a] << B_BITS | flat_b[last_b], return_counts=True))

    def columns(self) -> list[pa.Array]:
        self.counts[self.bad] = 0
        digests = ["" if bad or not started else d.hexdigest() for bad, started, d in zip(self.bad, self.started, self.digests)]
        keys, n = (np.concatenate(x) for x in zip(*self.links)) if self.links else (np.zeros(0, np.int64),) * 2
        if len(self.links) > 1:  # a text may be in several blocks
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, n, len(keys)).astype(np.int64)
        good = ~self.bad[keys >> (A_BITS + B_BITS)]
        keys, n = keys[good], n[good]
        cuts = pa.array(np.searchsorted(keys >> (A_BITS + B_BITS), np.arange(len(self.bad) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (keys & ((1 << A_BITS + B_BITS) - 1), n)]
        return [*map(pa.array, self.counts.T), pa.array(digests, pa.string()), *lists]


_MEASURES = "n_a long, n_b long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def aligned_texts(texts: DataFrame, a_path: str, b_path: str, pattern: str, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """The other columns of ``texts`` and, of its column ``text``: token and link counts, digest of the groups, and the
    distinct linked pairs (A id << 15 | B id) with how often each occurs in the text."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path, pattern)
        for batch in batches:
            for part in slices(batch, "text", block):
                found, owners, parts, size = _Texts(part.num_rows), [], [], 0
                for owner, text in enumerate(as_bytes(part.column("text"))):
                    for piece in pair.stretches(text.decode(), stretch) if text else ():
                        owners.append(owner)
                        parts.append(piece)
                        size += len(piece)
                        if size >= block:
                            found.add(pair, owners, parts)
                            owners, parts, size = [], [], 0
                if parts:
                    found.add(pair, owners, parts)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + found.columns(), keep + ["n_a", "n_b", "n_links", "groups_sha256", "pairs", "times"])

    schema = ", ".join(f"{c} {t}" for c, t in texts.dtypes if c != "text")
    return texts.select(*keep, "text").mapInArrow(run, f"{schema}, {_MEASURES}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and links: over all texts, times their copies ``n``. Each task adds up its own pairs before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            n = np.repeat(batch.column("n").to_numpy(), pairs.value_lengths().to_numpy(zero_copy_only=False))
            found = np.concatenate([keys, pairs.flatten().to_numpy().astype(np.int64)])
            weights = np.concatenate([sums, times.flatten().to_numpy() * n])
            order = np.argsort(found, kind="stable")
            found = found[order]
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, int)
            keys, sums = found[first], np.add.reduceat(weights[order], first) if len(first) else sums
        yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(sums)], names=["pair", "links"])

    return aligned.select("n", "pairs", "times").mapInArrow(run, "pair int, links long").groupBy("pair").agg(F.sum("links").alias("links"))


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    Texts meet by their full content; each distinct one is tokenised and aligned once, its copies weigh its pair
    counts, and its measures go back to the rows by the text's SHA-256. A text with a third of all rows is one
    row before the shuffle, and the join back may split its rows. Null and empty texts, and texts that a
    tokenizer does not give back byte for byte, have zeros and an empty digest. Texts of any length are read
    whole: long ones are cut before spaces between words, where no token of either vocabulary can reach over,
    so memory follows the stretch; only a text without such a space stays in one piece. Repeated rows count
    as often as they occur, null ids stay null, an empty table has no rows, and other columns are not read.

    Two tokens that end together are equal in their last bytes: one is a suffix of the other. The number of
    pairs is thus below the bytes of both vocabularies (under two million), whatever the corpus, and the table
    of their counts is broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    distinct = rows.filter("text != ''").groupBy("text").agg(F.count("*").alias("n"))
    aligned = written(aligned_texts(distinct.select(digest.alias("key"), "n", "text"), a_path, b_path, pattern))
    counted = pair_counts(aligned).orderBy("pair").toArrow()  # bounded by the vocabularies
    pairs, links = (counted.column(c).to_numpy().astype(np.int64) for c in ("pair", "links"))
    best = np.zeros(1 << B_BITS, np.int64)
    np.maximum.at(best, pairs & ((1 << B_BITS) - 1), links)
    shared = spark.sparkContext.broadcast((pairs, links, links == best[pairs & ((1 << B_BITS) - 1)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, tops = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(known, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            sums = [np.r_[0, np.cumsum(x)] for x in (times * tops[at], times * counts[at])]
            made = [pa.array(s[cuts[1:]] - s[cuts[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "n_a", "n_b", "n_links", "groups_sha256")] + made, ["key", "n_a", "n_b", "n_links", "groups_sha256", "n_best", "count_sum"])

    columns = aligned.select("key", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "times")
    measured = columns.mapInArrow(run, "key binary, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long")
    joined = rows.select("doc_id", F.when(F.col("text") != "", digest).alias("key")).join(measured, "key", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("doc_id", n("n_a"), n("n_b"), F.coalesce("n_links", F.lit(0)).alias("n_groups"), n("n_links"), n("n_best"), n("count_sum"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
