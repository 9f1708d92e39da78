"""Byte-level BPE: corpus-level merge replay over the distinct words of a block of documents."""
from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: Words whose ids a task remembers, and the longest word it remembers; others are replayed again.
REMEMBERED, LONGEST = 300_000, 64


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open-addressing table from a pair of tokens to the token they make, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, made = np.array(pairs, np.int64).reshape(-1, 2).T
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.made[at[won]] = made[won]
            keys, made, at = keys[~won], made[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none; negative symbols are no tokens."""
        keys = (left.astype(np.int64) << 32) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(keys >= 0)
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


class Merges:
    """Ranks of a vocabulary, with the replay that encodes many words at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.byte_table = np.array(self.byte_ids, np.int64)
        self.table = PairTable(ranks)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        short, long_ = [], []
        for k, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif word:
                (short if len(word) <= LONGEST else long_).append(k)
        for k, ids in zip(short, self._replay_together([words[k] for k in short])):
            out[k] = ids
        for k in long_:
            out[k] = self._replay_alone(words[k])
        return out

    def _replay_together(self, words: list[bytes]) -> list[bytes]:
        """Merge replay over many words, which lie one after another between walls.

        The index holds, for each pair that makes a token, its rank and its positions, in rank order. A sweep
        goes through it and applies the first entry of every word; words do not touch each other, so each sees
        its merges in rank order and from left to right. Only the pairs with the two neighbours of a merge are
        looked up again, and only they and the merged pair change in the index.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        n = len(text) + 1
        ends = np.cumsum(sizes + 1)  # the wall after each word, counted with the wall at 0
        symbols = np.empty(n, np.int64)
        symbols[1:] = self.byte_table[text]
        symbols[0], symbols[ends] = -1, -1
        owner = np.zeros(n, np.int64)
        owner[1:] = np.repeat(np.arange(len(words)), sizes + 1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.table.ranks(symbols[:-1], symbols[1:])
        touched = np.zeros(n, bool)
        index = np.sort((rank << 32 | np.arange(n))[rank >= 0])
        low = (1 << 32) - 1
        first = np.empty(len(words), np.int64)
        while len(index):
            places = index & low
            owners = owner[places]
            first[owners[::-1]] = places[::-1]  # the earliest entry is written last
            at = first[owners]
            at = at[at == places]
            gone, near = after[at], before[at]
            far = after[gone]
            symbols[at], symbols[gone] = rank[at], -2
            after[at], before[far] = far, at
            rank[gone] = -1
            rank[at] = self.table.ranks(symbols[at], symbols[far])
            rank[near] = self.table.ranks(symbols[near], symbols[at])
            changed = np.concatenate([at, near])
            touched[changed] = touched[gone] = True
            rest = index[~touched[places]]
            touched[changed] = touched[gone] = False
            changed = changed[rank[changed] >= 0]
            index = np.sort(np.concatenate([rest, rank[changed] << 32 | changed]))
        kept = symbols >= 0
        ids = symbols[kept].astype("<u4").tobytes()
        cuts = 4 * np.cumsum(kept)[ends]
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def _replay_alone(self, word: bytes) -> bytes:
        """The same replay for one long word: the index is a heap of (rank, position)."""
        pair = lambda a, b: self.ranks.get(self.tokens[symbols[a]] + self.tokens[symbols[b]], -1)
        symbols = list(map(self.byte_ids.__getitem__, word))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pair(k, k + 1) for k in range(n - 1)] + [-1]
        index = [(r, k) for k, r in enumerate(rank) if r >= 0]
        heapq.heapify(index)
        while index:
            made, at = heapq.heappop(index)
            if rank[at] != made:
                continue
            gone = after[at]
            far, near = after[gone], before[at]
            symbols[at], symbols[gone], after[at], rank[gone], rank[at] = made, -1, far, -1, -1
            if far < n:
                before[far] = at
                rank[at] = pair(at, far)
                if rank[at] >= 0:
                    heapq.heappush(index, (rank[at], at))
            if near >= 0:
                rank[near] = pair(near, at)
                if rank[near] >= 0:
                    heapq.heappush(index, (rank[near], near))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()


@functools.cache
def _loaded(path: str) -> Merges:
    return Merges(load_ranks(path))


class Encoder:
    """Encodes blocks of texts; remembers the ids of short words between blocks."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        self.merges = merges
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [w for w in set(chain.from_iterable(pieces)) if w not in known]
        made = self.merges.replay([w.encode() for w in new])
        long_words = [w for w in new if len(w) > LONGEST]
        known.update(zip(new, made))
        out = [b"".join(map(known.__getitem__, words)) for words in pieces]
        for w in long_words:
            del known[w]
        return out


def decode(merges: Merges, ids: bytes) -> bytes:
    return b"".join(map(merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _blocks(batches: Iterator[pa.RecordBatch], path: str, pattern: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], Callable]]:
    merges = _loaded(path)
    encoder = Encoder(merges, pattern)
    for batch in batches:
        for part in slices(batch, "text", size):
            yield part, encoder.encode([t.decode() for t in as_bytes(part.column("text"))]), merges


def _id_lists(ids: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encode(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id and ids (array<int>) of every row, as the rank file and the splitting pattern give them.

    Blocks of about ``block_bytes`` are encoded together; the distinct words of a block that its task has not
    met yet go through one merge replay. Words never cross documents or pattern matches; there are no special
    tokens. Null or empty text has no ids. Rows are independent: repeated ids give repeated rows, a null id
    stays null, other columns are not read. ``path`` must be readable on the executors.
    """

    def run(batches):
        for part, ids, _ in _blocks(batches, path, pattern, block_bytes):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _id_lists(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for; a null list has no bytes."""

    def run(batches):
        merges = _loaded(path)
        for batch in batches:
            texts = [b"".join(map(merges.tokens.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def token_digests(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    The same replay as ``encode``; ids are decoded back and both are digested inside the task, and no id list
    leaves it unless asked for ``with_ids``.
    """

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part, ids, merges in _blocks(batches, path, pattern, block_bytes):
            columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids)), pa.array([sha(decode(merges, x)) for x in ids])]
            yield pa.RecordBatch.from_arrays(columns + [_id_lists(ids)] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
