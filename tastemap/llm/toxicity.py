"""Toxicity by logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_slices, fresh
from .samples import fold, labelled

#: Bits of the hashed feature space: a weight table has at most 2**20 entries.
BITS = 20
_IDS = (1 << BITS) - 1
#: Rows the trainer sees at most, and passes over them.
TRAIN_ROWS, PASSES = 24_000, 4
#: FTRL: rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
#: Everything but a-z, digits and bytes beyond ASCII parts words.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) >> 1
        if len(self) < 200_000 and len(word) <= 64:
            self[word] = value
        return value


def features(texts: list[bytes], known: _WordHashes) -> np.ndarray:
    """Owner and hashed id, in one integer, of each word, bigram and skip-gram (one word between) of the texts."""
    words = [t.lower().translate(_WORD_BYTES).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(sizes.sum())).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint64(64 - BITS)
    found = [owner << BITS | (hashes * _MIX[0] >> shift).astype(np.int64)]
    for gap in (1, 2):
        same = owner[:-gap] == owner[gap:]
        pair = (hashes[:-gap] * _MIX[1] + (hashes[gap:] ^ _MIX[gap]) * _MIX[2]) * _MIX[0] >> shift
        found.append((owner[:-gap] << BITS | pair.astype(np.int64))[same])
    return np.concatenate(found)


@dataclass
class Model:
    """Bias and the weights that L1 left: sorted feature ids beside their values."""

    bias: float
    ids: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.ids] = self.values
        return dense


def train_ftrl(rows: list[tuple[int, np.ndarray]], passes: int = PASSES) -> Model:
    """FTRL-proximal over (label, feature ids) in the order given, with a rate of its own for each coordinate."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(ids):
        zi = z[ids]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(ids == bias, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n[ids])) / ALPHA + L2)

    for _ in range(passes):
        for label, ids in rows:
            ids = np.append(ids, bias)
            w = weights(ids)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            if abs(gradient) < 1e-4:
                continue
            old = n[ids]
            new = old + gradient * gradient
            z[ids] += gradient - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[ids] = new
    every = np.arange((1 << BITS) + 1)
    w = weights(every)
    ids = np.flatnonzero(w[:bias])
    return Model(float(w[bias]), ids, w[ids])


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = TRAIN_ROWS, doc: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``rows`` labelled documents outside the held fold, in one executor task.

    The features of the sample are made where the documents lie; one task then runs FTRL over them, bounded by
    ``rows``, and returns the sparse weights. Without labelled documents the model has no weights and bias 0.
    """

    def featured(batches: Iterator[pa.RecordBatch]):
        known = _WordHashes()

        def one(texts):
            distinct = np.unique(features(texts, known))
            cuts = np.searchsorted(distinct >> BITS, np.arange(len(texts) + 1))
            return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(distinct & _IDS, pa.int32()))]

        yield from by_slices(one, ["ids"], "text", ["place", "label"])(batches)

    def train(batches: Iterator[pa.RecordBatch]):
        seen = []  # views of the 32-bit ids in their batches: the sample is held once
        for b in batches:
            ids, cuts = (x.to_numpy() for x in (b.column("ids").values, b.column("ids").offsets))
            seen += zip(b.column("label").to_pylist(), (ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())))
        model = train_ftrl(seen) if seen else Model(0.0, np.zeros(0, np.int64), np.zeros(0))
        yield pa.record_batch([pa.array(np.append(model.ids, -1)), pa.array(np.append(model.values, model.bias))], names=["id", "value"])

    sample = labelled(docs, labels, label, folds, held, rows, doc, text).mapInArrow(featured, "place long, label int, ids array<int>")
    made = sample.orderBy("place").limit(rows).mapInArrow(train, "id long, value double").toPandas().sort_values("id")
    bias = made.loc[made.id < 0, "value"]
    rest = made[made.id >= 0]
    return Model(float(bias.iloc[0]) if len(bias) else 0.0, rest.id.to_numpy(), rest.value.to_numpy())


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """The columns ``keep`` (``doc_id`` if none are named) and the score ``name`` (0 to 1) of every row.

    The whole text counts. Null and empty texts get the score of the bias alone. The weights travel as a
    broadcast of at most 2**20 entries.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.ids, model.values))
    columns = keep or [doc]
    inner = fresh(docs, "scored_text")

    def run(batches):
        bias, ids, values = shared.value
        weights, known = Model(bias, ids, values).table(), _WordHashes()

        def one(texts):
            found = features(texts, known)
            found = np.unique(found[weights[found & _IDS] != 0])  # a feature counts once in a text
            total = bias + np.bincount(found >> BITS, weights[found & _IDS], len(texts))
            return [pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))]

        yield from by_slices(one, [name], inner, columns)(batches)

    rows = docs.select(*[docs[f"`{c}`"] for c in columns], docs[f"`{text}`"].cast("string").alias(inner))
    schema = StructType([*rows.schema.fields[:-1], StructField(name, DoubleType())])
    return rows.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held fold are never learnt from.

    Texts of any length count whole, null as empty; equal texts have equal scores, repeated rows are rows of their
    own, null ids stay null. Columns beyond id and text are not read, and no rows give no rows. The trainer holds the
    distinct features of its sample, at most 2**20 of them for a text.
    """
    scored = score(docs, fit(docs, labels, label, folds, held))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
