"""Quality by a generalised additive model with pairwise interactions, learnt by cyclic boosting of shallow trees."""
from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices
from .samples import fold, labelled

#: Rows the trainer sees at most.
TRAIN_ROWS = 24_000
#: Bins of a feature alone and in a pair, boosting rounds of both, pairs, learning rate, L2 of a leaf.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 48, 12, 150, 60, 10, 0.12, 2.0

FEATURES = (
    "log_bytes", "upper", "lower", "digits", "blanks", "newlines", "full_stops", "symbols", "marks", "bars", "beyond_ascii", "byte_entropy",
    "log_words", "word_bytes", "long_words", "distinct_words", "top_word", "repeated_neighbours", "distinct_triples", "lone_symbols",
    "line_bytes", "repeated_lines", "capital_lines", "short_lines",
)


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; shares are of bytes, words or lines, and 0 for an empty text."""
    out = np.zeros((len(texts), len(FEATURES)))
    group = lambda counts, chars: counts[list(chars)].sum()
    for row, text in zip(out, texts):
        n = len(text)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        share = counts[counts > 0] / n
        words = text.split()
        lines = text.split(b"\n")
        m = len(words)
        row[:12] = (
            np.log1p(n), counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n,
            group(counts, b".,;:") / n, group(counts, b"*#$%&@^~+=<>{}[]\\/_") / n, group(counts, b"!?") / n, counts[124] / n,
            counts[192:].sum() / n, -(share * np.log2(share)).sum(),
        )
        row[20:] = (
            np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x[:1].isupper() for x in lines) / len(lines),
            sum(len(x) < 20 for x in lines) / len(lines),
        )
        if m:
            often = Counter(words)
            row[12:20] = (
                np.log1p(m), (n - counts[32]) / m, sum(len(w) > 12 for w in words) / m, len(often) / m, max(often.values()) / m,
                sum(map(bytes.__eq__, words, words[1:])) / m, len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2),
                sum(not w.isalnum() for w in often) / len(often),
            )
    return out


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins of one feature, as one step for each bin."""
    step = np.zeros(len(g))
    gain, at = _best_cut(g, h)
    for a, b in ((0, at), (at, len(g))) if gain > 1e-9 else ((0, len(g)),):
        inner, cut = _best_cut(g[a:b], h[a:b])
        for c, d in ((a, a + cut), (a + cut, b)) if inner > 1e-9 else ((a, b),):
            step[c:d] = -g[c:d].sum() / (h[c:d].sum() + RIDGE)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature and then each side by the other: its gain and a step for each cell."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        base = a.sum() ** 2 / (b.sum() + RIDGE)
        # Rows of running sums over the first feature; each side takes its best cut in the second.
        left_a, left_b = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        sides = []
        for x, y in ((left_a, left_b), (a.sum(0) - left_a, b.sum(0) - left_b)):
            cx, cy = np.cumsum(x, 1), np.cumsum(y, 1)
            tx, ty = cx[:, -1:], cy[:, -1:]
            score = cx[:, :-1] ** 2 / (cy[:, :-1] + RIDGE) + (tx - cx[:, :-1]) ** 2 / (ty - cy[:, :-1] + RIDGE)
            sides.append((score.max(1), score.argmax(1) + 1))
        gain = sides[0][0] + sides[1][0] - base
        at = int(gain.argmax())
        if gain[at] > best[0]:
            step = np.zeros_like(a)
            for rows, cut in ((slice(0, at + 1), sides[0][1][at]), (slice(at + 1, None), sides[1][1][at])):
                for columns in (slice(0, cut), slice(cut, None)):
                    step[rows, columns] = -a[rows, columns].sum() / (b[rows, columns].sum() + RIDGE)
            best = (float(gain[at]), step.T if turn else step)
    return best


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)


@dataclass
class Model:
    """Base score, cut points and lookup tables; a score is the sum of one entry of each table."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = _bins(x, self.cuts), _bins(x, self.pair_cuts)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for a, b, table in self.pairs:
            total += table[coarse[:, a], coarse[:, b]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0)))


def train_gam(x: np.ndarray, y: np.ndarray) -> Model:
    """Main effects by cyclic boosting, then the pairs that explain most of what is left, boosted the same way."""
    rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(rate / (1 - rate)))
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
    if not len(y) or y.min() == y.max():
        none = [np.zeros(0)] * x.shape[1]
        return Model(base, none, [np.zeros(1)] * x.shape[1], none, [])
    cuts, pair_cuts = quantiles(BINS), quantiles(PAIR_BINS)
    bins, coarse = _bins(x, cuts), _bins(x, pair_cuts)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)))
            table += step
            total += step[bins[:, j]]

    def cells(a, b, values):
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        return np.bincount(coarse[:, a] * shape[1] + coarse[:, b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    able = [j for j, c in enumerate(pair_cuts) if len(c)]
    gains = [(_pair_tree(cells(a, b, g), cells(a, b, h))[0], a, b) for k, a in enumerate(able) for b in able[k + 1 :]]
    pairs = [(a, b, np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in pairs:
            g, h = slopes()
            step = RATE * _pair_tree(cells(a, b, g), cells(a, b, h))[1]
            table += step
            total += step[coarse[:, a], coarse[:, b]]
    return Model(base, cuts, tables, pair_cuts, pairs)


def fit(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = TRAIN_ROWS, doc: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``rows`` labelled documents outside the held fold, in one executor task.

    Features are made where the documents lie; the trainer gets numbers only. Without labelled documents, or
    with one label only, the model scores by the base rate.
    """

    def train(batches: Iterator[pa.RecordBatch]):
        seen = [(np.asarray(b.column("x").flatten()).reshape(-1, len(FEATURES)), np.asarray(b.column("label"))) for b in batches if b.num_rows]
        x = np.concatenate([s[0] for s in seen]) if seen else np.zeros((0, len(FEATURES)))
        y = np.concatenate([s[1] for s in seen]).astype(float) if seen else np.zeros(0)
        yield pa.record_batch([pa.array([pickle.dumps(train_gam(x, y))], pa.binary())], names=["model"])

    made = by_slices(_feature_lists, ["x"], "text", ["place", "label"])
    sample = labelled(docs, labels, label, folds, held, rows, doc, text).mapInArrow(made, "place long, label int, x array<double>")
    found = sample.orderBy("place").limit(rows).mapInArrow(train, "model binary").head()
    return pickle.loads(found["model"]) if found else train_gam(np.zeros((0, len(FEATURES))), np.zeros(0))


def _feature_lists(texts: list[bytes]) -> list[pa.Array]:
    x = text_features(texts)
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))]


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``quality`` (0 to 1) of every row from its whole text; null counts as empty.

    The model is some thousand numbers whatever the corpus, and goes out with the tasks.
    """
    run = by_slices(lambda texts: [pa.array(model.score(text_features(texts)))], ["quality"], "text", ["doc_id"])
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, quality double")


def predictions(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held fold are never learnt from.

    Texts of any length count whole, null as empty; equal texts have equal scores, repeated rows are rows of their
    own, null ids stay null. Columns beyond id and text are not read, and no rows give no rows.
    """
    scored = score(docs, fit(docs, labels, label, folds, held))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= threshold).cast("int").alias("predicted"))
