"""Language of documents by a bidirectional gated recurrent network over bytes, trained in numpy."""
from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices
from .samples import fold

#: Units of each direction; bytes read from one zero state; rows of stretches computed at once.
UNITS, STRETCH, LANES = 8, 128, 2048
#: Documents the trainer sees at most, stretches cut of each, their length, and the passes of gradient descent.
TRAIN_ROWS, PIECES, PIECE, STEPS, BATCH = 12_000, 2, 64, 260, 256
#: Symbol behind the end of a text: its update gate is shut, so the state stays as it is.
PAD, SHUT = 256, 40.0


@dataclass
class Network:
    """Languages, byte tables and recurrent weights of both directions (gates: keep, reset, candidate), output layer."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, langs=np.array([x.encode() for x in self.langs], object).astype("S"), t0=self.tables[0], t1=self.tables[1], u0=self.recurrent[0], u1=self.recurrent[1], out=self.out, bias=self.bias)
        return file.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Network:
        d = np.load(io.BytesIO(raw))
        return Network([x.decode() for x in d["langs"].tolist()], [d["t0"], d["t1"]], [d["u0"], d["u1"]], d["out"], d["bias"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lay_out(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``width`` bytes, padded at the end (one a row), their lengths, and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-sizes // width)
    first = np.cumsum(rows) - rows
    flat = np.full(int(rows.sum()) * width, PAD, np.int16)
    flat[np.arange(int(sizes.sum())) + np.repeat(first * width - (np.cumsum(sizes) - sizes), sizes)] = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    used = np.minimum(width, sizes[owner] - (np.arange(len(owner)) - first[owner]) * width)
    return flat.reshape(-1, width), used, owner


class Reader:
    """Runs a trained network over many stretches at once; arrays are laid out unit by stretch."""

    def __init__(self, net: Network) -> None:
        h = net.recurrent[0].shape[0]
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype("f4")  # sigmoid(x) is tanh(x / 2) / 2 + 1 / 2
        self.units, self.classes = h, len(net.langs)
        self.tables = [(t * half).astype("f4") for t in net.tables]
        self.recurrent = [np.ascontiguousarray((u * half).T.astype("f4")) for u in net.recurrent]
        self.out = [np.ascontiguousarray(net.out[:h].T.astype("f4")), np.ascontiguousarray(net.out[h:].T.astype("f4"))]
        self.bias = net.bias.astype("f4")[:, None]

    def _states(self, symbols: np.ndarray, way: int) -> Iterator[tuple[int, np.ndarray]]:
        """Position and state, in reading order; the state is overwritten by the next step."""
        h, (steps, lanes) = self.units, symbols.shape
        state, near = np.zeros((h, lanes), "f4"), np.empty((lanes, 3 * h), "f4")
        x, g = np.empty((3 * h, lanes), "f4"), np.empty((3 * h, lanes), "f4")
        gates, candidate = x[: 2 * h], g[2 * h:]
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(self.tables[way], symbols[t], 0, out=near, mode="clip")
            np.copyto(x, near.T)
            np.matmul(self.recurrent[way], state, out=g)
            gates += g[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            candidate *= gates[h:]
            candidate += x[2 * h:]
            np.tanh(candidate, out=candidate)
            state -= candidate
            state *= gates[:h]
            state += candidate
            yield t, state

    def positions(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Position and class probabilities (class by stretch), from the last position to the first."""
        forward = np.empty((len(symbols), self.units, symbols.shape[1]), "f4")
        for t, state in self._states(symbols, 0):
            forward[t] = state
        for t, state in self._states(symbols, 1):
            p = self.out[0] @ forward[t]
            p += self.out[1] @ state
            p += self.bias
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            yield t, p

    def _blocks(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Symbols by position, lengths, owners and row numbers of blocks of stretches of like length."""
        laid, used, owner = lay_out(texts, STRETCH)
        order = np.argsort(-used, kind="stable")
        for at in range(0, len(order), LANES):
            rows = order[at:at + LANES]
            yield np.ascontiguousarray(laid[rows, : used[rows[0]]].T).astype(np.intp), used[rows], owner[rows], rows

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean class probabilities over all positions of each text; an empty text has zeros."""
        sums = np.zeros((self.classes, len(texts)))
        for symbols, used, owner, _ in self._blocks(texts):
            total = np.zeros((self.classes, len(used)), "f4")
            for t, p in self.positions(symbols):
                n = int(np.searchsorted(-used, -t))  # stretches longer than t, as lengths fall
                total[:, :n] += p[:, :n]
            for c in range(self.classes):
                sums[c] += np.bincount(owner, total[c], len(texts))
        return (sums / np.maximum([len(t) for t in texts], 1)).T

    def labels(self, texts: list[bytes]) -> list[np.ndarray]:
        """Class of every byte of each text."""
        parts: dict[int, np.ndarray] = {}
        for symbols, used, _, rows in self._blocks(texts):
            found = np.empty(symbols.shape, np.int16)
            for t, p in self.positions(symbols):
                found[t] = p.argmax(0)
            parts |= {r: found[:n, k] for k, (r, n) in enumerate(zip(rows.tolist(), used.tolist()))}
        whole = np.concatenate([parts[r] for r in range(len(parts))]) if parts else np.zeros(0, np.int16)
        return np.split(whole, np.cumsum([len(t) for t in texts])[:-1])


def _forward(table: np.ndarray, u: np.ndarray, symbols: np.ndarray, order: range) -> tuple[np.ndarray, dict[int, tuple]]:
    h, lanes = u.shape[0], symbols.shape[1]
    states, seen, state = np.empty((len(symbols), lanes, h), "f4"), {}, np.zeros((lanes, h), "f4")
    for t in order:
        x, g = table[symbols[t]], state @ u
        gates = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
        keep, reset, inner = gates[:, :h], gates[:, h:], g[:, 2 * h:]
        candidate = np.tanh(x[:, 2 * h:] + reset * inner)
        seen[t] = (state, keep, reset, inner, candidate)
        state = candidate + keep * (state - candidate)
        states[t] = state
    return states, seen


def _backward(u: np.ndarray, symbols: np.ndarray, order: range, seen: dict[int, tuple], outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of the recurrent weights, through time; ``outer`` is the gradient at the states."""
    h = u.shape[0]
    into, du, dstate = np.empty((*symbols.shape, 3 * h), "f4"), np.zeros_like(u), np.zeros(outer.shape[1:], "f4")
    for t in reversed(order):
        before, keep, reset, inner, candidate = seen[t]
        dstate = dstate + outer[t]
        dcandidate = dstate * (1 - keep) * (1 - candidate * candidate)
        dkeep = dstate * (before - candidate) * keep * (1 - keep)
        dreset = dcandidate * inner * reset * (1 - reset)
        into[t] = np.concatenate([dkeep, dreset, dcandidate], 1)
        dg = np.concatenate([dkeep, dreset, dcandidate * reset], 1)
        du += before.T @ dg
        dstate = dstate * keep + dg @ u.T
    flat = symbols.ravel()
    columns = into.reshape(-1, 3 * h)
    return np.stack([np.bincount(flat, columns[:, k], PAD + 1) for k in range(3 * h)], 1).astype("f4"), du


def gradients(net: Network, symbols: np.ndarray, used: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions, and its gradients: both tables, both recurrent weights, output layer, bias."""
    steps, h = len(symbols), net.recurrent[0].shape[0]
    orders = (range(steps), range(steps - 1, -1, -1))
    runs = [_forward(t, u, symbols, o) for t, u, o in zip(net.tables, net.recurrent, orders)]
    both = np.concatenate([runs[0][0], runs[1][0]], 2)
    logits = both @ net.out + net.bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    weight = ((np.arange(steps)[:, None] < used) / used.sum()).astype("f4")
    lanes = np.arange(len(wanted))
    loss = float(-(np.log(p[:, lanes, wanted] + 1e-9) * weight).sum())
    p[:, lanes, wanted] -= 1
    p *= weight[:, :, None]
    flat = p.reshape(-1, p.shape[2])
    outer = p @ net.out.T
    back = [_backward(u, symbols, o, seen, outer[:, :, k * h:(k + 1) * h]) for k, (u, o, (_, seen)) in enumerate(zip(net.recurrent, orders, runs))]
    return loss, [back[0][0], back[1][0], back[0][1], back[1][1], both.reshape(-1, 2 * h).T @ flat, flat.sum(0)]


def train(pieces: list[bytes], labels: list[str], steps: int = STEPS, units: int = UNITS, seed: int = 7) -> Network:
    """Back-propagation through time with Adam; every language has the same share of a batch."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    keep = np.r_[np.full(units, 1.0), np.zeros(2 * units)]  # states are kept at first
    net = Network(
        langs, [(rng.normal(0, 0.3, (PAD + 1, 3 * units)) + keep).astype("f4") for _ in range(2)], [rng.normal(0, 0.4 / np.sqrt(units), (units, 3 * units)).astype("f4") for _ in range(2)],
        rng.normal(0, 0.3, (2 * units, len(langs))).astype("f4"), np.zeros(len(langs), "f4"))
    shut = np.r_[np.full(units, SHUT), np.zeros(2 * units)].astype("f4")
    laid, used, owner = lay_out(pieces, PIECE)
    label = np.searchsorted(langs, labels)[owner]
    groups = [np.flatnonzero(label == c) for c in range(len(langs))]
    weights = [*net.tables, *net.recurrent, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        for table in net.tables:
            table[PAD] = shut
        classes = rng.integers(0, len(langs), BATCH)
        rows = np.array([groups[c][int(r * len(groups[c]))] for c, r in zip(classes, rng.random(BATCH))])
        _, found = gradients(net, laid[rows].T.astype(np.intp), used[rows], label[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        rate = 0.02 * min(1.0, 2.0 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for w, g, m, v in zip(weights, found, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * m / (np.sqrt(v) + 1e-8)).astype("f4")
    for table in net.tables:
        table[PAD] = shut
    return net


def fit(docs: DataFrame, folds: int, held: int, rows: int = TRAIN_ROWS, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on at most ``rows`` documents outside the held fold, in one executor task; None without a labelled text.

    The ids with the least hashes are taken, whatever the storage; a language that is rarer than one document in
    ``rows`` may not be learnt. Of each text two stretches at hashed places are learnt from. Rows without id, text
    or language are left out. The ids are broadcast: there are at most ``rows`` of them.
    """
    known = docs.select(F.col(doc).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.filter((F.col("id").isNotNull()) & F.col("lang").isNotNull() & (F.col("text") != "") & (fold(F.col("id"), folds) != held))
    place = F.xxhash64("id")
    # A few times as many ids as needed pass to the sort, however many documents there are.
    share = min(1.0, 4.0 * rows / max(1, known.count()))
    some = known.select("id", place.alias("place")).filter(F.expr(f"shiftrightunsigned(place, 11) <= cast({share} * {1 << 53} as bigint)"))
    some = some.distinct().orderBy("place", "id").limit(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts = batch.column("place").to_pylist(), as_bytes(batch.column("text"))
            spots = [[(p * k >> 7) % max(1, len(t) - PIECE + 1) for k in range(1, PIECES + 1)] for p, t in zip(places, texts)]
            pieces = [[t[s:s + PIECE] for s in at] for t, at in zip(texts, spots)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(pieces, pa.list_(pa.binary()))], ["place", "lang", "pieces"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(piece, label) for b in batches for label, pieces in zip(b.column("lang").to_pylist(), b.column("pieces").to_pylist()) for piece in pieces]
        if rows:
            yield pa.record_batch([pa.array([train([p for p, _ in rows], [label for _, label in rows]).to_bytes()], pa.binary())], names=["network"])

    sample = known.join(F.broadcast(some), "id").select("place", "lang", "text").mapInArrow(cut, "place long, lang string, pieces array<binary>")
    made = sample.orderBy("place", "lang", "pieces").limit(rows).mapInArrow(learn, "network binary").collect()
    return Network.from_bytes(bytes(made[0].network)) if made else None


def predictions(docs: DataFrame, folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (mean probability of that language over all bytes) of every row.

    A text is read in stretches of 128 bytes, each from a zero state in both directions; every byte gets class
    probabilities, which are averaged over the whole text. Null texts, texts without a letter, and all texts
    where nothing could be learnt, are ``und`` with score 0. Equal texts get equal predictions, ties go to the
    first language by name, repeated rows are rows of their own, null ids stay null (and are not held out,
    nor learnt from), an empty table has no rows. Other columns are not read. The network of some 50 KB is broadcast.
    """
    net = fit(docs, folds, held, rows, doc, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(net.to_bytes() if net else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.from_bytes(shared.value) if shared.value else None
        reader = Reader(net) if net else None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = as_bytes(part.column("text"))
                if reader:
                    pooled = reader.pooled(texts)
                    top = pooled.argmax(1)
                    names, scores = [net.langs[k] for k in top.tolist()], np.round(pooled[np.arange(len(top)), top], 6).clip(0, 1)
                else:
                    names, scores = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("letters"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "letters", "lang", "score"])

    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    # A text without a letter need not be read.
    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), letters.alias("letters"), F.when(letters, F.col(text).cast("string")).alias("text"))
    found = texts.mapInArrow(run, "doc_id long, letters boolean, lang string, score double")
    return found.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def spans(docs: DataFrame, net: Network, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (byte offsets) and lang of each maximal run of bytes with one label; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(net.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.from_bytes(shared.value)
        reader = Reader(net)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, texts, out = part.column("doc_id").to_pylist(), as_bytes(part.column("text")), []
                for k, found in enumerate(reader.labels(texts)):
                    cuts = np.flatnonzero(np.diff(found, prepend=-1)).tolist()
                    out += [(ids[k], a, b, net.langs[found[a]]) for a, b in zip(cuts, [*cuts[1:], len(found)])]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "start", "end", "lang"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, lang string")
