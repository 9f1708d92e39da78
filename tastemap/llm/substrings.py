"""Removal of byte strings that occur twice or more, by suffix arrays over shards of what may repeat."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, free, hash_filter, passes, row_key, slices, whole_groups, written
from .suffix_arrays import common_prefixes, suffix_order, window_anchors

#: Bytes of a gram that can anchor a window.
GRAM = 32
#: Bytes that the anchor search takes at once, and contexts of one group that still go to one shard.
SLICE_BYTES, GROUP_CONTEXTS = 1 << 18, 500
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 18
#: Windows in a part of a context when a group with more contexts is split, level after level.
PARTS = (32, 4, 1)
_CONTEXT = "grp long, ctx binary, k binary, lo int, size int, at int"


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], bytes, np.ndarray]]:
    """Row keys, texts one after another, and where each text ends; about SLICE_BYTES at a time."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            texts = as_bytes(part.column("text"))
            yield part.column("k").to_pylist(), b"".join(texts), np.cumsum([len(t) for t in texts])


def _anchor_hashes(batches, window: int):
    for _, data, ends in _slices(batches):
        *_, hashes = window_anchors(np.frombuffer(data, np.uint8), ends, window, GRAM)
        yield pa.record_batch([pa.array(hashes)], names=["h"])


def _contexts(batches, window: int, filter_):
    """Contexts of the anchors that may repeat: the bytes of all windows that have the anchor."""
    bits = filter_.value
    names = [f.split()[0] for f in _CONTEXT.split(", ")]
    for keys, data, ends in _slices(batches):
        lo, hi, at, hashes = window_anchors(np.frombuffer(data, np.uint8), ends, window, GRAM)
        some = passes(bits, hashes)
        lo, hi, at, hashes = lo[some], hi[some], at[some], hashes[some]
        text = np.searchsorted(ends, lo, "right")
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        ctx = [_digest(data[a : z + window]) for a, z in zip(lo.tolist(), hi.tolist())]
        columns = [
            pa.array(hashes), pa.array(ctx, pa.binary()), pa.array([keys[t] for t in text.tolist()], pa.binary()),
            pa.array((lo - begins[text]).astype(np.int32)), pa.array((hi - lo + window).astype(np.int32)), pa.array((at - lo).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def _parts(row: tuple, window: int, part: int) -> Iterator[tuple[int, int, int]]:
    """Parts of a context, ``part`` windows at the same distance from the anchor: group, first and last start.

    The group is a hash of the bytes that all windows of the part share, cut as in a longer context.
    """
    group, _, _, at, data = row
    last = len(data) - window
    for p in range((at - last) // part, at // part + 1):
        highest, lowest = at - p * part, at - p * part - part + 1
        shared = b"%d:%d:" % (group, p) + data[highest : lowest + window]
        yield int.from_bytes(_digest(shared)[:8], "big", signed=True), max(lowest, 0), min(highest, last)


_LARGE = ("grp", "k", "lo", "at", "data")


def _part_groups(batches, window: int, part: int):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in _LARGE))
        yield pa.record_batch([pa.array([group for row in rows for group, _, _ in _parts(row, window, part)], pa.int64())], names=["h"])


def _split_contexts(batches, window: int, part: int, filter_):
    """The parts whose group may repeat, as contexts with their bytes."""
    names = [f.split()[0] for f in _CONTEXT.split(", ")] + ["data"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row in zip(*(batch.column(c).to_pylist() for c in _LARGE)):
            _, k, lo, at, data = row
            parts = list(_parts(row, window, part))
            for (group, a, z), some in zip(parts, passes(filter_.value, np.array([g for g, _, _ in parts], np.int64))):
                if some:
                    bytes_ = data[a : z + window]
                    for column, value in zip(out, (group, _digest(bytes_), k, lo + a, z - a + window, at - a, bytes_)):
                        column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)


def _shard_marks(batches, window: int, shard_bytes: int):
    """Repeated windows among the contexts of whole groups, which come one after another, as runs of starts.

    Shards are closed by size. A group that goes on in the next shards is merged across them before their
    marks leave; the shards of one group are few, as the group is bounded.
    """
    held: list[tuple] = []
    waiting: list[Shard] = []  # closed shards that end with the group at hand
    size, group = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "k", "lo", "copies", "data"))):
            if size >= shard_bytes:
                shard = Shard(held, window)
                _merge(waiting, shard)
                goes_on = row[0] == group
                if not goes_on or held[0][0] != group:
                    # Only the last group of a shard can go on; what waited for another one is done.
                    yield from (s.marks() for s in waiting)
                    waiting = []
                if goes_on:
                    waiting.append(shard)
                else:
                    yield shard.marks()
                held, size = [], 0
            group = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        shard = Shard(held, window)
        _merge(waiting, shard)
        yield from (s.marks() for s in [*waiting, shard])


def _merge(waiting: list[Shard], shard: Shard) -> None:
    for other in waiting:
        shard.meet(other)


class Shard:
    """Suffix array of some contexts, with runs of suffixes that share a whole window."""

    def __init__(self, rows: list[tuple], window: int) -> None:
        self.rows, self.window = rows, window
        self.data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        self.ends = np.cumsum([len(r[4]) for r in rows])
        self.order = suffix_order(self.data, window)
        near = common_prefixes(self.data, self.order, window) >= window
        owner = np.searchsorted(self.ends, self.order, "right")
        self.run = np.cumsum(~near) - 1
        # Suffixes that hold a window of their own context. A window of a text lies in one context only, so two
        # of them in a run are two places.
        self.whole = np.flatnonzero(self.order + window <= self.ends[owner])
        owner, runs = owner[self.whole], self.run[self.whole]
        copied = np.array([r[3] > 1 for r in rows])[owner]
        n = int(self.run[-1]) + 1
        self.filled = np.bincount(runs, minlength=n) > 0
        self.repeated = np.bincount(runs, minlength=n) + np.bincount(runs, copied, n) > 1

    def words(self) -> np.ndarray:
        """Eight bytes from each position on, as numbers that order like the bytes; zeros past the end."""
        padded = np.zeros(len(self.data) + self.window + 8, np.uint8)
        padded[: len(self.data)] = self.data
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)

    def meet(self, other: Shard) -> None:
        """Marks the windows that this shard shares with ``other``, by binary search in its suffix array."""
        group = self.rows[0][0]
        last = next((i for i, r in enumerate(self.rows) if r[0] != group), len(self.rows))
        slots = self.whole[self.order[self.whole] < self.ends[last - 1]]
        if other.rows[-1][0] != group or not len(slots):
            return
        starts, mine, theirs = self.order[slots], self.words(), other.words()
        n, tail = len(other.order), self.window % 8
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), n)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            less, equal = self._below(theirs, other.order[middle], mine, starts[live], len(other.data), tail)
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
        inside = np.flatnonzero(low < n)
        _, equal = self._below(theirs, other.order[low[inside]], mine, starts[inside], len(other.data), tail)
        found = inside[equal]
        runs = other.run[low[found]]
        found, runs = found[other.filled[runs]], runs[other.filled[runs]]
        other.repeated[runs] = True
        self.repeated[self.run[slots[found]]] = True

    def _below(self, theirs, a, mine, b, size: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffixes ``a`` come before the windows ``b``, and whether they begin with them."""
        less, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
        live = np.arange(len(a))
        for k in range(0, self.window, 8):
            x, y = theirs[a[live] + k], mine[b[live] + k]
            if k + 8 > self.window:
                x, y = x >> np.uint64(64 - 8 * tail), y >> np.uint64(64 - 8 * tail)
            differ = x != y
            less[live[differ]] = (x < y)[differ]
            equal[live[differ]] = False
            live = live[~differ]
            if not len(live):
                break
        short = equal & (a + self.window > size)  # ends early: it comes first
        return less | short, equal & ~short

    def marks(self) -> pa.RecordBatch:
        """k, lo, hi of the runs of repeated windows, whose starts follow one another in a context."""
        rows, window = self.rows, self.window
        begins = np.r_[0, self.ends[:-1]]
        starts = np.sort(self.order[self.whole[self.repeated[self.run[self.whole]]]])
        of = np.searchsorted(self.ends, starts, "right")
        new = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])]) if len(starts) else np.zeros(0, int)
        last = np.r_[new[1:] - 1, len(starts) - 1] if len(starts) else new
        row = of[new]
        lo = np.array([r[2] for r in rows], np.int64)[row] + starts[new] - begins[row]
        hi = lo + starts[last] - starts[new] + window
        return pa.RecordBatch.from_arrays([pa.array([rows[r][1] for r in row.tolist()], pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["k", "lo", "hi"])


def _cut_out(batches):
    """The bytes of the asked contexts of each text."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            out: list[list] = [[] for _ in range(7)]
            for asked, k, text in zip(part.column("asked").to_pylist(), part.column("k").to_pylist(), as_bytes(part.column("text"))):
                for a in asked:
                    for column, value in zip(out, (a["grp"], k, a["lo"], a["at"], a["copies"], a["hot"], text[a["lo"] : a["lo"] + a["size"]])):
                        column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["grp", "k", "lo", "at", "copies", "hot", "data"])


def _with_key(bits_of, wanted: bool = True):
    """Rows whose key passes a filter of keys; or, not wanted, the others."""

    def run(batches):
        for batch in batches:
            heads = np.array([int.from_bytes(k[:8], "big", signed=True) for k in batch.column("k").to_pylist()], np.int64)
            yield batch.filter(pa.array(passes(bits_of.value, heads) == wanted))

    return run


def _key_head(column: str = "k") -> Column:
    """The first eight bytes of a row key as a number."""
    return F.conv(F.hex(F.substring(column, 1, 8)), 16, -10).cast("long")


def repeated_spans(rows: DataFrame, window: int = 400, group_contexts: int = GROUP_CONTEXTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``k``, ``lo``, ``hi`` of runs of bytes covered by repeated windows; ``rows`` has k and text. Runs may overlap.

    Every window has an anchor, its gram of least hash, and equal windows share it. So only anchors that occur
    twice matter: their contexts (all windows with that anchor) are compared, grouped by anchor. Equal contexts
    are counted first, on the map side; contexts with copies repeat as a whole. Where the contexts of an anchor
    differ, one of each goes to a shard, where a suffix array with common prefixes finds the repeated windows.

    Shards take whole anchors in turn, so equal windows of any documents meet in one shard, or, when a group
    spans several, by binary search of its windows in the suffix arrays of the earlier ones. An anchor
    with more than ``group_contexts`` different contexts (a passage in very many documents) is split by longer
    shared strings, found around the same anchor, until its parts are small; a part of one window is decided by
    its count. Nothing is dropped on the way.
    """
    anchors = rows.mapInArrow(lambda b: _anchor_hashes(b, window), "h long")
    twice = hash_filter(anchors.groupBy("h").count().filter("count > 1"), "h")
    contexts = written(rows.mapInArrow(lambda b: _contexts(b, window, twice), _CONTEXT))
    marks = None
    for part in (*PARTS, 0):
        distinct = contexts.groupBy("grp", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("k", "lo", "size", "at")).alias("rep"))
        distinct = written(distinct.select("grp", "ctx", "copies", "rep.*"))
        # A context's digest covers its anchor, so it finds its copies alone.
        whole = written(contexts.select("ctx", "k", "lo", "size").join(distinct.filter("copies > 1").select("ctx"), "ctx", "left_semi").select("k", "lo", (F.col("lo") + F.col("size")).alias("hi")))
        marks = whole if marks is None else marks.union(whole)
        if not part:
            free(contexts, distinct)
            return marks
        widths = written(distinct.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp", (F.col("n") > group_contexts).alias("hot")))
        asked, lists = distinct.join(widths, "grp").select("grp", "k", "lo", "size", "at", "copies", "hot"), []
        if "data" in contexts.columns:
            cut = asked.join(contexts.select("grp", "k", "lo", "data").distinct(), ["grp", "k", "lo"]).select("grp", "k", "lo", "at", "copies", "hot", "data")
        else:
            asked = written(asked.groupBy("k").agg(F.collect_list(F.struct("grp", "lo", "size", "at", "copies", "hot")).alias("asked")))
            lists.append(asked)
            needed = hash_filter(asked.select(_key_head().alias("h")), "h")
            texts = rows.mapInArrow(_with_key(needed), rows.schema)
            cut = texts.join(asked, "k").mapInArrow(_cut_out, "grp long, k binary, lo int, at int, copies long, hot boolean, data binary")
        cut = written(cut)
        free(contexts, distinct, *lists)
        any_hot = not widths.filter("hot").isEmpty()
        shards = whole_groups(cut.filter("not hot"), "grp").sortWithinPartitions("grp")
        marks = marks.union(written(shards.mapInArrow(lambda b: _shard_marks(b, window, shard_bytes), "k binary, lo int, hi int")))
        if not any_hot:
            free(cut, widths)
            return marks
        large = cut.filter("hot")
        # A context with copies goes in as often as needed for its parts to count as repeated.
        large = large.withColumn("twice", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        large = written(large.select(*_LARGE))
        free(cut, widths)
        groups = large.mapInArrow(lambda b, part=part: _part_groups(b, window, part), "h long")
        again = hash_filter(groups.groupBy("h").count().filter("count > 1"), "h")
        contexts = written(large.mapInArrow(lambda b, part=part, again=again: _split_contexts(b, window, part, again), _CONTEXT + ", data binary"))
        free(large)
    return marks


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = 400, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (``content``) of every row.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same document
    or another; overlapping occurrences count, and strings are judged on the input. Matches never cross
    documents. Null text is empty. Rows equal in id and text are two documents, each repeated by the other.
    Texts shorter than ``window`` stay whole. Other columns are not read.
    """
    rows = docs.select(row_key(doc, text).alias("k"), F.col(text).cast("string").alias("text"))
    spans = repeated_spans(rows, window, **limits)
    # Runs of one text are merged to few before they travel as one list, which its length bounds.
    marks = written(spans.distinct().groupBy("k").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")))
    keyed = docs.select(row_key(doc, text).alias("k"), F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hit = hash_filter(marks.select(_key_head().alias("h")), "h")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 * SLICE_BYTES):
                texts = as_bytes(part.column("text"))
                spans = part.column("spans").to_pylist() if "spans" in part.schema.names else [None] * len(texts)
                yield _result(part.column("doc_id"), texts, [[(s["lo"], s["hi"]) for s in x or ()] for x in spans])

    def untouched(batches):
        return cut(_with_key(hit, wanted=False)(batches))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, content binary"
    rest = keyed.mapInArrow(_with_key(hit), keyed.schema).join(marks, "k", "left").mapInArrow(cut, schema)
    return keyed.mapInArrow(untouched, schema).union(rest)


def _result(ids: pa.Array, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    rows = []
    for text, some in zip(texts, spans):
        kept, end, removed, runs = [], 0, 0, 0
        for lo, hi in some:
            if lo > end or not runs:
                kept.append(text[end:lo])
                runs += 1
                end = lo
            removed += max(0, hi - end)
            end = max(end, hi)
        kept.append(text[end:])
        rows.append((len(text), removed, runs, b"".join(kept)))
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "content"])
