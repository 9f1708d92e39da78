"""Numpy kernels of the repeated-substring operator: anchors of windows, suffix arrays, common prefixes."""
from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
#: Multipliers of the rolling hash and of its final mix; any odd 64-bit numbers do.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a packed position, and bytes of a stretch whose anchors are searched at once.
POSITION_BITS, STRETCH_BYTES = 23, 1 << 20


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a power of two) that start at each position."""
    h, power, width = data.astype(np.uint64) + ONE, int(BASE), 1
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % 2**64
        width *= 2
    h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima inside blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def window_anchors(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Anchors of all ``window``-byte windows of the texts that lie one after another in ``data``.

    A window's anchor is its gram of least hash, the leftmost of equal ones: equal windows have equal
    anchors at the same offset. Returns, for each run of windows with one anchor inside one text: first
    window, last window, anchor position, anchor hash.

    Data of any size is searched in stretches that overlap by all but one byte of a window, so that each
    window lies whole in one of them; runs that go on in the next stretch are joined.
    """
    size = min(max(STRETCH_BYTES, 2 * window), 1 << POSITION_BITS)
    if size < window:
        raise ValueError(f"windows of over {size} bytes")
    found = []
    for start in range(0, max(1, len(data) - window + 1), size - window + 1):
        first, last, anchor, hashes = _stretch_anchors(data[start : start + size], ends - start, window, gram)
        found.append((first + start, last + start, anchor + start, hashes))
    if len(found) == 1:
        return found[0]
    first, last, anchor, hashes = map(np.concatenate, zip(*found))
    if not len(first):
        return first, last, anchor, hashes
    # An anchor lies inside the text of its windows, so one anchor is one text.
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return first[new], last[np.r_[new[1:] - 1, len(first) - 1]], anchor[new], hashes[new]


def _stretch_anchors(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """The same for at most 2**POSITION_BITS bytes; ``ends`` may lie outside of them."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_minimum(packed, window - gram + 1) & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(at)), "right")
    starts = np.flatnonzero(np.arange(len(at)) + window <= ends[text])
    if not len(starts):
        return none, none, none, none
    anchor, owner = at[starts], text[starts]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return starts[new], starts[last], anchor[new], hashes[anchor[new]].view(np.int64)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling in the manner of Larsson and Sadakane, exact for the first ``depth`` bytes.

    Some bytes sort at once; then only groups that are still tied are refined by the rank ``h`` bytes on,
    with ``h`` doubling. Positions past the end rank lowest. Up to 2**21 bytes, a sort key and its position
    share one 64-bit integer.
    """
    n = len(data)
    bits = max(1, int(n).bit_length())
    packs = 3 * bits <= 63
    h = min(7, (63 - bits) // 9) if packs else 7
    padded = np.zeros(n + h, np.int64)
    padded[:n] = data
    padded[:n] += 1
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << 9) | padded[k : n + k]

    def arranged(key, at):
        """Positions and keys in the order of the keys."""
        if packs:
            both = np.sort((key << bits) | at)
            return both & ((1 << bits) - 1), both >> bits
        within = np.argsort(key, kind="stable")
        return at[within], key[within]

    order, key = arranged(key, np.arange(n))
    rank = np.zeros(n + 1, np.int64)
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    slots, size = np.arange(n), n
    while True:
        # A rank is one more than the place where its group begins; zero is past the end.
        begins = np.flatnonzero(head[slots])
        lengths = np.diff(np.append(begins, size))
        rank[order[slots]] = np.repeat(slots[begins] + 1, lengths)
        slots = slots[np.repeat(lengths > 1, lengths)]
        size = len(slots)
        if h >= depth or not size:
            return order
        some = order[slots]
        key = (rank[some] << bits) | rank[np.minimum(some + h, n)]
        order[slots], key = arranged(key, some)
        head[slots[1:]] = key[1:] != key[:-1]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's common prefixes of neighbours in ``order``, up to ``limit``; entry 0 is 0.

    In text order a value is one less than that of the position before whenever both neighbours are
    preceded by the same byte, so only the other positions compare bytes, eight at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    fresh = (before < 1) | (here == 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = (data[inner - 1] != data[before[inner] - 1]) | (before[inner - 1] != before[inner] - 1)
    at = np.flatnonzero(fresh)
    a, b = at, before[at]
    size = np.zeros(len(at), np.int64)
    enough = limit + np.diff(np.append(at, n))  # the positions up to the next fresh one count down from here
    live = np.flatnonzero(b >= 0)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        i, j = a[live] + size[live], b[live] + size[live]
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        if not len(live):
            break
        differ = words[i] != words[j]
        step = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        size[live] += np.minimum(step, n - np.maximum(i, j))
        live = live[(step == 8) & (size[live] < enough[live])]
    run = np.cumsum(fresh) - 1
    text_order = np.maximum(size[run] - (here - at[run]), 0)
    return np.minimum(text_order[order], limit)
