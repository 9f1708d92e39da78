"""Exact Jaccard join of word shingle sets in metric space: pivots, regions, triangle-inequality windows."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_slices, free, hash_filter, passes, row_key, slices, whole_groups, written
from .components import connected_components

#: Shingles that count as frequent: seen this often in so many bytes of text; the most frequent are broadcast.
BATCH_BYTES, BATCH_FREQUENT, FREQUENT = 8 << 20, 4, 100_000
#: Documents and shingles (one document counts 200 more) of a region that one task joins in memory.
REGION_ROWS, REGION_WEIGHT = 500, 1 << 20
#: Documents of a region whose outlines one task compares.
OUTLINE_ROWS = 4_000
#: Times a larger region is cut by a new pivot before its blocks are joined one by one.
LEVELS = 3
#: Counters of the outline of a set, and of a set of LONG shingles or more; the sum of the differences between two
#: outlines is at most the symmetric difference of the sets, also where counters stop at FULL.
OUTLINE, LONG_OUTLINE, LONG, FULL = 64, 512, 1_000, 255
#: Pivots of one step inside a task, and documents that are compared directly.
PIVOTS, LEAF = 6, 24
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _shingles(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of the text's shingles of ``size`` words, in their order and with repeats.

    Words are parted by ASCII blanks, A-Z lower-cased. A text of fewer words is one shingle, none without words.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    # Hashing each word anew takes less time than looking it up, and no memory.
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        total = (total * _A) ^ (h[k : n - width + 1 + k] * _B)
        total += total >> np.uint64(31)
    total *= _C
    total ^= total >> np.uint64(29)
    total *= _D
    return total.view(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of ``size`` words."""
    return [_distinct(_shingles(text, size)) for text in texts]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def outline(shingles: np.ndarray) -> bytes:
    """Shingles by hash bucket, one byte each."""
    size = LONG_OUTLINE if len(shingles) >= LONG else OUTLINE
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(20)).astype(np.int64) % size, minlength=size)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def _with_possible_partner(sizes: np.ndarray, outlines: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members of a region may link with another, by sizes and outlines: sets that link differ by little."""
    able = np.zeros(len(sizes), bool)
    short = np.minimum(np.stack([o.reshape(-1, OUTLINE).sum(0) for o in outlines]), FULL)  # bucket numbers modulo OUTLINE
    for i in range(len(sizes) - 1):
        n, m = sizes[i], sizes[i + 1 :]
        apart = n + m - 2 * -(-percent * (n + m) // (100 + percent))  # most elements that may be in one of the two only
        close = np.flatnonzero(apart >= abs(m - n))
        if len(close):
            close = close[np.abs(short[i] - short[i + 1 :][close]).sum(1) <= apart[close]]
            if n >= LONG:
                close = np.array([c for c in close.tolist() if m[c] < LONG or np.abs(outlines[i] - outlines[i + 1 + c]).sum() <= apart[c]], np.int64)
            able[i] |= len(close) > 0
            able[i + 1 + close] = True
    return able


def _possible_members(batches: Iterator[pa.RecordBatch], percent: int):
    """Members of whole regions, which come one after another, that may have a partner there."""
    region, ids, sizes, outlines = None, [], [], []

    def release():
        able = _with_possible_partner(np.array(sizes, np.int64), outlines, percent)
        some = [u for u, ok in zip(ids, able.tolist()) if ok]
        return pa.RecordBatch.from_arrays([pa.array([region] * len(some), pa.string()), pa.array(some, pa.int64())], ["region", "uid"])

    for batch in batches:
        for name, uid, n, shape in zip(*(batch.column(c).to_pylist() for c in ("region", "uid", "n", "outline"))):
            if name != region:
                if len(ids) > 1:
                    yield release()
                region, ids, sizes, outlines = name, [], [], []
            ids.append(uid)
            sizes.append(n)
            outlines.append(np.frombuffer(shape, np.uint8).astype(np.int64))
    if len(ids) > 1:
        yield release()


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in order of frequency, then hash: two sets that link share one of them."""
    n = len(shingles)
    need = n + percent * n // -100 + 1  # n less the smallest overlap, plus one
    at = np.minimum(np.searchsorted(common, shingles), max(0, len(common) - 1))
    often = common[at] == shingles if len(common) else np.zeros(n, bool)
    rare = shingles[~often][:need]
    if len(rare) < need:
        some, count = shingles[often], counts[at[often]]
        rare = np.concatenate([rare, some[np.lexsort((some, count))][: need - len(rare)]])
    return rare


class Region:
    """Sets of one region in memory, joined recursively; ``links`` holds enough links for its components."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.reach = percent, 1 - percent / 100 + 1e-9
        self.sizes = np.array([len(s) for s in sets])
        every, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]]
        self.mark = np.zeros(len(every), bool)
        self.parent = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def roots(self, members: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = self.parent = q
        return p[members]

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Jaccard distance of the members to a pivot; members within reach are linked with it."""
        own = self.ids[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]
        self.mark[own] = True
        sizes = self.sizes[members]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[members] - ends + sizes, sizes)
        shared = np.add.reduceat(self.mark[self.ids[at]], np.r_[0, ends[:-1]], dtype=np.int64)
        self.mark[own] = False
        union = sizes + self.sizes[pivot] - shared
        for other in members[100 * shared >= self.percent * union].tolist():
            a, b = self.root(pivot), self.root(other)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((pivot, other))
        return 1 - shared / union

    def join(self, members: np.ndarray) -> None:
        """Links the members so that any two within reach end in one component."""
        if len(members) < 2 or (self.roots(members) == self.parent[members[0]]).all():
            return
        if len(members) <= LEAF:
            self.compare(members)
            return
        pivots, table = [int(members[0])], []
        for _ in range(PIVOTS):
            table.append(self.distances(pivots[-1], members))
            least = np.min(table, axis=0)
            pivots.append(int(members[least.argmax()]))  # the document farthest from all pivots comes next
            if least.max() <= 0:
                break
        table = np.array(table)
        # A document lies in the region of its nearest pivot, and in others that its partners may lie in.
        cells = [members[row - least <= 2 * self.reach] for row in table]
        if max(map(len, cells)) > 0.8 * len(members) or sum(map(len, cells)) > 2 * len(members):
            self.compare(members)
            return
        for cell in cells:
            self.join(cell)

    def compare(self, members: np.ndarray) -> None:
        """Takes documents outside the largest component as pivots, each against those its windows allow.

        Two documents in different components at the end cannot link: one of them was a pivot.
        """
        used = np.zeros(len(members), bool)
        table: list[np.ndarray] = []
        while True:
            roots = self.roots(members)
            names, sizes = np.unique(roots, return_counts=True)
            if len(names) == 1:
                return
            left = np.flatnonzero(~used & (roots != names[sizes.argmax()]))
            if not len(left):
                return
            at = int(left[0])
            used[at] = True
            near = roots != roots[at]
            for row in table:
                near &= np.abs(row - row[at]) <= self.reach
            if len(table) < PIVOTS:
                table.append(self.distances(int(members[at]), members))
            elif near.any():
                self.distances(int(members[at]), members[near])


def _joined_regions(batches: Iterator[pa.RecordBatch], size: int, percent: int):
    """Links of whole regions, which come one after another."""
    region, ids, sets = None, [], []

    def release():
        work = Region(sets, percent)
        work.join(np.arange(len(sets)))
        a, b = ([ids[x[k]] for x in work.links] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for name, uid, text in zip(batch.column("region").to_pylist(), batch.column("uid").to_pylist(), as_bytes(batch.column("text"))):
            if name != region:
                if len(ids) > 1:
                    yield release()
                region, ids, sets = name, [], []
            ids.append(uid)
            sets += shingle_sets([text], size)
    if len(ids) > 1:
        yield release()


def _pivot_distances(batches, size: int, percent: int):
    """region, uid, pivot and distance of rows that carry their text and the text of their pivot."""
    reach = 1 - percent / 100
    for batch in batches:
        mine = shingle_sets(as_bytes(batch.column("text")), size)
        texts = as_bytes(batch.column("pivot_text"))
        cache = {t: s for t, s in zip(set(texts), shingle_sets(list(set(texts)), size))}
        rings, linked = [], []
        for own, text in zip(mine, texts):
            other = cache[text]
            shared = len(np.intersect1d(own, other, assume_unique=True))
            union = len(own) + len(other) - shared
            linked.append(100 * shared >= percent * union)
            rings.append(0 if linked[-1] else 1 + int((1 - shared / union - reach) / reach - 1e-9))
        yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("uid"), batch.column("pivot"), pa.array(rings, pa.int32()), pa.array(linked)], ["region", "uid", "pivot", "ring", "linked"])


def _region_links(regions: DataFrame, texts: DataFrame, weights: DataFrame, size: int, percent: int, rows: int, weight: int, scratch: list[DataFrame]) -> DataFrame:
    """Links of all regions (``region``, ``uid``), the large ones cut into smaller regions first.

    A large region gets a pivot, and rings by distance to it, each as wide as two linked documents can be
    apart. Documents link only within a ring or with the ring before, so ring and ring before are a new region;
    those in the first ring are linked with the pivot and need no join among themselves. Regions that stay
    large after LEVELS pivots are joined by blocks: documents outside the first ring against all.
    Tables it writes go to ``scratch``.
    """
    out = None

    def add(links: DataFrame) -> None:
        nonlocal out
        out = links if out is None else out.union(links)

    for level in range(LEVELS + 2):
        sized = regions.join(weights, "uid").groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.col("n") + 200).alias("weight"), F.min("uid").alias("first"), F.max("uid").alias("last"))
        large = written(sized.filter(((F.col("rows") > rows) | (F.col("weight") > weight)) & (F.col("rows") > 2)))
        scratch.append(large)
        any_large = not large.isEmpty() and level <= LEVELS
        small = regions.join(large, "region", "left_anti") if any_large else regions
        packed = whole_groups(small.join(texts, "uid"), "region").sortWithinPartitions("region", "uid")
        add(packed.select("region", "uid", "text").mapInArrow(lambda b: _joined_regions(b, size, percent), "a long, b long"))
        if not any_large:
            return out
        pivots = large.select("region", F.when(F.lit(level % 2 == 0), F.col("first")).otherwise(F.col("last")).alias("pivot"), "rows", "weight")
        named = written(pivots.join(texts.select(F.col("uid").alias("pivot"), F.col("text").alias("pivot_text")), "pivot"))
        told = regions.join(texts, "uid").join(named, "region").filter("uid != pivot").select("region", "uid", "pivot", "text", "pivot_text")
        told = written(told.mapInArrow(lambda b: _pivot_distances(b, size, percent), "region string, uid long, pivot long, ring int, linked boolean"))
        scratch += [named, told]
        add(told.filter("linked").select(F.col("pivot").alias("a"), F.col("uid").alias("b")))
        name = lambda *parts: F.concat_ws("/", "region", *[p.cast("string") for p in parts])
        if level < LEVELS:
            again = F.explode(F.when(F.col("ring") > 0, F.array("ring", F.col("ring") + 1)).otherwise(F.array(F.lit(1))))
            spread = told.select("region", "uid", again.alias("r"), "ring")
            # A ring without documents of its own has nothing to join.
            own = told.filter("ring > 0").select("region", F.col("ring").alias("r")).distinct()
            regions = spread.join(own, ["region", "r"], "left_semi").select(name(F.col("r")).alias("region"), "uid")
        else:
            block = max(2, rows // 2)
            count = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(n / block, F.col("weight") / F.col("rows") * n * 2 / weight))).cast("int")
            outer = told.filter("ring > 0").groupBy("region").agg(F.count("*").alias("outside"))
            sizes = written(named.select("region", "rows", "weight").join(outer, "region").select("region", count(F.col("outside")).alias("n_out"), count(F.col("rows")).alias("n_all")))
            dealt = told.join(sizes, "region").withColumn("h", F.xxhash64("uid"))
            every = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda i: F.struct(i.alias("i"), F.pmod("h", F.col("n_all")).cast("int").alias("j")))
            outside = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda j: F.struct(F.pmod("h", F.col("n_out")).cast("int").alias("i"), j.alias("j")))
            cells = F.array_distinct(F.when(F.col("ring") > 0, F.concat(every, outside)).otherwise(every))
            dealt = dealt.select("region", "uid", F.explode(cells).alias("cell"))
            regions = dealt.select(name(F.col("cell.i"), F.col("cell.j")).alias("region"), "uid")
        regions = written(regions.distinct())
        scratch.append(regions)
    return out


def _outlined(regions: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The regions without the members that size and outline show to have no partner there, before any text moves.

    Large regions are first cut by size into rings that hold all sizes which can link, each with the ring before.
    """
    scratch = []

    def by_size(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        sized = written(df.groupBy("region").agg((F.count("*") <= OUTLINE_ROWS).alias("small")))
        scratch.append(sized)
        return df.join(sized.filter("small"), "region", "left_semi"), df.join(sized.filter("not small"), "region", "left_semi")

    small, large = by_size(regions)
    ring = F.floor(F.log("n") / (float(np.log(100 / percent)) + 1e-9)).cast("int")
    rings = large.join(points.select("uid", "n"), "uid").select("region", "uid", F.explode(F.array(ring, ring + 1)).alias("ring"))
    rings = written(rings.select(F.concat_ws("~", "region", F.col("ring").cast("string")).alias("region"), "uid"))
    more, dense = by_size(rings)
    # Sizes alone rule out most members, in rows of a few bytes; the window holds at most OUTLINE_ROWS of a region.
    order = Window.partitionBy("region").orderBy("n")
    sized = small.union(more).join(points.select("uid", "n"), "uid").withColumns({"under": F.lag("n").over(order), "over": F.lead("n").over(order)})
    alike = (F.col("under") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("over") * percent)
    near = written(sized.filter(alike).select("region", "uid"))
    small = whole_groups(near.join(points, "uid"), "region").sortWithinPartitions("region", "uid").select("region", "uid", "n", "outline")
    out = written(small.mapInArrow(lambda b: _possible_members(b, percent), "region string, uid long").union(dense))
    free(rings, near, *scratch)
    return out


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 90, size: int = 3, rows: int = REGION_ROWS, weight: int = REGION_WEIGHT, by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id reachable by links, its own included.

    Two documents link when their sets of distinct ``size``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100, compared in whole numbers.

    Equal sets are one point of the metric space, whatever their copies. Linked sets share one of their rarest
    shingles; the points that share one gather round the least of them, their pivot, which makes the first
    regions (a point without such a neighbour is linked with nothing). Members whose size and outline (shingles
    counted by hash bucket) rule out a partner in a region leave it. Each region is joined exactly: pivots part it into Voronoi cells, points within twice the reach of a border are in both, and cells are joined
    recursively; pivots and triangle inequality rule out most comparisons. Regions too large for one task are
    first cut into rings by distance to the pivot, as a distributed step. A region gives only the links its
    components need.

    Null and empty texts, or texts of blanks, have no shingles and link with nothing. A row with a null id has a
    null component and takes no part. Rows that repeat an id are judged by their own text. Other columns are
    not read.

    Components apart from each other can have the same smallest id when ids repeat. With ``by_row``, the row key
    ``k`` and ``component``, a number of its own for each component (null for rows that take no part), follow.
    """
    base = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([row_key(doc, text).alias("k")] if by_row else []))
    mine = ["doc_id", "k"] if by_row else ["doc_id"]

    def frequent(batches):
        for part in (part for batch in batches for part in slices(batch, "text", BATCH_BYTES)):
            found, count = np.unique(np.concatenate(shingle_sets(as_bytes(part.column("text")), size)), return_counts=True)
            some = count >= BATCH_FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(count[some])], ["shingle", "n"])

    often = base.select("text").mapInArrow(frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas().sort_values("shingle")  # an order, not a selection
    order = docs.sparkSession.sparkContext.broadcast((often["shingle"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def signatures(batches):
        common, counts = order.value

        def one(texts):
            sets = shingle_sets(texts, size)
            keys = [prefix(s, common, counts, percent) if len(s) else s for s in sets]
            cuts = np.cumsum([0] + [len(k) for k in keys])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary()), pa.array(map(outline, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))]

        yield from by_slices(one, ["n", "digest", "outline", "keys"], "text", mine)(batches)

    signed = written(base.mapInArrow(signatures, f"doc_id long, {'k binary, ' if by_row else ''}n long, digest binary, outline binary, keys array<long>"))
    able = signed.filter("n > 0 and doc_id is not null")
    points = able.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("outline").alias("outline"), F.first("keys").alias("keys"))
    points = written(points.withColumn("uid", F.monotonically_increasing_id()))
    # Prefixes and outlines are the bulk of both tables; what is needed to the end is written apart, and the rest goes.
    ids = written(signed.select(*mine, "n", "digest"))
    free(signed)
    keys = points.select("uid", F.explode("keys").alias("key"))
    pivots = written(keys.groupBy("key").agg(F.min("uid").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot"))
    members = keys.join(pivots, "key").filter("uid != pivot").select("pivot", "uid").distinct()
    members = written(members)
    slim = written(points.select("uid", "rep", "n", "digest", "outline"))
    free(points, pivots)
    regions = members.union(members.select("pivot", F.col("pivot").alias("uid")).distinct()).select(F.col("pivot").cast("string").alias("region"), "uid")

    regions = _outlined(regions, slim.select("uid", "n", "outline"), percent)
    points = written(slim.drop("outline"))
    free(members, slim)
    # The largest region of a document is its main one. A region whose members all have one other main region lies
    # inside that one, and adds nothing.
    sized = written(regions.groupBy("region").agg(F.count("*").alias("size")))
    main = regions.join(sized, "region").groupBy("uid").agg(F.max(F.struct("size", "region"))["region"].alias("main"))
    mains = regions.join(main, "uid").groupBy("region").agg(F.min("main").alias("least"), F.max("main").alias("most"))
    inside = written(mains.filter("least = most and least != region").select("region"))
    outer = written(regions.join(inside, "region", "left_anti"))
    free(regions, sized, inside)
    regions = outer

    wanted = points.select("uid", "rep", "digest").join(regions.select("uid").distinct(), "uid")
    wanted = written(wanted)
    bits = hash_filter(wanted.select(F.xxhash64("rep").alias("h")), "h")

    def only(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, np.array(batch.column("h").to_pylist(), np.int64))))

    def checked(batches):
        """The rows whose text has the point's set: an id may repeat with another text."""
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column("text")), size)
            yield batch.filter(pa.array([_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist())], pa.bool_())).select(["uid", "text"])

    some = base.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    some = some.mapInArrow(only, some.schema).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("uid", "digest", "text")
    texts = written(some.mapInArrow(checked, "uid long, text string").dropDuplicates(["uid"]))
    free(wanted)
    scratch: list[DataFrame] = []
    links = written(_region_links(regions, texts, points.select("uid", "n"), size, percent, rows, weight, scratch))
    free(texts, regions, *scratch)
    roots = connected_components(links)
    labelled = points.select("uid", "rep").join(roots.withColumnRenamed("v", "uid"), "uid")
    least = labelled.groupBy("root").agg(F.min("rep").alias("least"))
    labelled = labelled.join(least, "root").select("uid", "root", "least")
    named = points.select("uid", "digest", "rep").join(labelled, "uid", "left")
    named = written(named.select("digest", F.coalesce("least", "rep").alias("component_id"), *([F.coalesce("root", "uid").alias("component")] if by_row else [])))
    free(links, points)
    joined = ids.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["k", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component")] if by_row else []
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *more)
