"""Merkle manifest of a dataset: leaf coordinates by bitmap rank, levels reduced in keyed slot arrays."""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import with_position
from .common import written

#: Consecutive nodes of a run, levels that one slot array reduces, and leaves below such an array.
ARITY, LEVELS = 3, 5
SPAN = ARITY**LEVELS
#: A bitmap word covers 2**6 ids; popcount directories lie over 2**14 and 2**22 ids.
WORD, DIRECTORY = 6, (14, 22)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Order key of the group without a name, and of null ids (below every word of a 64-bit id).
NO_GROUP, NO_ID = "", -(1 << 60)

_SLOTS = "array<struct<slot: int, id: bigint, hash: binary, other: binary>>"
_PACK = f"tree string, size bigint, g bigint, slots {_SLOTS}"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tampered_rows(doc: str = "doc_id") -> Column:
    """Rows whose crc32 of the decimal id is even; a null id is never tampered with."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame, tamper: Column, group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """tree (order key of the group), id, hash of the row, and ``other``, the hash after tampering where that is another."""
    plain = F.unhex(F.sha2(F.concat(*[field_text(F.col(c)) for c in fields]), 256))
    cut = F.unhex(F.sha2(F.concat(*[field_text(F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c)) for c in fields]), 256))
    changed = tamper & F.coalesce(F.contains(F.col(text), F.lit("\n")), F.lit(False))
    tree = F.when(F.col(group).isNull(), NO_GROUP).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    return docs.select(tree.alias("tree"), F.col(fields[0]).cast("long").alias("id"), plain.alias("hash"), F.when(changed, cut).alias("other"))


def _before(counts: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows before each entry of a directory, within its key."""
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def bitmap_index(rows: DataFrame) -> DataFrame:
    """Bitmap words of every tree: tree, word, bits, n (rows), base (rows before the word), size (rows of the tree).

    Words are made by partial aggregates, so a tree with a third of all rows merges like any other, and words
    without a row are not kept. The popcount directories add up counts over 2**14 and 2**22 ids; each window
    runs over one directory's entries: 256 words, 256 entries, and one entry for 4 million ids at the top.
    """
    words = rows.groupBy("tree", _word().alias("word")).agg(F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")), F.lit(0)).alias("bits"), F.count("*").alias("n"))
    low, high = (F.expr(f"shiftright(word, {s - WORD})") for s in DIRECTORY)
    words = written(words.withColumns({"low": low, "high": high}))
    lows = words.groupBy("tree", "high", "low").agg(F.sum("n").alias("n"))
    highs = lows.groupBy("tree", "high").agg(F.sum("n").alias("n"))
    sizes = highs.groupBy("tree").agg(F.sum("n").alias("size"))
    highs = _before(highs, ["tree"], "high", "b2").join(sizes, "tree").drop("n")
    lows = _before(lows, ["tree", "high"], "low", "b1").join(highs, ["tree", "high"])
    lows = lows.select("tree", "low", (F.col("b1") + F.col("b2")).alias("b"), "size")
    placed = _before(words, ["tree", "low"], "word", "b0").join(lows, ["tree", "low"])
    return placed.select("tree", "word", "bits", "n", (F.col("b0") + F.col("b")).alias("base"), "size")


def _word() -> Column:
    return F.coalesce(F.expr(f"shiftright(id, {WORD})"), F.lit(NO_ID))


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, id, hash, other; a written table) with idx, the place in the tree by id, and the tree's size.

    The place is a rank query: the word's base plus the popcount of the lower bits. Where ids repeat in a tree
    or are null, a bit cannot tell the rows apart: the rows of those words are counted by id, then hash;
    equal rows are interchangeable. Null ids come first.
    """
    index = written(bitmap_index(rows))
    here = rows.withColumn("word", _word()).join(index, ["tree", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")
    crowded = F.col("n") != F.expr("bit_count(bits)")
    cols = ["tree", "size", "id", "hash", "other"]
    out = here.filter(~crowded).select(*cols, (F.col("base") + below).alias("idx"))
    if index.filter(crowded).isEmpty():
        return out
    several = written(here.filter(crowded).withColumn("part", F.spark_partition_id()))
    order = [F.col("id").asc_nulls_first(), "hash", "part"]
    several = with_position(several, ["tree", "word"], order, [F.coalesce("id", F.lit(NO_ID)), F.substring("hash", 1, 2), F.col("hash"), F.col("part")])
    return out.unionByName(several.select(*cols, (F.col("base") + F.col("position")).alias("idx")))


def _node(run: list[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


def _levels(hashes: list[bytes], last: bool) -> list[list[bytes]]:
    """The levels of one slot array, digests as hex text; the last array of a tree goes on until one node is left."""
    levels = [hashes]
    while len(levels[-1]) > 1 if last else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([_node(below[k:k + ARITY]) for k in range(0, len(below), ARITY)])
    return levels


def _packs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, list[bytes], pa.Array]]:
    """Row, whether it is the last array of its tree, its digests as hex text and its slots."""
    sizes = batch.column("size").to_pylist()
    for k in range(batch.num_rows):
        slots = batch.column("slots").slice(k, 1).flatten()
        yield k, sizes[k] <= SPAN, [h.hex().encode() for h in slots.field("hash").to_pylist()], slots


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [bytes.fromhex(_levels(hashes, last)[-1][0].decode()) for _, last, hashes, _ in _packs(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], [*batch.schema.names, "top"])


def storeys(nodes: DataFrame) -> list[DataFrame]:
    """Slot arrays of every tree, storey above storey: tree, size, g, slots and the digest ``top`` of the array.

    ``nodes`` has tree, size (nodes of the tree), idx, id, hash and other. An array holds the nodes whose idx
    has the same quotient by 243, keyed by the remainder; the next storey takes the tops as its nodes.
    """
    out = []
    while True:
        slot = F.struct(F.expr(f"cast(idx % {SPAN} as int)").alias("slot"), "id", "hash", "other")
        packs = nodes.groupBy("tree", "size", F.expr(f"idx div {SPAN}").alias("g")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        packs = written(packs.select("tree", "size", "g", F.col("slots").cast(_SLOTS).alias("slots")).mapInArrow(_reduced, f"{_PACK}, top binary"))
        out.append(packs)
        nodes = packs.filter(F.col("size") > SPAN).select(
            "tree", F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"), F.col("g").alias("idx"), F.lit(None).cast("long").alias("id"), F.col("top").alias("hash"), F.lit(None).cast("binary").alias("other"))
        if nodes.isEmpty():
            return out


def _steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """Digests before and after the way, level by level, out of a stored path."""
    out, at = [], 0
    while at < len(path):
        a, b = path[at], path[at + 1]
        cut = at + 2 + 32 * a
        end = cut + 32 * b
        out.append((path[at + 2:cut].hex().encode(), path[cut:end].hex().encode()))
        at = end
    return out


def _stored(step: tuple[bytes, bytes]) -> bytes:
    return bytes([len(step[0]) // 64, len(step[1]) // 64]) + bytes.fromhex((step[0] + step[1]).decode())


def _ways(hashes: list[bytes], last: bool) -> list[list[tuple[bytes, bytes]]]:
    """Of every slot of an array, its siblings level by level up to the array's top."""
    levels = _levels(hashes, last)
    ways: list[list[tuple[bytes, bytes]]] = [[]]
    for level in reversed(levels[:-1]):
        ways = [[(b"".join(level[k - k % ARITY:k]), b"".join(level[k + 1:k - k % ARITY + ARITY])), *ways[k // ARITY]] for k in range(len(level))]
    return ways


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slot of an array with its stored path up to the root."""
    for batch in batches:
        upper, first = batch.column("path").to_pylist(), batch.column("g").to_pylist()
        at, idx, paths = [], [], []
        for k, last, hashes, slots in _packs(batch):
            ways = _ways(hashes, last)
            at += [k] * len(ways)
            idx += [first[k] * SPAN + s for s in slots.field("slot").to_pylist()]
            paths += [b"".join(map(_stored, way)) + upper[k] for way in ways]
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("tree"), pa.array(idx, pa.int64()), rows.column("subroot"), pa.array(paths, pa.binary())], ["tree", "g", "subroot", "path"])


def _proofs(root: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper, subroots = batch.column("path").to_pylist(), batch.column("subroot").to_pylist()
            ids, out = [], []
            for k, last, hashes, slots in _packs(batch):
                above, sub = _steps(upper[k]), subroots[k].hex()
                tail = b"".join(a + b for a, b in above)
                others = slots.field("other").to_pylist()
                ids += slots.field("id").to_pylist()
                for leaf, other, way in zip(hashes, others, _ways(hashes, last)):
                    folded = other.hex().encode() if other else leaf
                    for before, after in way:
                        folded = _node([before, folded, after])
                    for before, after in above:
                        folded = _node([before, folded, after])
                    proof = _node([a + b for a, b in way] + [tail])
                    out.append((leaf.decode(), sub, root.decode(), proof.decode(), folded.decode(), folded == root))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns, kinds)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def _down(packs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The slot arrays of the lowest storey with subroot and path; ``tops`` (tree, subroot, path) is where the trees hang."""
    for storey in reversed(packs):
        hung = storey.filter(F.col("size") <= SPAN).join(tops, "tree")
        if storey is not packs[-1]:
            inner = storey.filter(F.col("size") > SPAN).join(paths, ["tree", "g"])
            hung = hung.unionByName(inner)
        if storey is not packs[0]:
            paths = written(hung.select("tree", "size", "g", "slots", "subroot", "path").mapInArrow(_paths, "tree string, g bigint, subroot binary, path binary"))
    return hung


def subroots(packs: list[DataFrame]) -> DataFrame:
    """tree and the digest that is left of it."""
    found = [p.filter(F.col("size") <= SPAN).select("tree", F.col("top").alias("subroot")) for p in packs]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _in_order(groups: DataFrame) -> DataFrame:
    """Nodes of the tree over the groups, placed by the order of their names: range-partitioned, then counted by range."""
    placed = groups.orderBy("tree").select("tree", "subroot", F.spark_partition_id().alias("part"), F.expr(f"monotonically_increasing_id() & {(1 << 33) - 1}").alias("row"))
    placed = written(placed)
    parts = _before(placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "part", "before")
    total = placed.count()
    return placed.join(parts, "part").select(F.col("tree").alias("name"), "subroot", (F.col("before") + F.col("row")).alias("idx"), F.lit(total).cast("long").alias("total"))


def manifest(docs: DataFrame, tamper: Column | None = None, group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    A leaf digests ``fields``, of which the first is a 64-bit id. Rows lie in their group by id; a null group
    comes first, as do null ids; repeated ids follow each other by digest, equal rows in any order, all as
    leaves of their own. Null fields are ``-``, an empty text is ``0:``; texts of any length are digested whole.
    Rows that ``tamper`` marks (by default those of ``tampered_rows``) are folded with line feeds deleted from
    the text. An empty table has no rows. Columns beyond ``fields`` are not read, so their names cannot clash.

    Coordinates come from bitmap ranks, no group is sorted. Arrays of 243 nodes reduce five levels at a time,
    upwards to the roots and downwards with the siblings on the way, so a group of any size spreads over tasks;
    paths are kept for the nodes above the lowest arrays only.
    """
    rows = written(leaves(docs, tampered_rows(fields[0]) if tamper is None else tamper, group, fields, text))
    packs = storeys(coordinates(rows))
    named = written(_in_order(subroots(packs)))
    over = storeys(named.select(F.lit(NO_GROUP).alias("tree"), F.col("total").alias("size"), "idx", F.lit(None).cast("long").alias("id"), F.col("subroot").alias("hash"), F.lit(None).cast("binary").alias("other")))
    last = subroots(over).head()
    if last is None:
        return rows.select(F.col("id").alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    hung = _down(over, over[0].select("tree").distinct().select("tree", F.expr("X''").alias("subroot"), F.expr("X''").alias("path")))
    ways = hung.mapInArrow(_paths, "tree string, g bigint, subroot binary, path binary").select(F.col("g").alias("idx"), "path")
    tops = written(named.join(ways, "idx").select(F.col("name").alias("tree"), "subroot", "path"))
    done = _down(packs, tops).select("tree", "size", "g", "slots", "subroot", "path")
    return done.mapInArrow(_proofs(bytes(last.subroot).hex().encode()), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
