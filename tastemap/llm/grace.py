"""Exact deduplication by Grace hashing with tables that compare complete content."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written

#: Content that one table holds at once, and the fan-out of a bucket that holds more.
TABLE_BYTES, FANOUT = 24 << 20, 16
_LOCAL = "doc_id long, row long, rep long, hash long, size long, n long, last_id long, last_row long, sha string, body binary"
_GROUP = "rep long, keep_id long, keep_row long, group_size long, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry number, entries compare by complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.bodies: list[bytes] = []
        self.bytes = 0

    def place(self, hash_: int, body: bytes) -> tuple[int, bool]:
        """Entry of the content, and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = hash_ & mask
        while (entry := int(slots[at])) >= 0:
            if self.hashes[entry] == hash_ and self.bodies[entry] == body:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.bodies)
        slots[at] = entry
        self.hashes.append(hash_)
        self.bodies.append(body)
        self.bytes += len(body) + 100
        if 2 * (entry + 1) > len(slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, hash_ in enumerate(self.hashes):
            at = hash_ & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _later(a: tuple, b: tuple) -> tuple:
    """The later of two (id, row): a null id is lowest, equal ids go by row."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _local_copies(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Collapse the copies inside one task: a small row for each document, and one row with the content for each text."""
    first = TaskContext.get().partitionId() << 40
    row, schema = first, None
    table, reps = ContentTable(), []

    def release():
        nonlocal table, reps
        columns = [
            [None] * len(reps), [None] * len(reps), [r["rep"] for r in reps], [xxhash.xxh3_64_intdigest(b, 1) >> 1 for b in table.bodies],
            [len(b) for b in table.bodies], [r["n"] for r in reps], [r["last"][0] for r in reps], [r["last"][1] for r in reps],
            [hashlib.sha256(b).hexdigest() for b in table.bodies], table.bodies,
        ]
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        table, reps = ContentTable(), []
        return out

    for batch in batches:
        longs = [pa.field(n, pa.int64()) for n in ("doc_id", "row", "rep", "hash", "size", "n", "last_id", "last_row")]
        schema = pa.schema([*longs, pa.field("sha", pa.string()), pa.field("body", pa.binary())])
        ids = batch.column("doc_id").to_pylist()
        owners = []
        begin = row
        for k, (one, text) in enumerate(zip(ids, batch.column("text").cast(pa.binary()).to_pylist())):
            body = (text or b"").lower()
            entry, new = table.place(xxhash.xxh3_64_intdigest(body), body)
            if new:
                reps.append({"rep": row, "n": 0, "last": (None, -1)})
            rep = reps[entry]
            rep["n"] += 1
            rep["last"] = _later(rep["last"], (one, row))
            owners.append(rep["rep"])
            row += 1
            if table.bytes > table_bytes or k == len(ids) - 1:
                n = row - begin
                nothing = [pa.nulls(n, f.type) for f in list(schema)[3:]]
                members = [pa.array(ids[k + 1 - n : k + 1], pa.int64()), pa.array(range(begin, row), pa.int64()), pa.array(owners, pa.int64())]
                yield pa.record_batch([*members, *nothing], schema=schema)
                begin, owners = row, []
                if table.bytes > table_bytes:
                    yield release()
    if reps:
        yield release()


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal content, bucket after bucket; the rows come ordered by bucket."""
    bucket, table, groups = None, ContentTable(), []

    def release():
        rows = [(rep, *g["last"], g["n"], g["sha"]) for g in groups for rep in g["reps"]]
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rep", "keep_id", "keep_row", "group_size", "text_sha256"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "rep", "n", "last_id", "last_row", "sha", "body")]
        for at, rep, n, last_id, last_row, sha, body in zip(*columns):
            if at != bucket:
                if groups:
                    yield release()
                bucket, table, groups = at, ContentTable(), []
            entry, new = table.place(xxhash.xxh3_64_intdigest(body), body)
            if new:
                groups.append({"reps": [], "n": 0, "last": (None, -1), "sha": sha})
            g = groups[entry]
            g["reps"].append(rep)
            g["n"] += n
            g["last"] = _later(g["last"], (last_id, last_row))
    if groups:
        yield release()


def exact_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups of documents whose texts are identical after lower-casing A-Z; the largest id of a group stays.

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Each task first collapses its own copies, so a text that fills a third of the corpus leaves each task
    once. The remaining contents go to partition files by hash, and a bucket whose distinct contents exceed
    ``table_bytes`` is partitioned again into new files, until each bucket fits one open-addressing table or
    holds a single text. Contents are compared byte by byte, hashes only find the slot.

    Null text counts as empty. A null id is smaller than any other. Of rows that share the largest id and
    the text, one stays. Other columns are not read. No rows give no rows.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    local = written(rows.mapInArrow(lambda batches: _local_copies(batches, table_bytes), _LOCAL))
    contents = local.filter("body is not null").drop("doc_id", "row")
    total = contents.agg(F.sum("size").alias("b")).first()["b"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * -(-total // table_bytes))
    open_rows = contents.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    groups, level = None, 0
    while True:
        sizes = open_rows.groupBy("bucket", "hash").agg(F.max("size").alias("size"))
        sizes = sizes.groupBy("bucket").agg(F.sum("size").alias("held"), F.count("*").alias("texts"))
        large = written(sizes.filter((F.col("held") > table_bytes) & (F.col("texts") > 1)).select("bucket"))
        deeper = not large.isEmpty()
        fits = open_rows.join(large, "bucket", "left_anti") if deeper else open_rows
        # Whole buckets, each in one task and in one piece.
        part = whole_groups(fits, "bucket").sortWithinPartitions("bucket")
        made = part.select("bucket", "rep", "n", "last_id", "last_row", "sha", "body").mapInArrow(_bucket_groups, _GROUP)
        groups = made if groups is None else groups.unionByName(made)
        if not deeper:
            break
        level += 1
        spill = open_rows.join(large, "bucket", "left_semi")
        open_rows = written(spill.withColumn("bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(FANOUT)))))
    members = local.filter("body is null").select("doc_id", "row", "rep")
    done = members.join(groups, "rep")
    kept = F.col("row") == F.col("keep_row")
    return done.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
