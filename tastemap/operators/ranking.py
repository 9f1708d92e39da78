"""Positions inside a key when one key may hold a large share of all rows.

A plain ``row_number`` sends a whole key to one task. Here the rows of a key are counted
in buckets that follow the order (an hour, a block of indices, ...), the bucket counts
are summed up (small tables), and only rows of one bucket are sorted together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    buckets: list[Column],
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its key, and on request the key's row count.

    ``buckets`` are expressions that never decrease along ``order``; each one splits the
    one before it further.
    """
    # Structs compare equal on null fields, so rows with a missing key keep their place.
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    fields += [b.alias(f"b{i}") for i, b in enumerate(buckets)]
    marked = df.withColumn("_leaf", F.struct(*fields))
    leaves = marked.groupBy("_leaf").agg(F.count("*").alias("_n"))

    def prefix(n: int) -> Column:
        names = [f"k{i}" for i in range(len(keys))] + [f"b{i}" for i in range(len(buckets))]
        return F.struct(*[F.col("_leaf")[x].alias(x) for x in names[:n]]) if n else F.lit(0)

    placed, offset = leaves, F.lit(0)
    for depth in range(len(buckets)):
        n = len(keys) + depth
        counts = leaves.groupBy(prefix(n).alias("_up"), prefix(n + 1).alias("_here")).agg(F.sum("_n").alias("_n"))
        before = W.partitionBy("_up").orderBy("_here").rowsBetween(W.unboundedPreceding, -1)
        counts = counts.select("_here", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_o{depth}"))
        placed = placed.withColumn("_here", prefix(n + 1)).join(counts, "_here").drop("_here")
        offset = offset + F.col(f"_o{depth}")
    placed = placed.select("_leaf", offset.alias("_offset"))
    if total:
        sums = leaves.groupBy(prefix(len(keys)).alias("_key")).agg(F.sum("_n").alias(total))
        placed = placed.withColumn("_key", prefix(len(keys))).join(sums, "_key").drop("_key")
    inside = W.partitionBy("_leaf").orderBy(*order)
    out = marked.withColumn("_rank", F.row_number().over(inside)).join(placed, "_leaf")
    out = out.withColumn(name, (F.col("_rank") - 1 + F.col("_offset")).cast("long"))
    return out.drop("_rank", "_offset", "_leaf")


def time_buckets(ts: str = "created_at") -> list[Column]:
    """Day and minute of a timestamp: coarse to fine, in time order."""
    return [F.date_trunc("day", F.col(ts)), F.date_trunc("minute", F.col(ts))]


def index_buckets(index: str = "post_index", block: int = 4096) -> list[Column]:
    c = F.col(index)
    return [F.floor(c / (block * block)), F.floor(c / block)]


def top_rows(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts each input partition to ``k`` rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def first_rows(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """First row per key as a partial aggregate (map-side combine, no sort)."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in columns])


def global_positions(df: DataFrame, order: list[Column | str], name: str = "position", running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row in the whole order, and for each ``running`` (new name: column) the
    sum of the rows before it.

    Rows are range-partitioned and sorted once; offsets of the ranges come from one small row a range. Rows that
    tie in ``order`` may swap.
    """
    sums = running or {}
    ranged = df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    ranges = ranged.groupBy("_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select("_range", (earlier("_n") - F.col("_first")).alias("_shift"), *[earlier(f"_s_{n}").alias(f"_b_{n}") for n in sums])
    out = ranged.join(ranges, "_range").withColumn(name, F.col("_row") + F.col("_shift"))
    inside = W.partitionBy("_range").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_range", "_row", "_shift", *[f"_b_{n}" for n in sums])


#: Rows that one task sorts at most to end a selection, and bars of a histogram.
FEW, BARS = 10_000, 1024


def nth_row(df: DataFrame, order: list[str], k: int, few: int = FEW) -> DataFrame:
    """The row at the 0-based place ``k`` of an order by whole numbers and texts, found without a sort of the table.

    A histogram over the range of the first column (numbers in ``BARS`` bars, texts by the character after
    their common start) tells which bar holds the place; only its rows are looked at next, then the next column
    once all agree. What is left below ``few`` rows is sorted. Each pass is a partial aggregate with as many rows
    as there are bars. Nulls come first. Rows equal in all columns are interchangeable.
    """
    order = list(order)
    while True:
        if not order:
            return df.limit(1)
        name, rest = order[0], order[1:]
        kind = dict(df.dtypes)[name]
        c = F.col(name)
        row = df.agg(F.count("*").alias("n"), F.count(c).alias("filled"), F.min(c).alias("low"), F.max(c).alias("high")).first()
        if k >= row["n"]:
            return df.limit(0)
        nulls = row["n"] - row["filled"]
        if nulls:
            if k < nulls:
                df, order = df.filter(c.isNull()), rest
                continue
            df, k = df.filter(c.isNotNull()), k - nulls
        if row["low"] == row["high"]:
            order = rest
            continue
        if row["filled"] <= few:
            last = df.orderBy(*order).limit(k + 1).withColumn("_place", F.row_number().over(W.orderBy(*order)))
            return last.filter(F.col("_place") == k + 1).drop("_place")
        if kind == "string":
            low, high = row["low"].encode(), row["high"].encode()
            same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            # Bytes in order; a text that ends here comes before all that go on.
            bar = F.substring(c.cast("binary"), same + 1, 1)
        else:
            bar = F.floor((c - F.lit(row["low"])) / ((row["high"] - row["low"]) // BARS + 1))
        for found in sorted(df.groupBy(bar.alias("bar")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["bar"]):
            if k < found["n"]:
                df = df.filter(bar == F.lit(found["bar"]))
                break
            k -= found["n"]
