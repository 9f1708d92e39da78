"""Packing of review batches against the plain loop."""
import random

from pyspark.sql import functions as F

from tastemap.operators import privacy
from tastemap.operators.ranking import global_positions


def batches_by_hand(sizes, max_rows, max_tokens):
    out, batch, rows, total = [], -1, 0, 0
    for n in sizes:
        if batch < 0 or rows == max_rows or total + n > max_tokens:
            batch, rows, total = batch + 1, 0, 0
        out.append(batch)
        rows, total = rows + 1, total + n
    return out


def packed(spark, sizes, **limits):
    rows = spark.createDataFrame([(k * 3, n) for k, n in enumerate(sizes)], "record_id long, n long").repartition(7)
    found = privacy.review_batches(rows, F.col("n"), **limits).collect()
    return [r["batch"] for r in sorted(found, key=lambda r: r["record_id"])]


def test_batches_follow_both_limits_over_many_blocks(spark):
    rng = random.Random(4)
    for n, block in ((1, 16), (16, 16), (33, 16), (500, 16), (499, 64)):
        sizes = [rng.choice([0, 1, 2, 3, 9, 30]) for _ in range(n)]
        limits = {"max_rows": 6, "max_tokens": 20, "block": block}
        assert packed(spark, sizes, **limits) == batches_by_hand(sizes, 6, 20)


def test_empty_records_weightless_records_and_giants(spark):
    assert packed(spark, []) == []
    assert packed(spark, [0] * 40, max_rows=6, max_tokens=20, block=8) == batches_by_hand([0] * 40, 6, 20)
    assert packed(spark, [100] * 20, max_rows=6, max_tokens=20, block=8) == list(range(20))
    assert packed(spark, [None, 5, None], max_rows=6, max_tokens=20, block=8) == [0, 0, 0]


def test_global_positions_and_running_sums(spark):
    rows = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "a long, b long").repartition(9)
    got = {r["a"]: (r["p"], r["s"]) for r in global_positions(rows, ["a"], "p", {"s": "a"}).collect()}
    assert got == {a: (a, a * (a - 1) // 2) for a in range(101)}
