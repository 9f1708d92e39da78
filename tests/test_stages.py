"""Stages as compressed tables. Rows are built here."""
import os

from pyspark.sql import functions as F

from tastemap import session


def folder_size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_a_stage_is_a_compressed_table_and_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(200_000).select("id", F.lit("the same long text in all rows").alias("t")).mapInArrow(count, "id long, t string")
    cut = session.cut_lineage(df)
    assert seen.value == 200_000  # a checkpoint ran the plan twice
    path = os.path.dirname(cut.inputFiles()[0].removeprefix("file://"))
    assert folder_size(path) < 200_000 * 20
    assert cut.agg(F.sum("id"), F.countDistinct("t")).first()[:] == (199_999 * 100_000, 1)


def test_a_stage_with_columns_no_table_holds_is_still_cut(spark):
    odd = session.cut_lineage(spark.range(3).select("id", F.lit(None).alias("nothing")))
    assert sorted(r.id for r in odd.collect()) == [0, 1, 2] and odd.schema["nothing"].dataType.simpleString() == "void"
