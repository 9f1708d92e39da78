"""Bounded samples of labelled documents for the classifiers, and the hold-out rule."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents outside the held fold: place (their order), label, text.

    The ids with the least hashes are taken, so the choice does not depend on how the tables are stored. A
    document labelled twice counts as 1 if either label is; ids without document, and null labels, are left
    out. The ids are broadcast: there are at most ``rows`` of them.
    """
    some = labels.filter(F.col(doc).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc), folds) != held))
    some = some.groupBy(F.col(doc).cast("long").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    some = some.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(rows)
    texts = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(some), "id").select("place", "label", "text")
