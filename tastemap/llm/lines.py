"""Line deduplication with keep bitmaps; DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, written

#: Blanks stripped from both ends of a line for its key.
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """One row per line that can be dropped: 128-bit key hash, row key, position."""
    keys = F.transform(_lines(ascii_lower(F.col(text))), lambda x: F.btrim(x, F.lit(BLANKS)))
    lines = docs.select(row_key(doc, text).alias("k"), keys.alias("keys")).select("k", F.posexplode("keys").alias("pos", "key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "k", "pos")


def drop_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Lines to drop, as one compressed bitmap per document: ``k`` (row key) and ``words``, an array of
    (word, bits) with 64 positions a word and without empty words.

    Documents without a dropped line have no row. Keys are lines without blanks at both ends and with A-Z
    lower-cased; those of ``min_chars`` code points found in ``min_docs`` documents are dropped. With
    ``keep_first`` the first occurrence in order of document key and position stays.

    Key hashes are range-partitioned with document and position as the lower sort columns, so a line that
    fills a third of the corpus spreads over many ranges. First occurrences and counts do not stream out of the
    sorted ranges: hash aggregates find them, partly before a shuffle, from the ranges that were written.

    A document is a row; rows equal in id and text are one document. Null text is one empty line. An empty table has
    no bitmaps, other columns are not read, and a document may have any number of lines.
    """
    found = line_occurrences(docs, doc, text, min_chars)
    ranged = written(found.repartitionByRange("h1", "h2", "k", "pos").sortWithinPartitions("h1", "h2", "k", "pos"))
    first_in_doc = ranged.groupBy(*KEY, "k").agg(F.min("pos").alias("pos"))
    firsts = first_in_doc.groupBy(*KEY).agg(F.count("*").alias("docs"), F.min(F.struct("k", "pos")).alias("first"))
    repeated = written(firsts.filter(F.col("docs") >= min_docs))
    dropped = ranged.join(repeated, KEY)
    if keep_first:
        dropped = dropped.filter(F.struct("k", "pos") != F.col("first"))
    bits = dropped.groupBy("k", F.floor(F.col("pos") / 64).cast("int").alias("word"))
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return bits.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def without_lines(docs: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of ``docs``; an empty table has no rows.

    The bitmap's gaps are filled once a document, so the cost is linear in its lines, however many it has.
    """
    rows = docs.select(row_key(doc, text).alias("k"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(bitmaps, "k", "left").select("doc_id", "text", _lines(F.col("text")).alias("lines"), "words")
    # Empty words up to each word, then its bits.
    dense = "flatten(transform(words, (x, i) -> concat(array_repeat(0L, x.word - if(i = 0, -1, words[i - 1].word) - 1), array(x.bits))))"
    # The array is bound as an argument: written as a column, it would be built again for every line. A shift by a column needs the SQL form.
    kept = F.expr(f"transform(array({dense}), d -> filter(lines, (x, i) -> (shiftrightunsigned(coalesce(get(d, cast(i div 64 as int)), 0L), cast(i % 64 as int)) & 1L) = 0L))[0]")
    rows = rows.withColumn("kept", F.when(F.col("words").isNotNull(), kept).otherwise(F.col("lines")))
    n = F.size("lines").cast("long")
    return rows.select("doc_id", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
