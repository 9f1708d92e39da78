"""What the operators share: table reading, row keys, tables in the shared folder, columns passed through Python."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def row_key(doc: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of a row by id and text; rows equal in both share it, a null differs from an empty text."""
    one = F.coalesce(F.col(doc).cast("string"), F.lit("~"))
    two = F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("~"))
    return F.unhex(F.md5(F.concat_ws("\n", one, two)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (tests) may leave that setting out.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: a lineage cut that any executor can read again.

    The files go with ``free``, or when the session ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes written tables once all that is made from them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def whole_groups(df: DataFrame, key: str) -> DataFrame:
    """``df`` with all rows of a ``key`` in one partition, for Python that goes through whole groups.

    Spark drops a plain repartition by the keys of a join below it when no join or aggregate above asks for it, and
    adaptive execution may then split the join's partitions or read them by pieces. A hash of the key is no key of a join.
    """
    return df.repartition(F.xxhash64(key))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(piece)]):
        yield batch.slice(a, b - a)


def by_slices(function: Callable[[list[bytes]], list[pa.Array]], names: list[str], text: str, keep: list[str], size: int = 1 << 20):
    """A function for ``mapInArrow`` that adds the columns ``function`` makes of the texts, some ``size`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, size):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + function(as_bytes(part.column(text))), keep + names)

    return run


#: Bits of a hash filter: 4 MiB, whatever the corpus.
FILTER_BITS = 25


def hash_filter(values: DataFrame, column: str):
    """A broadcast bitmap of fixed size that every hash in ``column`` passes, and of the others the fewer the fewer there are.

    It keeps rows that cannot matter out of a shuffle; results never depend on it.
    """
    slot = F.expr(f"shiftrightunsigned({column}, {64 - FILTER_BITS})")
    words = values.select(slot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    made = words.toPandas()  # at most 2**(FILTER_BITS - 6) words
    bits[made["w"].to_numpy(int)] = made["b"].to_numpy(np.int64).view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
