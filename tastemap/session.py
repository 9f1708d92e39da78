"""Session helpers: local sessions for tests and benches, table loading, lineage cuts."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A small local session for tests and benches; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tastemap")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps are UTC everywhere in this library."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = use_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer splits than cores goes to all cores before costly text work.

    A large input has many splits and passes unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a session on one machine gets one of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the session ends."""
    path = f"{_shared_base(spark)}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """State of an iteration, or a stage that several others read: a compressed table in the shared folder.

    The plan runs once (a checkpoint runs its last stage for a count and again for the files, which hold rows
    as they lie in memory). Null columns without a type and repeated names do not fit a table; they are checkpointed.
    """
    spark = df.sparkSession
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or "void" in df.schema.simpleString():
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(_shared_base(spark))
        return df.checkpoint(eager=True)
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def free(df: DataFrame) -> None:
    """Deletes a table of ``cut_lineage`` once all that is made from it has been cut itself; others stay."""
    if hasattr(df, "scratch"):
        spark = df.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
