"""Incremental runs over arriving posts, with the same column functions as the batch jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gate import gate
from ..operators.privacy import masked
from ..schemas import POST


def arriving_posts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(POST).option("lineSep", "\n").json(folder)


def gated_and_masked(posts: DataFrame, cues: dict) -> DataFrame:
    """Gate verdict and masked text of each post; stateless, so it runs on streams as on tables."""
    return gate(posts, cues).withColumn("masked_text", masked(F.col("text"), calendar=True))


def run_gate(spark: SparkSession, folder: str, target: str, checkpoint: str, cues: dict) -> StreamingQuery:
    """Process what has arrived since the last run and stop."""
    rows = gated_and_masked(arriving_posts(spark, folder), cues)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests without a result, each key once."""
    return requests.dropDuplicates(["request_key"]).join(results.select("request_key"), "request_key", "left_anti")


def issued_once(requests: DataFrame, arrived: str | None = None, retention: str = "7 days") -> DataFrame:
    """A stream of requests with each key once, over all micro-batches and restarts.

    Spark keeps the seen keys as keyed state in its checkpoint. With ``arrived`` (a timestamp column) a key is
    forgotten once the latest arrival is ``retention`` past its own, so the state holds the keys of that span and a
    request that is still unanswered may be issued again; rows later than that are dropped. Without it keys
    are kept for good.
    """
    if arrived is None:
        return requests.dropDuplicates(["request_key"])
    return requests.withWatermark(arrived, retention).dropDuplicatesWithinWatermark(["request_key"])


def run_pending(
    spark: SparkSession, requests: DataFrame, results_path: str, target: str, checkpoint: str, arrived: str | None = None, retention: str = "7 days"
) -> StreamingQuery:
    """Append the still unanswered requests of each micro-batch to the target, tagged with the batch.

    A key that arrives again in a later micro-batch is not issued again (see ``issued_once``). A batch that runs
    again after a failure replaces its own output, so nothing doubles.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        done = spark.read.schema("request_key string").json(results_path)
        pending_requests(batch, done).write.mode("overwrite").json(f"{target}/epoch={epoch}")

    once = issued_once(requests, arrived, retention)
    return once.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
