"""Current values kept up to date while claims arrive.

Arriving claims are appended to a store; each micro-batch re-arbitrates only the
(subject, predicate) groups it touches, over all their stored claims, and writes the
outcome of the batch. The store is cut into buckets by hash of the group, and a batch reads only the buckets it
touches. Replayed batches overwrite their own folders, so a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from strandline.operators.arbitrate import arbitrate, latest_claims
from strandline.plans.ontology import Schema

_COLUMNS = ["claim_key", "subject_key", "predicate", "object_key", "source_tool", "asserted_at", "authority", "specificity", "hedging", "loaded_at"]


BUCKETS = 64


def batch_writer(folder: str, schema: Schema | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: appends to <folder>/store and writes statuses of touched groups to <folder>/current."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.hash("subject_key", "predicate"), F.lit(BUCKETS))
        batch.select(*_COLUMNS).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/store/batch={batch_id}")
        schema_ = StructType([*batch.select(*_COLUMNS).schema.fields, StructField("batch", LongType()), StructField("bucket", LongType())])
        stored = spark.read.schema(schema_).option("basePath", f"{folder}/store").parquet(f"{folder}/store").where(F.col("batch") <= batch_id)
        new = stored.where(F.col("batch") == batch_id)
        read = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        store = stored.where(F.col("bucket").isin(read)).drop("batch", "bucket")
        touched = new.select("subject_key", "predicate").distinct()
        done = arbitrate(latest_claims(store.join(touched, ["subject_key", "predicate"], "left_semi")), schema)
        done.select("claim_key", "subject_key", "predicate", "object_key", "score", "status").write.mode("overwrite").parquet(f"{folder}/current/batch={batch_id}")

    return write


def start(claims: DataFrame, folder: str, schema: Schema | None = None, once: bool = True) -> StreamingQuery:
    """Start the query over a streaming DataFrame of claims."""
    w = claims.writeStream.foreachBatch(batch_writer(folder, schema)).option("checkpointLocation", f"{folder}/checkpoint")
    return (w.trigger(availableNow=True) if once else w).start()


def current(folder: str, spark) -> DataFrame:  # noqa: ANN001
    """Latest status of every claim: the last batch that touched its group."""
    x = spark.read.parquet(f"{folder}/current")
    r = x.groupBy("claim_key").agg(F.max(F.struct("batch", "subject_key", "predicate", "object_key", "score", "status")).alias("r"))
    return r.select("claim_key", "r.subject_key", "r.predicate", "r.object_key", "r.score", "r.status")


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window with a watermark; works on streams and tables. events: ts, event_type, value."""
    x = events.withWatermark("ts", late) if events.isStreaming else events
    return x.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
