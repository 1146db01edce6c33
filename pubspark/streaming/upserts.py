"""Incremental upserts as a stream: each micro-batch's latest row for each key replaces older ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import shared_folder


def stream_latest(spark: SparkSession, path: str) -> DataFrame:
    """record and its greatest run_id, read as a stream of files to its present end.

    State is Spark's own, in the checkpoint folder; the sink gets each batch's
    changed records, of which the last batch's stand.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder if name.endswith(".parquet") else path)
    latest = events.select((F.col("event_id") % 500).alias("record"), "event_id").groupBy("record").agg(F.max("event_id").alias("run_id"))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{place}/out")

    q = latest.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{place}/out")
    return rows.groupBy("record").agg(F.max_by("run_id", "batch").alias("run_id"))
