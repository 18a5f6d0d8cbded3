"""Incremental ingest: new files are read once, rows already taken are skipped by digest, results are appended."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share. A session on one machine that has none gets a temporary folder; a cluster's must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-stream-")
    return f"{base.rstrip('/')}/ingest-{uuid.uuid4().hex}"


def new_rows(spark: SparkSession, source: str, schema, digest_of: tuple[str, ...]) -> DataFrame:
    """A stream of files' rows with the digest by which repeats are known."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    return rows.withColumn("digest", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in digest_of))))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema, digest_of: tuple[str, ...]) -> DataFrame:
    """Takes all files that are there now; a second call takes only what came since. Returns the target table.

    What was taken before is looked up in the target's digests, so no state grows in memory, however far apart repeats come. A batch that is
    run again writes its own folder anew.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["digest"])
        if batch_id > 0:
            taken = batch.sparkSession.read.parquet(target).where(F.col("batch") < batch_id).select("digest")
            fresh = fresh.join(taken, "digest", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = new_rows(spark, source, schema, digest_of)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("batch")


def window_counts(spark: SparkSession, source: str, schema, width: str, target: str, checkpoint: str) -> DataFrame:
    """Counts and sums by event type and time window, upserted batch by batch: each batch appends its partial sums, reading adds them up."""
    rows = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        part.select(F.col("w.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
