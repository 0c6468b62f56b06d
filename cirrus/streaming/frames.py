"""Streams of frame records: tumbling groups of frames over a directory that files arrive in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cirrus.plans.lineage import shared_dir


def stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the files at path, a file or folder of Parquet; so many files a batch, by default all that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path + "*")


def groups_of_frames(records: DataFrame, size: int = 32, late: int = 1 << 20) -> DataFrame:
    """Frames, points and last frame of each group: a tumbling window over frame numbers, taken as seconds.

    State is one row a group; of a stream it goes when a frame has come that lies more than late frames after the group's end, and records of a group
    gone are left out. Records without a frame number are in no group.
    """
    timed = records.withColumn("at", F.timestamp_seconds("frame_id")).withWatermark("at", f"{late} seconds")
    counted = timed.groupBy(F.window("at", f"{size} seconds")).agg(F.count("*").alias("frames"), F.sum("num_proj").alias("points"), F.max("frame_id").alias("last_frame"))
    return counted.select((F.unix_seconds("window.start") / size).cast("int").alias("gof"), "frames", "points", "last_frame")


def drained(frame: DataFrame, name: str, *keys: str, at: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns the last row of each key.

    A batch writes the rows that it changed, in a folder of its own, so one that is run again after a loss replaces what it wrote before. Called again with
    the same folder (at), it goes on after the last batch.
    """
    spark = frame.sparkSession
    top = at or f"{shared_dir(spark)}/cirrus/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/result/batch={number}")

    run = frame.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{top}/state").foreachBatch(keep).start()
    run.awaitTermination()
    rows = spark.read.schema(T.StructType([*frame.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{top}/result")
    others = [c for c in frame.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in frame.columns])
