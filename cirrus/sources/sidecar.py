"""Checksum sidecar files: one text file for each group of frames with the number of frames, the bytes of a checksum, and a line of hex for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(sums: DataFrame, folder: str, group: int = 32) -> None:
    """sums: frame and md5 (hex), one row a frame. A group's lines, group at most, are in order of its frames."""
    rows = F.array_sort(F.collect_list(F.struct("frame", "md5")))
    files = sums.groupBy(F.floor(F.col("frame") / group).alias("gof")).agg(rows.alias("rows"))
    lines = F.transform("rows", lambda r: F.lower(r["md5"]))
    size = F.floor(F.length(lines[0]) / 2)
    files.select("gof", F.concat_ws("\n", F.array(F.size("rows").cast("string"), size.cast("string")), lines).alias("value")).write.partitionBy("gof").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """gof, place (from 0) and md5 of each line that a file's first number announces; files shorter than announced give the lines they have."""
    words = spark.read.schema("value string, gof long").text(folder, wholetext=True).select("gof", F.split(F.trim("value"), r"\s+").alias("words"))
    known = words.where(F.size("words") > 2).withColumn("announced", F.col("words")[0].cast("int"))
    return known.select("gof", F.posexplode(F.slice("words", 3, F.col("announced"))).alias("place", "md5")).select("gof", "place", F.lower("md5").alias("md5"))
