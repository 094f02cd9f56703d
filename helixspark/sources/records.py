"""Records of text files that a separator ends, read by byte ranges.

Spark's text source cuts a file of any size into byte ranges and gives each record to the range it begins in, so many
tasks read one file. What a range lacks is how many records came before it; that is one number a range, which a
first pass over the ranges counts and a running sum over the ranges (not over the records) adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges up to which their counts, a row each, are broadcast; beyond, the join shuffles.
MOST_RANGES = 100_000


def ranges_of(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """path, block (the first byte of the range), at (increasing within a range) and value of each record."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_records(spark: SparkSession, path: str | list[str], separator: str, head: Column | None = None) -> DataFrame:
    """path, record (from 0 in each file, in the file's order), records (of the file) and value. With head, also ``headed``:
    whether it holds for the file's first record."""
    rows = ranges_of(spark, path, separator)
    mark = F.lit(True) if head is None else F.coalesce(head, F.lit(False))
    ranges = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min_by(mark, "at").alias("mark"))
    w = Window.partitionBy("path").orderBy("block")
    ranges = ranges.select(
        "path", "block", "first",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("path")).alias("records"), F.first("mark").over(w).alias("headed"),
    )
    if rows.rdd.getNumPartitions() + len(rows.inputFiles()) <= MOST_RANGES:
        ranges = F.broadcast(ranges)
    return rows.join(ranges, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("record"), "records", "value", *(["headed"] if head is not None else []))
