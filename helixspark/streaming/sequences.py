"""The per-record operators on streams, and windowed composition with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.functions import sequence as S


def stream_records(spark: SparkSession, path: str, schema: str = "name string, seq string", files_at_once: int = 100) -> DataFrame:
    """Records from a folder of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def annotate(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Length, G+C content, reverse complement and translation of each record; no state, for batches and streams."""
    s = F.col(seq)
    return records.withColumns({"length": F.length(s), "gc": S.gc(s), "revcomp": S.revcomp(s), "protein": S.translate(s)})


def composition_by_window(records: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", seq: str = "seq") -> DataFrame:
    """window start, records, letters and G+C in event-time windows; rows later than ``late`` are dropped, as in any
    watermarked aggregate."""
    s = F.lower(F.col(seq))
    counted = records.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("records"), F.sum(S.times(s, "acgt")).alias("letters"), F.sum(S.times(s, "cg")).alias("gc_letters"))
    return counted.select(F.col("window.start").alias("start"), "records", "letters", F.try_divide(F.col("gc_letters").cast("double"), F.col("letters")).alias("gc"))
