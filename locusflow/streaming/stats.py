"""Filters and statistics on a stream of sites.

Both look at one record at a time, so the batch operators run unchanged on a
streaming frame, without state or watermark. Smoothing, scores and detection
need the whole genome and read what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from locusflow.config import Analysis, HardFilter
from locusflow.operators import raw_stats, variants


def statistics(sites: DataFrame, mode: str, a: Analysis, h: HardFilter) -> DataFrame:
    """Statistics of the records that pass, of a batch or a stream."""
    return raw_stats.raw_stats(variants.passed(sites, mode, a, h), mode, a.population)


def start(sites: DataFrame, mode: str, a: Analysis, h: HardFilter, out: str, checkpoint: str) -> StreamingQuery:
    """Write the statistics of all sites that are there as Parquet; a restart goes on where the last one ended."""
    writer = statistics(sites, mode, a, h).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
