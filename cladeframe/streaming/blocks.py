"""Alignment statistics over a stream of tracks: counters that only add up, so updates merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_composition(tracks: DataFrame) -> DataFrame:
    """Per track of a stream (track, seq): number of sequences, symbols, and of each base so far (update mode)."""
    base = lambda b: F.sum(F.length("seq") - F.length(F.regexp_replace("seq", b, ""))).cast("long").alias(b)
    return tracks.groupBy("track").agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("long").alias("symbols"), *map(base, "ACGT"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What an aggregated stream holds once all that is there now has been read: one row per group, kept as Parquet."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
