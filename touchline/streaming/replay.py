"""Streams over event files: daily counts, and running totals that carry state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.sources.shared import shared_path


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream, its time as a timestamp, which a watermark needs."""
    known = spark.read.parquet(f"{folder}/events.parquet")
    # A stream reads a folder; the pattern admits the one table.
    stream = spark.readStream.schema(known.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def ended(df: DataFrame, mode: str, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there, and read its last output (of ``complete``) or all of it (of ``append``), ``conf`` being
    set meanwhile.

    A batch's folder bears its number, so that one written again after a failure takes the place of the first try.
    """
    spark = df.sparkSession
    path, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    before = {c: spark.conf.get(c, None) for c in conf or {}}
    for c, value in (conf or {}).items():
        spark.conf.set(c, value)
    try:
        df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    return spark.read.schema(df.schema).parquet(path if mode == "complete" else f"{path}/batch=*")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their values by day and type. In append mode a day is given once the latest time is ``late`` past its
    end, and rows that come after that are dropped; in complete mode no row is."""
    day = F.window("ts", "1 day").alias("w")
    counted = stream.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def running_totals(stream: DataFrame) -> DataFrame:
    """Per user the number of events and the sum of values so far, after each batch that has some of the user's."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in frames:
            n, total = n + len(rows), total + float(rows.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return stream.groupBy("user_id").applyInPandasWithState(add, "user_id bigint, n bigint, total double", "n bigint, total double", "append", GroupStateTimeout.NoTimeout)
