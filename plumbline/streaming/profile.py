"""The operators on streams: conversions run unchanged, profiles run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profiled(stream: DataFrame, profile: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """Writes the profile of every batch, with its number, to a Parquet folder; a batch that is repeated after
    a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        profile(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def cyclic_hours(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and hour of day, with a watermark."""
    from plumbline.functions.cyclic import Cycle

    hour = Cycle(period=24).values(F.hour(time))
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
