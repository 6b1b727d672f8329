"""A folder of photos as a stream: every new image goes through the whole plan.

All stages up to matching work within an image, so micro-batches need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesselle.plans.solve import Params, solve
from tesselle.sources.images import to_pixels, with_id

SCHEMA = "image struct<origin string, height int, width int, nChannels int, mode int, data binary>"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, params: Params = Params(), available_now: bool = True) -> StreamingQuery:
    """Append the matches of each new photo to the Parquet table ``out``; a batch that is run again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        pixels = to_pixels(with_id(batch)).drop("a")
        solve(pixels, params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.format("image").schema(SCHEMA).load(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
