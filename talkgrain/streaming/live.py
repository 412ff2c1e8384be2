"""Change streams into the store, and arrivals per chat as a stream or whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkgrain.operators.changes import monitored
from talkgrain.schema import CHANGES
from talkgrain.sources.store import MessageStore


def read_changes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Changes as a stream of Parquet files in a folder."""
    reader = spark.readStream.schema(CHANGES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def follow(stream: DataFrame, store: MessageStore, checkpoint: str, watched: Callable[[], DataFrame] | None = None, exclude: bool = False, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Append a stream of changes to the store, a commit a batch. watched() is read anew for each batch.

    A batch that is run again after a failure appends the same changes again; the fold gives the same messages.
    progress: told the batch and its rows, which are counted while they are written.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch if watched is None else monitored(batch, watched(), exclude)
        seen = Observation(f"batch-{number}")
        store.append(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        if progress:
            progress(number, seen.get["rows"])

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str = "post_time", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """New messages a chat and window of time; later ones than the watermark are dropped, so that `all_arrivals` alone is whole."""
    return _arrivals(_new(stream, time).withWatermark("at", late), width)


def all_arrivals(changes: DataFrame, time: str = "post_time", width: str = "1 day") -> DataFrame:
    """The same counts over all changes of a batch, however late they came."""
    return _arrivals(_new(changes, time), width)


def _new(changes: DataFrame, time: str) -> DataFrame:
    return changes.where("op = 'new'").withColumn("at", F.col(time).cast("timestamp"))


def _arrivals(timed: DataFrame, width: str) -> DataFrame:
    return timed.groupBy(F.window("at", width), "chat_id").agg(F.count("*").alias("n"))
