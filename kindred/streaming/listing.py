"""Change feeds as streams: a keyed listing kept by upserts and deletes, windowed counts; first-seen state is in ``cleaning``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.sources.journaled import SEQUENCE, JournaledTable
from kindred.streaming.cleaning import first_seen as first_seen


def keep_listing(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of changes (path, size, modified, op) once, under its batch id; a batch run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_table(changes: DataFrame, table: JournaledTable, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Appends each batch of a stream of changes to a journaled table, once: a batch that is run again after a crash is known by its id.

    ``order`` is the column that tells which of a key's changes in one batch is the last.
    """

    def put(batch: DataFrame, number: int) -> None:
        table.append(batch.withColumn(SEQUENCE, F.col(order).cast("long")) if order else batch, name=str(number))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and kind; rows later than the watermark are dropped. Works on tables and streams."""
    return events.withWatermark(at, late).groupBy(F.window(at, window)["start"].alias("start"), kind).agg(F.count(F.lit(1)).alias("n"))
