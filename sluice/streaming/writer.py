"""Log -> table: micro-batches with dead letters, idempotent by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice import ingest
from sluice.catalog import Table
from sluice.errors import from_spark
from sluice.sources import eventlog


def source(spark: SparkSession, path: str, max_files: int = 100, max_bytes: int = 0) -> DataFrame:
    """max_bytes, if given, sizes the batches instead of the number of files."""
    bound = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(eventlog.ENVELOPE).option(*bound).parquet(path)


def write_batch(events: DataFrame, batch: int, table: Table, target: str, dlq: str | None, after: Callable[[], None] | None = None) -> None:
    """One micro-batch: each goes to a folder of its own number, so that a repeated batch replaces itself.

    A target that refuses the batch for good parks all of it; one that may take it later fails the batch.
    """
    events = events.filter(F.col("table_name") == table.name).persist()
    try:
        good, bad = ingest.typed(eventlog.decode(events, table), table)
        if not dlq and bad.limit(1).count():  # before anything is written: the batch comes again
            raise ValueError(f"rows that can't be stored and no dead-letter table: {table.name}")
        try:
            good.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        except Exception as e:
            if not dlq or from_spark(e).retryable:
                raise
            parked = events.select(F.to_json(F.struct("columns", "row")).alias("payload"), F.lit(str(e)[:500]).alias("error"))
            eventlog.dead_letters(parked, table.name, F.current_timestamp()).write.mode("overwrite").parquet(f"{dlq}/batch={batch}")
            return
        if dlq:
            sick = events.withColumn("error", eventlog.poison()).filter("error is not null").select(F.to_json(F.struct("columns", "row")).alias("payload"), "error")
            eventlog.dead_letters(bad.unionByName(sick), table.name, F.current_timestamp()).write.mode("overwrite").parquet(f"{dlq}/batch={batch}")
        if after:
            after()
    finally:
        events.unpersist()


def start(spark: SparkSession, log: str, table: Table, target: str, dlq: str | None, checkpoint: str, after: Callable[[], None] | None = None, max_bytes: int = 0, **trigger) -> StreamingQuery:
    """trigger: processingTime="5 seconds" or availableNow=True; max_bytes: of a batch."""
    return source(spark, log, max_bytes=max_bytes).writeStream.foreachBatch(lambda df, n: write_batch(df, n, table, target, dlq, after)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
