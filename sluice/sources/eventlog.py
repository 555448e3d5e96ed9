"""A durable, replayable log of ingested rows, and its dead letters, as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.catalog import Table
from sluice.errors import QueueFull
from sluice.operators.aggregates import col
from sluice.operators.once import once
from sluice.sources import files

ENVELOPE = "tenant string, table_name string, scope string, seq long, received_timestamp timestamp, format string, columns array<string>, row string, key string"


def compact(columns: list[str]) -> Column:
    """Positional JSON array over the columns; absent values are null."""
    return F.to_json(F.array(*(col(c).cast("string") for c in columns)))


def envelopes(rows: DataFrame, table: Table, tenant: str, received: Column, seq: Column, key: Column | None = None) -> DataFrame:
    """key: by which a row that is sent again is known; null if nothing tells."""
    names = [c.name for c in table.insertable]
    return rows.select(F.lit(tenant).alias("tenant"), F.lit(table.name).alias("table_name"), F.lit("").alias("scope"), seq.cast("long").alias("seq"), received.alias("received_timestamp"), F.lit("json_compact").alias("format"), F.array(*map(F.lit, names)).alias("columns"), compact(names).alias("row"), (F.lit(None) if key is None else key).cast("string").alias("key"))


def publish(events: DataFrame, path: str, max_bytes: int = 0) -> None:
    """Append; refuse when the log is past its budget."""
    if max_bytes and files.size(events.sparkSession, path) >= max_bytes:
        raise QueueFull()
    events.write.mode("append").partitionBy("tenant", "table_name").parquet(path)


def unsent(events: DataFrame, path: str, now: Column | None = None, window_seconds: int = 120) -> DataFrame:
    """Without the rows whose key the log took in the last two minutes: a repeat of a request that failed half-way."""
    spark = events.sparkSession
    if not files.names(spark, path):
        return events
    since = (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(window_seconds))
    recent = spark.read.schema(ENVELOPE).parquet(path).filter((F.col("received_timestamp") >= since) & F.col("key").isNotNull())
    return events.join(recent.select("tenant", "table_name", "key"), ["tenant", "table_name", "key"], "left_anti")


def last_seq(spark: SparkSession, path: str, tenant: str, table: str) -> int:
    """The newest number given in a table's part of the log; 0 before the first."""
    if not files.names(spark, path):
        return 0
    part = spark.read.schema(ENVELOPE).parquet(path).filter((F.col("tenant") == tenant) & (F.col("table_name") == table))
    return part.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def poison(values: Column | None = None) -> Column:
    """Why an envelope can't be paired with columns; null if it can.  values: the row's, if they're at hand."""
    values = F.from_json("row", "array<string>") if values is None else values
    return (
        F.when(F.col("table_name").isNull() | F.col("row").isNull(), "malformed").when(F.col("format") != "json_compact", "unknown_format")
        .when(values.isNull() | ~F.rtrim("row").endswith("]"), "malformed").when(F.coalesce(F.size("columns"), F.lit(0)) <= 0, "unpairable")
        .when(F.size(F.array_distinct("columns")) != F.size("columns"), "unpairable").when(F.size("columns") != F.size(values), "unpairable")
    )


def decode(events: DataFrame, table: Table) -> DataFrame:
    """Clean envelopes of a table with a text column for each of its columns, whatever column list each was written with."""
    parsed = once(events, {"_values": F.from_json("row", "array<string>")})
    clean = poison(F.col("_values")).isNull()
    # guarded once more: a pushed-down filter may look at the pairs of rows that aren't clean
    good = parsed.filter(clean).withColumn("_pairs", F.when(clean, F.map_from_arrays("columns", "_values")))
    return good.select("tenant", "scope", "seq", "received_timestamp", "columns", *(F.element_at("_pairs", c.name).alias(c.name) for c in table.insertable))


def replay(spark: SparkSession, path: str, tenant: str, table: str, since=None) -> DataFrame:
    """Events at or after ``since``, in order; partition pruning does the rest."""
    df = spark.read.schema(ENVELOPE).parquet(path).filter((F.col("tenant") == tenant) & (F.col("table_name") == table))
    if since is not None:
        df = df.filter(F.col("received_timestamp") >= F.lit(since))
    return df.orderBy("seq")


def dead_letters(bad: DataFrame, table: str, at: Column) -> DataFrame:
    return bad.select(F.lit(table).alias("table"), F.col("error"), at.alias("ts"), F.col("payload"))


def dead_letter_counts(dlq: DataFrame, table: str | None = None) -> DataFrame:
    return (dlq.filter(F.col("table") == table) if table else dlq).groupBy("table").agg(F.count("*").alias("n"))


def purge(spark: SparkSession, path: str, ack_floor: int, cutoff: Column) -> int:
    """The sweep itself: delete the log's files of which no event is retained; how many went.  Files are small beside the log."""
    log = spark.read.schema(ENVELOPE).parquet(path).withColumn("file", F.input_file_name())
    kept = retained(log, ack_floor, cutoff).select("file").distinct()
    gone = log.select("file").distinct().join(kept, "file", "left_anti").toLocalIterator()
    n = 0
    for r in gone:  # names only, streamed
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r.file))
        n += p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    return n


def trim_dead_letters(spark: SparkSession, path: str, log_bytes: int) -> int:
    """Delete the oldest batches until a tenth of the log's budget holds the rest; how many went.  The newest stays."""
    batches = sorted((n for n in files.names(spark, path) if n.startswith("batch=")), key=lambda n: int(n.split("=")[1]))
    sizes = [files.size(spark, f"{path}/{n}") for n in batches]
    n = 0
    while n < len(batches) - 1 and sum(sizes[n:]) > log_bytes // 10:
        files.delete(spark, f"{path}/{batches[n]}")
        n += 1
    return n


def retained(log: DataFrame, ack_floor: int, cutoff: Column) -> DataFrame:
    """What a sweep keeps: all from the first unacknowledged or still fresh event on."""
    fresh = log.filter(F.col("received_timestamp") >= cutoff).agg(F.min("seq").alias("first"))
    edge = F.least(F.lit(ack_floor + 1), F.coalesce(F.col("first"), F.lit(ack_floor + 1)))
    return log.join(F.broadcast(fresh), F.col("seq") >= edge).drop("first")  # fresh is one row
