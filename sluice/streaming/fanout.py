"""Log -> subscribers: each sees its columns of the rows its predicate shows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.catalog import Table
from sluice.errors import Forbidden
from sluice.functions import timestamps
from sluice.operators.aggregates import col
from sluice.policy import ReadGrant
from sluice.sources import eventlog


STRETCH = 1 << 16


def visible(decoded: DataFrame, table: Table, grant: ReadGrant) -> DataFrame:
    """Filter on the full row, then project."""
    shown = [c.name for c in table.insertable if grant.column(c.name)]
    return decoded.filter(grant.visible(table)).select("seq", "received_timestamp", "columns", *map(col, shown))


def withheld(decoded: DataFrame, table: Table, grant: ReadGrant) -> DataFrame:
    return decoded.agg(F.count_if(~grant.visible(table)).alias("withheld"))


def schema_frames(decoded: DataFrame, grant: ReadGrant) -> DataFrame:
    """A frame before the first event and wherever the readable column list changes; one log partition is one order.

    Events are compared within stretches of numbers, so that a tenant's log is no single task; a stretch's first
    event is compared with the last of the stretch before, of which there is one row each.
    """
    readable = F.filter("columns", lambda c: F.lit(True) if grant.select is None else c.isin(*[n for n in decoded.columns if grant.column(n)]))
    order, stretch = ["tenant", "_scope"], F.floor(F.col("seq") / STRETCH)
    rows = decoded.select("tenant", F.coalesce("scope", F.lit("")).alias("_scope"), "seq", stretch.alias("_stretch"), readable.alias("sig"))
    ends = rows.groupBy(*order, "_stretch").agg(F.max_by("sig", "seq").alias("_end"))
    ends = ends.select(*order, "_stretch", F.lag("_end").over(Window.partitionBy(*order).orderBy("_stretch")).alias("_before"))
    before = F.coalesce(F.lag("sig").over(Window.partitionBy(*order, "_stretch").orderBy("seq")), F.col("_before"))
    return rows.join(ends, [*order, "_stretch"]).withColumn("was", before).filter(F.col("was").isNull() | (F.col("was") != F.col("sig"))).select("seq", F.col("sig").alias("columns"))


def frames(decoded: DataFrame, table: Table, grant: ReadGrant) -> DataFrame:
    """(seq, id, event, data): schema frames and positional rows as a client reads them."""
    shown = [c.name for c in table.insertable if grant.column(c.name)]
    rows = visible(decoded, table, grant)
    data = rows.select("seq", F.lit(1).alias("rank"), timestamps.show(F.col("received_timestamp")).alias("id"), F.lit("message").alias("event"), eventlog.compact(shown).alias("data"))
    schema = schema_frames(decoded.join(rows.select("seq"), "seq", "left_semi"), grant).select("seq", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("id"), F.lit("schema").alias("event"), F.to_json("columns").alias("data"))
    return schema.unionByName(data).orderBy("seq", "rank").drop("rank")


@dataclass
class Subscriber:
    """A bounded queue that never blocks: what doesn't fit is dropped and counted."""

    grant: ReadGrant | Callable[[], ReadGrant]  # a callable is asked anew at each batch
    size: int = 64
    queue: deque = field(default_factory=deque)
    dropped: int = 0
    schema: str | None = None  # the last one sent
    after: int = -1  # the newest event taken

    def current(self) -> ReadGrant:
        return self.grant() if callable(self.grant) else self.grant

    def offer(self, frame) -> None:
        """Events that it had (a replay reaches into the live log) and schemas that still hold are passed over."""
        if frame.event == "schema" and frame.data == self.schema or frame.event != "schema" and frame.seq <= self.after:
            return
        if len(self.queue) >= min(self.size, 10_000):
            self.dropped += 1
            return
        self.queue.append(frame)
        if frame.event == "schema":
            self.schema = frame.data
        else:
            self.after = frame.seq


def broadcast(events: DataFrame, table: Table, subscribers: list[Subscriber]) -> None:
    """One micro-batch to all subscribers; equal grants share one plan and one read."""
    decoded = eventlog.decode(events, table).persist()
    try:
        plans: dict[int, tuple[ReadGrant, list[Subscriber]]] = {}
        for s in subscribers:
            try:
                own = s.current()
            except Forbidden:  # the policy no longer has a grant: nothing is seen
                continue
            same = next((k for k, (g, _) in plans.items() if g == own), len(plans))
            plans.setdefault(same, (own, []))[1].append(s)
        for grant, group in plans.values():
            most = max(min(s.size, 10_000) for s in group) + 1  # no queue takes more
            shown = frames(decoded.filter(F.col("seq") > min(s.after for s in group)), table, grant)
            got = shown.limit(most).collect()
            beyond = shown.count() - most if len(got) == most else 0
            for s in group:
                s.dropped += beyond
                for frame in got:
                    s.offer(frame)
    finally:
        decoded.unpersist()


def serve(spark: SparkSession, log: str, table: Table, subscribers: list[Subscriber], checkpoint: str, max_files: int = 100, **trigger) -> StreamingQuery:
    """The log's new events to the subscribers of the moment (the list may change between batches), batch by batch."""
    events = spark.readStream.schema(eventlog.ENVELOPE).option("maxFilesPerTrigger", max_files).parquet(log).filter(F.col("table_name") == table.name)
    return events.writeStream.foreachBatch(lambda df, _: broadcast(df, table, list(subscribers))).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_query(backfill: DataFrame, live: DataFrame, key: str = "received_timestamp") -> DataFrame:
    """Backfill, then live rows after its newest."""
    newest = backfill.agg(F.max(key).alias("_newest"))
    return backfill.unionByName(live.join(F.broadcast(newest), F.col("_newest").isNull() | (F.col(key) > F.col("_newest"))).drop("_newest"))
