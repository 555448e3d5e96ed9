"""The whole: queries, pipes, SQL, ingest, schemas and dead letters of one tenant."""

from __future__ import annotations

import re
import threading
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import cache as caching
from sluice import claims as claiming
from sluice import ingest, keys, pipes, policy, sqlscan
from sluice.catalog import Catalog, tenant_id
from sluice.errors import EmptyProjection, Forbidden, LimitExceeded, NotFound, Rejected, from_spark
from sluice.functions import render, shims, timestamps
from sluice.plans import ast, builder
from sluice.settings import Settings
from sluice.sources import eventlog, readers
from sluice.streaming import fanout


#: Views are the session's, not a tenant's: they stand only while a statement is analyzed.
ANALYSIS = threading.Lock()


def rows_to_read(df: DataFrame) -> int:
    """Rows that the scans of a plan would read: Parquet footers answer a count."""
    files = df.inputFiles()
    return df.sparkSession.read.parquet(*files).count() if files else 0


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, settings: Settings, tenant: str = "", clock=None):
        self.spark, self.catalog, self.settings, self.tenant = spark, catalog, settings, tenant_id(tenant)
        self.versions, self.cache, self.clock = caching.Versions(), caching.Cache(), clock
        if catalog.tables is None:
            catalog.refresh()

    def now(self) -> datetime:
        return self.clock() if self.clock else datetime.now(UTC)

    def limits(self) -> tuple[int, int]:
        return self.settings.query("default_max_rows", builder.DEFAULT_MAX_ROWS), self.settings.query("timestamp_bucket_seconds", 0)

    # --- structured queries ---
    def plan(self, table: str, query, role: str | None = None, claims: dict | None = None, now: datetime | None = None) -> DataFrame:
        found = self.catalog.lookup(table)
        q = query if isinstance(query, ast.StructuredQuery) else ast.decode(query)
        grant = policy.grant(self.settings.policy, table, role, "select", claims or {})
        try:
            df = builder.build(q, found, grant, now or self.now(), *self.limits())
        except EmptyProjection:
            return self.spark.createDataFrame([], "empty string")
        except AnalysisException as e:
            raise from_spark(e) from e
        if (cap := grant.cap("max_rows_to_read")) and rows_to_read(found.load()) > cap:
            raise LimitExceeded("max_rows_to_read")
        if (cap := grant.cap("max_memory_usage")) and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue()) > cap:
            raise LimitExceeded("max_memory_usage")  # the optimizer's estimate; Spark has no such limit for a query
        return df

    def query(self, table: str, query, role: str | None = None, claims: dict | None = None) -> tuple[list[dict], str]:
        """The key has all that decides the rows: table, query, the grant with every bound value, the time range's ends and the limits."""
        q, now = query if isinstance(query, ast.StructuredQuery) else ast.decode(query), self.now()
        df = self.plan(table, q, role, claims, now)
        grant = policy.grant(self.settings.policy, table, role, "select", claims or {})
        default, bucket = self.limits()
        ends = [timestamps.bound(x, now, bucket).isoformat() if q.time_range.column and q.time_range.since and x else "" for x in (q.time_range.since, q.time_range.until)]
        k = caching.key(self.tenant, "structured", [table, repr(q), repr(grant), ends, builder.row_limit(q, grant, default), self.catalog.lookup(table).names])
        return self.cache.through(k, self.versions.snapshot(self.tenant, [(table, "")]), lambda: self.rows(df, grant.cap("max_execution_time") / 1000))

    def rows(self, df: DataFrame, seconds: float = 0) -> list[dict]:
        tag, sc, done = f"limit-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event()

        def stop():
            while not done.wait(0.2):  # again and again: the job may not have been submitted yet
                sc.cancelJobsWithTag(tag)

        timer = threading.Timer(seconds, stop) if seconds else None
        sc.addJobTag(tag)
        try:
            if timer:
                timer.start()
            return [r.asDict(recursive=True) for r in render.rendered(df).collect()]
        except Exception as e:
            if timer and not timer.is_alive() or timer and "cancel" in str(e).lower():
                raise LimitExceeded("max_execution_time") from e
            raise from_spark(e) from e
        finally:
            done.set()
            sc.removeJobTag(tag)
            if timer:
                timer.cancel()

    # --- SQL ---
    def sql(self, text: str) -> DataFrame:
        """Verbatim, over those of the tenant's tables that the text names."""
        named = self.named(text)
        with ANALYSIS:
            try:
                for name in named:
                    self.catalog.tables[name].load().createOrReplaceTempView(name)
                return self.spark.sql(shims.rewrite(text))
            except Exception as e:
                raise from_spark(e) from e
            finally:
                for name in named:
                    self.spark.catalog.dropTempView(name)

    def named(self, text: str) -> list[str]:
        words = {w.casefold() for w in re.findall(r"\w+", text)}
        return sorted(n for n in self.catalog.tables if n.isidentifier() and n.casefold() in words)

    def raw_sql(self, text: str, role: str | None) -> DataFrame:
        if not self.settings.policy.is_admin(role):
            raise Forbidden("raw SQL is the admin's")
        if [1 for k, t, _, _ in sqlscan.tokens(text.rstrip().rstrip(";")) if k == "sign" and t == ";"]:
            raise Rejected("one statement at a time")
        return self.sql(text)

    def pipe(self, name: str, supplied: dict | None = None, role: str | None = None, claims: dict | None = None) -> DataFrame:
        text, _ = self.bound(name, supplied, role, claims)
        return self.spark.createDataFrame([], "empty string") if text is None else self.sql(text)

    def pipe_rows(self, name: str, supplied: dict | None = None, role: str | None = None, claims: dict | None = None) -> tuple[list[dict], str]:
        """Reads go through the cache, keyed on the bound text; a write runs every time, and what it names is out of date."""
        text, write = self.bound(name, supplied, role, claims)
        if text is None:
            return [], "MISS"
        named = self.named(text)
        if write:
            try:
                return self.rows(self.sql(text)), "MISS"
            finally:
                for table in named:
                    self.inserted(table)
        deps = [(table, "") for table in named]
        return self.cache.through(caching.key(self.tenant, "pipe", [text]), self.versions.snapshot(self.tenant, deps), lambda: self.rows(self.sql(text)))

    def bound(self, name: str, supplied: dict | None, role: str | None, claims: dict | None) -> tuple[str | None, bool]:
        """The statement (None: a read whose claim can't be bound, which has no rows), and whether it writes."""
        p = self.settings.pipes.get(name)
        if p is None:
            raise NotFound(f"unknown pipe {name!r}")
        if not policy.role_allowed(self.settings.policy, role, list(p.allowed_roles)):
            raise Forbidden(f"pipe {name!r}")
        write = sqlscan.is_write(pipes.skeleton(p))
        try:
            text = pipes.bind(p, supplied or {}, claims or {})
        except pipes.UnresolvedClaim as e:
            if write:
                raise Forbidden(str(e)) from None
            return None, write
        return text, write

    # --- streams ---
    def subscribe(self, table: str, role: str | None = None, claims: dict | None = None, size: int = 64, log: str | None = None, since=None) -> fanout.Subscriber:
        """A subscriber whose policy is read anew at each batch; with a log, it first gets the events since then."""
        found = self.catalog.lookup(table)
        s = fanout.Subscriber(lambda: policy.grant(self.settings.policy, table, role, "select", claims or {}), size)
        s.current()  # denied now is denied at once
        if log is not None:
            fanout.broadcast(eventlog.replay(self.spark, log, self.tenant, table, since), found, [s])
        return s

    # --- ingest ---
    def ingest(self, table: str, body: str, content_type: str = "application/json", role: str | None = None, claims: dict | None = None) -> DataFrame:
        """Outcomes and rows of a request; write the rows with sources.eventlog."""
        found = self.catalog.lookup(table)
        grant = policy.grant(self.settings.policy, table, role, "insert", claims or {})
        rule = self.settings.dedupe(table)
        records = readers.body(self.spark, body, readers.resolve_format(content_type))
        return ingest.prepare(records, found, grant, ingest.Dedupe(rule.get("id_field", ""), bool(rule.get("require_id"))))

    def publish(self, table: str, body: str, log: str, ids: str, content_type: str = "application/json", role: str | None = None, claims: dict | None = None) -> DataFrame:
        """A request into the log; its outcomes.  ids: the folder of the table's held and seen ids.

        Rows without an id are published as they come.  Numbers go on from the log's last: a table has one ingesting driver.
        """
        found, rule = self.catalog.lookup(table), self.settings.dedupe(table)
        rows = self.ingest(table, body, content_type, role, claims)

        def send(ok: DataFrame) -> None:
            last = eventlog.last_seq(self.spark, log, self.tenant, table)
            key = keys.idempotency_column(self.tenant, table, F.col("id")) if rule.get("id_field") else None
            events = eventlog.envelopes(ok, found, self.tenant, F.lit(self.now()), F.col("index") + last, key)
            eventlog.publish(eventlog.unsent(events, log, F.lit(self.now())), log, self.settings.log_bytes())

        held = claiming.Claims(self.spark, ids, self.settings.retention(table), clock=lambda: self.now().timestamp())
        return ingest.outcomes(held.settle(rows, send))

    def inserted(self, table: str) -> None:
        self.versions.bump(self.tenant, table)

    def schema(self, table: str) -> DataFrame:
        rows = [(c.position, c.name, c.type.name, c.default_kind, c.default) for c in self.catalog.lookup(table).columns]
        return self.spark.createDataFrame(rows, "position int, name string, type string, default_kind string, default_expression string").orderBy(F.col("position"))
