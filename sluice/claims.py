"""Ids that a request holds while it publishes, and what becomes of them if publishing fails.

held/<end of the lease>-<token>/ has the ids of one request, seen/ the ids that were published with
their expiry; both are Parquet in a folder that all executors share, and ids never come to the driver.
A table has one ingesting driver: the lock of this process is what keeps two requests apart.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import ingest
from sluice.errors import InFlight, QueueFull, Unavailable
from sluice.sources import files

LEASE = 30.0


class Claims:
    def __init__(self, spark: SparkSession, path: str, retention: float = 0, lease: float = LEASE, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.retention, self.lease, self.clock = spark, path.rstrip("/"), retention, lease, clock
        self.lock = threading.Lock()

    def held(self) -> list[str]:
        """Folders whose lease runs; those that lapsed are deleted."""
        live = []
        for name in files.names(self.spark, f"{self.path}/held"):
            if int(name.split("-")[0]) > self.clock() * 1000:
                live.append(f"{self.path}/held/{name}")
            else:
                files.delete(self.spark, f"{self.path}/held/{name}")
        return live

    def seen(self) -> DataFrame:
        if not files.names(self.spark, f"{self.path}/seen"):
            return self.spark.createDataFrame([], "id string, expires_at timestamp")
        return self.spark.read.schema("id string, expires_at timestamp").parquet(f"{self.path}/seen")

    def reserve(self, prepared: DataFrame) -> tuple[str, DataFrame]:
        """A token for the request's new ids, and its rows with the stored ids marked as duplicates.

        If another request holds one of the ids, its outcome decides this one's: come again after the lease.
        """
        with self.lock:
            marked = ingest.against_seen(prepared, self.seen(), F.timestamp_millis(F.lit(int(self.clock() * 1000))))
            mine = marked.filter((F.col("status") == "ok") & F.col("id").isNotNull()).select("id")
            if (others := self.held()) and not mine.join(self.spark.read.schema("id string").parquet(*others), "id", "left_semi").isEmpty():
                raise InFlight("another request publishes one of these ids", retry_after=self.lease)
            token = f"{int((self.clock() + self.lease) * 1000)}-{uuid.uuid4().hex}"
            mine.write.parquet(f"{self.path}/held/{token}")
            return token, marked

    def commit(self, token: str) -> None:
        """Published: seen from now on, for the retention (0: for good), then held no more."""
        until = F.timestamp_millis(F.lit(int((self.clock() + self.retention) * 1000))) if self.retention else F.lit(None).cast("timestamp")
        ids = self.spark.read.schema("id string").parquet(f"{self.path}/held/{token}")
        ids.select("id", until.alias("expires_at")).write.mode("append").parquet(f"{self.path}/seen")
        self.release(token)

    def release(self, token: str) -> None:
        files.delete(self.spark, f"{self.path}/held/{token}")

    def settle(self, prepared: DataFrame, publish: Callable[[DataFrame], None]) -> DataFrame:
        """Reserve, publish the rows that are ok, commit.

        A log that is full took nothing: the ids are free at once.  After any other failure the rows may be there:
        the ids stay held until the lease ends, and who comes again then sends the same idempotency keys.
        """
        token, marked = self.reserve(prepared)
        try:
            publish(marked.filter(F.col("status") == "ok"))
        except QueueFull:
            self.release(token)
            raise
        except Exception as e:
            raise Unavailable(str(e)[:500], retry_after=self.lease) from e
        self.commit(token)
        return marked
