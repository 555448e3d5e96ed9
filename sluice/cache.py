"""Results by tenant, query and versions; one execution for equal callers."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict, defaultdict
from concurrent.futures import Future


def ttl(query_seconds: float) -> float:
    """A thousand times the query's own time, between ten seconds and an hour."""
    return min(max(1000 * query_seconds, 10.0), 3600.0)


def key(tenant: str, text: str, params) -> str:
    return f"{tenant}:{hashlib.sha256(json.dumps([text, params], sort_keys=True, default=str).encode()).hexdigest()}"


class Versions:
    """Counters by tenant, table and scope.  A snapshot names those a result depends on."""

    def __init__(self):
        self.n: dict[tuple, int] = defaultdict(int)
        self.lock = threading.Lock()

    def bump(self, tenant: str, table: str | None = None, scope: str = "") -> None:
        with self.lock:
            self.n[(tenant, table, scope) if table is not None else (tenant,)] += 1
            if scope:
                self.n[tenant, table, None] += 1  # results over the whole table

    def snapshot(self, tenant: str, deps: list[tuple[str, str]]) -> tuple:
        """deps: (table, scope); scope "" is the whole table."""
        with self.lock:
            return (self.n[tenant,], *((t, s, self.n[tenant, t, ""], self.n[tenant, t, s or None]) for t, s in sorted(deps)))


class Cache:
    def __init__(self, max_entries: int = 1000, max_rows: int = 100_000, clock=time.monotonic):
        self.entries: OrderedDict[tuple, tuple[float, list]] = OrderedDict()
        self.max_entries, self.max_rows, self.clock, self.lock = max_entries, max_rows, clock, threading.Lock()
        self.flights: dict[tuple, Future] = {}

    def get(self, k: str, snapshot: tuple):
        with self.lock:
            got = self.entries.get((k, snapshot))
            if got is None or got[0] <= self.clock():
                self.entries.pop((k, snapshot), None)
                return None
            self.entries.move_to_end((k, snapshot))
            return got[1]

    def put(self, k: str, snapshot: tuple, rows: list, seconds: float) -> None:
        if seconds <= 0 or len(rows) > self.max_rows:
            return
        with self.lock:
            self.entries[k, snapshot] = (self.clock() + seconds, rows)
            while len(self.entries) > self.max_entries:
                self.entries.popitem(last=False)

    def through(self, k: str, snapshot: tuple, run) -> tuple[list, str]:
        """The rows, and HIT or MISS; equal calls at one time share a run."""
        if (rows := self.get(k, snapshot)) is not None:
            return rows, "HIT"
        with self.lock:
            mine = (k, snapshot) not in self.flights
            flight = self.flights.setdefault((k, snapshot), Future())
        if not mine:
            return flight.result(), "MISS"
        try:
            began = time.monotonic()
            rows = run()
            self.put(k, snapshot, rows, ttl(time.monotonic() - began))
            flight.set_result(rows)
            return rows, "MISS"
        except BaseException as e:
            flight.set_exception(e)
            raise
        finally:
            with self.lock:
                self.flights.pop((k, snapshot), None)
