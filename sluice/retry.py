"""When to try again: growing pauses, one probe at a time, and streams that restart from their checkpoint."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQuery

from sluice.errors import from_spark

FIRST = 1.0


@dataclass
class Outage:
    failures: int
    until: float
    cap: float
    began: float
    probe: bool = False


class Backoff:
    """Pauses of a target as a whole (table None) and of single tables of it.

    A pause doubles with each failure up to the cap of whoever failed, and is dealt between half of that and all
    of it, so that many don't return at once.  After it one caller may try; the others wait for what it finds.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic, chance: Callable[[], float] = random.random):
        self.clock, self.chance, self.lock = clock, chance, threading.Lock()
        self.outages: dict[str | None, Outage] = {}

    def ask(self, table: str | None, cap: float) -> float:
        """Seconds to stay away; at 0 the caller tries and must report worked() or failed()."""
        with self.lock:
            now, open_ = self.clock(), [o for k in {None, table} if (o := self.outages.get(k))]
            for o in open_:  # a smaller cap shortens the pause
                o.cap = min(o.cap, max(cap, FIRST))
                o.until = min(o.until, now + o.cap)
            waits = [o.until - now + FIRST * self.chance() if o.until > now else FIRST * (1 + self.chance()) / 2 for o in open_ if o.until > now or o.probe]
            if waits:
                return max(waits)
            for o in open_:
                o.probe = True
            return 0.0

    def failed(self, error: Exception, table: str | None, cap: float) -> float:
        """The pause after a failure: the table's own if the error is about it, else everyone's."""
        with self.lock:
            now, key = self.clock(), table if from_spark(error).table_scoped else None
            if key is None and table in self.outages:
                self.outages[table].probe = False
            o = self.outages.get(key)
            if o and now < o.until:  # began before the outage was known: the pause stands
                return o.until - now
            n, cap = (o.failures if o else 0) + 1, max(cap, FIRST)
            pause = min(FIRST * 2.0 ** min(n - 1, 60), cap) * (1 + self.chance()) / 2
            self.outages[key] = Outage(n, now + pause, cap, o.began if o else now)
            return pause

    def worked(self, table: str | None) -> float:
        """Any verdict of the target, a refused row included, ends its outage; how long it was."""
        with self.lock:
            ended = [o.began for k in {None, table} if (o := self.outages.pop(k, None))]
            return self.clock() - min(ended) if ended else 0.0


def insist(run: Callable[[], object], backoff: Backoff, table: str | None = None, cap: float = 60.0, attempts: int = 0, sleep: Callable[[float], None] = time.sleep):
    """run() until it succeeds, is refused for good, or has had its attempts (0: no bound)."""
    n = 0
    while True:
        while wait := backoff.ask(table, cap):
            sleep(wait)
        try:
            out = run()
        except Exception as e:
            error = from_spark(e)
            if not error.retryable:
                backoff.worked(table)
                raise error from e
            n += 1
            backoff.failed(error, table, cap)
            if n == attempts:
                raise error from e
            continue
        backoff.worked(table)
        return out


def supervise(start: Callable[[], StreamingQuery], backoff: Backoff, table: str | None = None, cap: float = 60.0, attempts: int = 0, sleep: Callable[[float], None] = time.sleep) -> None:
    """A stream to its end; after a failure that may pass it starts again from its checkpoint.

    Its batches write folders of their own number, so one that was half done replaces itself.
    """
    insist(lambda: start().awaitTermination(), backoff, table, cap, attempts, sleep)
