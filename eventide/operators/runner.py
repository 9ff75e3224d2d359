"""A background runner of the lifecycle, of which one among several processes works at a time.

The lease is a log beside the manifest: its newest record names the process that works, and until when. A process takes it over once it
has run out, and its owner renews it while a tick lasts. The lease only spares work: ticks that did overlap would be kept
apart by the manifest.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from ..sources.log import Folder, SharedFolder, VersionLog
from ..sources.store import GRACE, EventStore
from .lifecycle import tick


class Lease:
    def __init__(self, folder: Folder, seconds: float, owner: str | None = None, clock: Callable[[], float] = time.time) -> None:
        self.log, self.seconds, self.clock, self.owner = VersionLog(folder), seconds, clock, owner or uuid.uuid4().hex

    def take(self) -> bool:
        """Take or renew the lease; False if another process has it."""
        newest = self.log.newest()
        if newest and newest["owner"] != self.owner and newest["until"] > self.clock():
            return False
        taken = self.log.follow(newest, {"owner": self.owner, "until": self.clock() + self.seconds})
        if taken:
            self.log.prune(self.clock() - 10 * self.seconds)
        return taken

    def give_back(self) -> None:
        newest = self.log.newest()
        if newest and newest["owner"] == self.owner:
            self.log.follow(newest, {"owner": self.owner, "until": 0.0})


class LifecycleRunner:
    """Ticks each so many seconds, if it has the lease. Errors are kept, and the next tick tries again."""

    def __init__(self, store: EventStore, every: float = 60.0, lease_seconds: float = 180.0, limit: int | None = None, grace: float = GRACE, lease: Lease | None = None, work: Callable[[], None] | None = None) -> None:
        self.every = every
        self.lease = lease or Lease(SharedFolder(store.spark, f"{store.root}/lease"), lease_seconds)
        self.work = work or (lambda: tick(store, limit, grace))
        self.ticks, self.errors = 0, []
        self.stopping = threading.Event()
        self.thread = threading.Thread(target=self.run, name="lifecycle", daemon=True)

    def start(self) -> LifecycleRunner:
        self.thread.start()
        return self

    def run(self) -> None:
        while not self.stopping.is_set():
            try:
                if self.lease.take():
                    self.once()
            except Exception as error:
                self.errors = [*self.errors[-9:], error]
            self.stopping.wait(self.every)

    def once(self) -> None:
        """One tick, with the lease renewed beside it."""
        over = threading.Event()

        def renew() -> None:
            while not over.wait(self.lease.seconds / 3):
                try:
                    self.lease.take()
                except Exception as error:
                    self.errors = [*self.errors[-9:], error]

        beside = threading.Thread(target=renew, daemon=True)
        beside.start()
        try:
            self.work()
            self.ticks += 1
        finally:
            over.set()
            beside.join()

    def stop(self, timeout: float | None = None) -> bool:
        """End after the tick that runs, and give the lease back. False if that tick lasts longer than the timeout."""
        self.stopping.set()
        self.thread.join(timeout)
        if self.thread.is_alive():
            return False
        self.lease.give_back()
        return True
