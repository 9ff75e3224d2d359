"""The service: ``spark-submit`` or ``python -m eventide``. It ingests, keeps the store in order and answers queries until it is stopped.

STORE names the store's folder, which all executors see; PORT the port (8080); LANDING a folder of JSON files, or WATCH a cluster's server
(``auto``: the one that the pod or KUBECONFIG names) and NAMESPACES those to be watched; STORAGE_LIMIT_GB the store's limit.
"""

from __future__ import annotations

import os
import signal
import threading
from collections.abc import Mapping
from http.server import ThreadingHTTPServer

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.runner import LifecycleRunner
from .server import serve
from .session import SETTINGS, configured
from .sources.store import EventStore
from .sources.watch import watched
from .streaming.ingest import CollectedCounter, ingest, landing


class Service:
    """Everything that runs side by side. Several processes may serve one store; of their lifecycle runners one works at a time."""

    def __init__(self, spark: SparkSession, environ: Mapping[str, str]) -> None:
        root = environ["STORE"].rstrip("/")
        self.spark, self.store, self.streams = configured(spark), EventStore(spark, root), []
        counter = CollectedCounter()
        spark.streams.addListener(counter)
        self.counter = counter
        if environ.get("LANDING"):
            self.streams.append(ingest(landing(spark, environ["LANDING"]), self.store, f"{root}/offsets/landing", "landing"))
        if environ.get("WATCH"):
            options = {} if environ["WATCH"] == "auto" else {"server": environ["WATCH"]}
            if environ.get("NAMESPACES"):
                options["namespaces"] = environ["NAMESPACES"]
            self.streams.append(ingest(watched(spark, **options), self.store, f"{root}/offsets/watch", "watch"))
        self.runner = LifecycleRunner(self.store).start()
        self.server: ThreadingHTTPServer = serve(Engine(spark, self.store), int(environ.get("PORT", "8080")), counter)
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        """Streams first, then the runner's tick, then the answers."""
        for stream in self.streams:
            stream.stop()
        self.runner.stop()
        self.server.shutdown()
        self.server.server_close()
        self.spark.streams.removeListener(self.counter)


def main() -> None:
    builder = SparkSession.builder.appName("eventide")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    service, over = Service(builder.getOrCreate(), os.environ), threading.Event()
    for sign in (signal.SIGTERM, signal.SIGINT):
        signal.signal(sign, lambda *_: over.set())
    over.wait()
    service.stop()


if __name__ == "__main__":
    main()
