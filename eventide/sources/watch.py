"""Events of a Kubernetes cluster as a stream: list, then watch, resumed by resource version.

``spark.readStream.format("event_watch").schema(EVENT_SCHEMA).options(...).load()``, or ``watched``. Offsets are resource versions of the cluster's list of events.
The first micro-batch reads the list as it stood at its version, page by page; each later one replays the watch from the last
version to the one that the list has now, for each namespace by a task of its own. The checkpoint holds the offsets, so a stream that is
restarted goes on where its last committed batch ended, and a batch that failed is read again. Where the cluster has forgotten
a version (410), the list is read instead, and of it all events after the batch's first version: some of them come again with the next
batch, which the store's keys absorb.

Options: ``server`` (URL), ``token`` or ``tokenFile``, ``caFile``, ``namespaces`` (comma-separated; all if left out, as one task), ``pageSize``,
``watchSeconds`` (how long one watch request may stay open). Where ``server`` is left out, the service account of the pod that
runs the driver is taken, as the cluster mounts it, else the current context of the file in KUBECONFIG (as JSON).
"""

from __future__ import annotations

import json
import os
import ssl
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .schema import EVENT_SCHEMA

FORMAT = "event_watch"
ACCOUNT = "/var/run/secrets/kubernetes.io/serviceaccount"
#: Times that a watch that has ended before its last version is asked again.
TRIES = 20


class Gone(Exception):
    """The cluster has forgotten the version."""


def client_config(environ: Mapping[str, str] = os.environ, account: str = ACCOUNT) -> dict[str, str]:
    """Options for ``server``, ``tokenFile`` and ``caFile`` (or ``token``) from a pod's service account, or from a configuration file."""
    host = environ.get("KUBERNETES_SERVICE_HOST")
    if host and os.path.exists(f"{account}/token"):
        host = f"[{host}]" if ":" in host else host
        return {"server": f"https://{host}:{environ.get('KUBERNETES_SERVICE_PORT', '443')}", "tokenFile": f"{account}/token", "caFile": f"{account}/ca.crt"}
    if environ.get("KUBECONFIG"):
        with open(environ["KUBECONFIG"], encoding="utf-8") as file:
            raw = json.load(file)
        named = lambda kind, name: next(x for x in raw[kind + "s"] if x["name"] == name)[kind]
        context = named("context", raw["current-context"])
        cluster, user = named("cluster", context["cluster"]), named("user", context["user"])
        found = {"server": cluster["server"], "caFile": cluster.get("certificate-authority"), "token": user.get("token"), "tokenFile": user.get("tokenFile")}
        return {k: v for k, v in found.items() if v}
    raise ValueError("no server is given, and there is neither a service account nor KUBECONFIG")


@dataclass
class Client:
    """Lists and watches, with the standard library. Tokens are read anew for each request, as they are rotated."""

    server: str
    token: str | None = None
    token_file: str | None = None
    ca_file: str | None = None
    page: int = 500
    seconds: int = 30

    @staticmethod
    def of(options: Mapping[str, str]) -> Client:
        given = {k.lower(): v for k, v in options.items()}
        if "server" not in given:
            given |= {k.lower(): v for k, v in client_config().items()}
        return Client(given["server"].rstrip("/"), given.get("token"), given.get("tokenfile"), given.get("cafile"), int(given.get("pagesize", 500)), int(given.get("watchseconds", 30)))

    def open(self, namespace: str | None, **query: Any):
        path = f"/api/v1/namespaces/{namespace}/events" if namespace else "/api/v1/events"
        asked = urllib.request.Request(f"{self.server}{path}?{urlencode({k: v for k, v in query.items() if v is not None})}", headers={"Accept": "application/json"})
        token = self.token
        if self.token_file:
            with open(self.token_file, encoding="utf-8") as file:
                token = file.read().strip()
        if token:
            asked.add_header("Authorization", f"Bearer {token}")
        context = ssl.create_default_context(cafile=self.ca_file) if self.server.startswith("https") else None
        try:
            return urllib.request.urlopen(asked, timeout=self.seconds + 30, context=context)
        except urllib.error.HTTPError as error:
            if error.code == 410:
                raise Gone(path) from error
            raise

    def version(self, namespace: str | None = None) -> str:
        """The list's version now."""
        with self.open(namespace, limit=1) as answer:
            return json.load(answer)["metadata"]["resourceVersion"]

    def listed(self, namespace: str | None, version: str | None = None) -> Iterator[dict]:
        """The events of the list, as it stood at the version (None: now). A list that is forgotten between two pages is begun anew, as it stands then."""
        more, asked = None, version
        while True:
            exact = {"resourceVersion": asked, "resourceVersionMatch": "Exact"} if asked and not more else {}
            try:
                with self.open(namespace, limit=self.page, **{"continue": more}, **exact) as answer:
                    page = json.load(answer)
            except Gone:
                if not more and not asked:
                    raise
                more, asked = None, None
                continue
            yield from page["items"]
            more = page["metadata"].get("continue")
            if not more:
                return

    def watched(self, namespace: str | None, start: str, end: str) -> Iterator[dict]:
        """The events added or changed after one version and up to another, in the order of the cluster."""
        at, last = int(start), int(end)
        for _ in range(TRIES):
            with self.open(namespace, watch=1, resourceVersion=at, allowWatchBookmarks="true", timeoutSeconds=self.seconds) as lines:
                for line in lines:
                    said = json.loads(line)
                    thing = said["object"]
                    if said["type"] == "ERROR":
                        if thing.get("code") == 410:
                            raise Gone(start)
                        raise OSError(f"the watch failed: {thing.get('message')}")
                    version = int(thing["metadata"]["resourceVersion"])
                    if version > last:
                        return
                    at = version
                    if said["type"] in ("ADDED", "MODIFIED"):
                        yield thing
                    if at >= last:
                        return
            if at >= last or not self.newer(namespace, at, last):
                return
        raise OSError(f"the watch of {namespace or 'all namespaces'} did not come to version {end}")

    def newer(self, namespace: str | None, at: int, last: int) -> bool:
        """Whether the list holds an event of a version after the one and up to the other: a watch of a quiet namespace sees no end."""
        return any(at < int(x["metadata"]["resourceVersion"]) <= last for x in self.listed(namespace))

    def between(self, namespace: str | None, start: str | None, end: str) -> Iterator[dict]:
        if start is None:
            yield from self.listed(namespace, end)
            return
        try:
            yield from self.watched(namespace, start, end)
        except Gone:
            for thing in self.listed(namespace):
                if int(thing["metadata"]["resourceVersion"]) > int(start):
                    yield thing


def fitted(value: Any, kind: T.DataType) -> Any:
    """A JSON value as the schema has it; times are read as RFC 3339, a missing value is null."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.TimestampType):
        found = datetime.fromisoformat(value)
        return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    return int(value) if isinstance(kind, T.IntegralType) else str(value)


@dataclass
class Share(InputPartition):
    """A namespace (None: all) between two versions; from None: the whole list."""

    namespace: str | None
    start: str | None
    end: str


class WatchReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.kind, self.client = schema, Client.of(options)
        named = next((v for k, v in options.items() if k.lower() == "namespaces"), "")
        self.namespaces: list[str | None] = [n.strip() for n in named.split(",") if n.strip()] or [None]

    def initialOffset(self) -> dict:
        return {"version": None}

    def latestOffset(self) -> dict:
        return {"version": self.client.version()}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if start["version"] == end["version"]:
            return []
        return [Share(n, start["version"], end["version"]) for n in self.namespaces]

    def read(self, partition: Share) -> Iterator[tuple]:
        for thing in self.client.between(partition.namespace, partition.start, partition.end):
            yield fitted(thing, self.kind)

    def commit(self, end: dict) -> None: ...


class EventWatch(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return EVENT_SCHEMA

    def streamReader(self, schema: T.StructType) -> WatchReader:
        return WatchReader(schema, self.options)


def watched(spark: SparkSession, **options: str) -> DataFrame:
    """The stream of a cluster's events, for ``streaming.ingest.ingest``."""
    spark.dataSource.register(EventWatch)
    return spark.readStream.format(FORMAT).options(**options).load()
