"""The watch source against an HTTP server that lists and watches as a cluster does."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlsplit

import pytest

from eventide.sources.watch import Client, Gone, client_config, watched
from eventide.streaming.ingest import ingest

from .test_store import at, keys, store  # noqa: F401


class Cluster:
    """Events by version. Watches know the last ``remembered`` versions only."""

    def __init__(self):
        self.events, self.version, self.remembered, self.asked, self.fail = {}, 100, 1000, [], 0

    def add(self, namespace, n=1):
        for _ in range(n):
            self.version += 1
            name = f"{namespace}-{self.version}"
            self.events[self.version] = {"kind": "Event", "apiVersion": "v1", "metadata": {"name": name, "namespace": namespace, "uid": name, "resourceVersion": str(self.version), "creationTimestamp": "2024-01-01T00:00:05Z"}, "involvedObject": {"kind": "Pod", "name": "p"}, "reason": "BackOff", "type": "Warning", "count": 2, "firstTimestamp": None, "lastTimestamp": "2024-01-01T00:00:30.5Z", "unheard": {"of": 1}}


@pytest.fixture
def cluster():
    held = Cluster()

    class Api(http.server.BaseHTTPRequestHandler):
        def answer(self, code, body):
            body = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urlsplit(self.path)
            given = {k: v[0] for k, v in parse_qs(url.query).items()}
            held.asked.append((url.path, given, self.headers.get("Authorization")))
            parts = url.path.split("/")
            mine = [(v, e) for v, e in sorted(held.events.items()) if parts[3] != "namespaces" or e["metadata"]["namespace"] == parts[4]]
            if "watch" in given:
                return self.watch([(v, e) for v, e in mine if v > int(given["resourceVersion"])], int(given["resourceVersion"]))
            if held.fail:
                held.fail -= 1
                return self.answer(500, {})
            first, version = (int(x) for x in given["continue"].split("/")) if "continue" in given else (0, int(given.get("resourceVersion", held.version)))
            rows = [e for v, e in mine if v <= version]
            size = int(given["limit"])
            meta = {"resourceVersion": str(version)}
            if first + size < len(rows):
                meta["continue"] = f"{first + size}/{version}"
            self.answer(200, {"metadata": meta, "items": rows[first : first + size]})

        def watch(self, rows, start):
            self.send_response(200)
            self.end_headers()
            if start < held.version - held.remembered:
                return self.wfile.write(json.dumps({"type": "ERROR", "object": {"code": 410, "message": "too old"}}).encode() + b"\n")
            for _, thing in rows[:7]:  # the watch ends early
                self.wfile.write(json.dumps({"type": "ADDED", "object": thing}).encode() + b"\n")

        def log_message(self, *args): ...

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    held.url = f"http://127.0.0.1:{server.server_port}"
    yield held
    server.shutdown()


@pytest.mark.parametrize("namespaces", ["", "a,b"])
def test_the_stream_goes_on_after_a_restart(spark, store, cluster, tmp_path, namespaces):
    def run():
        stream = watched(spark, server=cluster.url, pageSize="4", watchSeconds="1", token="secret", **({"namespaces": namespaces} if namespaces else {}))
        running = ingest(stream, store, f"{tmp_path}/offsets", once=True)
        running.awaitTermination()
        return sum(p["numInputRows"] for p in running.recentProgress)

    cluster.add("a", 11)
    cluster.add("b", 5)
    assert run() == 16
    cluster.add("b", 20)
    cluster.add("a", 3)
    assert run() == 23 and run() == 0
    assert keys(store.events(at(0), at(60))[0]) == sorted(map(str, range(101, 140)))
    row = store.events(at(0), at(60))[0].first()
    assert (row["count"], row["type"], row["metadata"]["namespace"] in "ab", row["firstTimestamp"] is not None) == (2, "Warning", True, True)
    assert {a[2] for a in cluster.asked} == {"Bearer secret"}
    assert {a[0] for a in cluster.asked if "watch" in a[1]} == ({"/api/v1/namespaces/a/events", "/api/v1/namespaces/b/events"} if namespaces else {"/api/v1/events"})
    cluster.add("a", 9)
    cluster.remembered = 2  # the versions since the last batch are forgotten: the list is read
    assert run() == 9
    assert keys(store.events(at(0), at(60))[0]) == sorted(map(str, range(101, 149)))


def test_a_batch_that_failed_is_read_again(spark, store, cluster, tmp_path, monkeypatch):
    cluster.add("a", 6)
    usual, failed = store.append, []

    def append(*args):
        if not failed:
            failed.append(1)
            raise OSError("lost")
        return usual(*args)

    monkeypatch.setattr(store, "append", append)
    run = lambda: ingest(watched(spark, server=cluster.url), store, f"{tmp_path}/offsets", once=True).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    cluster.add("a", 2)
    run()  # the batch as it was planned
    assert keys(store.events(at(0), at(60))[0])[:6] == sorted(map(str, range(101, 107)))
    run()
    assert keys(store.events(at(0), at(60))[0]) == sorted(map(str, range(101, 109)))


def test_lists_and_watches(cluster):
    client = Client.of({"SERVER": cluster.url + "/", "pagesize": "3", "watchSeconds": "1"})
    cluster.add("a", 10)
    versions = lambda things: [int(x["metadata"]["resourceVersion"]) for x in things]
    assert client.version() == "110" and versions(client.listed("a")) == list(range(101, 111)) and versions(client.listed("b")) == []
    assert versions(client.listed(None, "105")) == list(range(101, 106))
    assert versions(client.between(None, "100", "109")) == list(range(101, 110)) and versions(client.between("b", "100", "109")) == []
    cluster.remembered = 3
    with pytest.raises(Gone):
        list(client.watched(None, "101", "110"))
    assert versions(client.between(None, "101", "110")) == list(range(102, 111))
    cluster.fail = 1
    with pytest.raises(OSError):
        client.version()


def test_client_configuration(tmp_path):
    account = tmp_path / "account"
    account.mkdir()
    (account / "token").write_text("t\n")
    found = client_config({"KUBERNETES_SERVICE_HOST": "fd00::1", "KUBERNETES_SERVICE_PORT": "6443"}, str(account))
    assert found == {"server": "https://[fd00::1]:6443", "tokenFile": f"{account}/token", "caFile": f"{account}/ca.crt"}
    config = tmp_path / "config"
    config.write_text(json.dumps({"current-context": "x", "contexts": [{"name": "x", "context": {"cluster": "c", "user": "u"}}], "clusters": [{"name": "c", "cluster": {"server": "https://c"}}], "users": [{"name": "u", "user": {"token": "t"}}]}))
    assert client_config({"KUBECONFIG": str(config)}) == {"server": "https://c", "token": "t"}
    with pytest.raises(ValueError):
        client_config({}, str(tmp_path))
