"""Keys looked up by filters whatever the times, and writers that come too late."""

import http.server
import subprocess
import sys
import threading
import urllib.error
import urllib.request

import pytest

from eventide.operators import lifecycle
from eventide.sources import keys as K
from eventide.sources.log import LINEAGE, SharedFolder, VersionLog
from eventide.sources.store import HOT, EventStore, Segment

from .test_store import at, event, frame, keys, store  # noqa: F401


def reads(monkeypatch, store):
    """The segments whose keys an append reads, beside those of its own."""
    usual, seen = store.keys_of, []

    def keys_of(*ids):
        listed = {s.id for s in store.manifest().segments}
        seen.extend(i for i in ids if i in listed)
        return usual(*ids)

    monkeypatch.setattr(store, "keys_of", keys_of)
    return seen


def test_a_known_key_with_another_time_is_dropped(store, spark):
    store.append(frame(spark, event(1, 10), event(2, 20)))
    assert store.append(frame(spark, event(1, 99_999))) == 0
    lifecycle.archive(store, 0)
    assert store.append(frame(spark, event(2, -99_999), event(2, 5, lastTimestamp=None), event(3, 7))) == 1
    assert keys(store.rows_of(*[s.id for s in store.manifest().segments])) == ["1", "2", "3"]


def test_an_append_reads_only_segments_that_may_hold_its_keys(store, spark, monkeypatch):
    for k in range(8):
        store.append(frame(spark, *[event(100 * k + j, 100 * k + j) for j in range(40)]))
    seen = reads(monkeypatch, store)
    assert store.append(frame(spark, event(350, -5), event(9000, 1), event(None, 2), event(None, 2))) == 4 and seen == []
    third = store.manifest().segments[3].id
    assert store.append(frame(spark, event(339, 99_999), event(9001, 1))) == 1 and seen == [third]


def test_filters(spark):
    assert [K.slots_for(n) for n in (0, 1, 1024, 1025, 5000)] == [0, 1, 1, 2, 8]
    held = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    filters = K.key_filter(held, "a", 16).union(K.key_filter(held.where("key < '5'"), "b", 32)).cache()
    assert filters.count() == 48
    asked = lambda *k: sorted(K.segments_with(spark.createDataFrame([(x,) for x in k], "key string"), filters, [16, 32]))
    assert asked("77") == ["a"] and asked("19999") == ["a", "b"] and asked("20001", None) == [] and asked() == []
    every = spark.range(20_000).selectExpr("CAST(id AS STRING) AS key")
    assert K.segments_with(every.where("key >= '5'"), filters.where("segment = 'a'"), [16]) == ["a"]


def test_bounds_of_keys():
    held = Segment("a", HOT, 1, 1, 0, 0, "98", "103", 1)
    assert held.may_hold("99", "99") and held.may_hold("100", "2000") and not held.may_hold("1", "97") and not held.may_hold("104", "1000")
    assert Segment("a", HOT, 1, 1, 0, 0).may_hold("x", "x") and not Segment("a", HOT, 1, 1, 0, 0, None, None, 0).may_hold("x", "x")


def test_segments_without_filters_are_read(store, spark):
    """Those of an earlier state of the library."""
    store.append(frame(spark, event(1, 10)))
    now = store.manifest()
    bare = [Segment(s.id, s.tier, s.rows, s.bytes, s.min_us, s.max_us) for s in now.segments]
    assert store.publish(now, segments=tuple(bare))
    assert store.append(frame(spark, event(1, 500), event(2, 500))) == 1


def test_a_stalled_writer_is_told(store, spark):
    store.append(frame(spark, event(1, 10)))
    stalled = store.manifest()
    for k in (2, 3):
        store.append(frame(spark, event(k, 10)))
    store.vacuum(0)
    assert len(store.versions()) == 1
    assert not store.publish(stalled, batches={"late": 1})
    assert len(store.versions()) == 1 and store.manifest().version == 3 and keys(store.events(at(0), at(99))[0]) == ["1", "2", "3"]


def test_a_version_that_others_have_followed_is_published(spark, tmp_path):
    folder = SharedFolder(spark, f"file://{tmp_path}/log")
    log = VersionLog(folder)
    assert log.newest() is None and log.follow(None, {"x": 0}) and not log.follow(None, {"x": 1})
    usual, other = folder.create, VersionLog(SharedFolder(spark, f"file://{tmp_path}/log"))

    def create(name, text):
        """Others follow, and old records are deleted, before the writer looks."""
        done = usual(name, text)
        if done:
            for k in range(3):
                assert other.follow(other.newest(), {"x": 10 + k})
            other.prune(float("inf"))
        return done

    folder.create = create
    assert log.follow(log.newest(), {"x": 2}) and log.newest()["x"] == 12 and len(log.newest()["lineage"]) == 5 < LINEAGE


class Objects(http.server.BaseHTTPRequestHandler):
    """A store without rename: objects are put whole, if asked only where there is none."""

    held: dict = {}
    lock = threading.Lock()

    def answer(self, code, body=b""):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        name = self.path.strip("/")
        with self.lock:
            body = "\n".join(self.held).encode() if not name else self.held.get(name)
        self.answer(404 if body is None else 200, body or b"")

    def do_PUT(self):
        body, name = self.rfile.read(int(self.headers["Content-Length"])), self.path.strip("/")
        with self.lock:
            taken = self.headers.get("If-None-Match") == "*" and name in self.held
            if not taken:
                self.held[name] = body
        self.answer(412 if taken else 200)

    def do_DELETE(self):
        with self.lock:
            self.held.pop(self.path.strip("/"), None)
        self.answer(200)

    def log_message(self, *args): ...


class ObjectFolder:
    def __init__(self, url):
        self.url = url

    def ask(self, name, method="GET", body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/{name}", body, {k.replace("_", "-"): v for k, v in headers.items()}, method=method)) as r:
                return r.read().decode()
        except urllib.error.HTTPError as error:
            if error.code == 404:
                raise FileNotFoundError(name) from error
            return None

    def names(self):
        return [n for n in self.ask("").splitlines() if n]

    def read(self, name):
        return self.ask(name)

    def create(self, name, text):
        return self.ask(name, "PUT", text.encode(), If_None_Match="*") is not None

    def delete(self, name):
        self.ask(name, "DELETE")

    def changed(self, name):
        return None


COUNTS = """
import sys
sys.path[:0] = [{root!r}]
from eventide.sources.log import VersionLog
from tests.test_keys import ObjectFolder
log, done = VersionLog(ObjectFolder({url!r})), 0
while done < 40:
    now = log.newest()
    done += log.follow(now, {{"counts": (now or {{}}).get("counts", {{}}) | {{sys.argv[1]: done + 1}}}})
"""


@pytest.fixture
def objects():
    Objects.held = {}
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Objects)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_processes_on_a_store_without_rename_lose_nothing(objects):
    root = __import__("pathlib").Path(__file__).resolve().parent.parent
    text = COUNTS.format(root=str(root), url=objects)
    running = [subprocess.Popen([sys.executable, "-c", text, name]) for name in "abc"]
    assert [p.wait(120) for p in running] == [0, 0, 0]
    newest = VersionLog(ObjectFolder(objects)).newest()
    assert newest["counts"] == {"a": 40, "b": 40, "c": 40} and newest["version"] == 120 == len(Objects.held)


def test_an_event_store_with_its_log_elsewhere(spark, tmp_path, objects):
    one, two = (EventStore(spark, f"file://{tmp_path}/s", ObjectFolder(objects)) for _ in range(2))
    work = [threading.Thread(target=lambda s=s, k=k: [s.append(frame(spark, event(k * 10 + j, j), event(99, j))) for j in range(3)]) for k, s in enumerate((one, two))]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert keys(one.events(at(0), at(9))[0]) == ["0", "1", "10", "11", "12", "2", "99"]
