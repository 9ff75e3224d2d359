"""The whole service: files that land are ingested, archived by the runner, and answered over HTTP."""

import json
import time
import urllib.error
import urllib.request

from eventide.__main__ import Service

from .test_store import at, event, frame


def test_from_landing_to_answers(spark, tmp_path):
    folder = f"{tmp_path}/landing"
    frame(spark, event(1, 0), event(2, 60)).coalesce(1).write.json(folder)
    service = Service(spark, {"STORE": f"file://{tmp_path}/store", "LANDING": folder, "PORT": "0"})
    try:
        base = f"http://127.0.0.1:{service.server.server_port}"
        asked = {"query": "SELECT count(*) AS n FROM $events", "start": at(0).isoformat(), "end": at(99).isoformat()}
        until, n = time.time() + 60, None
        while n != 3 and time.time() < until:
            if n == 2:
                frame(spark, event(2, 60), event(3, 70)).coalesce(1).write.mode("append").json(folder)
                n = -1
            time.sleep(0.5)
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{base}/query", json.dumps(asked).encode())) as r:
                    found = json.loads(r.read())["results"][0]["n"]
            except urllib.error.HTTPError:  # nothing is stored yet
                continue
            n = found if found == 3 or n is None else n
        assert n == 3
        while service.runner.ticks < 1 and time.time() < until:
            time.sleep(0.1)
        with urllib.request.urlopen(f"{base}/metrics") as r:
            assert b"events_collected_total" in r.read()
        assert service.runner.ticks >= 1 and service.runner.errors == []
    finally:
        service.stop()
    assert not service.runner.thread.is_alive() and not any(s.isActive for s in service.streams)
