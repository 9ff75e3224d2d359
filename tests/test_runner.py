"""The background runner, and figures of executors."""

import subprocess
import sys
import threading
import time
from pathlib import Path

from eventide.engine import Engine
from eventide.operators.runner import Lease, LifecycleRunner
from eventide.sources.log import SharedFolder

from .test_store import at, event, frame, keys, store  # noqa: F401


def wait_for(what, seconds=30):
    until = time.time() + seconds
    while not what() and time.time() < until:
        time.sleep(0.05)
    assert what()


def test_a_lease_has_one_owner(spark, tmp_path):
    now = [1000.0]
    one, two = (Lease(SharedFolder(spark, f"file://{tmp_path}/lease"), 30, n, lambda: now[0]) for n in "ab")
    assert one.take() and one.take() and not two.take()
    now[0] += 29
    assert not two.take() and one.take()
    now[0] += 31  # the owner has died
    assert two.take() and not one.take()
    two.give_back()
    assert one.take() and not two.take()
    two.give_back()  # it is not its own
    assert not two.take() and len(one.log.names()) <= 8


def test_of_two_runners_one_archives(store, spark):
    for k in range(3):
        store.append(frame(spark, event(k, k)))
    worked = []

    def work(name):
        from eventide.operators.lifecycle import archive

        if archive(store, 1):
            worked.append(name)
        time.sleep(0.8)  # longer than the lease, which is renewed meanwhile

    folder = f"{store.root}/lease"
    runners = [LifecycleRunner(store, 0.05, lease=Lease(SharedFolder(spark, folder), 0.5, n), work=lambda n=n: work(n)).start() for n in "ab"]
    wait_for(lambda: sum(r.ticks for r in runners) >= 2)
    first = next(r for r in runners if r.ticks)
    other = next(r for r in runners if r is not first)
    assert other.ticks == 0 and len(worked) == 1 and [s.tier for s in store.manifest().segments] == ["archive"]
    assert first.stop(20) and not first.thread.is_alive()
    wait_for(lambda: other.ticks >= 1)
    assert other.stop(20) and first.errors == other.errors == []
    assert keys(store.events(at(0), at(9))[0]) == ["0", "1", "2"]


def test_an_error_does_not_end_the_runner(store):
    calls = []

    def work():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("once")

    runner = LifecycleRunner(store, 0.01, work=work).start()
    wait_for(lambda: runner.ticks >= 2)
    assert runner.stop(10) and [str(e) for e in runner.errors] == ["once"]


def test_the_usual_work_is_a_tick(store, spark):
    from eventide.operators import lifecycle

    store.append(frame(spark, event(1, 1)))
    lifecycle.archive(store, 0)
    runner = LifecycleRunner(store, 60, limit=0, grace=0)
    threading.Thread(target=runner.once).run()
    assert runner.ticks == 1 and store.manifest().segments == ()


CLUSTER = """
import sys, json
sys.path[:0] = [{root!r}]
from pyspark.sql import SparkSession
from eventide.figures import executors, local_folders
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "800m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.driver.host", "127.0.0.1").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import time
until = time.time() + 60
while len(executors(spark)) < 3 and time.time() < until:
    time.sleep(0.2)
from pyspark import StorageLevel
spark.range(0, 200000, 1, 8).selectExpr("id", "repeat(string(id), 3) s").persist(StorageLevel.DISK_ONLY).count()
print("FIGURES " + json.dumps([executors(spark), local_folders(spark)]), flush=True)
spark.stop()
"""


def test_figures_of_two_executors(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", CLUSTER.format(root=root)], capture_output=True, text=True, timeout=180, cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": root})
    line = next(x for x in done.stdout.splitlines() if x.startswith("FIGURES "))
    held, folders = __import__("json").loads(line[8:])
    assert [x["id"] for x in held] == ["0", "1", "driver"] and all(x["most"] > 0 for x in held)
    assert len({f["folder"] for f in folders}) >= 2 and sum(f["bytes"] for f in folders) > 100_000 and all(f["free"] > 0 for f in folders)


def test_figures_in_the_statistics(store, spark):
    store.append(frame(spark, event(1, 1)))
    stats = Engine(spark, store).stats()
    assert stats["memory"][0]["id"] == "driver" and stats["temporary_files"]["bytes"] >= 0 and stats["errors"] == []
