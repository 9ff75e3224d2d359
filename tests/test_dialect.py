import json

import duckdb
import pytest

from eventide.dialect import NotUnderstood, java_pattern, parse, with_view, written
from eventide.engine import Engine, NotAQuery

from .test_store import at, event, frame, store  # noqa: F401


def test_what_spark_understands_passes_through():
    for text in ("SELECT a, 'it''s $events' -- $events (\n FROM x WHERE b[c] = \"q\" /* ( */ AND (d)", "SELECT m['k'], -1 AS n", "SELECT (((", "))"):
        assert written(parse(text)) == with_view(text) == text


@pytest.mark.parametrize(("given", "want"), [
    ("SELECT * EXCLUDE (a, b), t.* EXCLUDE c FROM $events", "SELECT * EXCEPT (a, b), t.* EXCEPT (c) FROM window_events"),
    ("SELECT strftime(t, '%Y-%m-%dT%H:%M:%S'), strftime('%-d %b', t)", "SELECT date_format(t, 'yyyy-MM-dd''T''HH:mm:ss'), date_format(t, 'd MMM')"),
    ("SELECT len(list(x)), len(a), x::VARCHAR, CAST(y AS VARCHAR), 7 // 2", "SELECT size(collect_list(x)), length(a), x::STRING, CAST(y AS STRING), 7 div 2"),
    ("SELECT list_transform(l, lambda x: x + 1), list_filter(l, x -> x > 1), [1, 2], l[2], f(a).b[1]", "SELECT transform(l, x -> x + 1), filter(l, x -> x > 1), array(1, 2), get(l, 1), get(f(a).b, 0)"),
    ("SELECT struct_pack(a := 1, b := f(c, d)), struct_extract(s, 'a'), approx_quantile(v, 0.9)", "SELECT named_struct('a', 1, 'b', f(c, d)), (s).`a`, approx_percentile(v, 0.9)"),
    ("SELECT date_diff('hour', a, b), regexp_extract(a, 'x+'), regexp_replace(a, 'x', 'y', 'g')", "SELECT timestampdiff(HOUR, date_trunc('HOUR', a), date_trunc('HOUR', b)), regexp_extract(a, 'x+', 0), regexp_replace(a, 'x', 'y')"),
    ("SELECT t.list(1), list, len FROM unnest", "SELECT t.list(1), list, len FROM unnest"),
])
def test_words(given, want):
    assert with_view(given) == want


def test_patterns():
    assert java_pattern("'%H:%M o''clock %%'") == "'HH:mm'' o''''clock %'''"
    with pytest.raises(NotUnderstood):
        java_pattern("'%Q'")
    with pytest.raises(NotUnderstood):
        with_view("SELECT strftime(t, pattern)")


QUERIES = [
    "SELECT reason, rv, row_number() OVER (PARTITION BY reason ORDER BY ts DESC, rv) AS k FROM $events QUALIFY k <= 2 ORDER BY reason, k",
    "SELECT reason, count(*) AS n FROM $events GROUP BY reason QUALIFY rank() OVER (ORDER BY count(*) DESC) = 1",
    "SELECT DISTINCT reason FROM $events QUALIFY row_number() OVER (PARTITION BY ns ORDER BY ts, rv) < 3",
    "WITH a AS (SELECT * FROM $events QUALIFY row_number() OVER (PARTITION BY reason ORDER BY rv) = 1) SELECT rv FROM a UNION ALL SELECT ns FROM (SELECT ns, rv FROM $events QUALIFY dense_rank() OVER (ORDER BY ns) = 1) b",
    "SELECT * EXCLUDE (ts, n) FROM $events WHERE n > 3",
    "SELECT rv, n FROM $events WHERE n > 5 UNION ALL BY NAME SELECT ns, rv FROM $events WHERE n < 2 ORDER BY rv, ns LIMIT 30",
    "WITH c AS (SELECT n AS x, ns FROM $events) SELECT ns FROM c UNION BY NAME SELECT x, ns FROM c UNION ALL BY NAME SELECT 'z' AS z",
    "SELECT p.rv, q.rv AS before, q.n FROM $events p ASOF LEFT JOIN (SELECT * FROM $events WHERE reason = 'a') q ON p.ns = q.ns AND p.ts > q.ts WHERE p.reason <> 'a'",
    "SELECT rv, q.n FROM (SELECT rv, ns, ts FROM $events WHERE reason = 'b') AS p ASOF JOIN (SELECT ns, ts, n FROM $events WHERE reason = 'a') AS q USING (ns, ts)",
    "WITH q AS (SELECT ns AS place, ts AS since, max(n) AS most FROM $events GROUP BY 1, 2) SELECT * FROM (SELECT ns, ts FROM $events WHERE reason = 'b') p ASOF JOIN q ON q.since <= p.ts AND p.ns = q.place QUALIFY row_number() OVER (PARTITION BY ns ORDER BY ts, since) <= 5",
    "SELECT strftime(ts, '%Y-%m-%d %Hh') AS label, count(*) AS n FROM $events GROUP BY 1",
    "SELECT ns, len(list(rv)) AS many, len(ns) AS long, len([1, 2, 3]) AS three FROM $events GROUP BY ns",
    "SELECT rv, len(l) AS n, l[2] AS second, l[9] AS none FROM (SELECT rv, list_transform([n, n + 1], lambda x: x * 2) AS l FROM $events)",
    "SELECT reason, approx_quantile(n, 0.5) >= 0 AS fine, (max(n) // 2)::VARCHAR AS half, struct_extract(struct_pack(a := max(n)), 'a') AS most FROM $events GROUP BY reason",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(reason || '|' || ns, '|')) AS word FROM $events) GROUP BY word",
    "SELECT rv, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes, regexp_extract(ns, 's.') AS part FROM $events",
]


@pytest.mark.parametrize("sql", QUERIES)
def test_answers_by_the_other_engine(spark, store, sql):
    rows = [event(k, (k * 37) % 400, "abc"[k % 3], namespace=f"ns{k % 4}", count=k % 7 + 1) for k in range(60)]
    if not store.manifest().segments:
        store.append(frame(spark, *rows))
    flat = "(SELECT metadata.resourceVersion AS rv, metadata.namespace AS ns, reason, lastTimestamp AS ts, count AS n FROM $events)"
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute("CREATE TABLE t (rv VARCHAR, ns VARCHAR, reason VARCHAR, ts TIMESTAMP, n INTEGER)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(r["metadata"]["resourceVersion"], r["metadata"]["namespace"], r["reason"], r["lastTimestamp"].replace(tzinfo=None), r["count"]) for r in rows])
    want = db.execute(sql.replace("$events", "t"))
    names = [d[0] for d in want.description]
    text = sql.replace("WITH ", f"WITH e AS {flat}, ", 1) if sql.startswith("WITH") else f"WITH e AS {flat} {sql}"
    head, _, tail = text.partition(flat)
    got, _ = Engine(spark, store).frame(head + flat + tail.replace("$events", "e"), at(0), at(400))
    assert [c.lower() for c in got.columns] == [c.lower() for c in names]
    plain = lambda x: x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x
    order = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=str)
    assert order(got.collect()) == order(want.fetchall())


def test_refusals(spark, store):
    store.append(frame(spark, event(1, 0)))
    for bad in ("SELECT 1 FROM $events a ASOF JOIN $events b ON a.x = b.x", "SELECT 1 FROM $events a ASOF JOIN $events b ON a.kind = b.kind AND a.reason <= b.reason", "SELECT 1 FROM $events a JOIN $events c USING (kind) ASOF JOIN $events b USING (kind, reason)", "SELECT len(lastTimestamp, 1) FROM $events", "SELECT 1 AS a UNION ALL BY NAME SELECT * FROM elsewhere", "SELECT kind FROM $events QUALIFY java_method('java.lang.System', 'getProperty', 'user.home') = 'x'", "SELECT strftime(lastTimestamp, reason) FROM $events"):
        with pytest.raises(NotAQuery):
            Engine(spark, store).query(bad, at(0), at(9))
    assert json.dumps(Engine(spark, store).query("SELECT * EXCLUDE (metadata, involvedObject, source, series, related) FROM $events", at(0), at(9)).results)
