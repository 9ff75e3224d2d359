import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import maxscore

SCHEMA = "vec_id long, embedding array<double>, label int, rid int, query string, shard int, dim int"


def by_hand(rows, asks, k=10):
    whole = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (i, q) in enumerate(whole):
        if i is None or not asks(i):
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0, n) for n, (j, v) in enumerate(whole) if n != own and len(v) == len(q)]
        out += [(i, rank, None if null else j, -s) for rank, (s, null, j, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "q", 3, 4) for i, v in rows], SCHEMA)


def searched(spark, rows, every=3, **options):
    found = maxscore.top_k(table(spark, rows), F.col("vec_id") % every == 0, **options).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("shard", [1 << 19, 200])
def test_scores_by_brute_force(spark, shard):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 12))
    x = np.concatenate([base, base[:1] + rng.normal(size=(60, 12)) * 0.01, np.repeat(base[3:4], 40, 0), -base[:30], np.round(base[:40])])
    rows = [(int(i), row.tolist()) for i, row in enumerate(x)]
    odd = [(900, None), (903, [None] * 12), (906, [float("nan")] * 12), (909, [float("inf")] * 12), (912, []), (915, []), (918, [1.0, 2.0]), (919, [0.5, -2.0]), (921, [0.0] * 12), (None, [0.25] * 12), (None, [0.0] * 12), (3, [-0.1] * 12), (3, [0.1] * 12), (924, [1.0] * 5)]
    assert searched(spark, rows + odd, shard=shard, seed_every=4) == by_hand(rows + odd, lambda i: i % 3 == 0)
    assert searched(spark, [(3, [1.0]), (6, [2.0])]) == [(3, 1, 6, 2048 * 1024), (6, 1, 3, 2048 * 1024)]
    assert searched(spark, []) == [] and searched(spark, [(6, [1.0])]) == []


def test_components_of_any_size(spark):
    rows = [(i, [(-1.0) ** i * 10.0**i, 1.0 / (i + 1), 3.0]) for i in range(14)] + [(20 + i, [0.1 * i, -0.2, 0.3]) for i in range(30)]
    assert searched(spark, rows, shard=40, seed_every=2) == by_hand(rows, lambda i: i % 3 == 0)
    huge = [(3, [1e305, -1e305]), (6, [1e305, 1.0]), (7, [-1e305, 5.0])]
    assert searched(spark, huge) == by_hand(huge, lambda i: i % 3 == 0)


def test_lists_are_left_out():
    """Of a vector that lies in no essential list nothing is read, and the best are found all the same."""
    rows = np.zeros((5000, 40))
    rng = np.random.default_rng(2)
    for i in range(5000):
        rows[i, rng.choice(40, 3, replace=False)] = rng.integers(-50, 50, 3)
    rows[7, :3], query = 400, np.concatenate([[300, 300, 300], rng.integers(1, 9, 37)]).astype(float)
    import pyarrow as pa

    postings = maxscore.Postings.build(np.arange(5000), pa.array(range(5000)), rows)
    exact = rows @ query
    want = sorted(range(5000), key=lambda i: (-exact[i], i))[:10]
    for d in range(3, 40):
        for sign in (0, 1):
            postings.lists[sign][0][d] = None  # a traversal of it would fail
    beat = exact[want[-1]]
    near, score = postings.best(query, -1, beat, 10)
    assert sorted(zip(-score, near)) == sorted((-exact[i], i) for i in want)


def test_sql_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in maxscore.op12_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(db.sql(maxscore.ORACLE).fetchall()) and len(got) == 50
