import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from eventide.llm import common, vectors


def by_hand(ids, x, threshold=0.95):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = x @ x.T >= threshold
    np.fill_diagonal(like, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(like, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    least = pd.Series(ids).groupby(root).transform("min").to_numpy()
    return like.sum(1), least


@pytest.mark.parametrize("blocks", [(1024, 2048), (16, 40)])
def test_links_by_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:120] + rng.normal(size=(120, 16)) * 0.1, base[:1] + rng.normal(size=(200, 16)) * 0.05, base[5:6], base[5:6], base[5:6] * 3]).astype(np.float32)
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), [float(v) for v in row], 1, 7) for i, row in zip(ids, x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] * 8), (9005, [float("inf")] * 16), (9006, []), (9007, [1.0, 2.0]), (9008, [1.0, 2.0]), (9010, [1.0]), (9011, [2.0]), (9012, [-3.0]), (9013, [-0.5])]
    table = spark.createDataFrame(rows + [(i, v, None, 1) for i, v in odd], "vec_id long, embedding array<float>, label int, nid int")
    got = vectors.near_duplicates(table, members=blocks[0], visitors=blocks[1]).toPandas().set_index("vec_id")
    assert len(got) == len(rows) + len(odd) and (got.kept == (got.index == got.component_id)).all()
    links, least = by_hand(ids, x.astype(float))
    assert got.loc[ids].n_links.sum() >= 0.97 * links.sum() and (got.loc[ids].n_links.to_numpy() <= links).all()
    assert (got.loc[ids].component_id.to_numpy() == least).mean() > 0.97
    assert (got.loc[[9001, 9002, 9003, 9004, 9005, 9006]].n_links == 0).all() and got.loc[[9001, 9006]].kept.all()
    assert got.loc[9008].component_id == 9007 and got.loc[9007].n_links == 1
    assert got.loc[[9010, 9011, 9012, 9013]].component_id.tolist() == [9010, 9010, 9012, 9012] and (got.loc[[9010, 9011, 9012, 9013]].n_links == 1).all()
    assert vectors.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["check_s", "check_h"])
def test_recall_on_a_whole_table(spark, name):
    """Tables with links between near copies, in groups of up to a thousand."""
    sf = f"/root/testdata/{name}"
    if not os.path.exists(f"{sf}/embeddings.parquet"):
        pytest.skip("no such table here")
    got = vectors.op4_embedding_near_dedup(spark, sf).toPandas().set_index("vec_id")
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    links, least = by_hand(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float))
    got = got.loc[table.vec_id]
    assert links.sum() > 50_000 and got.n_links.sum() >= 0.98 * links.sum() and (got.n_links.to_numpy() <= links).all()
    assert (got.component_id.to_numpy() == least).mean() > 0.98


@pytest.mark.parametrize("seed", [2, 3])
def test_rare_links_are_found(spark, seed):
    """Fifty pairs among twenty thousand vectors that have no link: the slack does not rest on the links that queries meet."""
    rng = np.random.default_rng(seed)
    scaled = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = scaled(rng.normal(size=(20_000, 64)))
    cosines, other = rng.uniform(0.951, 0.995, (50, 1)), scaled(rng.normal(size=(50, 64)))
    other = scaled(other - (other * x[:50]).sum(1, keepdims=True) * x[:50])
    x[-50:] = cosines * x[:50] + np.sqrt(1 - cosines**2) * other
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(table).where("n_links > 0").toPandas()
    assert len(got) >= 0.97 * 100 and (got.n_links == 1).all()


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_table_by_sql(spark, monkeypatch, tmp_path, most):
    """The table's vectors, near copies of some of them, and odd rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    table = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    x, rng = np.stack(table.embedding).astype(float), np.random.default_rng(1)
    copies = [x[k % 40] + rng.normal(size=64) * np.abs(x[k % 40]).mean() * 0.2 for k in range(120)]
    rows = [*zip(table.vec_id.tolist(), x.tolist()), *enumerate((c.tolist() for c in copies), 10_000), (None, x[0].tolist()), (7, x[1].tolist()), (1, None), (2, []), (3, [0.0] * 64), (4, [float("nan")] * 64), (5, [1.0, None] * 32), (6, [2.0]), (8, [3.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = con.execute(vectors.ORACLE).fetchall()
    got = vectors.op4_embedding_near_dedup(spark, f"file://{tmp_path}").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected)) and sum(r[1] for r in expected) > 200


def test_cells_come_nearest_first():
    rng = np.random.default_rng(2)
    index = vectors.MultiIndex(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), 3.0)
    d1, d2 = index.distances(rng.normal(size=(1, 8)))
    grid = (d1[0][:, None] + d2[0][None, :]).ravel()
    order = [int(k) for k in np.argsort(grid) if grid[k] <= grid.min() + 3.0]
    assert [i * 7 + j for i, j in index.visits(d1[0], d2[0])] == order


def test_a_hot_group_does_not_set_the_slack_alone(spark):
    """A third of the vectors in one group of near copies, the others in pairs near the threshold."""
    rng = np.random.default_rng(6)
    scaled = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    hot = scaled(scaled(rng.normal(size=(1, 64))) + scaled(rng.normal(size=(4000, 64))) * 0.045)
    base, cosines = scaled(rng.normal(size=(4000, 64))), rng.uniform(0.951, 0.99, (4000, 1))
    other = rng.normal(size=base.shape)
    other = scaled(other - (other * base).sum(1, keepdims=True) * base)
    x = np.concatenate([hot, base, cosines * base + np.sqrt(1 - cosines**2) * other]).astype(np.float32)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = vectors.near_duplicates(table).toPandas().set_index("vec_id").loc[np.arange(len(x))]
    outside = got.n_links.to_numpy()[4000:]  # each has one link
    assert outside.max() <= 1 and outside.mean() >= 0.98, outside.mean()
    assert got.n_links.to_numpy()[:4000].mean() >= 0.99 * 3999
