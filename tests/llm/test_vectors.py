import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, embed_join

NAN, INF = float("nan"), float("inf")
ODD = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [NAN, 1.0], 0), (4, [INF, 1.0], 0), (5, [1.0, None], 0), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [1.0], 0),
       (10, [], 0), (None, [1.0, 0.001], 0), (20, [0.9, 0.1], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, cls int")


def clustered(rng, groups, each, spread=0.02, d=16):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=d)
        for _ in range(each):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=d) * spread * rng.uniform(0, 3)], g % 3))
    return rows


def brute(rows, cosine):
    x = np.array([np.array(r[1], np.float32).astype(float) for r in rows])
    n = np.linalg.norm(x, axis=1)
    links = (x @ x.T / np.outer(n, n) >= cosine) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])) & ~np.eye(len(rows), dtype=bool)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min([root[i], *root[links[i]]]) for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    return {r[0]: (int(links[i].sum()), int(root[i])) for i, r in enumerate(rows)}


@pytest.mark.parametrize(("cell_rows", "block"), [(2048, 1 << 20), (20, 1 << 20), (20, 256)])
def test_range_join(spark, cell_rows, block):
    rows = clustered(np.random.default_rng(1), 12, 25)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(5)]
    got = embed_join.near_vectors(frame(spark, rows), 0.98, cell_rows=cell_rows, block=block).collect()
    want = brute([(i, v, label) for i, (_, v, label) in enumerate(rows)], 0.98)
    names = [r[0] for r in rows]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {names[i]: (n, names[c]) for i, (n, c) in want.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_tight_cluster_is_not_copied(spark, monkeypatch):
    """Items per vector stay flat where pivots can't part a cluster, and all links are found."""
    rng, join, items = np.random.default_rng(3), embed_join._join_cells, {}
    for n in (1000, 2000, 4000):
        centre = rng.normal(size=64) / 8
        x = (centre + 0.02 * rng.normal(size=(n, 64))).astype(np.float32)
        rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]

        def counted(found, cosine, block, n=n):
            items[n] = found.count() / n
            return join(found, cosine, block)

        monkeypatch.setattr(embed_join, "_join_cells", counted)
        got = {r.vec_id: r.n_links for r in embed_join.near_vectors(frame(spark, rows), 0.98, cell_rows=256).collect()}
        y = x.astype(float)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        want = (y @ y.T >= 0.98).sum(1) - 1
        assert sum(got[i] == int(want[i]) for i in range(n)) >= n - 2  # sums in another order may differ at the limit itself
    assert items[4000] <= 1.2 * items[1000] and items[4000] < 3, items


def test_odd_vectors_link_with_nothing(spark):
    got = [(r.vec_id, r.n_links, r.component_id) for r in embed_join.near_vectors(frame(spark, ODD)).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3, 4, 5, 6, 9, 10, 20)) == [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10, 20)]
    assert sorted(x for x in got if x[0] in (7, 8)) == [(7, 3, 7), (8, 3, 7), (8, 3, 7)]
    assert [x for x in got if x[0] is None] == [(None, 3, 7)]
    assert embed_join.near_vectors(frame(spark, [])).count() == 0


def nearest(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows]
    out = {}
    for i, q in good:
        if i % every == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in good if j != i))[:k]
    return out


@pytest.mark.parametrize("factor", [1.0, 0.8])
def test_nearest(spark, factor):
    rows = clustered(np.random.default_rng(2), 40, 20, spread=0.5)
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)]
    df = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, factor=factor, shard_rows=200, block_rows=16)
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    recall = np.mean([len({x for x, _ in got[q]} & {j for _, j in want[q]}) / 20 for q in want])
    assert recall >= (1.0 if factor == 1 else 0.9)
    if factor == 1:
        assert all([x for x, _ in got[q]] == [j for _, j in want[q]] for q in want)
        assert all(s == pytest.approx(-n, abs=1e-9) for q in want for (_, s), (n, _) in zip(got[q], want[q], strict=True))


def test_recall_on_test_data(embeddings):
    rows = [(r.vec_id, r.embedding, 0) for r in embeddings.collect()]
    got = ann.nearest(embeddings, F.col("vec_id") % 20 == 0, 20, factor=0.8)
    want = nearest(rows, 20, 20)
    hits = sum(r.vec_id in {j for _, j in want[r.query_id]} for r in got.collect())
    assert hits >= 0.9 * 20 * len(want)


def test_few_and_odd_candidates(spark):
    got = ann.nearest(frame(spark, ODD), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(20, 1, 8), (20, 2, 8), (20, 3, 6), (20, 4, 7)]
    assert ann.nearest(frame(spark, []), F.lit(True)).count() == 0
