import numpy as np
import pytest

from ledgerweave.llm import itq_near_dup as I


def brute(ids, labels, x, threshold=0.98):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= threshold) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None], comp.max()).min(axis=1))
        if (new == comp).all():
            return link.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("block", [7, 512])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 32))
    x = np.concatenate([base, base[:1] + 0.08 * rng.normal(size=(60, 32)), base[1:2] + 0.12 * rng.normal(size=(30, 32)), np.repeat(base[3:4], 9, 0)]).astype(np.float32)
    labels = np.where(np.arange(len(x)) % 11 == 0, 2, 1)
    ids = np.arange(len(x)) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(v) for v in r], int(lb), 0) for i, r, lb in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<float>, label int, key int")
    got = {r.vec_id: r for r in I.near_duplicates(df, block=block).collect()}
    n, comp = brute(ids, labels, x)
    assert sum(got[i].n_links for i in ids) >= 0.97 * n.sum()
    assert all(got[i].n_links <= k for i, k in zip(ids, n, strict=True))
    assert [got[i].component_id for i in ids] == list(comp)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_odd_inputs(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, inf], 1), (5, [nan, 1.0], 1), (6, [1.0, 2.0], None), (7, [], 1),
            (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (9, [2.0, 4.0], 1), (10, [1.0, 2.0], 2), (11, [1.0, 2.0, 0.0], 1), (12, [-1.0, -2.0], 1), (None, [3.0, 6.0], 1), (13, [1e30, 2e30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = sorted(((r.vec_id, r.n_links, r.component_id) for r in I.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12)] + [(i, 4, 8) for i in (8, 9, 9, None, 13)]
    assert out == sorted(want, key=str)
    assert I.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.981, 0.99])
def test_whole_table_recall(spark, cosine):
    """Every vector of the table gets a planted neighbour; all labels, all pairs by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, rng = np.stack(df.embedding).astype(np.float64), np.random.default_rng(3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side])
    ids, labels = np.arange(len(x)), np.concatenate([df.label.to_numpy()] * 2)
    got = I.near_duplicates(spark.createDataFrame([(int(a), b.tolist(), int(c)) for a, b, c in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int"))
    got = got.toPandas().set_index("vec_id").loc[ids]
    n, comp = brute(ids, labels, x)
    assert n.sum() >= len(x)
    assert (got.n_links.to_numpy() <= n).all()
    assert got.n_links.sum() >= 0.97 * n.sum()
    assert (got.component_id.to_numpy() == comp).mean() > 0.97
