import math

import numpy as np
import pytest

from ledgerweave.llm import exact_top_k as K


def brute(rows, k=20, every=20):
    """All pairs, on Python integers."""
    good = [(i, v, [math.floor(64 * float(x)) for x in e]) for i, (v, e) in enumerate(rows) if e and all(x is not None and math.isfinite(64 * x) for x in e)]
    out = []
    for i, v, e in good:
        if v is None or v % every:
            continue
        found = [(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(e, f, strict=True)))), w is None, w, j) for j, w, f in good if j != i and len(e) == len(f)]
        found.sort(key=lambda t: (t[0], t[1], t[2] or 0, t[3]))
        out += [(v, n + 1, t[2], -t[0]) for n, t in enumerate(found[:k])]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<double>, row int, block string")


def got(df, **kw):
    return sorted((tuple(r) for r in K.top_k(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("block", "cell"), [(1 << 14, 1 << 12), (4, 16), (1, 1 << 12)])
def test_matches_brute_force_with_ties(spark, block, cell):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 6)), 1)  # many equal scores
    x[50:90] = x[0]
    ids = rng.permutation(300).tolist()
    rows = [(int(v), e.tolist()) for v, e in zip(ids, x, strict=True)]
    rows += [(40, rows[0][1]), (40, rows[0][1]), (None, rows[0][1])]
    assert got(table(spark, rows), block=block, cell=cell) == brute(rows)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (140, [1.0, 2.0, 3.0]), (160, [1e307, 1.0]), (180, [0.0, 0.0]), (1, [-1.0, 0.004]), (2, [1e30, -1e30]), (3, [3.0, 1e9]), (-20, [1e12, 5.5])]
    assert got(table(spark, rows)) == brute(rows)
    assert K.top_k(table(spark, rows).limit(0)).count() == 0


def test_floats_and_few_candidates(spark):
    rows = [(20 * i, np.float32(v).tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(7, 4)))]
    df = table(spark, rows)
    assert got(df.withColumn("embedding", df.embedding.cast("array<float>"))) == brute(rows)


def test_large_and_small_products_agree():
    rng = np.random.default_rng(9)
    q, c = np.floor(rng.normal(size=(9, 12)) * 1e9), np.floor(rng.normal(size=(30, 12)) * 1e9)
    want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in c] for x in q]
    assert (K.products(q, c) == np.array(want)).all()
    assert (K.products(np.floor(q / 1e7), np.floor(c / 1e7)) == np.floor(q / 1e7).astype(np.int64) @ np.floor(c / 1e7).astype(np.int64).T).all()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert got(df) == brute(rows)
