import math
import zlib

import numpy as np

from ledgerweave.llm import gam_quality as G


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert len(model.tables) == 4 and model.pairs


def test_one_class_and_no_labels():
    x = np.zeros((5, 3))
    assert G.fit(x, np.ones(5)).score(x).tolist() == [6 / 7] * 5
    assert G.fit(x[:0], np.ones(0)).score(x).tolist() == [0.5] * 5


def test_held_out_accuracy(spark):
    out = G.op5_gam_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert len(out) == docs
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    m = out[out.held_out].merge(labels, on="doc_id")
    good, bad = m[m.quality == 1], m[m.quality == 0]
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.1, (good.predicted.mean(), bad.predicted.mean())


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "A fine text of the day.", 0.1), (2, None, 0.2), (2, None, 0.2), (3, "", 0.3), (None, "x", 0.4), (4, "a%%% " * 40_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = G.classify(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert G.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in G.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert G.keep_good(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001").columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_scores_are_lookup_sums(spark):
    """The query against a score summed by hand, table entry by table entry, for every document."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = G.train(docs, labels)
    assert model.tables and model.pairs
    got = {r.doc_id: r for r in G.op5_gam_quality(spark, sf).collect()}
    for r in docs.collect():
        x = G.features(r.text)
        at = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x, strict=True)]
        margin = model.intercept + sum(t[i] for t, i in zip(model.tables, at, strict=True)) + sum(t[at[a]][at[b]] for a, b, t in model.pairs)
        want = 1 / (1 + math.exp(-min(30.0, max(-30.0, margin))))
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_repeated_labelled_ids_train_alike(spark):
    rows = [(i // 3, f"text {i} " * (1 + i % 17), "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    a, b = (G.train(d, labels) for d in (docs, docs.orderBy(G.F.desc("text")).repartition(7)))
    x = np.array([G.features(t) for _, t, _ in rows])
    assert (a.score(x) == b.score(x)).all()
