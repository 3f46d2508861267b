import random

from ledgerweave.llm import simhash_dedup as S
from tests_support_llm import brute_components, brute_fp

def test_fingerprint_matches_definition():
    for t in ["", None, "A", "a B", "AbÉ c\td\x0be f", "x " * 50, "  y z q w e"]:
        got = S.fingerprint_words((t or "").encode().lower().split()) & (2**64 - 1)
        assert got == brute_fp(t), t
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    assert S.fingerprint_words(long.encode().split(), step=1000) == S.fingerprint_words(long.encode().split())


def test_components_match_all_pairs(spark):
    rnd = random.Random(3)
    fps = []
    for _ in range(12):
        base = rnd.getrandbits(64)
        fps.append(base)
        for _ in range(rnd.choice([0, 1, 5, 60])):
            x = rnd.choice(fps[-3:])
            for _ in range(rnd.choice([0, 1, 2, 2, 3])):
                x ^= 1 << rnd.randrange(64)
            fps.append(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for crowd in (0, 8, 1000):
        uniq = sorted(set(signed))
        edges = S.links(spark.createDataFrame([(f,) for f in uniq], "fp long"), crowd)
        comp = {r.node: r.component for r in S.connected_components(edges).collect()}
        want = brute_components([f & (2**64 - 1) for f in uniq])
        got = [comp.get(f, f) for f in uniq]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_rows_and_odd_inputs(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text, 1), (2, text, 1), (9, text.replace("word7 ", "other "), 1), (1, None, 1), (3, "", 1), (3, "", 1), (None, text, 1), (7, "alone here today", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in S.near_duplicates(df).collect()}
    assert S.near_duplicates(df).count() == len(rows)
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components(fps)
    for i, r in enumerate(rows):
        assert got[(r[0], fps[i])] == min(x[0] for x, c in zip(rows, comp, strict=True) if c == comp[i] and x[0] is not None)
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_one(spark, df, "")
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({c for c in got.values()})


def test_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in rows]
    comp = brute_components(fps)
    want = {(r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, comp, strict=True)}
    assert {tuple(r) for r in S.op4_simhash_deletion_variants(spark, "/root/testdata/sf0.001").collect()} == want
