import re

import pytest

from ledgerweave.llm import sainte_lague_mix as M


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = sum(weight[s] for s in names if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / left if left else 0
        more = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def highest_quotients(target, seats):
    got = dict.fromkeys(target, 0)
    for _ in range(seats):
        best = max(target, key=lambda s: target[s] / (2 * got[s] + 1))
        got[best] += 1
    return got


def check(rows, docs):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(M.WORD, text or ""))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        taken[r.source] += r.taken
    block = M.block_words(sum(sizes.values()), len(sizes))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block + 1, (s, taken[s], want[s])


def test_mix_matches_brute_force(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 90)), ["a", "b", "é", "z", "~", None, "big"][min(i % 13, 6)]) for i in range(700)]
    docs += [(900, None, "a"), (901, "", "nothing"), (902, "x y z", None), (5, "w", "b"), (5, "w", "b"), (None, "p q r", "a"), (903, "w " * 30_000, "huge")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, source string, size int")
    rows = M.taken_words(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    again = M.taken_words(df.repartition(5)).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert M.taken_words(df.limit(0)).count() == 0


def test_quotas_are_highest_quotients(spark):
    target = {"a": 503.5, "b": 201.25, "c": 99.0, "d": 3.25, "e": 0.0}
    shares = spark.createDataFrame(list(target.items()), "source string, target double")
    for shards in (1, 4):
        rows = M.quotas(shares, 10, shards).collect()
        house = round(sum(target.values()) / 10)
        assert {r.source: r.seats for r in rows} == highest_quotients(target, house)
        for k in range(shards):
            upto = house * (k + 1) // shards
            assert {r.source: sum(r.quotas[: k + 1]) for r in rows} == highest_quotients(target, upto)
        assert all(q >= 0 for r in rows for q in r.quotas)


@pytest.mark.parametrize("target", [{"a": 100.0, "b": 100.0}, {"a": 50.0, "b": 150.0, "c": 250.0, "d": 50.0}, {c: 66.0 for c in "gfedcba"}])
def test_equal_quotients_go_by_source_in_every_shard(spark, target):
    shares = spark.createDataFrame(list(target.items()), "source string, target double")
    by_source = dict(sorted(target.items()))
    for block, shards in ((66, 1), (40, 5), (7, 8)):
        rows = M.quotas(shares, block, shards).collect()
        house = max(1, round(sum(target.values()) / block))
        for k in range(shards):
            want = highest_quotients(by_source, house * (k + 1) // shards)
            assert {r.source: sum(r.quotas[: k + 1]) for r in rows} == want, (block, shards, k)


def test_shards_take_their_quotas(spark):
    docs = [(i, " ".join(["w"] * (1 + i * 53 % 700)), "abc"[min(i % 7, 2)]) for i in range(400)] + [(None, "w " * 3, "tiny")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = M.taken_words(df, shards=4).collect()
    size = {s: sum(len(d[1].split()) for d in docs if d[2] == s) for s in {d[2] for d in docs}}
    block = M.block_words(sum(size.values()), len(size))
    target = {r.source: r.target for r in rows}
    house = round(sum(target.values()) / block)
    taken, words = {}, {}
    for n, r in enumerate(rows):
        assert sum(s.hi - s.lo for s in r.spans) == r.taken and all(0 <= s.lo < s.hi <= r.size for s in r.spans)
        for s in r.spans:
            taken[r.source, s.shard] = taken.get((r.source, s.shard), 0) + s.hi - s.lo
            words.setdefault((n, s.round), []).extend(range(s.lo, s.hi))
    assert all(len(w) == len(set(w)) for w in words.values())
    for k in range(4):
        for s, quota in highest_quotients(dict(sorted(target.items())), house * (k + 1) // 4).items():
            assert sum(taken.get((s, i), 0) for i in range(k + 1)) == min(quota * block, 3 * size[s])


def test_stage_with_repeated_and_null_ids(spark):
    same = [(None, "a b c d e", "s"), (None, "v w x y z", "s"), (7, "k l m n o", "s"), (7, "p q r s t", "s"), (7, "p q r s t", "s")] * 40 + [(9, "u " * 500, "t"), (None, None, "t"), (None, "", None)]
    df = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(same)], "doc_id long, text string, source string, __n long, row string")
    plan = {s: sum(r.taken for r in M.taken_words(df).where(M.F.col("source") == s).collect()) for s in ("s", "t")}
    out = M.mixed(spark, df, "")
    assert out.columns == df.columns
    rows = out.collect()
    assert {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in ("s", "t")} == plan
    assert all(len(r.text.split()) == 5 for r in rows if r.source == "s") or plan["s"] % 5
    assert M.mixed(spark, df.limit(0), "").count() == 0


def test_stage_rows(spark):
    docs = [(i, " ".join(f"t{j}" for j in range(1 + i % 40)), f"s{i % 5}", 0) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    plan = {r.doc_id: r for r in M.taken_words(df).collect()}
    out = M.mixed(spark, df, "").collect()
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {i: r.taken for i, r in plan.items() if r.taken}


def test_documents(spark):
    rows = M.taken_words(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(rows.collect(), docs)
