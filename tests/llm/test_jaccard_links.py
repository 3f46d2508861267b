import random

import pytest

from ledgerweave.llm import jaccard_links as J
from ledgerweave.llm import simhash_dedup as S


def grams(text):
    w = [x.lower() for x in (text or "").split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """Component of each text by exact Jaccard over all pairs."""
    sets, of = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or 5 * both >= 4 * (len(a) + len(b) - both) > 0:
                of[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("crowd", [2, 16])
def test_stage_keeps_one_of_each_jaccard_group(spark, crowd, monkeypatch):
    monkeypatch.setattr(S, "near_copies", lambda d, k, f: J.near_copies(d, k, f, crowd))
    rnd, texts = random.Random(5), [None, "", "one two", "One  two", "three"]
    line = [f"common{i}" for i in range(30)]
    for g in range(8):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([8, 60, 200]))]
        texts += [" ".join(edited(rnd, base, k)) for k in (0, 0, 1, 2, 3, 5, 8)] + [" ".join(base[:-3]), " ".join(line + base)]
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    comp = brute_groups(texts)
    assert 20 < len(set(comp)) < len(texts) - 20
    assert sorted(r.doc_id for r in S.keep_one(spark, df, "").collect()) == sorted(set(comp))


def test_stage_on_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    comp = brute_groups([r.text for r in rows])
    assert {r.doc_id for r in S.keep_one(spark, docs, "").collect()} == {rows[c].doc_id for c in comp}


def test_survivors_of_null_and_repeated_ids(spark):
    text = [" ".join(f"{g}{i}" for i in range(40)) for g in "abcdef"]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (3, text[2]), (2, text[3]), (5, text[3]), (5, text[4]), (None, text[5]), (None, text[5] + " end")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3)
    kept = [(r.doc_id, r.text) for r in S.keep_one(spark, df, "").collect()]
    sure = {(None, text[0]), (None, text[1]), (3, text[2]), (2, text[3]), (5, text[4])}
    assert len(kept) == 6 and sure < set(kept)
    assert (set(kept) - sure).pop() in {(None, text[5]), (None, text[5] + " end")}
    assert S.keep_one(spark, df, "").columns == df.columns and S.keep_one(spark, df.limit(0), "").count() == 0
