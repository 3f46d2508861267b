import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerweave.llm import training_order as O


def brute_slot(i, n, key):
    """The permutation by hand: XXH64 of 8-byte integers, seeded by the hash of the round key."""
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    while True:
        left, right, widths = i >> low, i & ((1 << low) - 1), (bits - low, low)
        for k in range(6):
            f = xxhash.xxh64_intdigest(struct.pack("<q", right), xxhash.xxh64_intdigest(struct.pack("<q", key + k), 42))
            left, right = right, left ^ (f & ((1 << widths[k % 2]) - 1))
        i = left << low | right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 65, 4097])
def test_permutation_is_a_keyed_bijection(spark, n):
    def slots(key):
        return np.array([r[0] for r in spark.range(n).select(O.slot_of(F.col("id"), n, key)).collect()])

    a = slots(31)
    assert sorted(a) == list(range(n))
    assert list(a) == [brute_slot(i, n, 31) for i in range(n)]
    if n > 60:  # small domains scatter widely
        assert (a != slots(32)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 4 / n**0.5


def test_shards_round_trip_and_resume(spark, tmp_path):
    rows = [(i, "é\nword " * (i * 13 % 200)) for i in range(120)] + [(5, None), (5, ""), (None, "no id"), (-7, "negative"), (2**62, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int").repartition(5, "doc_id")
    parts = [[(r.doc_id, r.text) for r in p] for p in df.rdd.glom().collect()]
    layout = O.write_shards(df, str(tmp_path / "s"), shard_bytes=40_000)
    sizes = [f.stat().st_size for f in sorted((tmp_path / "s").glob("part-*"))]
    assert all(s == layout["per_shard"] * O.STRIDE for s in sizes[:-1]) and sum(sizes) == layout["n"] * O.STRIDE
    got = sorted(O.read_shards(spark, layout).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(layout["n"]))
    assert all(r.offset == r.slot % layout["per_shard"] * O.STRIDE and r.shard == r.slot // layout["per_shard"] for r in got)
    at = 0  # number of the partition's first sequence
    for part in parts:
        stream = b"".join((t or "").encode() + O.STOP for _, t in part)
        owners = [(i, k) for i, t in part for k in range(len((t or "").encode()) + 1)]
        for k in range(0, len(stream), O.TOKENS):
            r = got[brute_slot(at, layout["n"], layout["key"])]
            assert bytes(r.tokens) == stream[k : k + O.TOKENS] and r.n_tokens == len(r.tokens)
            assert (r.doc_id, r.doc_offset) == owners[k]
            at += 1
    assert at == layout["n"]
    late = O.read_shards(spark, layout, first=layout["n"] - 9).collect()
    assert sorted(r.slot for r in late) == list(range(layout["n"] - 9, layout["n"]))
    again = O.write_shards(df, str(tmp_path / "t"), shard_bytes=40_000)
    assert [bytes(r.tokens) for r in sorted(O.read_shards(spark, again).collect(), key=lambda r: r.slot)] == [bytes(r.tokens) for r in got]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert O.read_shards(spark, O.write_shards(df, str(tmp_path / "e"))).count() == 0


def test_other_splits_between_scans_raise(spark, tmp_path, monkeypatch):
    """Records packed from fewer, more, or differently filled partitions than were counted."""
    docs = spark.createDataFrame([(i, "word " * (400 + 37 * i % 900)) for i in range(60)], "doc_id long, text string").repartition(5, "doc_id")
    pack = O.packed
    for k, other in enumerate((lambda d: d.coalesce(2), lambda d: d.repartition(9, "doc_id"), lambda d: d.repartition(5, "text"))):
        monkeypatch.setattr(O, "packed", lambda d, other=other: pack(other(d)))
        with pytest.raises(Exception, match="split otherwise"):
            O.write_shards(docs, str(tmp_path / f"s{k}"), shard_bytes=1 << 14)
    monkeypatch.setattr(O, "packed", pack)
    assert O.write_shards(docs, str(tmp_path / "s"), shard_bytes=1 << 14)["n"] > 60
