import math
import time
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from ledgerweave.llm import piece_sampling as P

SMALL = P.Pieces((b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", b"  ", b"aba"), tuple(range(300, 309)), tuple(-0.3 * k for k in range(9)), tuple(range(256)))


def paths(text, pieces):
    """All segmentations of a text with their weights."""
    out = {}

    def walk(at, ids, w):
        if at == len(text):
            out[tuple(ids)] = w
        for t, i, lw in zip(pieces.texts, pieces.ids, pieces.logs, strict=True):
            if text.startswith(t, at):
                walk(at + len(t), [*ids, i], w + lw)

    walk(0, [], 0.0)
    total = sum(map(math.exp, out.values()))
    return {k: math.exp(v) / total for k, v in out.items()}


@pytest.mark.parametrize("text", [b"abab", b"aba  ab", b"  ab"])
def test_sampling_has_the_path_probabilities(text):
    n = 20_000
    ids, counts = P.sample([b" " + text] * n, np.arange(n), np.zeros(n, int), SMALL, 3)
    got = Counter(tuple(ids[a:b]) for a, b in pairwise(np.concatenate([[0], np.cumsum(counts)])))
    want = paths(b" " + text, SMALL)
    assert set(got) <= set(want)
    for path, p in want.items():
        assert abs(got[path] / n - p) < 0.015, (path, got[path] / n, p)


def test_row_key_decides_and_batches_do_not():
    pieces = P.load_pieces()
    texts = ["The quick brown fox.\nJumps  over ▁ it \U0001f600 é\x00", "", " ", "\n\n", "x" * 3000, "many words " * 50]
    raw = [b" " + t.encode() for t in texts]
    keys, zero = np.arange(len(texts)) + 7, np.zeros(1, int)
    ids, n = P.sample(raw, keys, np.zeros(len(raw), int), pieces, 29)
    ends = np.cumsum(n)
    parts = np.split(ids, ends[:-1])
    for t, k, part in zip(raw, keys, parts, strict=True):
        assert P.decode(part.tolist(), pieces) == t.decode()[1:]
        assert (P.sample([t], np.array([k]), zero, pieces, 29)[0] == part).all()
    assert any(len(P.sample([raw[0]], np.array([k]), zero, pieces, 29)[0]) != n[0] for k in range(20))


def test_segments_change_no_piece(monkeypatch):
    pieces = P.load_pieces()
    raw = (" " + "some words \n and  ünïcödé " * 90 + "é" * 1500 + "x\n\n" + "漢字" * 400).encode()
    one, _ = P.sample([raw], np.array([5]), np.zeros(1, int), pieces, 29)
    monkeypatch.setattr(P, "PART", 700)
    parts = P.segments(raw)
    assert len(parts) > 5 and b"".join(t for _, t in parts) == raw and sorted(len(t) for _, t in parts)[-3] <= 700
    ids, _ = P.sample([t for _, t in parts], np.full(len(parts), 5), np.array([at for at, _ in parts]), pieces, 29)
    assert (ids == one).all()


def test_long_words_have_the_path_probabilities(monkeypatch):
    """A word in runs of a few bytes, against all paths of its whole lattice."""
    monkeypatch.setattr(P, "LONG", 3)
    monkeypatch.setattr(P, "RUN", 2)
    text, n = b" abababaa", 2500
    got = Counter(tuple(P.sample([text], np.array([k]), np.zeros(1, int), SMALL, 3)[0]) for k in range(n))
    want = paths(text, SMALL)
    assert set(got) <= set(want)
    for path, p in want.items():
        assert abs(got[path] / n - p) < 0.03, (path, got[path] / n, p)


@pytest.mark.parametrize("run", [50, 700, 1 << 16])
def test_three_kilobytes_without_a_blank_against_one_lattice(monkeypatch, run):
    """Sums, cuts and draws of runs are those of one uncut lattice of the word."""
    pieces = P.load_pieces()
    text = (" " + "".join(chr(0x4E00 + i * 7919 % 500) if i % 5 else "abcé"[i % 4] for i in range(1100))).encode()
    monkeypatch.setattr(P, "RUN", run)
    word = np.frombuffer(text, dtype=np.uint8)
    start, end, _, weight = P.edges(word, np.array([0]), np.array([len(text)]), pieces)
    total = np.full(len(text) + 1, -np.inf)
    total[0] = 0.0
    for a, b, w in zip(start, end, weight, strict=True):  # edges come sorted by end, so their starts are done
        total[b] = np.logaddexp(total[b], total[a] + w)
    got = P._forward(word, pieces, max(map(len, pieces.texts)))
    reached = np.isfinite(total)
    assert np.allclose(got[reached], total[reached]) and not np.isfinite(got[~reached]).any()
    for key in range(5):
        keys, zero = np.array([key]), np.zeros(1, int)
        long, _ = P.sample([text], keys, zero, pieces, 29)
        monkeypatch.setattr(P, "LONG", 1 << 20)
        whole, _ = P.sample([text], keys, zero, pieces, 29)
        monkeypatch.setattr(P, "LONG", 512)
        assert (long == whole).all() and P.decode(long.tolist(), pieces) == text.decode()[1:]


def test_five_megabytes_without_a_blank(spark):
    text = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(1_000_000)) + "q8" * 1_000_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    began = time.time()
    out = P.encode_sampled(df).select("doc_id", "n_pieces", "lossless").collect()
    assert len(out) == 2 and all(r.lossless for r in out) and time.time() - began < 90


def test_frame(spark):
    pieces = P.load_pieces()
    rows = [(1, "Some text here.", 0), (1, "Some text here.", 0), (2, None, 1), (None, "Some text here.", 2), (3, "", 3), (4, "wörter und Wörter " * 9000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    out = P.encode_sampled(df, keep=df.columns).collect()
    assert len(out) == len(rows) and list(out[0].asDict()) == ["doc_id", "text", "pieces", "n_pieces", "lossless"]
    for r in out:
        assert r.lossless and (r.pieces is None) == (r.text is None)
        assert r.text is None or (P.decode(r.pieces, pieces) == r.text and r.n_pieces == len(r.pieces))
    assert len({tuple(r.pieces) for r in out if r.doc_id == 1}) == 1
    assert P.encode_sampled(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = P.op10_piece_sampling(spark, "/root/testdata/sf0.001")
    assert a.where("not lossless").count() == 0 and a.count() == docs.count()
    b = P.encode_sampled(docs.repartition(7))
    assert a.exceptAll(b).count() == 0
