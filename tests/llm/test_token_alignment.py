import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerweave.llm import token_alignment as T

COLUMNS = T.OUT[1:]
ODD = [None, "", " ", "  two  blanks ", "a▁b", "<|endoftext|> and <s> </s>", "tab\tand\nline\r\n end ", "é漢字\U0001f600 ﬁ é", "\x00 nul \x1c x", "x" * 3000, " " * 2000, "word " * 3, "don't 123,456 can't", "same text twice", "same text twice", "漢字書" * 500, "\n \n" * 40]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{T.TOKENIZERS}/piece_bpe_32k.model")
        self.alphabet = {}
        n = 0
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
                self.alphabet[chr(x)] = x
            else:
                self.alphabet[chr(256 + n)] = x
                n += 1

    def groups(self, text):
        """[(A ids, B ids)] of whole texts."""
        if not text:
            return []
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False)
        sa = [bytes(self.alphabet[c] for c in self.a.id_to_token(i)) for i in a.ids]
        ids = self.b.encode(text)
        sb = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(self.b.id_to_piece, ids), strict=True)]
        if b"".join(sa) != raw or b"".join(sb) != raw:
            return []
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (sa, sb)]
        out, at = [], [0, 0]
        for end in sorted(ends[0] & ends[1]):
            group = []
            for k, (s, i) in enumerate(((sa, a.ids), (sb, ids))):
                start, n = at[k], sum(map(len, s[: at[k]])) if not out else last
                while n < end:
                    n += len(s[at[k]])
                    at[k] += 1
                group.append(list(i[start : at[k]]))
            out.append(tuple(group))
            last = end
        return out

    def rows(self, texts):
        per = [self.groups(t) for t in texts]
        count = Counter(p for groups in per for p in {(x, y) for a, b in groups for x in a for y in b})
        most = {}
        for (x, _), n in count.items():
            most[x] = max(most.get(x, 0), n)
        out = []
        for groups in per:
            links = [(x, y) for a, b in groups for x in a for y in b]
            printed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            out.append((
                sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(printed.encode()).hexdigest() if groups else "",
            ))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    return ODD + docs.text.tolist()


@pytest.mark.parametrize("table", [T.TABLE, 300, 0])
def test_whole_texts_match_brute_force(spark, brute, monkeypatch, table):
    texts = corpus(spark)
    monkeypatch.setattr(T, "SHARD", 1 << 9)
    monkeypatch.setattr(T, "FAN", 2)
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, row long, rest string").repartition(6)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in T.align(df, table=table).collect()}
    for k, want in enumerate(brute.rows(texts)):
        assert got[k] == want, (k, texts[k])


def test_repeats_null_ids_and_empty_tables(spark, brute):
    texts = ["one two", "one two", None, "three"]
    df = spark.createDataFrame(list(zip([None, 1, 1, 1], texts, strict=True)), "doc_id long, text string")
    got = sorted((tuple(r[c] for c in T.OUT) for r in T.align(df).collect()), key=str)
    assert got == sorted(((d, *w) for d, w in zip([None, 1, 1, 1], brute.rows(texts), strict=True)), key=str)
    assert T.align(df.limit(0)).count() == 0


def test_words_and_runs_change_no_token(monkeypatch, spark):
    """Words one by one give the ids of whole texts, also when a text is read in short runs."""
    tok, brute = T.tokenizers(), Brute()
    monkeypatch.setattr(T, "RUN", 40)
    for text in corpus(spark):
        if text:
            words = [w for run in T.word_runs(text) for w in run]
            assert " ".join(words) == text
            assert [i for w in words for i in tok.encode_a(" " + w)] == brute.a.encode(" " + text, add_special_tokens=False).ids
            assert [i for x in tok.encode_b(words) for i in x] == brute.b.encode(text)


@pytest.mark.parametrize("pairs", [T.PAIRS, 40])
def test_small_caches_change_nothing(spark, brute, monkeypatch, pairs):
    from pyspark import TaskContext

    texts = corpus(spark)[:120]
    monkeypatch.setattr(T, "CACHE", 50)
    monkeypatch.setattr(T, "SLICE", 3000)
    monkeypatch.setattr(T, "CHUNK", 60)
    monkeypatch.setattr(T, "RUN_WORDS", 3)
    monkeypatch.setattr(T, "PAIRS", pairs)
    T.known_words.cache_clear()
    monkeypatch.setattr(TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 3})())
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([t.encode() if t is not None else None for t in texts], pa.binary())})
    out = Counter()
    for b in T._counted(T.TOKENIZERS)(iter([batch])):
        out.update(dict(zip(b.column("pair").to_pylist(), b.column("n").to_pylist(), strict=True)))
    want = Counter(p for t in texts for p in {x << 32 | y for a, b in brute.groups(t) for x in a for y in b})
    assert out == want


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 62, 50_000))
    shard = T.shard_of(keys, 5)
    h = T.PerfectHash([T.build_hash(keys[shard == s]) for s in range(5)])
    assert sorted(h.slots(keys, shard)) == list(range(len(keys)))
    assert len(h.bits) * 64 < 5 * len(keys)
    other = rng.integers(0, 1 << 62, 1000)
    assert (h.slots(other, T.shard_of(other, 5)) < len(keys)).all()
    assert T.build_hash(keys[:0])[0].size == 0


def test_large_groups_fold(monkeypatch):
    rng = np.random.default_rng(0)
    ga, gb = np.sort(rng.integers(0, 9, 300)), np.sort(rng.integers(0, 9, 200))
    a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 200)
    for most in (0, 100, 1 << 20):
        g, p, t = T.links_of(a, ga, b, gb, 9, most)
        got = Counter()
        for x in zip(g.tolist(), p.tolist(), t.tolist(), strict=True):
            got[x[:2]] += x[2]
        assert got == Counter((i, x << 32 | y) for i, x in zip(ga.tolist(), a.tolist(), strict=True) for j, y in zip(gb.tolist(), b.tolist(), strict=True) if i == j)
