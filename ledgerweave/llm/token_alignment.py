"""Alignment of two tokenizers, counted through minimal perfect hashing (operator 12).

Every text is encoded as blank + text by a byte-level BPE (A) and by a piece BPE that adds the blank itself (B). Byte
offsets where tokens of both end cut the text into groups; an A and a B token are linked when their bytes share a group.
The count of an id pair is the number of documents that hold it linked.

1. First pass: texts are aligned and the pairs of each document counted once, in each task. A task's counts come out as
   (pair, n), so equal pairs of a task meet before the shuffle.
2. The distinct pairs are dealt to shards by hash (about ``SHARD`` pairs each, whatever the corpus) and each shard gets a
   minimal perfect hash: on every level a pair whose bit place is its own sets that bit, the others go to the next
   level, and the rank of its bit is the slot of a pair. The keys are stored by slot, so every lookup is verified.
3. Dense count vectors, one for each shard and run of tasks, are filled by slot and summed in a tree of ``FAN``.
4. Second pass: texts are aligned again and counts looked up in a perfect hash over the commonest pairs, which is
   broadcast and holds at most ``table`` pairs. Links of rarer pairs leave the pass as short lists and meet their counts
   in a shuffle join, so neither memory nor result depends on how many pairs there are.

Texts are cut at single blanks between words, where both tokenizers always cut, so a word is encoded and aligned once for
each cache (``CACHE`` words) of a Python worker. Both vocabularies are checked for that when they are loaded.

Defined results: texts that are null or empty, or that either tokenizer does not give back byte by byte (such as those
with U+2581), have no tokens: zeros and ''. Repeated rows are documents of their own and count as such; a null doc_id
is kept; ties for an A id's highest count are all best; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import freeze

TOKENIZERS = "/opt/tokenizers"
SHARD = 1 << 15
FAN = 16
TABLE = 1 << 21
CACHE = 3 << 16
CACHE_CHARS = 1 << 25
PAIRS = 1 << 20
SLICE = 2 << 20
RUN = 1 << 20
CHUNK, RUN_WORDS = 1 << 16, 400
LONG_BLANK = re.compile(r"\s{500}")
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Fixed value: how the byte-level tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Pair:
    """Encoders of both tokenizers (A of a text that begins with the blank, B of texts to which it adds one), and the bytes of every id."""

    a_bytes: list[bytes]
    b_bytes: list[bytes]
    encode_a: object
    encode_b: object

    @property
    def a_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.a_bytes], dtype=np.int64)

    @property
    def b_sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.b_bytes], dtype=np.int64)


@lru_cache(maxsize=2)
def merging(path: str):
    """A byte-level BPE by its merges; slower on words than ``ranked`` below, which is used where it can be."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def tokenizers(folder: str = TOKENIZERS, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    import tiktoken

    with open(f"{folder}/{a}") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    vocab = {bytes(map(alphabet.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if v not in special}
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for k, v in vocab.items():
        a_bytes[v] = k
    # ids of a byte-level BPE are the ranks of its merges, and a rank encoder is several times faster on words
    ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode_a(text: str) -> list[int]:
        # long runs of white space overflow the rank encoder's stack
        return merging(f"{folder}/{a}").encode_batch_fast([text], add_special_tokens=False)[0].ids if LONG_BLANK.search(text) else ranked.encode_ordinary(text)

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b}")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("a piece goes over the end of a word")
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Pair(a_bytes, b_bytes, encode_a, lambda texts: model.encode(texts, num_threads=1))


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the group of each A and each B token, and where the groups end."""
    mark = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, dtype=bool)
    mark[b_ends] = True
    joint = a_ends[mark[a_ends]]
    return np.searchsorted(joint, a_ends), np.searchsorted(joint, b_ends), joint


def links_of(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int, most: int = 1 << 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links; tokens of large groups are folded by id before they are paired."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    large = np.flatnonzero(na * nb > most)
    small = ~np.isin(ga, large)
    firsts = np.cumsum(nb) - nb
    times = nb[ga[small]]
    left = np.repeat(np.flatnonzero(small), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(firsts[ga[small]], times)
    group, pair, mult = [ga[left]], [a[left] << 32 | b[right]], [np.ones(len(left), dtype=np.int64)]
    for g in large.tolist():
        ua, ca = np.unique(a[ga == g], return_counts=True)
        ub, cb = np.unique(b[gb == g], return_counts=True)
        pair.append((ua[:, None] << 32 | ub[None]).ravel())
        mult.append((ca[:, None] * cb[None]).ravel())
        group.append(np.full(len(pair[-1]), g))
    return np.concatenate(group), np.concatenate(pair), np.concatenate(mult)


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Words:
    """Words met so far: their tokens, groups and links, each found once. A word stands for blank + word."""

    def __init__(self, tok: Pair, printed: bool):
        self.tok, self.printed = tok, printed
        self.sizes = tok.a_sizes, tok.b_sizes
        n = max(len(tok.a_bytes), len(tok.b_bytes))
        #: an id as text with the mark that follows it
        self.named = [b"%d%s" % (i, m) for m in (b",", b"|", b";") for i in range(n)] if printed else []
        self.ids = n
        self.clear()

    def clear(self) -> None:
        self.index = Numbered()
        self.chars = 0
        self.stats = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.whole = np.zeros(0, dtype=bool)
        self.used = np.zeros(0, dtype=np.int64)
        self.text: list[bytes] = []
        self.begin = np.zeros(1, dtype=np.int64)
        self.known = Numbered()  # pairs
        self.pairs = np.zeros(0, dtype=np.int64)
        self.pair = np.zeros(0, dtype=np.int32)
        self.times = np.zeros(0, dtype=np.int64)

    def full(self) -> bool:
        return len(self.index) > CACHE or self.chars > CACHE_CHARS

    def crowded(self) -> bool:
        return len(self.known) > PAIRS

    def thin(self) -> np.ndarray:
        """Keeps the half of ``CACHE`` that was met most often, but no long words; returns their old numbers."""
        short = np.fromiter(map(len, self.index), dtype=np.int64, count=len(self.index)) < 256
        most = np.lexsort((-self.used, ~short))[: CACHE // 2]
        keep = np.sort(most[short[most] & (self.used[most] > 1)])
        link, size = self.links(keep), np.diff(self.begin)[keep]
        names = list(self.index)
        self.index = Numbered(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        self.chars = sum(map(len, self.index))
        self.stats, self.whole, self.used, self.pair, self.times = self.stats[keep], self.whole[keep], self.used[keep], self.pair[link], self.times[link]
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.text = [self.text[i] for i in keep.tolist()] if self.printed else []
        return keep

    def numbers(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the words of each run; new words are aligned together."""
        at = len(self.index)
        found = [np.fromiter(map(self.index.__getitem__, run), dtype=np.int32, count=len(run)) for run in runs]
        if len(self.index) > at:
            self.add(list(itertools.islice(self.index, at, None)))
        if found:
            self.used += np.bincount(np.concatenate(found), minlength=len(self.used))
        return found

    def add(self, words: list[str]) -> None:
        chunks, size = [[]], 0
        for w in words:
            size += len(w)
            if size > CHUNK and chunks[-1]:
                chunks.append([])
                size = len(w)
            chunks[-1].append(w)
            if w[-1].isspace():  # the end of a text, whose blank would join the next word's
                size = CHUNK
        parts = [p for c in chunks if c for p in self.aligned(c)]
        stats, whole, per, pair, times, text = zip(*parts, strict=True)
        fresh = np.concatenate(pair)
        kinds, kind = np.unique(fresh, return_inverse=True)
        local = np.fromiter(map(self.known.__getitem__, kinds.tolist()), dtype=np.int32, count=len(kinds))
        self.pairs = np.fromiter(self.known, dtype=np.int64, count=len(self.known))
        self.chars += sum(map(len, words))
        self.stats = np.concatenate([self.stats, *stats])
        self.whole = np.concatenate([self.whole, *whole])
        self.used = np.concatenate([self.used, np.zeros(len(words), dtype=np.int64)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(per))])
        self.pair = np.concatenate([self.pair, local[kind]])
        self.times = np.concatenate([self.times, *times])
        for t in text:
            self.text += t

    def aligned(self, words: list[str]) -> list[tuple]:
        """(stats, whole, links of each word, pair, times, text) of words that lie end to end."""
        # the piece encoder is quickest on short texts
        runs = [" ".join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)]
        joined = " " + " ".join(runs)
        raw = joined.encode()
        ids = self.tok.encode_a(joined), list(itertools.chain.from_iterable(self.tok.encode_b(runs)))
        if any(b"".join(map(names.__getitem__, x)) != raw for names, x in zip((self.tok.a_bytes, self.tok.b_bytes), ids, strict=True)):
            if len(words) > 1:
                half = len(words) // 2
                return self.aligned(words[:half]) + self.aligned(words[half:])
            none = np.zeros(0, dtype=np.int64)
            return [(np.zeros((1, 4), dtype=np.int64), np.zeros(1, dtype=bool), np.zeros(1, dtype=np.int64), none, none, [b""])]
        a, b = (np.array(x, dtype=np.int64) for x in ids)
        ga, gb, joint = groups_of(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        n, groups = len(words), len(joint)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), dtype=np.int64, count=n))
        word = np.searchsorted(ends, joint)
        if not np.array_equal(joint[np.searchsorted(joint, ends)], ends):
            raise RuntimeError("a token goes over the end of a word")
        group, pair, times = links_of(a, ga, b, gb, groups)
        owner = word[group]
        order = np.argsort(owner, kind="stable") if (owner[1:] < owner[:-1]).any() else slice(None)
        n_links = np.bincount(owner, weights=times, minlength=n).astype(np.int64)
        stats = np.stack([np.bincount(word[ga], minlength=n), np.bincount(word[gb], minlength=n), np.bincount(word, minlength=n), n_links], axis=1)
        text = self.texts(a, ga, b, gb, word, n) if self.printed else []
        return [(stats, np.ones(n, dtype=bool), np.bincount(owner, minlength=n), pair[order], times[order], text)]

    def texts(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of each word: the A ids of a group before its B ids."""
        last = [np.append(g[1:] != g[:-1], True) for g in (ga, gb)]
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        name = np.concatenate([a + self.ids * last[0], b + 2 * self.ids * last[1]])[order]
        mine = np.concatenate([word[ga], word[gb]])[order]
        named = [self.named[i] for i in name.tolist()]
        ends = np.cumsum(np.bincount(mine, minlength=n)).tolist()
        return [b"".join(named[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def links(self, words: np.ndarray) -> np.ndarray:
        """Positions among the links of all links of the given words."""
        first = self.begin[words]
        size = self.begin[words + 1] - first
        return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=1)
def known_words(folder: str, printed: bool) -> Words:
    """The words of this Python worker: tasks one after the other go on with them."""
    return Words(tokenizers(folder), printed)


def word_runs(text: str) -> Iterator[list[str]]:
    """The words of a text, in runs of about ``RUN`` characters that end at cuts."""
    at = 0
    while len(text) - at > RUN:
        cut = CUT.search(text, at + RUN)
        if cut is None:
            break
        yield CUT.split(text[at : cut.start()])
        at = cut.end()
    yield CUT.split(text[at:] if at else text)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        turn = np.cumsum(size, dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(i, j - i)


def _documents(texts: list[bytes | None], words: Words) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the text, its words in runs) of every text that has any; bytes that are not UTF-8 never come back, so
    they count as a text that does not. New words are aligned together, about ``SLICE`` characters of text at a time."""
    waiting, held = [], 0

    def flush() -> Iterator[tuple[int, list[np.ndarray]]]:
        found = iter(words.numbers([run for _, runs in waiting for run in runs]))
        for d, runs in waiting:
            yield d, [next(found) for _ in runs]
        waiting.clear()

    for d, raw in enumerate(texts):
        try:
            text = raw.decode() if raw else ""
        except UnicodeDecodeError:
            text = "▁"
        if text:
            waiting.append((d, list(word_runs(text))))
            held += len(text)
        if held > SLICE:
            yield from flush()
            held = 0
    yield from flush()


def _counted(folder: str):
    """First pass: (part, pair, n), n documents of a run of a task that hold the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(folder, False)
        part = TaskContext.get().partitionId()
        counts = stamp = np.zeros(0, dtype=np.int64)

        def counted() -> pa.RecordBatch:
            on = np.flatnonzero(counts)
            return pa.record_batch([pa.array(np.full(len(on), part, dtype=np.int32)), pa.array(words.pairs[on]), pa.array(counts[on])], names=["part", "pair", "n"])

        for batch in _slices(batches):
            for _, runs in _documents(batch.column("text").to_pylist(), words):
                if len(counts) < len(words.pairs):
                    counts = np.concatenate([counts, np.zeros(len(words.pairs) - len(counts), dtype=np.int64)])
                    stamp = np.zeros(len(counts), dtype=np.int64)
                if not all(words.whole[w].all() for w in runs):
                    continue
                held = [words.pair[words.links(w)] for w in runs]
                pair = np.concatenate(held) if len(held) > 1 else held[0]
                # of equal pairs only the one that stamped last counts
                place = np.arange(len(pair))
                stamp[pair] = place
                counts[pair[stamp[pair] == place]] += 1
            if words.crowded():
                yield counted()
                words.clear()
                counts = stamp = np.zeros(0, dtype=np.int64)
            elif words.full():
                words.thin()
        yield counted()

    return run


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit values for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits in 64-bit words, words of each level) of a minimal perfect hash of distinct keys."""
    words, sizes, left = [], [], keys
    while len(left):
        size = -(-2 * len(left) // 64)
        place = (mix(left, len(sizes)) % np.uint64(64 * size)).astype(np.int64)
        alone = np.bincount(place, minlength=64 * size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[place]]
    return np.concatenate(words) if words else np.zeros(0, dtype="<u8"), np.array(sizes, dtype=np.int32)


class PerfectHash:
    """Slots of pairs over several shards end to end: shard, then the first level whose bit is set, then its rank."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray]]):
        levels = max((len(s) for _, s in shards), default=0)
        self.size = np.zeros((len(shards), levels), dtype=np.int64)
        for i, (_, s) in enumerate(shards):
            self.size[i, : len(s)] = s
        flat = self.size.ravel()
        self.first = (np.cumsum(flat) - flat).reshape(self.size.shape)
        self.bits = np.concatenate([w for w, _ in shards]) if shards else np.zeros(0, dtype="<u8")
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.rank = np.cumsum(ones) - ones

    def slots(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it; keys that were never added may get any slot."""
        out = np.full(len(keys), -1, dtype=np.int64)
        live = np.arange(len(keys))
        for level in range(self.size.shape[1]):
            live = live[self.size[shard[live], level] > 0]
            place = (mix(keys[live], level) % (64 * self.size[shard[live], level]).astype(np.uint64)).astype(np.int64)
            word, bit = self.first[shard[live], level] + (place >> 6), (place & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = self.rank[word[hit]] + np.bitwise_count(below)
            live = live[~hit]
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys, 1 << 20) % np.uint64(shards)).astype(np.int64)


def _shard(pair: str, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(pairs: pd.Series) -> pd.Series:
        return pd.Series(shard_of(pairs.to_numpy(), shards).astype(np.int32))

    return of(pair)


def _hashed(values: bool):
    """(shard, keys by slot, bits, level sizes and, if asked for, values by slot) of each shard."""

    def run(group: pa.Table) -> pa.Table:
        keys = group["pair"].to_numpy()
        bits, sizes = build_hash(keys)
        slots = PerfectHash([(bits, sizes)]).slots(keys, np.zeros(len(keys), dtype=np.int64))
        by_slot = np.zeros_like(keys)
        by_slot[slots] = keys
        cols = {"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "keys": pa.array([by_slot.tobytes()]), "bits": pa.array([bits.tobytes()]), "sizes": pa.array([sizes.tobytes()])}
        if values:
            held = np.zeros_like(keys)
            held[slots] = group["value"].to_numpy()
            cols["held"] = pa.array([held.tobytes()])
        return pa.table(cols)

    return run


def perfect_hash(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, bits, sizes[, held]) of ``pairs(pair[, value])`` with distinct pairs, one row a shard."""
    values = "value" in pairs.columns
    dealt = pairs.withColumn("shard", _shard("pair", shards))
    return dealt.groupBy("shard").applyInArrow(_hashed(values), f"shard int, keys binary, bits binary, sizes binary{', held binary' if values else ''}")


def _dense(counts: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense vector of a shard from the counts of a run of tasks, every key verified."""
    keys = counts["pair"].to_numpy()
    bits, sizes = (np.frombuffer(hashes[c][0].as_py(), dtype=t) for c, t in (("bits", "<u8"), ("sizes", "<i4")))
    known = np.frombuffer(hashes["keys"][0].as_py(), dtype="<i8")
    slots = PerfectHash([(bits, sizes)]).slots(keys, np.zeros(len(keys), dtype=np.int64))
    if (slots < 0).any() or (known[slots] != keys).any():
        raise RuntimeError("a pair of the counts is not in the hash")
    vector = np.zeros(len(known), dtype="<i8")
    np.add.at(vector, slots, counts["n"].to_numpy())
    return pa.table({"shard": hashes["shard"][:1], "node": hashes["node"][:1], "vector": pa.array([vector.tobytes()])})


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), dtype="<i8") for v in group["vector"])
    return pa.table({"shard": group["shard"][:1], "node": group["node"][:1], "vector": pa.array([total.tobytes()])})


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of whole shards."""
    for batch in batches:
        for keys, vector in zip(batch.column("keys").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(keys, dtype="<i8")), pa.array(np.frombuffer(vector, dtype="<i8"))], names=["pair", "n"])


def pair_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(pair, n, best): in how many of ``docs(text)`` each pair ``a << 32 | b`` is linked, and whether no pair of its A id
    is linked in more. Frozen."""
    read = docs.select(F.col("text").cast("binary").alias("text"))
    partial = freeze(read.mapInArrow(_counted(folder), "part int, pair long, n long"), "align-counts")
    keys = freeze(partial.select("pair").distinct(), "align-keys")
    shards = keys.count() // SHARD + 1
    hashes = freeze(perfect_hash(keys, shards), "align-hashes")
    dealt = partial.select(_shard("pair", shards).alias("shard"), F.expr(f"part div {FAN}").cast("int").alias("node"), "pair", "n")
    leaves = (partial.agg(F.max("part")).first()[0] or 0) // FAN + 1
    vector = "shard int, node int, vector binary"
    each = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("node"), "keys", "bits", "sizes")
    some = dealt.select("shard", "node").distinct()  # a run of tasks may have no pair of a shard
    each = each.join(some.hint("merge"), ["shard", "node"])
    tree = dealt.groupBy("shard", "node").cogroup(each.groupBy("shard", "node")).applyInArrow(_dense, vector)
    while leaves > 1:
        leaves = (leaves - 1) // FAN + 1
        tree = tree.withColumn("node", F.expr(f"node div {FAN}").cast("int")).groupBy("shard", "node").applyInArrow(_summed, vector)
    total = tree.select("shard", "vector").hint("merge").join(hashes.select("shard", "keys").hint("merge"), "shard").select("keys", "vector")
    counts = freeze(total.mapInArrow(_flat, "pair long, n long"), "align-pairs")
    a = F.shiftright("pair", 32)
    # one row for each id of a vocabulary, or fewer: a proven bound
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return freeze(counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-known")


def common_pairs(counts: DataFrame, table: int) -> tuple[DataFrame, int, bool]:
    """The commonest pairs, at most ``table`` of them, how many they are, and whether that is all."""
    power = F.floor(F.log2("n")).cast("int")
    held, taken, least = {r.p: r.k for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect()}, 0, None  # at most 64 rows
    for p in sorted(held, reverse=True):
        if taken + held[p] > table:
            break
        taken, least = taken + held[p], p
    chosen = counts.where(power >= F.lit(least)) if least is not None else counts.limit(0)
    return chosen, taken, taken == sum(held.values())


def _looked_up(folder: str, shared: Broadcast):
    """Second pass: the row of each document, links of pairs beyond the table left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        phf = PerfectHash([(np.frombuffer(b, dtype="<u8"), np.frombuffer(s, dtype="<i4")) for b, s in table["shards"]])
        keys, held = table["keys"], table["held"]
        words = known_words(folder, True)
        value, hit = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)  # of each pair
        sums, gaps = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=bool)  # count_sum and n_best of each word, and whether a pair is missing
        row = TaskContext.get().partitionId() << 40

        def look_up() -> None:
            nonlocal value, hit, sums, gaps
            pairs = words.pairs[len(value) :]
            slot = phf.slots(pairs, shard_of(pairs, max(1, len(table["shards"]))))
            found = slot >= 0
            found[found] = keys[slot[found]] == pairs[found]
            new = np.zeros(len(pairs), dtype=np.int64)
            new[found] = held[slot[found]]
            value, hit = np.concatenate([value, new]), np.concatenate([hit, found])
            first = words.begin[len(sums)]
            pair, times = words.pair[first:], words.times[first:]
            run = np.cumsum(np.stack([(value[pair] >> 1) * times, (value[pair] & 1) * times, ~hit[pair]], axis=1), axis=0)
            run = np.concatenate([np.zeros((1, 3), dtype=np.int64), run])
            each = run[words.begin[len(sums) + 1 :] - first] - run[words.begin[len(sums) : -1] - first]
            sums, gaps = np.concatenate([sums, each[:, :2]]), np.concatenate([gaps, each[:, 2] > 0])

        for batch in _slices(batches):
            texts = batch.column("text").to_pylist()
            n = len(texts)
            stats = np.zeros((n, 6), dtype=np.int64)
            digest, rest = [""] * n, [[] for _ in range(n)]
            for d, runs in _documents(texts, words):
                if len(sums) < len(words.whole):
                    look_up()
                if not all(words.whole[w].all() for w in runs):
                    continue
                hashed, left = hashlib.sha256(), []
                for k, w in enumerate(runs):
                    stats[d, :4] += words.stats[w].sum(axis=0)
                    stats[d, 4:] += sums[w].sum(axis=0)
                    text = b"".join(map(words.text.__getitem__, w.tolist()))
                    hashed.update(text if k < len(runs) - 1 else text[:-1])
                    if gaps[w].any():
                        link = words.links(w[gaps[w]])
                        link = link[~hit[words.pair[link]]]
                        left.append(np.stack([words.pairs[words.pair[link]], words.times[link]], axis=1))
                digest[d] = hashed.hexdigest()
                if left:
                    pairs, which = np.unique(np.concatenate(left)[:, 0], return_inverse=True)
                    times = np.bincount(which, weights=np.concatenate(left)[:, 1]).astype(np.int64)
                    rest[d] = [{"pair": p, "times": t} for p, t in zip(pairs.tolist(), times.tolist(), strict=True)]
            cols = [batch.column("doc_id"), *[pa.array(stats[:, i]) for i in range(6)], pa.array(digest, pa.string())]
            cols += [pa.array(np.arange(row, row + n)), pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))]
            row += n
            yield pa.record_batch(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "count_sum", "n_best", "groups_sha256", "row", "rest"])
            if words.crowded():
                words.clear()
                value, hit, sums, gaps = value[:0], hit[:0], sums[:0], gaps[:0]
            elif words.full():
                keep = words.thin()
                sums, gaps = sums[keep], gaps[keep]

    return run


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, folder: str = TOKENIZERS, table: int = TABLE) -> DataFrame:
    """Tokens, groups and links of every row of ``docs(doc_id, text)``, with the counts of its links over all rows."""
    spark = docs.sparkSession
    counts = pair_counts(docs, folder)
    chosen, n, whole = common_pairs(counts, table)
    value = (F.col("n") * 2 + F.col("best").cast("long")).alias("value")
    shards = n // SHARD + 1
    # at most ``table`` pairs of 16 bytes
    built = {r.shard: r for r in perfect_hash(chosen.select("pair", value), shards).collect()}
    at = [built.get(i) for i in range(shards)]
    parts = {c: np.concatenate([np.frombuffer(r[c], dtype="<i8") for r in at if r] or [np.zeros(0, dtype="<i8")]) for c in ("keys", "held")}
    shared = spark.sparkContext.broadcast(parts | {"shards": [(bytes(r.bits), bytes(r.sizes)) if r else (b"", b"") for r in at]})
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, count_sum long, n_best long, groups_sha256 string, row long, rest array<struct<pair: long, times: long>>"
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = read.mapInArrow(_looked_up(folder, shared), schema)
    if whole:
        return rows.select(*OUT)
    # the rarer pairs meet their counts in a shuffle; row numbers hold because the rows are written first
    rows = freeze(rows, "align-rows")
    left = rows.select("row", F.explode("rest").alias("x")).select("row", F.col("x.pair").alias("pair"), F.col("x.times").alias("times"))
    met = left.hint("merge").join(counts.hint("merge"), "pair")
    more = met.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("c"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"))
    out = rows.drop("rest").join(more.hint("merge"), "row", "left")
    out = out.withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0)))
    return out.select(*OUT)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
